import numpy as np

from tidewright.llm import language, queries

WORDS = {"aa": ["kaba", "raka", "naka", "baka"], "bb": ["miti", "liri", "titi", "nimi"], "cc": ["ögö", "ümü", "rölö", "güfü"]}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(rng.choice(WORDS[lang], rng.integers(3, 60))), lang))
    return rows


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain(model, text):
    """Mean probabilities over the bytes of one text, byte by byte."""
    total, data = 0, text.encode()
    for at in range(0, len(data), language.STRETCH):
        part, states = data[at : at + language.STRETCH], []
        for d, read in enumerate((part, part[::-1])):
            h, found = np.zeros(language.STATE), []
            for byte in read:
                z, r = (sigmoid(model.into[d, byte, g] + h @ model.back[d, g]) for g in (0, 1))
                new = np.tanh(model.into[d, byte, 2] + r * (h @ model.back[d, 2]))
                h = new + z * (h - new)
                found.append(h)
            states.append(found if d == 0 else found[::-1])
        for a, b in zip(*states):
            score = np.exp(a @ model.out[0] + b @ model.out[1] + model.bias)
            total = total + score / score.sum()
    return total / len(data)


def test_derivatives_are_differences_of_the_loss():
    rows = corpus(24, 1)
    symbols, owner = language._stretches([t.encode() for _, t, _ in rows], 40)
    truth = np.array([["aa", "bb", "cc"].index(lang) for _, _, lang in rows])[owner]
    model = language._fresh(["aa", "bb", "cc"], np.random.default_rng(2))
    _, found = language.gradients(model, symbols, truth)
    for name, grad in found.items():
        weights = getattr(model, name)
        for at in map(tuple, np.argwhere(np.abs(grad) > np.abs(grad).max() * 0.7)[:5]):
            old, loss = weights[at], []
            for step in (0.01, -0.01):
                weights[at] = old + step
                loss.append(language.gradients(model, symbols, truth)[0])
            weights[at] = old
            assert abs((loss[0] - loss[1]) / 0.02 - grad[at]) < 0.03 * abs(grad[at]) + 1e-5


def test_held_out_texts_of_three_alphabets(spark):
    rows = corpus(300, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter("doc_id < 200"))
    out = language.predicted(docs.filter("doc_id >= 200"), model).collect()
    assert all(r.lang_pred == r.lang for r in out)
    for r in out[:10]:
        assert abs(r.score - plain(model, r.text).max()) < 1e-4


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score int"
    docs = spark.createDataFrame([(*r, 1) for r in corpus(120, 4)], schema)
    odd = [(None, "kaba raka", None, 1), (1, None, "aa", 1), (2, "", "aa", 1), (3, "123 ... \n", "bb", 1), (4, "titi " * 400_000, None, 1), (4, "titi " * 400_000, None, 1)]
    model = language.train(docs.union(spark.createDataFrame(odd, schema)))
    assert model.languages == ["aa", "bb", "cc"]
    out = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in language.predicted(spark.createDataFrame(odd, schema), model).collect())
    assert [x[1] for x in out] == ["aa", "und", "und", "und", "bb", "bb"] and out[4] == out[5] and out[1][2] == 0
    assert language.predicted(docs.limit(0), model).count() == 0
    none = language.train(docs.filter("false"))
    assert {(r.lang_pred, r.score) for r in language.predicted(docs, none).collect()} == {("und", 0.0)}


def test_a_hot_id_is_one_document(spark):
    rows = corpus(90, 5)
    docs = spark.createDataFrame(rows + [rows[0]] * 45, "doc_id long, text string, lang string")
    once = language.train(docs.dropDuplicates())
    assert np.array_equal(once.into, language.train(docs).into)


def test_held_out_documents_of_the_table(spark):
    out = queries.op12_language(spark, "/root/testdata/sf0.1")
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang")
    held = out.filter("held_out").join(docs, "doc_id").filter("lang IS NOT NULL AND lang_pred != 'und'").toPandas()
    assert len(held) > 1500 and (held.lang == held.lang_pred).mean() > 0.99
