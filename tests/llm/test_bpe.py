import numpy as np
import public_tokenizers
import pytest

from tests.llm import brute
from tidewright.llm import bpe, queries

PATH = queries.RANKS
ODD = [None, "", " ", "  two  spaces", "tab\t then space", "end ", "line\n next", "\x1c sep", "don't we'll I'D", "ñandú été 北京 123,456",
       "a" * 5000, "\U0001f600 emoji", " lead", "x  y", "՘   z", "<|endoftext|>", "word " * 3000, "\r\n \x0b mix\x0c"]


def test_odd_texts_as_the_library_encodes_them(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(3, ODD[3], 0), (None, "no id here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    plain = brute.encoder(PATH)
    want = sorted(((i, plain.encode_ordinary(t or "")) for i, t, _ in rows), key=repr)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    for r in bpe.decode(encoded, PATH).collect():
        texts = {t or "" for i, t, _ in rows if i == r.doc_id}
        assert bytes(r.decoded).decode() in texts


def test_whole_table_round_trip(spark, sf_dir):
    plain = brute.encoder(PATH)
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op10_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(plain.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(ids.tobytes()))
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id].encode())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)).count() == 0


def test_each_distinct_word_is_sent_once_per_portion(spark):
    docs = spark.createDataFrame([(i, "same words again and again") for i in range(500)], "doc_id long, text string").coalesce(1)
    portion = docs.mapInArrow(bpe._cut(public_tokenizers.PATTERN, 8), bpe._PORTION_SQL).collect()
    assert len(portion) == 1
    assert sum(len(bpe._unzip(bytes(w.words))) for w in portion[0].words) == 4 + 0  # " again" twice


@pytest.mark.parametrize("text", ["a  b", "a \n b", "a b", " a", "a　 b"])
def test_pieces_equal_the_whole_text(text):
    pieces = bpe._Pieces(public_tokenizers.PATTERN)
    numbers = list(bpe.pre_tokens(text, pieces))
    words = list(pieces.words)
    for cut in bpe.splitters(public_tokenizers.PATTERN):
        assert [words[n] for n in numbers] == cut.findall(text)


def test_every_character_falls_in_the_library_s_class():
    """Each character beside a letter, a digit, a sign and blanks, against the library."""
    plain = brute.encoder(PATH)
    for start in range(0, 0x110000, 0x400):
        chars = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}\t " for c in chars)
        pieces = bpe._Pieces(public_tokenizers.PATTERN)
        numbers = list(bpe.pre_tokens(text, pieces))
        words = list(pieces.words)
        joined = [i for n in numbers for i in plain._encode_single_piece(words[n])]
        assert joined == plain.encode_ordinary(text)


def test_exchange_is_made_once_and_read_twice(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = bpe.encode(queries.table(spark, sf_dir, "documents"), PATH, public_tokenizers.PATTERN)
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
