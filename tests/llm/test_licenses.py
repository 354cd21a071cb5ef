import re

from tests.oracle import compare
from tidewright.llm import licenses, queries


def dice(a, b):
    return 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 0.0


def by_hand(text):
    text = (text or "").lower()
    found, units = {}, []
    for unit in [*text.split("\n"), text.replace("\n", " ")]:
        grams = licenses.bigrams(unit)
        best = max(((dice(licenses.bigrams(t), grams), -k) for k, (_, t) in enumerate(licenses.TEMPLATES)), default=(0, 0))
        if best[0] >= 0.8:
            found[tuple(grams)] = best
            units.append((*best, -float("inf")))
    words = licenses.words_of(text)
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        m = len(licenses.words_of(template))
        spots = {}
        for gram, spot in licenses.anchors(template):
            spots.setdefault(gram, []).append(spot)
        starts = {i - spot for i in range(len(words) - 1) for spot in spots.get(f"{words[i]} {words[i + 1]}", ())}
        for start in starts:
            d = dice(licenses.bigrams(template), licenses.bigrams(" ".join(words[max(start, 0) : start + m])))
            if d >= 0.8:
                units.append((d, -k, -max(start, 0)))
    if not units:
        return None, None, None, None, 0
    d, k, place = max(units)
    return licenses.TEMPLATES[-k][0], -k, d, None if place == -float("inf") else -place, len(found)


MIT = licenses.BODIES[0][1]
ODD = [None, "", "\n", "Licensed", "Released under the MIT License.", "released UNDER the mit licence", "Prose first.\n  * Licensed under CC BY-NC 4.0 *\nReleased under the MIT License!\nReleased under the MIT License.",
       "This work is licensed under the GNU General Public License, version 2 or 3.", "mit mit mit " * 20_000, "Released under\nthe MIT License", "Licensed under the Apache License, Version 2.0 (the License)", "é ü Licensed under the MIT License ß",
       "This software is released under the MIT License.", "This project is licensed under the MIT License.", "All text here is licensed under CC BY-NC 4.0.", "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0 (the License).",
       "prose " * 300 + MIT + " prose" * 5_000 + "\n" + MIT, "a line\n" * 50 + MIT.replace("merge,", "combine or join,").replace("tort", "wrong") + "\nand more" * 9, MIT[300:], "mit license " * 400,
       licenses.BODIES[5][1].replace("3. Neither", "4. Neither") + " Permission is hereby granted", "x " * 7 + licenses.BODIES[12][1].replace("version 2", "version 3")]


def test_by_hand(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(4, ODD[4], 2), (None, ODD[4], 2)], "doc_id long, text string, dice int")
    got = licenses.scanned(docs).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.license, r.template, r.dice, r.place, r.n_notices) == by_hand(r.text)


def test_pruning_loses_nothing():
    for size in range(1, 40):
        lo, hi = licenses._bounds(size, 80)
        for n in range(1, 200):
            reachable = 200 * min(n, size) >= 80 * (n + size)
            assert reachable == (lo <= n <= hi)


def test_anchors_lose_nothing():
    """A unit that has every bigram of a template but its anchors stays below the threshold, whatever its size."""
    for _, text in licenses.TEMPLATES:
        grams = licenses.bigrams(text)
        places = licenses.anchors(text)
        words = licenses.words_of(text)
        assert all(" ".join(words[i : i + 2]) == g for g, i in places)
        common = len(grams) - len({g for g, _ in places})
        assert max(200 * common / (len(grams) + b) for b in range(max(common, 1), 3 * len(grams))) < 80


def test_notices_in_running_text(spark):
    """Sentences, wrapped notices and a changed body within a long document are found where they stand."""
    apache = licenses.BODIES[9][1]
    want = [("This software is released under the MIT License.", "MIT", 3), ("This project is licensed under the MIT License.", "MIT", 3),
            ("intro text here. Licensed under\nthe Apache License, Version 2.0 (the License); you may not use", "Apache-2.0", 3),
            ("word " * 1_000 + apache.replace("you may not", "nobody may") + " word" * 90, "Apache-2.0", 1_000),
            ("word " * 40 + MIT + " word" * 90, "MIT", 40), ("licensed people under the general public roof " * 20, None, None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.place) for r in licenses.scanned(docs).collect()}
    assert got == {i: (name, place) for i, (_, name, place) in enumerate(want)}


def test_notices_of_the_table(spark):
    notice = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
              "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in queries.op9_licenses(spark, "/root/testdata/sf0.01").collect():
        names = {notice[x.strip()] for x in texts[r.doc_id].split("\n") if x.strip() in notice}
        assert (r.license in names) if names else not re.search("licensed under|released under", texts[r.doc_id].lower()) or r.license


def test_oracle(spark):
    assert not compare(spark, "/root/testdata/sf0.01", "op9_licenses", queries.op9_licenses, queries.ORACLES["op9_licenses"])[0]


def test_empty_table_and_plan(spark):
    out = licenses.scanned(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
