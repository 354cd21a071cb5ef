"""The segmented helpers against plain windows, with one key holding most of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewright.functions import ordered
from tidewright.functions.ordered import latest_per_key, numbered, with_last, with_previous


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds about half of 3,000 rows, the others a few each; positions have gaps."""
    return spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") * 3).alias("pos"),
        F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"),
    ).repartition(7)


@pytest.mark.parametrize("group", [2, 1024])
@pytest.mark.parametrize("width", [1, 64, 1000])
def test_with_previous_equals_lag(skewed, width, group, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP", group)
    got = with_previous(
        skewed, ["k"], ["pos"], {"pv": "v", "pp": "pos"}, F.floor(F.col("pos") / width)
    )
    w = Window.partitionBy("k").orderBy("pos")
    want = skewed.withColumn("pv", F.lag("v").over(w)).withColumn("pp", F.lag("pos").over(w))
    cols = ["k", "pos", "v", "pv", "pp"]
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("group", [2, 1024])
@pytest.mark.parametrize("width", [1, 64, 1000])
@pytest.mark.parametrize("descending", [False, True])
def test_with_last_equals_last_value(skewed, width, group, descending, monkeypatch):
    """A value every 200 rows or so, so most segments have none and some keys never get one."""
    monkeypatch.setattr(ordered, "GROUP", group)
    rare = F.when(F.xxhash64("pos") % 200 == 0, F.struct("pos"))
    got = with_last(skewed, ["k"], ["pos"], {"m": rare, "n": F.col("v")}, F.floor(F.col("pos") / width), descending)
    w = Window.partitionBy("k").orderBy(F.col("pos").desc() if descending else F.col("pos")).rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("m", F.last(rare, True).over(w)).withColumn("n", F.last("v", True).over(w))
    assert rows(got, "k", "pos", "v", "m", "n") == rows(want, "k", "pos", "v", "m", "n")


@pytest.mark.parametrize("width", [1, 64, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_numbered_equals_row_number(skewed, width, descending, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP", 8)
    seg = F.floor(F.col("pos") / width)
    got = numbered(skewed, ["k"], ["pos"], seg, "rn", descending, total="n")
    order = F.col("pos").desc() if descending else F.col("pos").asc()
    w = Window.partitionBy("k").orderBy(order)
    want = skewed.withColumn("rn", F.row_number().over(w)).withColumn(
        "n", F.count("*").over(Window.partitionBy("k"))
    )
    cols = ["k", "pos", "rn", "n"]
    assert rows(got, *cols) == rows(want, *cols)


def test_numbered_over_everything(skewed):
    got = numbered(skewed, [], ["pos"], F.floor(F.col("pos") / 100), "rn")
    assert rows(got, "pos", "rn") == sorted(((i * 3, i + 1) for i in range(3000)), key=repr)


def test_latest_per_key(skewed):
    w = Window.partitionBy("k").orderBy(F.col("pos").desc())
    want = skewed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    got = latest_per_key(skewed, ["k"], ["pos"])
    assert rows(got, "k", "pos", "v") == rows(want, "k", "pos", "v")


def test_null_keys_and_segments_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 5), ("a", 900)], "k string, pos int")
    got = numbered(df, ["k"], ["pos"], F.floor(F.col("pos") / 4), "rn", total="n")
    want = [(None, 1, 1, 2), (None, 2, 2, 2), ("a", None, 1, 3), ("a", 5, 2, 3), ("a", 900, 3, 3)]
    assert rows(got, "k", "pos", "rn", "n") == sorted(want, key=repr)
    before = with_previous(df, ["k"], ["pos"], {"p": "pos"}, F.floor(F.col("pos") / 4))
    assert rows(before, "k", "pos", "p") == sorted([(None, 1, None), (None, 2, 1), ("a", None, None), ("a", 5, None), ("a", 900, 5)], key=repr)


def test_no_single_task_over_segments(spark):
    """Without keys only the rows of groups, one for GROUP segments, meet in one task."""
    flat = spark.range(3000).select(F.col("id").alias("pos"))
    plan = numbered(flat, [], ["pos"], F.floor(F.col("pos") / 2), "rn")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1
