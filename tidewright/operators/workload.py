"""Repeatable workload rows: weighted actions, random picks, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.measures import seeded_fraction

# Action weights, order states, user range and amounts of the workload.
ACTIONS = (("query", 5), ("insert", 2), ("update", 3))
STATES = ("pending", "completed", "cancelled")
USERS = 100
AMOUNT_CENTS = (1000, 100_000)

# Words that mark a result message.
SUCCESS, FAILURE, AFFECTED = "成功", "失败", r"影响行数=(\d+)"


def weighted_choice(fraction: Column, weights) -> Column:
    """One of the named choices by weight, from a uniform number."""
    total = sum(w for _, w in weights)
    choice, below = None, 0
    for name, weight in weights[:-1]:
        below += weight
        test = fraction * total < below
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    return choice.otherwise(weights[-1][0])


def sequence_rows(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(rows).withColumnRenamed("id", "seq")


def workload_actions(rows: DataFrame, seed: int) -> DataFrame:
    """An action per ``seq``: kind, user, amount and state, all fixed by the seed."""

    def pick(salt: str) -> Column:
        return seeded_fraction(seed, F.lit(salt), F.col("seq"))

    low, high = AMOUNT_CENTS
    cents = F.floor(pick("amount") * (high - low) + 0.5) + low
    state = F.element_at(
        F.array(*[F.lit(s) for s in STATES]),
        (F.floor(pick("state") * len(STATES)) + 1).cast("int"),
    )
    return rows.select(
        "seq",
        weighted_choice(pick("action"), ACTIONS).alias("action"),
        (F.floor(pick("user") * USERS) + 1).alias("user_id"),
        (cents / 100).alias("amount"),
        state.alias("state"),
    )


def _draw(seed: int, id_col: str) -> Column:
    """A seeded total order over rows."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))
    return F.struct(F.md5(text).alias("draw"), F.col(id_col).alias("id"))


def random_pick(rows: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """One row per key, drawn by seed; combined on the map side, so hot keys are cheap."""
    rest = [c for c in rows.columns if c not in keys]
    drawn = F.min_by(F.struct(*rest), _draw(seed, id_col))
    return rows.groupBy(*keys).agg(drawn.alias("r")).select(*keys, "r.*")


def pick_and_change(
    rows: DataFrame, keys: list[str], id_col: str, match: Column, change: dict[str, Column], seed: int
) -> DataFrame:
    """Change one drawn matching row per key. Picks rejoin on the row id, which is never hot."""
    picks = rows.filter(match).groupBy(*keys).agg(F.min(_draw(seed, id_col)).alias("d"))
    marked = rows.join(picks.select(F.col("d.id").alias(id_col), F.lit(True).alias("_hit")), id_col, "left")
    hit = F.col("_hit").isNotNull()
    return marked.withColumns(
        {c: F.when(hit, new).otherwise(F.col(c)) for c, new in change.items()}
    ).drop("_hit")


def pick_and_remove(rows: DataFrame, keys: list[str], id_col: str, match: Column, seed: int) -> DataFrame:
    """Remove one drawn matching row per key."""
    picks = rows.filter(match).groupBy(*keys).agg(F.min(_draw(seed, id_col)).alias("d"))
    return rows.join(picks.select(F.col("d.id").alias(id_col)), id_col, "left_anti")


def run_summary(results: DataFrame, group: str, order: str, first: int = 10) -> DataFrame:
    """Successes, failures, affected rows, elapsed seconds and the first failures per run.

    ``results`` has ``message`` and ``ts``. Only the first failures are gathered: sorted
    aggregation over a bounded window keeps the rest on the map side.
    """
    message = F.col("message")
    ok = F.count_if(message.contains(SUCCESS))
    micros = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
    totals = results.groupBy(group).agg(
        F.count("*").alias("total"),
        ok.alias("successes"),
        (F.count("*") - ok).alias("failures"),
        F.coalesce(F.sum(F.regexp_extract(message, AFFECTED, 1).try_cast("bigint")), F.lit(0)).alias("affected"),
        F.round(micros.cast("decimal(20,0)") / 1000000, 2).cast("double").alias("elapsed"),
    )
    failed = first_rows(results.filter(message.contains(FAILURE)), group, order, first)
    listed = failed.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, "message"))), lambda r: r["message"]), "; "
        ).alias("first_failures")
    )
    return totals.join(listed, group, "left")


def first_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows per group. Spark cuts each partition to ``n`` before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
