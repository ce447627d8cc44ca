"""Two-level ordered operations against plain windows, with blocks of a few rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    # One key holds most of the rows; some blocks are empty and some values are null.
    data = []
    for i in range(400):
        key = 0 if rng.random() < 0.7 else rng.randrange(1, 5)
        data.append((key, i * rng.choice([1, 1, 7]) + i, i, rng.choice([None, rng.randrange(50)])))
    return spark.createDataFrame(data, "k INT, t BIGINT, id BIGINT, v INT").cache()


def same(left, right):
    a = sorted(map(tuple, left.collect()), key=repr)
    b = sorted(map(tuple, right.collect()), key=repr)
    assert a == b


def block():
    return ordered.id_block("t", 16)


ORDER = ["t", "id"]


def window():
    return Window.partitionBy("k").orderBy(*ORDER)


def test_numbered(rows):
    same(
        ordered.numbered(rows, ["k"], ORDER, block(), "n"),
        rows.withColumn("n", F.row_number().over(window()).cast("bigint")),
    )


def test_running_sums(rows):
    value = F.coalesce("v", F.lit(0)).cast("bigint")
    same(
        ordered.running_sums(rows, ["k"], ORDER, block(), {"s": value}),
        rows.withColumn("s", F.sum(value).over(window().rowsBetween(Window.unboundedPreceding, 0))),
    )


def test_previous(rows):
    same(
        ordered.previous(rows, ["k"], ORDER, block(), {"p": "v"}),
        rows.withColumn("p", F.lag("v").over(window())),
    )


@pytest.mark.parametrize("inclusive", [True, False])
def test_nearest_known(rows, inclusive):
    w = window()
    same(
        ordered.ordered_pass(
            rows,
            ["k"],
            ORDER,
            block(),
            before={"b": F.col("v")},
            after={"a": F.col("v")},
            include_current=inclusive,
        ),
        rows.withColumn(
            "b",
            F.last("v", True).over(
                w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            ),
        ).withColumn("a", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing))),
    )


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_exact_quantiles(rows, width):
    probabilities = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    got = ordered.exact_quantiles(rows, ["k"], "v", probabilities, width)
    want = rows.groupBy("k").agg(
        *[F.percentile("v", p).alias(n) for n, p in probabilities.items()]
    )
    rounded = lambda d: d.select("k", *[F.round(n, 9).alias(n) for n in probabilities])
    same(rounded(got), rounded(want))


def test_attach_keeps_every_row_once(rows):
    facts = rows.groupBy("k").agg(F.max("t").alias("top"))
    joined = ordered.attach(rows, facts, ["k"], F.col("id"), salts=5)
    same(joined.select(*rows.columns, "top"), rows.join(facts, "k").select(*rows.columns, "top"))


def test_earliest_and_latest(rows):
    first = ordered.earliest_rows(rows, ["k"], ORDER)
    last = ordered.latest_rows(rows, ["k"], ORDER)
    w = window()
    same(first, rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n"))
    back = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    same(last, rows.withColumn("n", F.row_number().over(back)).filter("n = 1").drop("n"))


def test_partition_count_does_not_matter(spark, rows):
    from loomframe.plans import registry

    folder = "/root/testdata/sf0.001"
    names = ["motion_stats", "exact_palette", "median_cut_palette", "history_fold", "smooth_tracks"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for count in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", count)
        results.append(
            [
                sorted(map(tuple, registry.QUERIES[n](spark, folder).collect()), key=repr)
                for n in names
            ]
        )
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_a_single_key_is_spread_over_tasks(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = spark.range(4000).withColumn("k", F.lit(1))
        done = ordered.numbered(one, ["k"], ["id"], ordered.id_block("id", 100), "n")
        parts = done.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()
        assert len(parts) > 1 and max(r.c for r in parts) < 4000
        assert done.filter(F.col("n") != F.col("id") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_attach_never_broadcasts_the_repeated_facts(spark):
    """A few facts are below any threshold; eight times as many would be held by the driver."""
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "id INT, k INT")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "k INT, v STRING")
    joined = ordered.attach(rows, facts, ["k"], F.col("id"))
    got = sorted((r.id, r.v) for r in joined.collect())
    assert got == [(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(50)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
