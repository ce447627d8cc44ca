"""Ordered operations over keys of any size.

A plain window over a key puts the whole key into one task. Every function here
works on two levels instead: rows are windowed inside ``(key, block)``, where the
block is a coarse bucket of the order column, and one summary row per block is
windowed over the key. A key that holds a third of all rows is therefore spread over
as many tasks as it has blocks, and only block summaries meet in one place.

``block`` must not decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BLOCK = 1 << 16
_BLOCK = "_block"


def id_block(name: str, width: int = ID_BLOCK) -> Column:
    """Block of a numeric order column."""
    return F.floor(F.col(name) / F.lit(width)).cast("bigint")


def time_block(name: str, seconds: int = 300) -> Column:
    """Block of a timestamp order column.

    Short blocks spread a busy key over more tasks; a quiet key just has fewer of them.
    """
    return F.floor(F.unix_micros(F.col(name).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast(
        "bigint"
    )


def _local_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, _BLOCK).orderBy(*order)


def _before(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )


def ordered_pass(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Running sums and nearest known values per key, all in one pass.

    ``sums`` are inclusive. ``before`` gives the latest non-null value up to the row
    (with the row itself when ``include_current`` is set), ``after`` the earliest one
    behind it. However many are asked for, the rows are shuffled once and joined once to
    the summaries of their blocks.
    """
    sums, before, after = sums or {}, before or {}, after or {}
    known = {**before, **after}
    blocked = df.withColumn(_BLOCK, block).withColumns(
        {f"_v_{n}": c for n, c in {**sums, **known}.items()}
    )
    window = _local_window(keys, order)
    until = window.rowsBetween(Window.unboundedPreceding, 0)
    past = until if include_current else window.rowsBetween(Window.unboundedPreceding, -1)
    future = window.rowsBetween(1, Window.unboundedFollowing)
    local = blocked.withColumns(
        {
            **{f"_l_{n}": F.sum(f"_v_{n}").over(until) for n in sums},
            **{f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(past) for n in before},
            **{f"_l_{n}": F.first(f"_v_{n}", ignorenulls=True).over(future) for n in after},
        }
    )
    seen = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))
    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", seen(n)).alias(f"_t_{n}") for n in before],
        *[F.min_by(f"_v_{n}", seen(n)).alias(f"_t_{n}") for n in after],
    )
    by_block = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    later = by_block.rowsBetween(1, Window.unboundedFollowing)
    carried = totals.select(
        *keys,
        _BLOCK,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in before],
        *[F.first(f"_t_{n}", ignorenulls=True).over(later).alias(f"_c_{n}") for n in after],
    )
    joined = local.join(carried, [*keys, _BLOCK], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in known],
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``sums`` per key."""
    return ordered_pass(df, keys, order, block, sums=sums)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str = "row_no",
) -> DataFrame:
    """Add a 1-based position per key."""
    return running_sums(df, keys, order, block, {name: F.lit(1).cast("bigint")})


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    columns: Mapping[str, str],
) -> DataFrame:
    """Add the value that each source column had in the row before, per key."""
    blocked = df.withColumn(_BLOCK, block)
    window = _local_window(keys, order)
    payload = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    local = blocked.withColumn("_prev", F.lag(payload).over(window)).withColumn(
        "_first", F.row_number().over(window) == 1
    )
    tails = blocked.groupBy(*keys, _BLOCK).agg(
        F.max_by(payload, F.struct(*order)).alias("_tail")
    )
    edge = tails.select(
        *keys,
        _BLOCK,
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy(_BLOCK)).alias("_edge"),
    )
    joined = local.join(edge, [*keys, _BLOCK], "left").withColumn(
        "_prev", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_prev"))
    )
    return joined.select(*df.columns, *[F.col(f"_prev.{out}").alias(out) for out in columns])


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    columns: Mapping[str, Column],
    include_current: bool = True,
) -> DataFrame:
    """Add the latest non-null value of each expression up to the row, per key."""
    return ordered_pass(
        df, keys, order, block, before=columns, include_current=include_current
    )


def earliest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    bucket_width: float,
    mean: str | None = None,
    largest: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, null values ignored.

    Equal values are counted together first, then ranked inside value buckets, so a
    key with many rows is never gathered in one place. The mean and the maximum can be
    had from the same counts.
    """
    bucket = "_bucket"
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count("*").alias("_n"))
        .withColumn(bucket, F.floor(F.col("_value") / F.lit(bucket_width)))
    )
    totals = counts.groupBy(*keys, bucket).agg(F.sum("_n").alias("_t"))
    by_key = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        bucket,
        F.coalesce(
            F.sum("_t").over(
                by_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_o"),
        F.sum("_t").over(by_key).alias("_all"),
    )
    local = counts.withColumn(
        "_c",
        F.sum("_n").over(
            Window.partitionBy(*keys, bucket)
            .orderBy("_value")
            .rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    ranked = local.join(offsets, [*keys, bucket]).withColumns(
        {"_hi": F.col("_o") + F.col("_c"), "_lo": F.col("_o") + F.col("_c") - F.col("_n")}
    )
    picks, outputs = [], []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_all") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("_all") - 1)
        for tag, rank in (("a", low), ("b", high)):
            inside = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
            picks.append(F.max(F.when(inside, F.col("_value"))).alias(f"_{tag}_{name}"))
        picks.append(F.max(position - low).alias(f"_f_{name}"))
        outputs.append(
            (
                F.col(f"_a_{name}")
                + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * F.col(f"_f_{name}")
            ).alias(name)
        )
    if mean is not None:
        picks.append((F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias(mean))
        outputs.append(F.col(mean))
    if largest is not None:
        picks.append(F.max("_value").alias(largest))
        outputs.append(F.col(largest))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outputs)


def attach(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: Column, salts: int = 8,
    how: str = "left",
) -> DataFrame:
    """Join a large table to one row per key without one task per hot key.

    Rows of a key are spread over ``salts`` by the ``spread`` expression and the
    narrow fact rows are repeated once per salt. Meant for facts much fewer than rows;
    adaptive execution splits what is still too large for one task. The facts are never
    broadcast: the planner's estimate does not count the repeats, so the driver would hold
    ``salts`` times what its threshold allows.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
