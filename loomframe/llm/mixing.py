"""Mixing sources to target weights.

Words are summed per source, each source gets a target, and its repetition rate is target
over size. A document is taken ``floor(rate)`` times plus once more with the probability
of the fraction, drawn from a digest of its id, so that a rerun takes the same copies.

Targets: the mix holds ``factor`` times all words. Sources in code point order (null last)
weigh ``weights`` in turn. No target exceeds ``most`` times its source; what is cut off is
shared anew by weight. That is the level at which every source gets the lesser of its
limit and its weight times the level, found by one sort of the sources instead of rounds.

Edge cases: null and empty texts have no words; a source without words has target and rate
0; documents of a null source are one source; a null id is replaced by a digest of the
text in the draw; repeated rows get equal draws; an empty table gives an empty mix. Columns
named like a new one are replaced by ``with_copies``; ``mix`` keeps any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import by_place, stored

# The word pattern and the mix asked for.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
FACTOR = 1.5
MOST = 2.0

#: Up to this many sources their facts are sent to every task; beyond it they are joined.
FEW_SOURCES = 10_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_rates(
    sized: DataFrame,
    size: str = "size",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    factor: float = FACTOR,
    most: float = MOST,
) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate``; one row per source.

    The windows run over one row per source, after the sums.
    """
    facts = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = facts.withColumn("_w", F.element_at(turn, (place % len(weights) + 1).cast("int")))
    limit = (F.col("source_size") * F.lit(most)).cast("double")
    weighed = weighed.withColumns({"_limit": limit, "_order": limit / F.col("_w")})
    by_limit = Window.orderBy("_order", F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mix = F.sum("source_size").over(everything) * F.lit(factor)
    left = mix - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", left / F.sum("_w").over(rest))
    level = F.max(F.when(F.col("_level") <= F.col("_order"), F.col("_level"))).over(everything)
    shared = F.coalesce(F.least("_limit", level * F.col("_w")), F.col("_limit"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    return (
        levels.withColumn("target", shared)
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def draw(doc_id: str, text: str | None = None, seed: int = 0) -> Column:
    """A number in [0, 1) from 48 bits of a digest of the id."""
    key = F.col(doc_id).cast("string")
    if text is not None:
        key = F.coalesce(key, F.md5(F.col(text)))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def with_copies(
    docs: DataFrame, rates: DataFrame, unit: Column, source: str = "source"
) -> DataFrame:
    """Add the facts of each document's source and the number of times it is taken.

    ``rates`` must be read from storage: its rows are counted first. Documents stay where
    they are if there are few sources, else both sides are shuffled by source.
    """
    facts = rates.withColumnsRenamed({"source": "_source", "target": "_target", "rate": "_rate"})
    facts = facts.withColumnRenamed("source_size", "_source_size")
    if rates.count() <= FEW_SOURCES:
        facts = F.broadcast(facts)
    joined = docs.join(facts, docs[source].eqNullSafe(facts["_source"]), "left").drop("_source")
    whole = F.floor("_rate")
    extra = (unit < F.col("_rate") - whole).cast("bigint")
    return joined.withColumn("_copies", whole + extra)


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = 0,
) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with."""
    names = docs.columns
    given = by_place(docs, names)
    text, source, doc_id = (f"c{names.index(c)}" for c in (text, source, doc_id))
    sized = given.select(F.col(source).alias("source"), words(text).alias("size"))
    rates = stored(source_rates(sized), "rates")
    taken = with_copies(given, rates, draw(doc_id, text, seed), source)
    again = taken.withColumn("_again", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return again.select(*given.columns).toDF(*names)
