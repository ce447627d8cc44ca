"""Prefix trie of conversations by union-find over sorted neighbours.

Every conversation is a sequence of turns (role, text). The sequences are sorted, and the
edge between two sorted neighbours has the length of their longest common prefix. Edges are
taken in descending depth; each one merges two components of a union-find, and every merge
opens (or widens) the branching node at that depth, so a node's members, leaves and savings
are sums over components. Sorted conversations are cut into parts of bounded size. A part
merges all edges that nothing outside of it can precede, emits the nodes closed by that, and
leaves a contracted forest: the components on its left and right rim. Contracted forests of
neighbouring parts are merged by the same function, level by level, until one component, the
root, is left. Chains of nodes with one child are written out at the end from the turns of
their smallest member.

Long conversations are cut into blocks of ``BLOCK`` turns. Equal blocks get the same number,
numbers follow the order of the blocks, and a conversation is sorted by its block numbers, so
that no task holds more than one number per block of it. Equal conversations are one
component with a count. The hash of the members that end at a node is sequential by its
definition; one task reads them in order, joined beforehand in ranges of ids.

Edge cases: the family of a negative id is cut towards zero; a null role or text is empty; turns are in order of their number, null first,
equal numbers by role and then by a digest of the text; a repeated turn is a turn of its own; rows with a null ``conv_id`` belong to no
conversation and are left out; a table without conversations has no node, not even the root;
of extra columns nothing is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import stored
from loomframe.operators.ordered import attach, id_block, previous

#: Turns of a block of a conversation.
BLOCK = 1024
#: Sorted conversations of a part of the union-find, and contracted forests merged together.
PART = 4096
FAN = 64
#: Range of ids whose members are joined before they are hashed.
ENDS = 4096
#: A conversation whose number this divides lends its first turns to those up to the next one.
FAMILY = 100
#: Shared turns are fewer than this.
SHARED = 6


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def _placed(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``digest`` and ``chars`` of every turn.

    Rows are dealt out in ranges of the order itself, so one conversation spans as many
    tasks as it fills; only its count per task is needed to go on numbering.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
        # Rows alike in all else are interchangeable; this lets them span several ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("tie")]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            start = np.repeat(first, np.diff(np.r_[first, len(ids)]))
            local = np.arange(len(ids)) - start + 1
            if ids[0] == last:
                local[start == 0] += seen
            last, seen = ids[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local, pa.int64()), pa.array(np.full(len(ids), part), pa.int64())],
                ["conv_id", "digest", "chars", "local", "part"],
            )

    numbered = stored(
        dealt.select("conv_id", "digest", "chars").mapInArrow(
            number, "conv_id bigint, digest string, chars bigint, local bigint, part bigint"
        ),
        "turns",
    )
    counts = numbered.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only a conversation that goes on from another range has an offset: one row a range at most.
    carried = counts.withColumn("offset", F.sum("n").over(before)).filter("offset > 0").drop("n")
    return numbered.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "chars"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``digest`` and ``chars`` of the rebuilt conversations.

    The first turns come from the first conversation of the family, the own ones follow.
    Each conversation also has a row with ``pos`` 0 and no digest, so that those without
    turns are known.
    """
    placed = stored(
        _placed(turns).withColumns(
            {"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id"))}
        ),
        "placed",
    )
    lent = (
        placed.filter((F.col("conv_id") == F.col("family")) & (F.col("pos") < SHARED))
        .groupBy("family")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("lent"))
    )
    rows = attach(placed, lent, ["family"], F.struct("conv_id", "pos"))
    none = F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")
    rows = rows.withColumn("lent", F.coalesce(F.slice("lent", 1, F.col("h").cast("int")), none))
    own = F.when(
        F.col("pos") > F.col("h"),
        F.array(F.struct((F.col("pos") - F.col("h") + F.size("lent")).alias("pos"), "digest", "chars")),
    )
    # The first turn also stands for the conversation: its marker and the turns lent to it.
    zero = F.lit(0).cast("bigint")
    marker = F.array(F.struct(zero.alias("pos"), F.lit(None).cast("string").alias("digest"), zero.alias("chars")))
    lead = F.when(F.col("pos") == 1, F.concat(marker, "lent"))
    every = F.concat(F.coalesce(own, none), F.coalesce(lead, none))
    return rows.select("conv_id", F.inline(every))


def _blocks(sequences: DataFrame, block: int) -> DataFrame:
    """Blocks of conversations: digests, characters before each turn, and a key of the content."""
    number = F.greatest(F.floor((F.col("pos") - 1) / F.lit(block)), F.lit(0)).cast("bigint")
    before = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("digest").isNotNull(), F.struct("pos", "digest", F.coalesce(F.col("_before"), F.lit(0)).alias("before"), "chars"))
    grouped = (
        sequences.withColumn("block", number)
        .withColumn("_before", F.sum("chars").over(before))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("chars").alias("chars"))
    )
    return stored(
        grouped.select(
            "conv_id",
            "block",
            F.col("turns.digest").alias("digests"),
            F.col("turns.before").alias("before"),
            "chars",
            F.size("turns").cast("bigint").alias("size"),
            F.md5(F.array_join("turns.digest", "")).alias("key"),
        ),
        "blocks",
    )


def _classes(blocks: DataFrame) -> DataFrame:
    """Equal conversations as one: smallest id, how many, and the hash of their ids."""
    content = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "key"))).alias("keys"))
    joined = (
        content.select("conv_id", F.md5(F.array_join("keys.key", "")).alias("content"))
        .groupBy("content", F.floor(F.col("conv_id") / F.lit(ENDS)).alias("range"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("content", "range", F.col("ids")[0].alias("first"), F.size("ids").cast("bigint").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )
    ordered = joined.repartition("content").sortWithinPartitions("content", "range")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One class after another; of a class only the state of its hash is held."""
        now, first, n, state = None, 0, 0, hashlib.sha256()
        done: list[tuple[int, int, str]] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [(), (), ()]
            types = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["first", "n", "ends_sha256"])

        for batch in batches:
            for content, _, smallest, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content != now:
                    if now is not None:
                        done.append((first, n, state.hexdigest()))
                    now, first, n, state = content, smallest, 0, hashlib.sha256()
                state.update((("," if n else "") + ids).encode())
                n += count
            yield made()
            done.clear()
        if now is not None:
            done.append((first, n, state.hexdigest()))
        yield made()

    return stored(ordered.mapInArrow(hashed, "first bigint, n bigint, ends_sha256 string"), "classes")


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """Sorted, with a number ``place`` from 0 without gaps."""
    parted = stored(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = parted.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = parted.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_offset") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("place", place).drop("_part", "_id", "_offset")


def _equal_ahead(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    least = f"least(size({a}), size({b}))"
    differ = f"array_position(zip_with(slice({a}, 1, {least}), slice({b}, 1, {least}), (x, y) -> x <> y), true)"
    return F.expr(f"if({differ} > 0, {differ} - 1, {least})").cast("int")


def _sorted_items(blocks: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Distinct conversations in order, each with the edges to its neighbours."""
    firsts = classes.select(F.col("first").alias("conv_id"), "n")
    held = blocks.join(firsts, "conv_id")
    contents = held.groupBy("key").agg(F.first("digests").alias("digests"), F.first("before").alias("before"), F.first("chars").alias("chars"))
    numbers = stored(_in_order(contents, "digests").withColumnRenamed("place", "number"), "numbers")
    sequences = (
        held.select("conv_id", "n", "block", "key", "size", "chars")
        .join(numbers.select("key", "number"), "key")
        .groupBy("conv_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("block", "number", "size", "chars"))).alias("blocks"))
        .select(
            "conv_id",
            "n",
            F.filter("blocks", lambda b: b.size > 0).alias("blocks"),
        )
        .select("conv_id", "n", F.col("blocks.number").alias("numbers"), F.col("blocks.size").alias("sizes"), F.col("blocks.chars").alias("chars"))
    )
    total = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + x)
    items = stored(_in_order(sequences, "numbers").withColumn("_all", F.lit(0)), "items")
    pairs = previous(items, ["_all"], ["place"], id_block("place", PART), {"prior": "numbers"})
    pairs = pairs.filter("prior IS NOT NULL").withColumn("_same", _equal_ahead("prior", "numbers"))
    at = F.col("_same") + 1
    cut = pairs.select(
        "place",
        (F.col("_same") * F.lit(block)).cast("bigint").alias("depth"),
        total(F.slice("chars", 1, F.col("_same"))).alias("chars"),
        F.array_join(F.slice("numbers", 1, F.col("_same")).cast("array<string>"), ",").alias("path"),
        F.get("prior", at - 1).alias("a"),
        F.get("numbers", at - 1).alias("b"),
    )
    side = lambda name: numbers.select(F.col("number").alias(name), F.col("digests").alias(f"{name}_digests"))
    inner = numbers.select(F.col("number").alias("b"), F.col("digests").alias("b_digests"), F.col("before").alias("b_before"), F.col("chars").alias("b_chars"))
    met = cut.join(side("a"), "a", "left").join(inner, "b", "left")
    both = F.col("a_digests").isNotNull() & F.col("b_digests").isNotNull()
    met = met.withColumn("_e", F.when(both, _equal_ahead("a_digests", "b_digests")).otherwise(0))
    inside = F.when(F.col("_e") < F.size("b_digests"), F.get("b_before", F.col("_e"))).otherwise(F.col("b_chars"))
    edges = stored(
        met.select(
            "place",
            (F.col("depth") + F.col("_e")).alias("depth"),
            (F.col("chars") + F.when(F.col("_e") > 0, inside).otherwise(0)).alias("chars"),
            F.md5(F.concat_ws("|", "path", F.array_join(F.slice(F.coalesce("b_digests", F.array().cast("array<string>")), 1, F.col("_e")), ""))).alias("key"),
        ),
        "edges",
    )
    left = edges.select("place", F.col("depth").alias("left_depth"))
    right = edges.select(
        (F.col("place") - 1).alias("place"),
        F.col("depth").alias("right_depth"),
        F.col("chars").alias("right_chars"),
        F.col("key").alias("right_key"),
    )
    return items.join(left, "place", "left").join(right, "place", "left").select(
        "place",
        F.lit(None).cast("string").alias("key"),
        total("sizes").alias("depth"),
        total("chars").alias("chars"),
        "n",
        F.col("conv_id").alias("first"),
        F.lit(1).cast("bigint").alias("leaves"),
        F.lit(0).cast("bigint").alias("saved"),
        F.lit(0).cast("bigint").alias("children"),
        F.col("conv_id").alias("ends"),
        F.coalesce("left_depth", F.lit(-1)).alias("left_depth"),
        F.coalesce("right_depth", F.lit(-1)).alias("right_depth"),
        F.coalesce("right_chars", F.lit(0)).alias("right_chars"),
        "right_key",
    )


_ITEM = (
    "place bigint, key string, depth bigint, chars bigint, n bigint, first bigint, leaves bigint, saved bigint, "
    "children bigint, ends bigint, left_depth bigint, right_depth bigint, right_chars bigint, right_key string"
)
_STEP = f"open boolean, {_ITEM}, top bigint, parent_key string"
_NAMES = [x.split()[0] for x in _STEP.split(", ")]


def contract(items: list[dict]) -> list[dict]:
    """Merge neighbours in descending depth as far as nothing outside can precede it.

    ``items`` are components in sorted order with the edges around them. Closed nodes come
    back with ``open`` false and the depth ``top`` of the node above, the rest as
    components with ``open`` true. An edge waits if one of the two components has a deeper
    edge on its other side that could not be taken: what lies there is merged first.
    """
    items = sorted(items, key=lambda x: x["place"])
    root = list(range(len(items)))
    left = [x["left_depth"] for x in items[:1]] + [x["right_depth"] for x in items[:-1]]
    right = [x["right_depth"] for x in items]
    state, last, closed = dict(enumerate(items)), list(range(len(items))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in sorted(range(len(items) - 1), key=lambda i: -items[i]["right_depth"]):
        edge = items[i]
        depth, chars = edge["right_depth"], edge["right_chars"]
        a, b = find(i), find(i + 1)
        if left[a] > depth or right[last[b]] > depth:
            continue
        merged = {
            "place": state[a]["place"], "key": edge["right_key"], "depth": depth, "chars": chars, "n": 0,
            "first": min(state[a]["first"], state[b]["first"]), "leaves": 0, "saved": 0, "children": 0, "ends": None,
        }
        for part in (state.pop(a), state.pop(b)):
            merged["n"] += part["n"]
            merged["saved"] += part["saved"]
            if part["depth"] > depth:
                closed.append({**part, "open": False, "top": depth, "parent_key": edge["right_key"]})
                merged["saved"] += (part["n"] - 1) * (part["chars"] - chars)
                merged["leaves"] += part["leaves"]
                merged["children"] += 1
            else:
                merged["leaves"] += part["leaves"] if part["children"] else 0
                merged["children"] += part["children"]
                merged["ends"] = part["ends"] if merged["ends"] is None else merged["ends"]
        root[b] = a
        state[a], last[a] = merged, last[b]
    rest = []
    for a in sorted(state):
        end = items[last[a]]
        around = {"left_depth": left[a], **{k: end[k] for k in ("right_depth", "right_chars", "right_key")}}
        # A component with nothing on either side is the whole trie: its node reaches up to the root.
        whole = left[a] < 0 and right[last[a]] < 0
        rest.append({**state[a], **around, "open": not whole, "top": -1, "parent_key": None})
    return closed + rest


def _merged(items: DataFrame, part: int, fan: int) -> DataFrame:
    """All closed nodes: parts first, then contracted forests, until no component is open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = contract(group.to_dict("records"))
        return pd.DataFrame([{k: x.get(k) for k in _NAMES} for x in made], columns=_NAMES).astype({"ends": "Int64"})

    width, closed, rest = part, None, items
    while True:
        in_part = rest.withColumn("_part", F.floor(F.col("place") / F.lit(width)))
        # Whole numbers with nulls would become fractions on their way.
        given = in_part.withColumn("ends", F.coalesce("ends", F.lit(_NONE)))
        step = stored(
            given.groupBy("_part").applyInPandas(lambda df: run(_read(df)), _STEP), "forest"
        )
        done = step.filter("NOT open")
        closed = done if closed is None else closed.unionByName(done)
        rest = step.filter("open").drop("open", "top", "parent_key")
        if rest.isEmpty():
            return closed
        width *= fan


_NONE = -(1 << 63)


def _read(df: pd.DataFrame) -> pd.DataFrame:
    ends = df["ends"].astype(object)
    return df.assign(ends=ends.where(df["ends"] != _NONE, None))


def nodes(sequences: DataFrame, block: int = BLOCK, part: int = PART, fan: int = FAN) -> DataFrame:
    """All nodes of the trie over ``sequences`` as returned by ``rebuilt``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (characters that members after the first
    one share, over the subtree) and ``ends_sha256``.
    """
    blocks = _blocks(sequences, block)
    classes = _classes(blocks)
    closed = stored(_merged(_sorted_items(blocks, classes, block), part, fan), "closed")
    named = closed.filter("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("first").alias("_above"))
    hashes = classes.select(F.col("first").alias("ends"), "ends_sha256")
    edges = attach(closed, named, ["parent_key"], F.col("first")).join(hashes, "ends", "left")
    common = ["first", "n", "top", "depth", "chars", "leaves", "saved", "children", "ends_sha256", "_above"]
    number = lambda pos: F.floor((pos - 1) / F.lit(block)).cast("bigint")
    lowest = F.greatest(F.col("top") + 1, F.lit(1))
    cut = edges.filter(F.col("depth") >= lowest).select(
        *common, F.explode(F.sequence(number(lowest), number(F.col("depth")))).alias("block")
    )
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = classes.select(F.col("first").alias("conv_id"))
    known = blocks.join(firsts, "conv_id", "left_semi").select(
        F.col("conv_id").alias("first"), "block", "before", F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("_ahead")
    )
    placed = cut.join(known, ["first", "block"]).select(*common, "block", "_ahead", F.posexplode("before").alias("_i", "_before"))
    placed = placed.withColumn("pos", F.col("block") * block + F.col("_i") + 1).filter(
        F.col("pos").between(lowest, F.col("depth"))
    )
    root = edges.filter("top < 0").select(*common, F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("_sofar"))
    every = placed.select(*common, "pos", (F.col("_ahead") + F.col("_before")).alias("_sofar")).unionByName(root)
    last = F.col("pos") == F.col("depth")
    return every.select(
        F.col("first").alias("conv_id"),
        F.col("pos").cast("bigint").alias("depth"),
        F.when(F.col("pos") > 0, F.when((F.col("pos") == F.col("top") + 1), F.col("_above")).otherwise(F.col("first"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("chars") - F.col("_sofar"))).cast("bigint").alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, block: int = BLOCK, part: int = PART, fan: int = FAN) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations of ``turns``."""
    return nodes(rebuilt(turns), block, part, fan)
