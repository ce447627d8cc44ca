"""Revision graphs ``(project_id, revision_id, parent_id)`` and dependency graphs.

Iterations double their reach every round and are checkpointed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.documents import canonical_json, revision_id
from loomframe.functions.numeric import first_reason
from loomframe.operators.ordered import attach
from loomframe.session import cut_lineage

MAX_NODES = 10_000
NODE = ["project_id", "revision_id"]


def _links(revs: DataFrame) -> DataFrame:
    """Each node once, with its parent when that exists, and how its chain ends if known."""
    nodes = revs.groupBy(*NODE).agg(F.min("parent_id").alias("parent_id"))
    present = nodes.select("project_id", F.col("revision_id").alias("parent_id")).withColumn(
        "_present", F.lit(True)
    )
    joined = nodes.join(present, ["project_id", "parent_id"], "left")
    found = F.col("_present").isNotNull()
    return joined.select(
        *NODE,
        F.when(found, F.col("parent_id")).alias("up"),
        F.when(found, 1).otherwise(0).cast("bigint").alias("hops"),
        F.when(F.col("parent_id").isNull(), "root").when(~found, "orphan").alias("ending"),
    )


def depths(revs: DataFrame) -> DataFrame:
    """Depth of each node and how its chain of parents ends: root, orphan or cycle.

    Pointer doubling: a row whose chain is still open takes over the pointer of the
    node it points to. A chain that has gone as many steps as its project has nodes and
    is still open must be on a cycle or lead into one.
    """
    links = _links(revs)
    sizes = links.groupBy("project_id").agg(F.count("*").alias("_size"))
    state = cut_lineage(attach(links, sizes, ["project_id"], F.col("revision_id")))
    while True:
        waiting = state.filter(F.col("ending").isNull())
        if waiting.isEmpty():
            break
        target = state.select(
            "project_id",
            F.col("revision_id").alias("up"),
            F.col("up").alias("_up"),
            F.col("hops").alias("_hops"),
            F.col("ending").alias("_ending"),
        )
        hops = F.col("hops") + F.col("_hops")
        moved = waiting.join(target, ["project_id", "up"]).select(
            *NODE,
            F.col("_up").alias("up"),
            hops.alias("hops"),
            F.coalesce("_ending", F.when(hops >= F.col("_size"), "cycle")).alias("ending"),
            "_size",
        )
        state = cut_lineage(state.filter(F.col("ending").isNotNull()).unionByName(moved))
    return state.select(
        *NODE,
        F.when(F.col("ending") != "cycle", F.col("hops")).alias("depth"),
        "ending",
    )


def ancestry(revs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All ancestors of the given nodes with their distance; a node itself has distance 0.

    ``nodes``: ``project_id, revision_id`` of the nodes asked for; without it every node's
    ancestors are listed, which for one long chain is the square of its length. Only jump
    pointers are kept for the whole graph, one row per node and round. Nodes on or behind
    a cycle are left out.
    """
    sound = depths(revs).filter(F.col("ending") != "cycle").select(*NODE)
    links = cut_lineage(_links(revs).join(sound, NODE).select(*NODE, "up"))
    asked = links if nodes is None else links.join(nodes.select(*NODE).distinct(), NODE)
    known = cut_lineage(
        asked.select(
            *NODE, F.col("revision_id").alias("ancestor_id"), F.lit(0).cast("bigint").alias("distance")
        )
    )
    jump = links.filter(F.col("up").isNotNull())
    reach = 1
    while True:
        hop = jump.select("project_id", F.col("revision_id").alias("ancestor_id"), F.col("up").alias("_far"))
        added = cut_lineage(
            known.join(hop, ["project_id", "ancestor_id"]).select(
                *NODE, F.col("_far").alias("ancestor_id"), (F.col("distance") + reach).alias("distance")
            )
        )
        if added.isEmpty():
            return known
        known = known.unionByName(added)
        above = jump.select("project_id", F.col("revision_id").alias("up"), F.col("up").alias("_up"))
        jump = cut_lineage(
            jump.join(above, ["project_id", "up"]).select(*NODE, F.col("_up").alias("up"))
        )
        reach *= 2


def is_ancestor(revs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether ``ancestor_id`` lies on the way from ``revision_id`` to its root.

    The lower node is lifted by the difference of the depths, one power of two at a
    time; a node counts as its own ancestor. Unknown nodes and nodes on cycles are not.
    """
    level = depths(revs)
    low = level.select(*NODE, F.col("depth").alias("_low"))
    high = level.select(
        "project_id", F.col("revision_id").alias("ancestor_id"), F.col("depth").alias("_high")
    )
    keyed = pairs.select("project_id", "revision_id", "ancestor_id").distinct()
    state = (
        keyed.join(low, NODE, "left")
        .join(high, ["project_id", "ancestor_id"], "left")
        .withColumns(
            {
                "_lift": F.col("_low") - F.col("_high"),
                "_at": F.when(F.col("_low") >= F.col("_high"), F.col("revision_id")),
            }
        )
    )
    state = cut_lineage(state.drop("_low", "_high"))
    farthest = state.agg(F.coalesce(F.max("_lift"), F.lit(0))).first()[0]
    jump = _links(revs).filter(F.col("up").isNotNull()).select(*NODE, "up")
    for bit in range(max(0, farthest).bit_length()):
        hop = jump.select(
            "project_id", F.col("revision_id").alias("_at"), F.col("up").alias("_next")
        )
        moves = F.col("_lift").bitwiseAND(F.lit(1 << bit)) != 0
        state = cut_lineage(
            state.join(hop, ["project_id", "_at"], "left")
            .withColumn(
                "_at", F.when(moves, F.col("_next")).otherwise(F.col("_at"))
            )
            .drop("_next")
        )
        second = jump.select("project_id", F.col("revision_id").alias("up"), F.col("up").alias("_2"))
        jump = cut_lineage(
            jump.join(second, ["project_id", "up"]).select(*NODE, F.col("_2").alias("up"))
        )
    result = state.select(
        "project_id",
        "revision_id",
        "ancestor_id",
        F.coalesce(F.col("_at") == F.col("ancestor_id"), F.lit(False)).alias("is_ancestor"),
    )
    return pairs.join(result, ["project_id", "revision_id", "ancestor_id"], "left")


def heads(revs: DataFrame) -> DataFrame:
    """Number of children of each node; heads are the nodes without any."""
    children = (
        revs.filter(F.col("parent_id").isNotNull())
        .groupBy("project_id", F.col("parent_id").alias("revision_id"))
        .agg(F.count("*").alias("children"))
    )
    joined = revs.select(*NODE).distinct().join(children, NODE, "left")
    count = F.coalesce("children", F.lit(0))
    return joined.select(*NODE, count.alias("children"), (count == 0).alias("is_head"))


def graph_violations(
    revs: DataFrame,
    current: DataFrame,
    max_nodes: int = MAX_NODES,
    recomputed: str | None = None,
) -> DataFrame:
    """Broken rules per project: ``rule`` and the number of nodes it concerns.

    ``current``: ``project_id, revision_id`` of each project's checked-out node.
    ``recomputed``: column with the content id to compare the stored id with.
    """

    def rule(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("project_id", F.lit(name).alias("rule"), F.col("n").cast("bigint"))

    count = lambda df: df.groupBy("project_id").agg(F.count("*").alias("n"))
    totals = revs.groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("parent_id").isNull()).alias("roots")
    )
    copies = revs.groupBy(*NODE).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    ends = depths(revs)
    missing = current.join(revs.select(*NODE).distinct(), NODE, "left_anti")
    parts = [
        rule(totals.filter(F.col("roots") != 1).withColumn("n", F.col("roots")), "root_count"),
        rule(totals.filter(F.col("n") > max_nodes), "node_limit"),
        rule(count(copies), "duplicate_id"),
        rule(count(ends.filter(F.col("ending") == "orphan")), "orphan"),
        rule(count(ends.filter(F.col("ending") == "cycle")), "cycle"),
        rule(count(missing), "missing_current"),
    ]
    if recomputed is not None:
        wrong = revs.filter(~F.col("revision_id").eqNullSafe(F.col(recomputed)))
        parts.append(rule(count(wrong), "wrong_id"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def hash_audit(revs: DataFrame) -> DataFrame:
    """Whether each node's id is the content id of what is stored, and so are its ancestors'.

    ``revs``: ``project_id, revision_id, parent_id, state, command_metadata``, the last two
    as JSON text. ``verdict`` is ``ok``, ``malformed`` (a text without canonical form),
    ``wrong_id``, ``behind_wrong_id`` for a sound node with an ancestor that is not, ``orphan``
    or ``cycle``. The flag of an ancestor is carried down by pointer doubling.
    """
    metadata, state = canonical_json("command_metadata"), canonical_json("state")
    expected = revision_id(metadata, F.col("parent_id"), state)
    own = F.when(metadata.isNull() | state.isNull(), "malformed").when(
        ~F.col("revision_id").eqNullSafe(expected), "wrong_id"
    )
    judged = cut_lineage(revs.withColumn("_own", own).select(*NODE, "parent_id", "_own"))
    flagged = judged.groupBy(*NODE).agg(F.max("_own").alias("own"))
    open_ends = depths(judged).select(*NODE, F.col("ending"))
    links = _links(judged).select(*NODE, "up").join(flagged, NODE).join(open_ends, NODE)
    walk = cut_lineage(
        links.filter(F.col("ending") != "cycle").select(*NODE, "up", F.col("own").isNotNull().alias("bad"))
    )
    # ``bad`` tells of the nodes from this one up to, and without, the one pointed at.
    while not walk.filter(F.col("up").isNotNull()).isEmpty():
        above = walk.select("project_id", F.col("revision_id").alias("up"), F.col("up").alias("_up"), F.col("bad").alias("_bad"))
        walk = cut_lineage(
            walk.join(above, ["project_id", "up"], "left").select(
                *NODE, F.col("_up").alias("up"), (F.col("bad") | F.coalesce("_bad", F.lit(False))).alias("bad")
            )
        )
    verdict = (
        F.when(F.col("ending") == "cycle", "cycle")
        .when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("bad"), "behind_wrong_id")
        .when(F.col("ending") == "orphan", "orphan")
        .otherwise("ok")
    )
    known = flagged.join(open_ends, NODE).join(walk.select(*NODE, "bad"), NODE, "left")
    return known.select(*NODE, verdict.alias("verdict"))


# --- dependency graphs ---------------------------------------------------------------------


DAG_KEY = ["graph_id", "name"]
#: Nodes and edges of a graph that is worked out by one task.
SMALL_GRAPH = 100_000


def _small_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Level and cycle of each node of small graphs, each graph in linear time."""
    types = dict(nodes.dtypes)
    schema = f"graph_id {types['graph_id']}, name {types['name']}, level INT, cycle {types['name']}"

    def run(key: tuple, names: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        known = sorted(names["name"].tolist())
        levels, cycles = _order(known, list(zip(edges["name"], edges["dependency"], strict=True)))
        made = {
            "graph_id": [key[0]] * len(known),
            "name": known,
            "level": pd.array([levels.get(n) for n in known], "Int32"),
            "cycle": pd.Series([cycles.get(n) for n in known], dtype=object),
        }
        return pd.DataFrame(made)

    return nodes.groupBy("graph_id").cogroup(links.groupBy("graph_id")).applyInPandas(run, schema)


def _order(names: list, edges: list[tuple]) -> tuple[dict, dict]:
    """Levels of the nodes that can be ordered, and the smallest node of the cycle of the others on one."""
    waits, users = dict.fromkeys(names, 0), {}
    for name, need in edges:
        waits[name] += 1
        users.setdefault(need, []).append(name)
    levels = {n: 0 for n, count in waits.items() if not count}
    front = list(levels)
    while front:
        later = []
        for need in front:
            for name in users.get(need, ()):
                waits[name] -= 1
                if not waits[name]:
                    levels[name] = levels[need] + 1
                    later.append(name)
        front = later
    # Strongly connected parts of the rest, by one walk that keeps its own stack.
    rest = {n for n in names if n not in levels}
    needs = {}
    for name, need in edges:
        if name in rest and need in rest:
            needs.setdefault(name, []).append(need)
    met, low, path, on_path, cycles = {}, {}, [], set(), {}
    for start in sorted(rest):
        if start in met:
            continue
        walk = [(start, iter(needs.get(start, ())))]
        met[start] = low[start] = len(met)
        path.append(start)
        on_path.add(start)
        while walk:
            node, ahead = walk[-1]
            step = next((n for n in ahead if n not in met or n in on_path), None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == met[node]:
                    part = [path.pop()]
                    while part[-1] != node:
                        part.append(path.pop())
                    on_path.difference_update(part)
                    if len(part) > 1 or node in needs.get(node, ()):
                        cycles.update(dict.fromkeys(part, min(part)))
            elif step in met:
                low[node] = min(low[node], met[step])
            else:
                met[step] = low[step] = len(met)
                path.append(step)
                on_path.add(step)
                walk.append((step, iter(needs.get(step, ()))))
    return levels, cycles


def _large_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The same for large graphs, in rounds over the whole table.

    A node that has its level is written once and leaves; only nodes that still wait are
    written again. What is left then lies on a cycle, or behind one or an absent node.
    """
    wanted = links.groupBy(*DAG_KEY).agg(F.count("*").alias("_open"))
    state = cut_lineage(nodes.join(wanted, DAG_KEY, "left").withColumn("_open", F.coalesce("_open", F.lit(0).cast("bigint"))))
    done, level = [], 0
    front = state.filter(F.col("_open") == 0).select(*DAG_KEY)
    waiting = state.filter(F.col("_open") > 0)
    while not front.isEmpty():
        done.append(front.withColumn("level", F.lit(level).cast("int")))
        needs = front.select("graph_id", F.col("name").alias("dependency"))
        met = links.join(needs, ["graph_id", "dependency"]).groupBy(*DAG_KEY).agg(F.count("*").alias("_met"))
        left = F.col("_open") - F.coalesce("_met", F.lit(0))
        state = cut_lineage(waiting.join(met, DAG_KEY, "left").select(*DAG_KEY, left.alias("_open")))
        front, waiting, level = state.filter(F.col("_open") == 0).select(*DAG_KEY), state.filter(F.col("_open") > 0), level + 1
    ordered = reduce(DataFrame.unionByName, done) if done else nodes.limit(0).withColumn("level", F.lit(0))
    stuck = waiting.select(*DAG_KEY)
    found = stuck.join(_cycles(stuck, links), DAG_KEY, "left")
    kind = nodes.schema["name"].dataType
    return ordered.select(*DAG_KEY, "level", F.lit(None).cast(kind).alias("cycle")).unionByName(
        found.select(*DAG_KEY, F.lit(None).cast("int").alias("level"), "cycle")
    )


def _inside(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between two of the nodes."""
    ends = nodes.select("graph_id", F.col("name").alias("dependency"))
    return links.join(nodes.select(*DAG_KEY), DAG_KEY, "left_semi").join(ends, ["graph_id", "dependency"], "left_semi")


def _cycles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Strongly connected parts with a cycle: ``cycle`` is their smallest node.

    Every node takes the smallest node that it can be reached from; whoever keeps its own
    name is then followed backwards inside its colour, which gives its part. Parts leave, and so do nodes that nothing
    in the rest depends on or that depend on nothing, until no node is left.
    """
    parts = []
    rest, inner = cut_lineage(nodes.select(*DAG_KEY)), cut_lineage(_inside(links, nodes))
    while not rest.isEmpty():
        before = rest.count()
        users = inner.select("graph_id", F.col("dependency").alias("name")).distinct()
        rest = cut_lineage(rest.join(users, DAG_KEY, "left_semi").join(inner.select(*DAG_KEY).distinct(), DAG_KEY, "left_semi"))
        inner = cut_lineage(_inside(inner, rest))
        if rest.count() < before:
            continue
        color = cut_lineage(rest.withColumn("color", F.col("name")))
        while True:
            near = color.select("graph_id", F.col("name").alias("dependency"), F.col("color").alias("_near"))
            best = inner.join(near, ["graph_id", "dependency"]).groupBy(*DAG_KEY).agg(F.min("_near").alias("_near"))
            step = color.join(best, DAG_KEY, "left").select(
                *DAG_KEY, F.least("color", "_near").alias("color"), (F.col("_near") < F.col("color")).alias("_moved")
            )
            color = cut_lineage(step)
            if color.filter("_moved").isEmpty():
                break
        color = color.drop("_moved")
        # Back from the root of each colour: over what its nodes depend on, inside the colour.
        part = cut_lineage(color.filter(F.col("name") == F.col("color")))
        front = part
        while not front.isEmpty():
            needs = inner.join(front, DAG_KEY).select("graph_id", F.col("dependency").alias("name"), "color").distinct()
            front = cut_lineage(needs.join(color, [*DAG_KEY, "color"], "left_semi").join(part, DAG_KEY, "left_anti"))
            part = part.unionByName(front)
        part = cut_lineage(part)
        looped = inner.filter(F.col("name") == F.col("dependency")).select(*DAG_KEY, F.lit(True).alias("_loop")).distinct()
        sizes = part.join(looped, DAG_KEY, "left").groupBy("graph_id", "color").agg(
            F.count("*").alias("_n"), F.max("_loop").alias("_loop")
        )
        real = sizes.filter((F.col("_n") > 1) | F.col("_loop")).select("graph_id", "color")
        parts.append(part.join(real, ["graph_id", "color"], "left_semi").withColumnRenamed("color", "cycle"))
        rest = cut_lineage(rest.join(part, DAG_KEY, "left_anti"))
        inner = cut_lineage(_inside(inner, rest))
    if not parts:
        return nodes.select(*DAG_KEY, F.col("name").alias("cycle")).limit(0)
    return reduce(DataFrame.unionByName, parts).select(*DAG_KEY, "cycle")


def dag_order(nodes: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """Level of each node, or the cycle that it lies on.

    ``level`` is one more than the highest level among the dependencies; null for nodes
    that cannot be ordered. ``cycle`` is the smallest node of the strongly connected part of a
    node on a cycle, null for nodes that only lie behind one or miss a dependency. Graphs up
    to ``small`` nodes and edges are one task each, larger ones are worked out in rounds.
    """
    # New names for columns that may come from one table.
    names = nodes.select(*DAG_KEY).distinct().toDF(*DAG_KEY)
    links = edges.select(*DAG_KEY, "dependency").distinct().toDF(*DAG_KEY, "dependency")
    both = names.select("graph_id").unionAll(links.select("graph_id"))
    sizes = both.groupBy("graph_id").agg((F.count("*") > small).alias("_large"))
    large = cut_lineage(sizes.filter("_large").select("graph_id"))
    known = links.join(names, DAG_KEY, "left_semi").toDF(*DAG_KEY, "dependency")
    if large.isEmpty():
        return _small_levels(names, known)
    pick = lambda df, how: df.join(large, "graph_id", how)
    found = _large_levels(cut_lineage(pick(names, "left_semi")), cut_lineage(pick(known, "left_semi")))
    return _small_levels(pick(names, "left_anti"), pick(known, "left_anti")).unionByName(found)


def dag_audit(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topological level of each node, and the broken rules per graph.

    ``nodes``: ``graph_id, name, position, masked``; ``edges``: ``graph_id, name,
    dependency``. Nodes that never get a level are ``unordered``: they are on or behind a cycle or miss
    a dependency; ``dag_cycles`` tells which ones are on one.
    """
    key = DAG_KEY
    unique = nodes.groupBy(*key).agg(
        F.count("*").alias("_copies"),
        F.min("position").alias("position"),
        F.max("masked").alias("masked"),
    )
    links = edges.select("graph_id", "name", "dependency").distinct()
    wanted = links.groupBy(*key).agg(F.count("*").alias("_open"))
    state = cut_lineage(dag_order(nodes, edges))
    used = links.select("graph_id", F.col("dependency").alias("name")).distinct()
    terminal = unique.join(used, key, "left_anti")
    known = unique.select("graph_id", F.col("name").alias("dependency"))
    absent = links.join(known, ["graph_id", "dependency"], "left_anti")
    looped = links.filter(F.col("name") == F.col("dependency"))
    stuck = state.filter(F.col("level").isNull())
    # A node that waits for an absent dependency is not on a cycle for that reason alone.
    wide = wanted.join(unique.filter("masked"), key).filter(F.col("_open") > 1)
    ends = (
        unique.select("graph_id")
        .distinct()
        .join(terminal.groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .filter(F.col("n") != 1)
    )

    def rule(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit(name))

    violations = (
        rule(unique.filter(F.col("_copies") > 1), "duplicate_name")
        .unionByName(rule(looped, "self_dependency"))
        .unionByName(rule(absent, "missing_dependency"))
        .unionByName(rule(stuck, "unordered"))
        .unionByName(rule(wide, "masked_not_unary"))
        .unionByName(ends.withColumn("rule", F.lit("terminal_count")))
    )
    return state.select(*key, "level"), violations


def dag_cycles(nodes: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """Nodes without a level: ``cycle`` for those on one, null for those that wait behind one
    or for an absent node."""
    return dag_order(nodes, edges, small).filter(F.col("level").isNull()).select(*DAG_KEY, "cycle")


#: Steps of a plan that cost little more than the scan below them.
_CHEAP = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range"}


def _shared(df: DataFrame, users: int) -> DataFrame:
    """The same rows, written once if several read them and their plan is more than a scan."""
    if users < 2:
        return df
    waiting, kinds = [df._jdf.queryExecution().optimizedPlan()], set()
    while waiting:
        node = waiting.pop()
        kinds.add(node.getClass().getSimpleName())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return df if kinds <= _CHEAP else cut_lineage(df)


def run_dag(
    px: DataFrame,
    nodes: Sequence[tuple[str, Callable[..., DataFrame], Sequence[str]]],
) -> DataFrame:
    """Run named transforms in dependency order; one input, one output.

    A node without dependencies gets ``px``. Names, dependencies and the single
    terminal are checked before anything is built. What several nodes read is worked out
    once, unless it is just a scan with projections.
    """
    waits = {name: list(needs) for name, _, needs in nodes}
    if len(waits) != len(nodes):
        raise ValueError("duplicate node names")
    for name, needs in waits.items():
        if name in needs or len(set(needs)) != len(needs) or any(n not in waits for n in needs):
            raise ValueError(f"node {name!r} has invalid dependencies")
    terminals = [n for n in waits if not any(n in needs for needs in waits.values())]
    if len(terminals) != 1:
        raise ValueError("the graph needs exactly one terminal node")
    users = Counter(need for needs in waits.values() for need in needs)
    sources = sum(not needs for needs in waits.values())
    given = _shared(px, sources)
    done: dict[str, DataFrame] = {}
    while len(done) < len(nodes):
        ready = [
            (n, fn, needs)
            for n, fn, needs in nodes
            if n not in done and all(d in done for d in needs)
        ]
        if not ready:
            raise ValueError("the graph has a cycle")
        for name, fn, needs in ready:
            made = fn(*[done[d] for d in needs]) if needs else fn(given)
            done[name] = _shared(made, users[name])
    return done[terminals[0]]


def workflow_reason(ops: DataFrame) -> DataFrame:
    """First static problem of an operation row: its index and its version."""
    return ops.withColumn(
        "reason",
        first_reason(
            index=F.col("idx").isNull() | (F.col("idx") < 0),
            version=F.col("capability_version").isNull() | (F.col("capability_version") < 1),
        ),
    )
