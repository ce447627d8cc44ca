"""Registered revision-graph and edit-log queries and their cross-check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.documents import revision_id
from loomframe.operators import clips, edits, graphs, pixels
from loomframe.operators.ordered import numbered, time_block
from loomframe.plans.common import six
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views
from loomframe.sources.documents import read_documents


def _broken(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions with cycles, missing parents, second roots and copies put in."""
    revs = data.revisions(spark, folder).select(
        "project_id", "revision_id", "parent_id", "command_metadata"
    )
    p, r = F.col("project_id"), F.col("revision_id")
    parent = (
        F.when((p % 7 == 0) & (r == 0), F.lit(1).cast("bigint"))
        .when((p % 11 == 0) & (r == 2), F.lit(99).cast("bigint"))
        .when((p % 5 == 0) & (r == 3), F.lit(None).cast("bigint"))
        .otherwise(F.col("parent_id"))
    )
    changed = revs.withColumn("parent_id", parent)
    return changed.unionByName(changed.filter((p % 13 == 0) & (r == 1)))


def revision_depths(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.depths(_broken(spark, folder))


def revision_ancestry(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.ancestry(data.revisions(spark, folder)).withColumn(
        "distance", F.col("distance").cast("bigint")
    )


def head_ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """Ways from the heads to their roots; only the heads' rows are worked out."""
    revs = data.revisions(spark, folder)
    return graphs.ancestry(revs, graphs.heads(revs).filter("is_head"))


def ancestor_pairs(spark: SparkSession, folder: str) -> DataFrame:
    revs = data.revisions(spark, folder)
    pairs = revs.select(
        "project_id",
        "revision_id",
        F.explode(
            F.array(
                F.col("revision_id"),
                F.floor(F.col("revision_id") / 2),
                F.greatest(F.col("revision_id") - 3, F.lit(0).cast("bigint")),
                F.col("revision_id") + 1,
            )
        ).alias("ancestor_id"),
    )
    return graphs.is_ancestor(revs, pairs.distinct())


def revision_heads(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.heads(data.revisions(spark, folder))


def graph_violations(spark: SparkSession, folder: str) -> DataFrame:
    revs = _broken(spark, folder).withColumn(
        "expected",
        F.when(
            (F.col("project_id") % 17 == 0) & (F.col("revision_id") == 1), F.lit(-1).cast("bigint")
        ).otherwise(F.col("revision_id")),
    )
    current = revs.groupBy("project_id").agg(F.max("revision_id").alias("revision_id"))
    current = current.withColumn(
        "revision_id",
        F.col("revision_id") + F.when(F.col("project_id") % 3 == 0, 1).otherwise(0),
    )
    return graphs.graph_violations(revs, current, max_nodes=7, recomputed="expected")


def _revision_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document per project with real content ids; some states changed afterwards."""
    c = data.table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.length("text").alias("n"), (F.col("conv_id") % 6).alias("k")
    )
    state = lambda n, t: F.concat(F.lit('{"n":'), n.cast("string"), F.lit(',"turn":'), t.cast("string"), F.lit("}"))
    node = F.struct(
        "turn",
        state(F.col("n"), F.col("turn")).alias("state"),
        F.concat(F.lit('{"role":"'), "role", F.lit('"}')).alias("meta"),
        state(F.col("n") + F.when((F.col("k") == 1) & (F.col("turn") == 1), 1).otherwise(0), F.col("turn")).alias("stored"),
    )
    # A project is one document by contract, at most 8 MiB.
    packed = c.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def add(done, node):
        made = revision_id(node["meta"], done["last"], node["state"])
        parent = F.when((F.col("k") == 2) & (node["turn"] == 1), F.lit("0" * 64)).otherwise(done["last"])
        # Blanks and another order of keys do not change what a document says.
        item = F.concat(
            F.lit('{"state": '), node["stored"], F.lit(', "revision_id":'), quoted(made), F.lit(',"parent_id":'),
            F.coalesce(quoted(parent), F.lit("null")), F.lit(',"command_metadata": '), node["meta"], F.lit("}"),
        )
        return F.struct(made.alias("last"), F.concat(done["items"], F.array(item)).alias("items"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("items"))
    folded = packed.select("conv_id", F.aggregate("nodes", start, add).alias("d"))
    first = F.get_json_object(F.get("d.items", F.lit(0)), "$.revision_id")
    return folded.select(
        "conv_id",
        F.concat(
            F.lit('{"schema_version":1,"root_revision_id":'), quoted(first), F.lit(',"current_revision_id":'),
            quoted(F.col("d.last")), F.lit(',"revisions":['), F.array_join("d.items", ","), F.lit("]}"),
        ).alias("document"),
    )


def revision_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Revision documents unpacked into their nodes."""
    return read_documents(_revision_documents(spark, folder), "revisions").select(
        "conv_id", "idx", "revision_id", "parent_id", "state", "current_revision_id", "reason"
    )


def revision_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Content ids worked out again from the stored documents."""
    revs = read_documents(_revision_documents(spark, folder), "revisions")
    return graphs.hash_audit(revs.withColumnRenamed("conv_id", "project_id"))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    c = data.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("graph_id"), F.col("turn").alias("name")
    )
    g, n = F.col("graph_id"), F.col("name")
    nodes = c.withColumns({"position": n, "masked": (g + n) % 4 == 0})
    needs = F.when(n > 0, F.array_distinct(F.array(n - 1, F.floor(n / 2)))).otherwise(
        F.when(g % 7 == 0, F.array(F.lit(2).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        )
    )
    more = F.array_compact(
        F.array(
            F.when((g % 5 == 0) & (n == 1), F.lit(77).cast("bigint")),
            F.when((g % 11 == 0) & (n == 3), F.lit(3).cast("bigint")),
        )
    )
    edges = c.select("graph_id", "name", F.explode(F.concat(needs, more)).alias("dependency"))
    return nodes, edges


def dag_levels(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.dag_audit(*_graph(spark, folder))[0]


def dag_violations(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.dag_audit(*_graph(spark, folder))[1].select("graph_id", "rule", "n")


def dag_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.dag_cycles(*_graph(spark, folder))


def dag_run(spark: SparkSession, folder: str) -> DataFrame:
    px = clips.to_linear(clips.to_pixels(data.frames(spark, folder)))
    cell = ["clip_id", "frame_idx", "y", "x"]

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select(*cell, *[F.col(c).alias(f"_{c}") for c in "rgb"])
        joined = a.join(other, cell)
        return joined.withColumns({c: (F.col(c) + F.col(f"_{c}")) / 2 for c in "rgb"}).drop(
            "_r", "_g", "_b"
        )

    done = graphs.run_dag(
        px,
        [
            ("merge", merge, ("bright", "curved")),
            ("bright", lambda d: pixels.exposure(d, 1.0), ()),
            ("curved", lambda d: pixels.tone_curve(d, ((0.0, 0.1), (1.0, 0.9))), ()),
        ],
    )
    return six(done, *"rgba")


# --- logs --------------------------------------------------------------------------------


def _log(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.table(spark, folder, "events").select(
        F.col("user_id").alias("project_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
    )
    return numbered(rows, ["project_id"], ["ts", "event_id"], time_block("ts"), "seq")


def history_fold(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    log = _log(spark, folder).select(
        "project_id",
        "seq",
        F.when(kind == "click", "undo").when(kind == "error", "redo").otherwise("execute").alias("op"),
        F.col("event_id").alias("revision_id"),
    )
    return edits.fold_history(log)


def layer_fold(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    name = lambda n: F.concat(F.lit("L"), n.cast("string"))
    wild = F.floor(F.col("value")).cast("bigint")
    log = _log(spark, folder).select(
        "project_id",
        "seq",
        F.when(F.col("event_id") % 40 == 0, "replace")
        .when(kind == "signup", "add")
        .when(kind == "view", "reorder")
        .when(kind == "click", "duplicate")
        .when(kind == "purchase", "opacity")
        .otherwise("remove")
        .alias("command"),
        name(F.when(kind == "signup", wild % 12).otherwise(wild % 8)).alias("layer_id"),
        name(F.col("seq") + 100).alias("new_layer_id"),
        name(F.col("event_id")).alias("source_id"),
        (F.col("value") % 1.1).alias("opacity"),
        F.lit(True).alias("visible"),
        F.lit("normal").alias("blend_mode"),
        F.lit(None).cast("string").alias("mask"),
        (wild % 4).cast("int").alias("from_pos"),
        (F.col("seq") % 3).cast("int").alias("to_pos"),
        F.expr(
            "array(named_struct('layer_id', 'L1', 'source_id', 'S1', 'opacity', 1.0D, 'visible',"
            " true, 'blend_mode', 'normal', 'mask', cast(null as string)), named_struct("
            "'layer_id', concat('L', floor(value) % 3), 'source_id', 'S2', 'opacity', 0.5D,"
            " 'visible', true, 'blend_mode', 'screen', 'mask', cast(null as string)))"
        ).alias("layers"),
    )
    folded = edits.fold_layers(log)
    ids = F.transform("stack", lambda v: v["layer_id"])
    return folded.select(
        "project_id",
        "seq",
        "command",
        "error",
        "revision",
        F.concat_ws(",", ids).alias("stack"),
    )


def transform_fold(spark: SparkSession, folder: str) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    log = _log(spark, folder).select(
        "project_id",
        "seq",
        F.when(kind == "signup", "crop")
        .when(kind == "view", "scale")
        .when(kind == "purchase", "translate")
        .otherwise("rotate")
        .alias("command"),
        F.array(
            (v % 40).cast("int"), F.lit(0), (v * 5).cast("int") + 1, F.lit(320)
        ).alias("crop"),
        (v / 2.0).alias("scale"),
        ((v * 7) % 250.0 - F.col("project_id") % 3 * 45.0).alias("degrees"),
        ((v * 3) % 200.0 - 80.0).alias("dx"),
        ((v * 2) % 100.0 - 50.0).alias("dy"),
    )
    folded = edits.fold_transforms(log)
    flat = folded.select(
        "project_id",
        "seq",
        "error",
        F.concat_ws(",", "crop").alias("crop"),
        "scale",
        "rotation",
        "x",
        "y",
    )
    return six(flat, "scale", "rotation", "x", "y")


def _operations(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select(
        F.col("project_id").alias("workflow_id"),
        (F.col("seq") - 1).alias("idx"),
        ((F.col("event_type") == "error") & (F.col("value") > 40)).alias("failed"),
        "value",
    )


def replay_audit(spark: SparkSession, folder: str) -> DataFrame:
    return edits.replay_audit(_operations(spark, folder)).select("workflow_id", "idx", "status")


def replay_summary(spark: SparkSession, folder: str) -> DataFrame:
    return edits.replay_summary(_operations(spark, folder))


def replay_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """A user resolver that keeps a balance and refuses to go beyond a limit."""

    def resolver(total: float, row) -> float:
        if total + row.value > 600:
            raise ValueError("limit")
        return total + row.value

    done = edits.replay_with(_operations(spark, folder), lambda: 0.0, resolver)
    return done.select("workflow_id", "idx", "status", "error")


QUERIES = {
    "revision_documents": revision_documents,
    "revision_audit": revision_audit,
    "revision_depths": revision_depths,
    "revision_ancestry": revision_ancestry,
    "head_ancestry": head_ancestry,
    "ancestor_pairs": ancestor_pairs,
    "revision_heads": revision_heads,
    "graph_violations": graph_violations,
    "dag_levels": dag_levels,
    "dag_violations": dag_violations,
    "dag_cycles": dag_cycles,
    "dag_run": dag_run,
    "history_fold": history_fold,
    "layer_fold": layer_fold,
    "transform_fold": transform_fold,
    "replay_audit": replay_audit,
    "replay_summary": replay_summary,
    "replay_resolved": replay_resolved,
}

_BROKEN = """raw AS (
    SELECT project_id, revision_id,
           CASE WHEN project_id % 7 = 0 AND revision_id = 0 THEN 1
                WHEN project_id % 11 = 0 AND revision_id = 2 THEN 99
                WHEN project_id % 5 = 0 AND revision_id = 3 THEN NULL
                ELSE parent_id END AS parent_id FROM revisions),
broken AS (SELECT * FROM raw UNION ALL
           SELECT * FROM raw WHERE project_id % 13 = 0 AND revision_id = 1),
walk AS (
    SELECT DISTINCT project_id, revision_id, parent_id AS up, 0 AS hops FROM broken
    UNION ALL
    SELECT w.project_id, w.revision_id, b.parent_id, w.hops + 1
    FROM walk w JOIN (SELECT DISTINCT * FROM broken) b
        ON b.project_id = w.project_id AND b.revision_id = w.up
    WHERE w.hops < 40),
ends AS (
    SELECT DISTINCT project_id, revision_id,
           CASE WHEN max(hops) OVER w < 40 THEN CAST(max(hops) OVER w AS BIGINT) END AS depth,
           CASE WHEN max(hops) OVER w >= 40 THEN 'cycle'
                WHEN bool_or(up IS NULL) OVER w THEN 'root' ELSE 'orphan' END AS ending
    FROM walk WINDOW w AS (PARTITION BY project_id, revision_id))"""

_CLOSURE = """up AS (
    SELECT project_id, revision_id, revision_id AS ancestor_id, CAST(0 AS BIGINT) AS distance
    FROM revisions
    UNION ALL
    SELECT u.project_id, u.revision_id, r.parent_id, u.distance + 1
    FROM up u JOIN revisions r ON r.project_id = u.project_id AND r.revision_id = u.ancestor_id
    WHERE r.parent_id IS NOT NULL)"""

_DAG = """nodes AS (
    SELECT conv_id AS graph_id, turn AS name, (conv_id + turn) % 4 = 0 AS masked
    FROM conversations),
deps AS (
    SELECT graph_id, name, name - 1 AS dependency FROM nodes WHERE name > 0
    UNION SELECT graph_id, name, name // 2 FROM nodes WHERE name > 0
    UNION SELECT graph_id, name, 2 FROM nodes WHERE name = 0 AND graph_id % 7 = 0
    UNION SELECT graph_id, name, 77 FROM nodes WHERE name = 1 AND graph_id % 5 = 0
    UNION SELECT graph_id, name, 3 FROM nodes WHERE name = 3 AND graph_id % 11 = 0),
reach AS (
    SELECT graph_id, name, dependency FROM deps
    UNION
    SELECT r.graph_id, r.name, d.dependency FROM reach r JOIN deps d
        ON d.graph_id = r.graph_id AND d.name = r.dependency),
stuck AS (
    SELECT DISTINCT graph_id, name FROM reach r WHERE
        NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = r.graph_id AND n.name = r.dependency)
        OR EXISTS (SELECT 1 FROM reach c WHERE c.graph_id = r.graph_id AND c.name = r.dependency
                   AND c.dependency = r.dependency)
        OR r.name = r.dependency),
paths AS (
    SELECT graph_id, name, 0 AS level FROM nodes n WHERE (graph_id, name) NOT IN (
        SELECT (graph_id, name) FROM stuck)
        AND (graph_id, name) NOT IN (SELECT (graph_id, name) FROM deps)
    UNION
    SELECT d.graph_id, d.name, p.level + 1 FROM paths p JOIN deps d
        ON d.graph_id = p.graph_id AND d.dependency = p.name
    WHERE (d.graph_id, d.name) NOT IN (SELECT (graph_id, name) FROM stuck)),
levels AS (
    SELECT graph_id, name, CAST(max(level) AS INTEGER) AS level FROM nodes LEFT JOIN paths
        USING (graph_id, name) GROUP BY ALL)"""

_LOG = """log AS (
    SELECT user_id AS project_id, event_id, event_type, value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""

_ARGS = """args AS (
    SELECT project_id, seq,
           CASE event_type WHEN 'signup' THEN 'crop' WHEN 'view' THEN 'scale'
                WHEN 'purchase' THEN 'translate' ELSE 'rotate' END AS command,
           [CAST(trunc(value % 40) AS INTEGER), 0, CAST(trunc(value * 5) AS INTEGER) + 1, 320] AS crop,
           value / 2 AS scale, (value * 7) % 250 - project_id % 3 * 45 AS degrees,
           (value * 3) % 200 - 80 AS dx, (value * 2) % 100 - 50 AS dy FROM log),
checked AS (
    SELECT *, CASE WHEN NOT coalesce(CASE command
           WHEN 'crop' THEN crop[1] BETWEEN 0 AND 320 AND crop[3] >= 1 AND crop[1] + crop[3] <= 320
           WHEN 'scale' THEN scale BETWEEN 0.01 AND 64
           WHEN 'rotate' THEN degrees BETWEEN -360 AND 360
           ELSE dx BETWEEN -320 AND 320 AND dy BETWEEN -320 AND 320 END, false)
           THEN 'invalid_arguments' END AS bad FROM args),
fold AS (
    SELECT project_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error,
           [0, 0, 320, 320] AS crop, CAST(1 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS rotation,
           CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y
    FROM (SELECT DISTINCT project_id FROM log)
    UNION ALL
    SELECT f.project_id, c.seq,
           CASE WHEN bad IS NOT NULL THEN bad
                WHEN command = 'rotate' AND abs(rotation + degrees) > 360 THEN 'rotation_range'
                WHEN command = 'translate' AND (abs(x + dx) > 320 OR abs(y + dy) > 320)
                THEN 'position_range' END,
           CASE WHEN bad IS NULL AND command = 'crop' THEN c.crop ELSE f.crop END,
           CASE WHEN bad IS NULL AND command = 'scale' THEN c.scale ELSE f.scale END,
           CASE WHEN bad IS NULL AND command = 'rotate' AND abs(rotation + degrees) <= 360
                THEN rotation + degrees ELSE rotation END,
           CASE WHEN bad IS NULL AND command = 'translate' AND abs(x + dx) <= 320
                AND abs(y + dy) <= 320 THEN x + dx ELSE x END,
           CASE WHEN bad IS NULL AND command = 'translate' AND abs(x + dx) <= 320
                AND abs(y + dy) <= 320 THEN y + dy ELSE y END
    FROM fold f JOIN checked c ON c.project_id = f.project_id AND c.seq = f.seq + 1)"""

_OPS = """ops AS (
    SELECT project_id AS workflow_id, seq - 1 AS idx, event_type = 'error' AND value > 40 AS failed,
           value FROM log),
firsts AS (SELECT workflow_id, min(idx) FILTER (failed) AS failed_at FROM ops GROUP BY 1)"""

_REVISIONS = """WITH RECURSIVE c AS (
        SELECT conv_id, turn, role, length(text) AS n, conv_id % 6 AS k,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations),
    chain AS (
        SELECT conv_id, idx, CAST(NULL AS VARCHAR) AS parent, sha256('{"command_metadata":{"role":"' || role
               || '"},"parent_id":null,"state":"{\\"n\\":' || n || ',\\"turn\\":' || turn || '}"}') AS id
        FROM c WHERE idx = 0
        UNION ALL
        SELECT c.conv_id, c.idx, p.id, sha256('{"command_metadata":{"role":"' || role || '"},"parent_id":"' || p.id
               || '","state":"{\\"n\\":' || n || ',\\"turn\\":' || turn || '}"}')
        FROM chain p JOIN c ON c.conv_id = p.conv_id AND c.idx = p.idx + 1),
    stored AS (
        SELECT conv_id, CAST(idx AS INTEGER) AS idx, id AS revision_id,
               CASE WHEN k = 2 AND turn = 1 THEN repeat('0', 64) ELSE parent END AS parent_id, k, turn,
               '{"n":' || (n + CASE WHEN k = 1 AND turn = 1 THEN 1 ELSE 0 END) || ',"turn":' || turn || '}' AS state,
               last_value(id) OVER (PARTITION BY conv_id ORDER BY idx
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_revision_id
        FROM chain JOIN c USING (conv_id, idx))"""

ORACLES = {
    "revision_documents": _REVISIONS + """
    SELECT conv_id, idx, revision_id, parent_id, state, current_revision_id, CAST(NULL AS VARCHAR) AS reason
    FROM stored""",
    "revision_audit": _REVISIONS + """
    SELECT conv_id AS project_id, revision_id,
           CASE WHEN k IN (1, 2) AND turn = 1 THEN 'wrong_id' WHEN k IN (1, 2) AND turn > 1 THEN 'behind_wrong_id'
                ELSE 'ok' END AS verdict FROM stored""",
    "revision_depths": with_views("revisions", recursive=True)
    + f", {_BROKEN} SELECT project_id, revision_id, depth, ending FROM ends",
    "head_ancestry": with_views("revisions", recursive=True)
    + f""", {_CLOSURE} SELECT u.* FROM up u WHERE NOT EXISTS (
        SELECT 1 FROM revisions r WHERE r.project_id = u.project_id AND r.parent_id = u.revision_id)""",
    "revision_ancestry": with_views("revisions", recursive=True)
    + f", {_CLOSURE} SELECT * FROM up",
    "ancestor_pairs": with_views("revisions", recursive=True)
    + f""", {_CLOSURE}, pairs AS (
        SELECT DISTINCT project_id, revision_id,
               unnest([revision_id, revision_id // 2, greatest(revision_id - 3, 0),
                       revision_id + 1]) AS ancestor_id FROM revisions)
    SELECT project_id, revision_id, ancestor_id, distance IS NOT NULL AS is_ancestor
    FROM pairs LEFT JOIN up USING (project_id, revision_id, ancestor_id)""",
    "revision_heads": with_views("revisions")
    + """ SELECT r.project_id, r.revision_id, count(c.revision_id) AS children,
               count(c.revision_id) = 0 AS is_head
          FROM revisions r LEFT JOIN revisions c ON c.project_id = r.project_id
              AND c.parent_id = r.revision_id GROUP BY ALL""",
    "graph_violations": with_views("revisions", recursive=True)
    + f""", {_BROKEN}, cur AS (
        SELECT project_id, max(revision_id) + CASE WHEN project_id % 3 = 0 THEN 1 ELSE 0 END AS rev
        FROM broken GROUP BY project_id),
    totals AS (SELECT project_id, count(*) AS n, count(*) FILTER (parent_id IS NULL) AS roots
               FROM broken GROUP BY 1)
    SELECT project_id, 'root_count' AS rule, roots AS n FROM totals WHERE roots <> 1
    UNION ALL SELECT project_id, 'node_limit', n FROM totals WHERE n > 7
    UNION ALL SELECT project_id, 'duplicate_id', count(*) FROM (
        SELECT project_id, revision_id FROM broken GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
    UNION ALL SELECT project_id, ending, count(*) FROM ends WHERE ending <> 'root' GROUP BY ALL
    UNION ALL SELECT project_id, 'missing_current', 1 FROM cur c WHERE NOT EXISTS (
        SELECT 1 FROM broken b WHERE b.project_id = c.project_id AND b.revision_id = c.rev)
    UNION ALL SELECT project_id, 'wrong_id', count(*) FROM broken
        WHERE project_id % 17 = 0 AND revision_id = 1 GROUP BY 1""",
    "dag_levels": f"WITH RECURSIVE {_DAG} SELECT * FROM levels",
    "dag_cycles": f"""WITH RECURSIVE {_DAG}, goes(graph_id, a, b) AS (
        SELECT graph_id, name, dependency FROM deps
        UNION SELECT r.graph_id, r.a, d.dependency FROM goes r
        JOIN deps d ON d.graph_id = r.graph_id AND d.name = r.b),
    looped AS (SELECT r.graph_id, r.a AS name, min(r.b) AS cycle FROM goes r
        JOIN goes q ON q.graph_id = r.graph_id AND q.a = r.b AND q.b = r.a GROUP BY 1, 2)
    SELECT graph_id, name, cycle FROM levels LEFT JOIN looped USING (graph_id, name) WHERE level IS NULL""",
    "dag_violations": f"""WITH RECURSIVE {_DAG}
    SELECT graph_id, 'self_dependency' AS rule, count(*) AS n FROM deps WHERE name = dependency
        GROUP BY 1
    UNION ALL SELECT graph_id, 'missing_dependency', count(*) FROM deps d WHERE NOT EXISTS (
        SELECT 1 FROM nodes n WHERE n.graph_id = d.graph_id AND n.name = d.dependency) GROUP BY 1
    UNION ALL SELECT graph_id, 'unordered', count(*) FROM levels WHERE level IS NULL GROUP BY 1
    UNION ALL SELECT graph_id, 'masked_not_unary', count(*) FROM (
        SELECT d.graph_id, d.name FROM deps d JOIN nodes n USING (graph_id, name) WHERE masked
        GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
    UNION ALL SELECT graph_id, 'terminal_count', terminals FROM (
        SELECT graph_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM deps d
            WHERE d.graph_id = n.graph_id AND d.dependency = n.name)) AS terminals
        FROM nodes n GROUP BY 1) WHERE terminals <> 1""",
    "dag_run": with_views("pixels")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, "
    + ", ".join(
        f"round(({c} * 2 + (CAST(0.1 AS DOUBLE) + {c} * CAST(0.8 AS DOUBLE))) / 2, 6) AS {c}"
        for c in "rgb"
    )
    + ", round(a, 6) AS a FROM pixels",
    "history_fold": f"""WITH RECURSIVE {_LOG}, ops AS (
        SELECT project_id, seq, event_id, CASE event_type WHEN 'click' THEN 'undo'
               WHEN 'error' THEN 'redo' ELSE 'execute' END AS op FROM log),
    fold AS (
        SELECT project_id, CAST(0 AS BIGINT) AS seq, '' AS op, true AS valid,
               CAST([] AS BIGINT[]) AS undo, CAST(NULL AS BIGINT) AS cur, CAST([] AS BIGINT[]) AS redo
        FROM (SELECT DISTINCT project_id FROM log)
        UNION ALL
        SELECT f.project_id, o.seq, o.op,
               CASE o.op WHEN 'execute' THEN true WHEN 'undo' THEN len(undo) > 0
                    ELSE len(redo) > 0 END,
               CASE WHEN o.op = 'execute' THEN list_append(undo, cur)
                    WHEN o.op = 'undo' AND len(undo) > 0 THEN undo[1:len(undo) - 1]
                    WHEN o.op = 'redo' AND len(redo) > 0 THEN list_append(undo, cur)
                    ELSE undo END,
               CASE WHEN o.op = 'execute' THEN o.event_id
                    WHEN o.op = 'undo' AND len(undo) > 0 THEN undo[len(undo)]
                    WHEN o.op = 'redo' AND len(redo) > 0 THEN redo[len(redo)] ELSE cur END,
               CASE WHEN o.op = 'execute' THEN CAST([] AS BIGINT[])
                    WHEN o.op = 'undo' AND len(undo) > 0 THEN list_append(redo, cur)
                    WHEN o.op = 'redo' AND len(redo) > 0 THEN redo[1:len(redo) - 1]
                    ELSE redo END
        FROM fold f JOIN ops o ON o.project_id = f.project_id AND o.seq = f.seq + 1)
    SELECT project_id, seq, op, valid, CAST(len(undo) AS BIGINT) AS depth, cur AS current_id
    FROM fold WHERE seq > 0""",
    "transform_fold": f"""WITH RECURSIVE {_LOG}, {_ARGS}
    SELECT project_id, seq, error, array_to_string(crop, ',') AS crop, round(scale, 6) AS scale,
           round(rotation, 6) + 0.0 AS rotation, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y
    FROM fold WHERE seq > 0""",
    "replay_audit": f"""WITH {_LOG}, {_OPS} SELECT workflow_id, idx,
        CASE WHEN failed_at IS NULL OR idx < failed_at THEN 'committed'
             WHEN idx = failed_at THEN 'failed' ELSE 'not_attempted' END AS status
        FROM ops JOIN firsts USING (workflow_id)""",
    "replay_summary": f"""WITH {_LOG}, {_OPS} SELECT workflow_id, failed_at,
        count(*) FILTER (failed_at IS NULL OR idx < failed_at) AS committed,
        count(*) AS operations FROM ops JOIN firsts USING (workflow_id) GROUP BY ALL""",
    "replay_resolved": f"""WITH {_LOG}, sums AS (
        SELECT project_id AS workflow_id, seq - 1 AS idx,
               sum(value) OVER (PARTITION BY project_id ORDER BY seq) AS total FROM log),
    firsts AS (SELECT workflow_id, min(idx) FILTER (total > 600) AS failed_at FROM sums GROUP BY 1)
    SELECT workflow_id, idx,
           CASE WHEN failed_at IS NULL OR idx < failed_at THEN 'committed'
                WHEN idx = failed_at THEN 'failed' ELSE 'not_attempted' END AS status,
           CASE WHEN idx = failed_at THEN 'ValueError: limit' END AS error
    FROM sums JOIN firsts USING (workflow_id)""",
    "layer_fold": f"""WITH RECURSIVE {_LOG}, cmds AS (
        SELECT project_id, seq,
               CASE WHEN event_id % 40 = 0 THEN 'replace' WHEN event_type = 'signup' THEN 'add'
                    WHEN event_type = 'view' THEN 'reorder' WHEN event_type = 'click' THEN 'duplicate'
                    WHEN event_type = 'purchase' THEN 'opacity' ELSE 'remove' END AS command,
               'L' || CAST(floor(value) AS BIGINT) % CASE WHEN event_type = 'signup' THEN 12 ELSE 8 END
                   AS id,
               'L' || (seq + 100) AS new_id, value % CAST(1.1 AS DOUBLE) <= 1 AS ok,
               CAST(floor(value) AS BIGINT) % 4 + 1 AS a, seq % 3 + 1 AS b,
               CASE WHEN CAST(floor(value) AS BIGINT) % 3 <> 1
                    THEN ['L1', 'L' || CAST(floor(value) AS BIGINT) % 3] END AS fresh
        FROM log),
    fold AS (
        SELECT project_id, CAST(0 AS BIGINT) AS seq, '' AS command, CAST(NULL AS VARCHAR) AS error,
               CAST([] AS VARCHAR[]) AS stack
        FROM (SELECT DISTINCT project_id FROM log)
        UNION ALL
        SELECT project_id, seq, command, error, CASE WHEN error IS NOT NULL THEN stack
            WHEN command = 'replace' THEN fresh WHEN command = 'add' THEN list_append(stack, id)
            WHEN command = 'remove' THEN list_filter(stack, lambda v: v <> id)
            WHEN command = 'reorder' THEN list_concat(list_concat(rest[1:b - 1], [stack[a]]),
                                                      rest[b:len(stack)])
            WHEN command = 'duplicate' THEN list_concat(list_append(stack[1:pos], new_id),
                                                        stack[pos + 1:len(stack)])
            ELSE stack END
        FROM (SELECT *, list_concat(stack[1:a - 1], stack[a + 1:len(stack)]) AS rest,
                     CASE command WHEN 'replace' THEN
                              CASE WHEN fresh IS NULL THEN 'invalid_stack' END
                          WHEN 'add' THEN CASE WHEN NOT ok THEN 'invalid_layer'
                              WHEN pos > 0 THEN 'duplicate_layer' END
                          WHEN 'reorder' THEN
                              CASE WHEN greatest(a, b) > len(stack) THEN 'index' END
                          ELSE CASE WHEN pos = 0 THEN 'unknown_layer'
                              WHEN command = 'opacity' AND NOT ok THEN 'invalid_value' END END
                          AS error
              FROM (SELECT f.stack, c.*, coalesce(list_position(f.stack, c.id), 0) AS pos
                    FROM fold f JOIN cmds c ON c.project_id = f.project_id AND c.seq = f.seq + 1)))
    SELECT project_id, seq, command, error,
           count(*) FILTER (error IS NULL) OVER (PARTITION BY project_id ORDER BY seq) AS revision,
           array_to_string(stack, ',') AS stack
    FROM fold WHERE seq > 0""",
}
