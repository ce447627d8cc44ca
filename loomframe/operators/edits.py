"""Edit logs: undo and redo, layer commands, transform commands and workflow replay."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.folds import fold_rows, sorted_runs
from loomframe.operators.piecewise import Effect
from loomframe.operators.ordered import attach, id_block, last_known, ordered_pass, running_sums
from loomframe.session import cut_lineage

CHUNK = 1024
MAX_LAYERS = 256
BLEND_MODES = ("normal", "multiply", "screen", "overlay")
LAYER = "STRUCT<layer_id: STRING, source_id: STRING, opacity: DOUBLE, visible: BOOLEAN, blend_mode: STRING, mask: STRING>"


# --- undo and redo -------------------------------------------------------------------------


_EFFECT = (
    "shift BIGINT, low ARRAY<BIGINT>, high ARRAY<BIGINT>, depth ARRAY<BIGINT>, top ARRAY<BIGINT>"
)
_EFFECT_NAMES, _EFFECT_TYPES = zip(*(field.split() for field in _EFFECT.split(", ")))
#: Chunks whose effects are put together for the first level of the scan.
CHUNKS = 256


def _runs(batches: Iterator[pd.DataFrame], keys: Sequence[str], add: Callable, values: Sequence[str]):
    """One effect per run of equal keys, grown row by row; rows come sorted."""
    current, held = None, None
    names = [*keys, *_EFFECT_NAMES]
    for batch in batches:
        done = []
        columns = [batch[c].tolist() for c in (*keys, *values)]
        for row in zip(*columns, strict=True):
            key = row[: len(keys)]
            if key != current:
                if current is not None:
                    done.append((*current, *add(held, None).row()))
                current, held = key, (Effect(), None, 0)
            held = add(held, row[len(keys) :])
        yield pd.DataFrame(done, columns=names)
    if current is not None:
        yield pd.DataFrame([(*current, *add(held, None).row())], columns=names)


def _add_operation(held: tuple[Effect, str | None, int], row: tuple | None):
    """Count equal operations together; without a row the effect is complete."""
    effect, op, n = held
    if row is not None and row[0] == op:
        return effect, op, n + 1
    if op is not None:
        effect = effect.run(op, n)
    return effect if row is None else (effect, row[0], 1)


def _add_effect(held: tuple[Effect, str | None, int], row: tuple | None):
    return held[0] if row is None else (held[0].then(Effect.of(*row)), None, 0)


def _chain(batches: Iterator[pd.DataFrame], keys: list[str], order: str, given: bool) -> Iterator[pd.DataFrame]:
    """Depth and top before each stretch, from the effects of those before it.

    ``given`` says that rows carry the state at the beginning of their key.
    """
    current, state = None, (0, 0)
    for batch in batches:
        starts = []
        for row in batch.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != current:
                current, state = key, ((int(row.at), int(row.redo)) if given else (0, 0))
            starts.append(state)
            state = Effect.of(*(getattr(row, n) for n in _EFFECT_NAMES))(*state)
        yield pd.DataFrame(
            {
                **{k: batch[k] for k in ("project_id", order)},
                "at": [p for p, _ in starts],
                "redo": [t for _, t in starts],
            }
        )


def _replay_step(state: dict[str, int], row: Any) -> tuple[int, bool]:
    """One operation from the known position."""
    at = state.setdefault("at", row.at)
    top = state.setdefault("top", row.redo)
    if row.op == "execute":
        valid, at, top = True, at + 1, at + 1
    elif row.op == "undo":
        valid = at > 0
        at -= valid
    else:
        valid = at < top
        at += valid
    state.update(at=at, top=top)
    return at, valid


def fold_history(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Current revision after each execute, undo or redo of a project.

    ``log``: ``project_id, seq, op, revision_id``. An undo or redo with nothing to go
    to is reported by ``valid`` and changes nothing. ``depth`` is the number of steps
    that can be undone; at depth 0 the current revision is null (the initial state).

    A log is cut into chunks of ``chunk`` numbers. Each one's effect on depth and redo
    depth is worked out for every state it may meet (``piecewise.Effect``), the effects of
    ``CHUNKS`` chunks are composed, and the states before those groups, then before their chunks, follow from
    them. Each chunk is replayed from its true start, so one long log is spread over
    many tasks; a project's own task sees one row per group.
    """
    block = id_block("seq", chunk)
    # Read by two steps below, so it is written once.
    chunked = cut_lineage(
        log.select("project_id", "seq", "op", "revision_id", block.alias("chunk"))
    )
    project = f"project_id {dict(log.dtypes)['project_id']}"
    piece, group = ["project_id", "chunk"], ["project_id", "group"]
    names = [*_EFFECT_NAMES]
    # Only what lies before another chunk needs an effect; a project's last chunk has none.
    spans = chunked.groupBy("project_id").agg(F.min("chunk").alias("_first"), F.max("chunk").alias("_last"))
    several = cut_lineage(spans.filter("_last > _first").select("project_id", "_last"))
    before = attach(chunked.select(*piece, "seq", "op"), several, ["project_id"], F.col("seq"), how="inner")
    before = before.filter(F.col("chunk") < F.col("_last")).drop("_last")
    effects = sorted_runs(before, piece, ["seq"]).mapInPandas(
        lambda b: _runs(b, piece, _add_operation, ["op"]), f"{project}, chunk BIGINT, {_EFFECT}"
    )
    nothing = [F.lit(v).cast(t) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast(t) for v, t in zip(Effect().row(), _EFFECT_TYPES)]
    ends = several.select("project_id", F.col("_last").alias("chunk"), *[c.alias(n) for c, n in zip(nothing, names)])
    effects = cut_lineage(
        effects.unionByName(ends).withColumn("group", F.floor(F.col("chunk") / F.lit(CHUNKS)).cast("bigint"))
    )
    groups = sorted_runs(effects, group, ["chunk"]).mapInPandas(
        lambda b: _runs(b, group, _add_effect, names), f"{project}, group BIGINT, {_EFFECT}"
    )
    state = "at BIGINT, redo BIGINT"
    ahead = sorted_runs(groups, ["project_id"], ["group"]).mapInPandas(
        lambda b: _chain(b, ["project_id"], "group", False), f"{project}, group BIGINT, {state}"
    )
    starts = sorted_runs(effects.join(ahead, group), group, ["chunk"]).mapInPandas(
        lambda b: _chain(b, group, "chunk", True), f"{project}, chunk BIGINT, {state}"
    )
    known = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("at", "redo")}
    placed = chunked.join(starts, piece, "left").withColumns(known)
    replayed = cut_lineage(
        fold_rows(placed, piece, ["seq"], dict, _replay_step, "depth BIGINT, valid BOOLEAN")
    )
    # The node at a depth is the latest one that was executed onto it.
    landed = F.when(F.col("op") == "execute", F.col("revision_id"))
    current = last_known(
        replayed, ["project_id", "depth"], ["seq"], block, {"current_id": landed}
    )
    return current.select(
        "project_id",
        "seq",
        "op",
        "valid",
        "depth",
        F.when(F.col("depth") > 0, F.col("current_id")).alias("current_id"),
    )


# --- layer commands ------------------------------------------------------------------------


def _layer_step(state: dict[str, Any], row: Any) -> tuple[str | None, list[dict]]:
    """Apply one command to the list of layers; a broken rule leaves it unchanged."""
    layers: list[dict] = state["layers"]
    at = next((i for i, v in enumerate(layers) if v["layer_id"] == row.layer_id), None)
    error = None
    command = row.command
    if command == "replace":
        if row.replaces:
            state["layers"] = [dict(v) for v in row.layers]
        else:
            error = "invalid_stack"
    elif command == "add":
        added = {name: getattr(row, name) for name in _LAYER_FIELDS}
        if not row.layer_ok:
            error = "invalid_layer"
        elif at is not None:
            error = "duplicate_layer"
        elif len(layers) >= MAX_LAYERS:
            error = "layer_limit"
        else:
            layers.append(added)
    elif command == "reorder":
        size = len(layers)
        source, target = row.from_pos, row.to_pos
        if not (_within(source, size) and _within(target, size)):
            error = "index"
        else:
            layers.insert(int(target), layers.pop(int(source)))
    elif at is None:
        error = "unknown_layer"
    elif command == "remove":
        layers.pop(at)
    elif command == "duplicate":
        taken = any(v["layer_id"] == row.new_layer_id for v in layers)
        if row.new_layer_id is None:
            error = "invalid_layer"
        elif len(layers) >= MAX_LAYERS:
            error = "layer_limit"
        elif taken:
            error = "duplicate_layer"
        else:
            layers.insert(at + 1, {**layers[at], "layer_id": row.new_layer_id})
    elif command == "visibility":
        if row.visible is None:
            error = "invalid_value"
        else:
            layers[at] = {**layers[at], "visible": bool(row.visible)}
    elif command == "opacity":
        if not row.opacity_ok:
            error = "invalid_value"
        else:
            layers[at] = {**layers[at], "opacity": float(row.opacity)}
    elif command == "blend":
        if row.blend_mode not in BLEND_MODES:
            error = "invalid_value"
        else:
            layers[at] = {**layers[at], "blend_mode": row.blend_mode}
    elif command == "set_mask":
        layers[at] = {**layers[at], "mask": row.mask}
    elif command == "update_mask":
        if layers[at]["mask"] is None:
            error = "no_mask"
        elif row.mask is None or _mask_identity(row.mask) != _mask_identity(layers[at]["mask"]):
            error = "mask_identity"
        else:
            layers[at] = {**layers[at], "mask": row.mask}
    else:
        error = "unknown_command"
    return error, [dict(v) for v in state["layers"]]


_LAYER_FIELDS = ("layer_id", "source_id", "opacity", "visible", "blend_mode", "mask")


def _within(value: Any, size: int) -> bool:
    return value is not None and not pd.isna(value) and 0 <= value < size


def _mask_identity(mask: str) -> tuple:
    data = json.loads(mask)
    return data.get("mask_id"), data.get("source_asset_id")


def fold_layers(log: DataFrame) -> DataFrame:
    """Layer stack after each command of a project.

    ``log``: ``project_id, seq, command`` and the arguments ``layer_id, new_layer_id,
    source_id, opacity, visible, blend_mode, mask, from_pos, to_pos, layers``. Invalid
    commands get an ``error`` and leave the stack as it was; every valid one raises the
    revision by one. A valid replacement makes the stack independent of everything
    before it, so logs are cut there and the pieces run in parallel.
    """
    in_range = lambda c: F.coalesce(c.between(0.0, 1.0), F.lit(False))
    mode_ok = lambda c: F.coalesce(c.isin(*BLEND_MODES), F.lit(False))
    ids = F.transform("layers", lambda v: v["layer_id"])
    sound = F.forall(
        "layers",
        lambda v: v["layer_id"].isNotNull()
        & v["source_id"].isNotNull()
        & v["visible"].isNotNull()
        & in_range(v["opacity"])
        & mode_ok(v["blend_mode"]),
    )
    replaces = (
        (F.col("command") == "replace")
        & F.col("layers").isNotNull()
        & (F.size("layers") <= MAX_LAYERS)
        & (F.size(F.array_distinct(ids)) == F.size("layers"))
        & sound
    )
    checked = log.withColumns(
        {
            "replaces": F.coalesce(replaces, F.lit(False)),
            "opacity_ok": in_range(F.col("opacity")),
            "layer_ok": F.col("layer_id").isNotNull()
            & F.col("source_id").isNotNull()
            & F.col("visible").isNotNull()
            & in_range(F.col("opacity"))
            & mode_ok(F.col("blend_mode")),
        }
    )
    cut = running_sums(
        checked,
        ["project_id"],
        ["seq"],
        id_block("seq"),
        {"piece": F.col("replaces").cast("bigint")},
    )
    folded = fold_rows(
        cut,
        ["project_id", "piece"],
        ["seq"],
        lambda: {"layers": []},
        _layer_step,
        f"error STRING, stack ARRAY<{LAYER}>",
    )
    # Numbering reads the result twice; the fold itself should run once.
    folded = cut_lineage(folded.select("project_id", "seq", "command", "error", "stack"))
    numbered = running_sums(
        folded,
        ["project_id"],
        ["seq"],
        id_block("seq"),
        {"revision": F.col("error").isNull().cast("bigint")},
    )
    return numbered.withColumn("n_layers", F.size("stack"))


# --- transform commands --------------------------------------------------------------------


#: Far more than the rounding of a project's sums.
NEAR_BOUND = 1e-6


def _transform_step(state: dict[str, Any], row: Any) -> tuple:
    """Add up turns and moves; a sum beyond its bound is refused."""
    error = row.error
    if error is None and row.command == "rotate":
        if abs(state["rotation"] + row.degrees) <= 360.0:
            state["rotation"] += row.degrees
        else:
            error = "rotation_range"
    elif error is None and row.command == "translate":
        x, y = state["x"] + row.dx, state["y"] + row.dy
        if abs(x) <= 320.0 and abs(y) <= 320.0:
            state["x"], state["y"] = x, y
        else:
            error = "position_range"
    return error, state["rotation"], state["x"], state["y"]


def fold_transforms(log: DataFrame) -> DataFrame:
    """Transform state after each command: crop and scale replace, the rest adds up.

    ``log``: ``project_id, seq, command`` (crop, scale, rotate, translate) with
    ``crop ARRAY<INT>, scale, degrees, dx, dy``. Where no running sum of a project ever
    leaves its bound, sums are all there is to it; projects that leave or nearly touch it are visited
    row by row, because a refused command does not count.
    """
    command = F.col("command")
    cx, cy, cw, ch = (F.get("crop", i) for i in range(4))
    box_ok = (
        (F.size("crop") == 4)
        & cx.between(0, 320)
        & cy.between(0, 320)
        & (cw >= 1)
        & (ch >= 1)
        & (cx + cw <= 320)
        & (cy + ch <= 320)
    )
    ok = (
        F.when(command == "crop", box_ok)
        .when(command == "scale", F.col("scale").between(0.01, 64.0))
        .when(command == "rotate", F.col("degrees").between(-360.0, 360.0))
        .when(
            command == "translate",
            F.col("dx").between(-320.0, 320.0) & F.col("dy").between(-320.0, 320.0),
        )
    )
    checked = log.withColumn(
        "error", F.when(~F.coalesce(ok, F.lit(False)), "invalid_arguments")
    )
    good = F.col("error").isNull()
    part = lambda kind, c: F.when(good & (command == kind), F.col(c)).otherwise(F.lit(0.0))
    latest = lambda kind, c: F.when(good & (command == kind), F.col(c))
    renamed = checked.withColumnsRenamed({"crop": "_crop", "scale": "_scale"})
    # Crop and scale never depend on the sums, so one pass gives all of them.
    passed = cut_lineage(
        ordered_pass(
            renamed,
            ["project_id"],
            ["seq"],
            id_block("seq"),
            sums={
                "rotation": part("rotate", "degrees"),
                "x": part("translate", "dx"),
                "y": part("translate", "dy"),
            },
            before={"crop": latest("crop", "_crop"), "scale": latest("scale", "_scale")},
        )
    )
    # Block sums may round otherwise than the fold, so what comes close to a bound is folded.
    edge = lambda bound: F.lit(bound - NEAR_BOUND)
    outside = (F.abs("rotation") > edge(360.0)) | (F.abs("x") > edge(320.0)) | (F.abs("y") > edge(320.0))
    bounded = passed.groupBy("project_id").agg(F.max(outside).alias("_outside"))
    routed = attach(passed, bounded, ["project_id"], F.col("seq"))
    simple = routed.filter(~F.col("_outside")).drop("_outside")
    strict = routed.filter("_outside").drop("_outside", "rotation", "x", "y")
    visited = fold_rows(
        strict,
        ["project_id"],
        ["seq"],
        lambda: {"rotation": 0.0, "x": 0.0, "y": 0.0},
        _transform_step,
        "refused STRING, rotation DOUBLE, x DOUBLE, y DOUBLE",
    )
    visited = visited.withColumn("error", F.col("refused")).drop("refused")
    whole = F.array(F.lit(0), F.lit(0), F.lit(320), F.lit(320))
    return simple.unionByName(visited).select(
        "project_id",
        "seq",
        "command",
        "error",
        F.coalesce("crop", whole).alias("crop"),
        F.coalesce("scale", F.lit(1.0)).alias("scale"),
        "rotation",
        "x",
        "y",
    )


# --- workflow replay -----------------------------------------------------------------------


def replay_audit(ops: DataFrame) -> DataFrame:
    """Which operations of each workflow were committed.

    ``ops``: ``workflow_id, idx, failed``. Everything before the first failure is
    committed, everything after it was not attempted.
    """
    first = ops.groupBy("workflow_id").agg(
        F.min(F.when(F.col("failed"), F.col("idx"))).alias("failed_at")
    )
    joined = attach(ops, first, ["workflow_id"], F.col("idx"))
    status = (
        F.when(F.col("failed_at").isNull() | (F.col("idx") < F.col("failed_at")), "committed")
        .when(F.col("idx") == F.col("failed_at"), "failed")
        .otherwise("not_attempted")
    )
    return joined.withColumn("status", status)


def replay_summary(ops: DataFrame) -> DataFrame:
    """First failing index and the number of committed operations per workflow."""
    audited = replay_audit(ops)
    return audited.groupBy("workflow_id").agg(
        F.min("failed_at").alias("failed_at"),
        F.count_if(F.col("status") == "committed").alias("committed"),
        F.count("*").alias("operations"),
    )


def replay_with(
    ops: DataFrame, start: Callable[[], Any], resolver: Callable[[Any, Any], Any]
) -> DataFrame:
    """Replay each workflow through a user function ``resolver(state, row) -> state``.

    The first operation on which it raises fails; later ones are not attempted.
    """

    def step(box: dict[str, Any], row: Any) -> tuple:
        if box["stopped"]:
            return "not_attempted", None
        try:
            box["state"] = resolver(box["state"], row)
        except Exception as error:  # the user's failure is the result of this row
            box["stopped"] = True
            return "failed", f"{type(error).__name__}: {error}"
        return "committed", None

    return fold_rows(
        ops,
        ["workflow_id"],
        ["idx"],
        lambda: {"state": start(), "stopped": False},
        step,
        "status STRING, error STRING",
    )
