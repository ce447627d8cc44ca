"""Chat formatting from an event log, with DataFrame functions only.

A log holds, per message of a conversation, ordered events: ``open`` (gives the role),
``delta`` (appends a piece of streamed text), ``edit`` (replaces the text so far) and
``regenerate`` (drops the text so far; deltas of a new attempt follow). Folding keeps what
the last ``open``, ``edit`` or ``regenerate`` left and joins the deltas behind it.

Rendering puts each message between marks and escapes texts so that no mark can come from
a text: backslashes are doubled, then ``<|`` becomes ``<\\|``. That is reversible, as only
the second step leaves an odd run of backslashes between ``<`` and ``|``. Line ends inside
a role become a mark of their own.

The loss mask is kept as runs: per turn the code points to skip, to learn and to skip.

Conversations are put together in two steps, blocks of turns first, so that a very long
conversation is folded and rendered by many tasks; only its finished blocks meet.

Edge cases: null texts and roles are empty; a null turn sorts first; turns with equal
numbers sort by role, then text, and repeated rows stay separate turns; a null conversation
id is one conversation; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
LEARNT = "assistant"
#: Turns of one conversation that are rendered together.
BLOCK = 64
#: Code points of the drafts that derived logs replace later.
DRAFT = 8


def log_of(turns: DataFrame) -> DataFrame:
    """Event log of finished conversations (conv_id, turn, role, text).

    Assistant texts come as a draft that is regenerated and then streamed in two pieces,
    other texts as a draft that is edited into the whole text.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.ceil(F.length(text) / 2).cast("int")
    event = lambda seq, kind, piece: F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), piece.alias("piece")
    )
    nothing = F.lit("")
    draft = event(1, "delta", F.substring(text, 1, DRAFT))
    streamed = F.array(
        event(0, "open", nothing),
        draft,
        event(2, "regenerate", nothing),
        event(3, "delta", F.substr(text, F.lit(1), half)),
        event(4, "delta", F.substr(text, half + 1)),
    )
    edited = F.array(event(0, "open", nothing), draft, event(2, "edit", text))
    role = F.coalesce("role", F.lit(""))
    # The id is given before the events are spread out, so that they share it.
    named = turns.select(
        "conv_id",
        "turn",
        F.monotonically_increasing_id().alias("message"),
        role.alias("role"),
        F.when(role == LEARNT, streamed).otherwise(edited).alias("_events"),
    )
    return named.select("conv_id", "turn", "message", "role", F.inline("_events"))


def fold(events: Column) -> Column:
    """Text that the sorted events of one message leave."""
    reset = F.array_max(F.transform(F.filter(events, lambda e: e.kind != "delta"), lambda e: e.seq))
    kept = F.filter(
        events,
        lambda e: reset.isNull() | (e.seq > reset) | ((e.seq == reset) & (e.kind == "edit")),
    )
    return F.array_join(F.transform(kept, lambda e: e.piece), "")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def messages(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Final messages: conv_id, _block, turn, role, text; events of a block share a task."""
    placed = log.withColumn("_block", F.floor(F.col("turn") / block))
    # Grouping by more columns than the partitioning has needs no further shuffle.
    together = placed.repartition("conv_id", "_block")
    folded = together.groupBy("conv_id", "_block", "turn", "message").agg(
        F.max("role").alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", "kind", "piece"))).alias("_events"),
    )
    return folded.select("conv_id", "_block", "turn", "role", fold(F.col("_events")).alias("text"))


def render(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_runs`` (skip, take, rest per turn)."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE))
    text = escape(F.col("text"))
    shown = messages(log, block).select(
        "conv_id",
        "_block",
        F.struct("turn", "role", "text").alias("_order"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("_head"),
        text.alias("_body"),
    )
    learnt = F.col("_order.role") == LEARNT
    size = F.length("_body").cast("bigint")
    ready = shown.select(
        "conv_id",
        "_block",
        F.struct(
            "_order",
            F.concat("_head", "_body", F.lit(END)).alias("text"),
            F.struct(
                F.length("_head").cast("bigint").alias("skip"),
                F.when(learnt, size).otherwise(F.lit(0)).cast("bigint").alias("take"),
                (F.when(learnt, F.lit(0)).otherwise(size) + len(END)).cast("bigint").alias("rest"),
            ).alias("run"),
        ).alias("_turn"),
    )
    in_block = ready.groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    blocks = in_block.select(
        "conv_id",
        F.struct(
            "_block",
            F.array_join(F.transform("_turns", lambda t: t.text), "").alias("text"),
            F.transform("_turns", lambda t: t.run).alias("runs"),
        ).alias("_part"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("_parts", lambda p: p.text), "").alias("formatted"),
        F.flatten(F.transform("_parts", lambda p: p.runs)).alias("loss_runs"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` parsed from what ``render`` returns."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.size("loss_runs"))
    head = lambda p: F.instr(p, "\n")
    turns = F.transform(
        "_pieces",
        lambda p: F.struct(
            unescape(F.replace(F.substr(p, F.lit(1), head(p) - 1), F.lit(LINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(p, head(p) + 1, F.length(p) - head(p) - len(END))).alias("text"),
        ),
    )
    learnt = F.zip_with(
        "_pieces",
        "loss_runs",
        lambda p, r: F.when(
            r.take > 0, unescape(F.substr(p, (r.skip - len(START) + 1).cast("int"), r.take.cast("int")))
        ).otherwise(F.lit("")),
    )
    return (
        rendered.withColumn("_pieces", pieces)
        .withColumns({"turns": turns, "loss_text": F.array_join(learnt, "")})
        .drop("_pieces")
    )
