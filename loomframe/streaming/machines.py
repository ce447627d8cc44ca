"""State machines of jobs and deliveries over event streams.

With a delay, events are held per key until the watermark has passed them and are then
replayed in event time, whatever batches they came in. Held events lie in map state as sorted
runs of ``SLOT`` events at most, and the machine's own state is one tuple per key that also
lists the runs with their time range and the one timer that is set. So a batch costs a key a
few calls of the state store, however many events and time buckets it has, and a timer reads
the due runs only. Keys that have ended, or that have been silent for long, lose their state
by timer. What is still held when the input ends is replayed from the state store by ``drain``.

The rules of a machine are plain functions on that tuple, shared by the stream and the drain.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from loomframe.operators.folds import fold_rows
from loomframe.operators.jobs import TRANSITIONS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

JOB_OUTPUT = (
    "job_id BIGINT, ts_us BIGINT, event_id BIGINT, before STRING, after STRING, "
    "verdict STRING, attempt INT"
)
DELIVERY_OUTPUT = (
    "job_id BIGINT, artifact_id BIGINT, event_id BIGINT, before STRING, after STRING, "
    "verdict STRING, attempt INT"
)
#: Events of a run, and events of a key that are taken from a batch at once.
SLOT = 256
TAKEN = 4096
#: Held events are replayed when the watermark passes the end of their time bucket.
BUCKET_MS = 600_000

State = tuple[str | None, int, int | None]


class JobRules:
    """Job status events; a lease that runs out without an end requeues the job."""

    keys = ("job_id",)
    value = "status"
    output = JOB_OUTPUT

    def __init__(self, lease_seconds: int, max_attempts: int) -> None:
        self._lease_us = lease_seconds * 1_000_000
        self._max_attempts = max_attempts

    def on_deadline(self, key: tuple, state: State) -> tuple[State, tuple]:
        _, attempt, lease = state
        after = "failed" if attempt >= self._max_attempts else "queued"
        return (after, attempt, None), (key[0], lease, None, "processing", after, "lease_expired", attempt)

    def on_event(self, key: tuple, state: State, ts_us: int, event_id: int, value: str) -> tuple[State, list[tuple]]:
        rows = []
        if state[2] is not None and state[2] <= ts_us:
            state, expired = self.on_deadline(key, state)
            rows.append(expired)
        before, attempt, lease = state
        if before is None:
            verdict = "initial"
        elif before == value:
            verdict = "unchanged"
        elif value in TRANSITIONS.get(before, ()):
            verdict = "legal"
        elif before == "queued" and value == "created":
            verdict = "rollback"
        else:
            verdict = "illegal"
        after = before
        if verdict in ("initial", "legal", "rollback"):
            after, lease = value, None
            if value == "processing":
                attempt, lease = attempt + 1, ts_us + self._lease_us
        rows.append((key[0], ts_us, event_id, before, after, verdict, attempt))
        return (after, attempt, lease), rows

    def ended(self, state: State) -> bool:
        return state[0] is not None and not TRANSITIONS.get(state[0])


class DeliveryRules:
    """One delivery per identity; nothing is ever sent twice."""

    keys = ("job_id", "artifact_id")
    value = "state"
    output = DELIVERY_OUTPUT

    def __init__(self, max_attempts: int) -> None:
        self._max_attempts = max_attempts

    def _decide(self, state: str | None, attempt: int, event: str) -> tuple[str | None, int, str]:
        if state is None:
            return ("intent", 1, "send") if event == "intent" else (None, 0, "no_intent")
        if event == "intent":
            if state == "failed":
                if attempt < self._max_attempts:
                    return "intent", attempt + 1, "retry"
                return state, attempt, "give_up"
            # An intent seen again may already have been sent; nobody can tell.
            known = {"intent": ("unknown", "hold"), "sent": ("sent", "skip_sent")}
            after, verdict = known.get(state, (state, "hold" if state == "unknown" else "give_up"))
            return after, attempt, verdict
        if state == "intent" and event in ("sent", "failed", "unknown"):
            return event, attempt, event
        if state == "failed" and event == "terminal":
            return event, attempt, event
        return state, attempt, "illegal"

    def on_event(self, key: tuple, state: State, ts_us: int, event_id: int, value: str) -> tuple[State, list[tuple]]:
        before, attempt, _ = state
        after, attempt, verdict = self._decide(before, attempt, value)
        return (after, attempt, None), [(*key, event_id, before, after, verdict, attempt)]

    def ended(self, state: State) -> bool:
        return state[0] in ("sent", "terminal")


_STATE = "status STRING, attempt INT, deadline_us BIGINT, last_us BIGINT"
_RUNS = "runs ARRAY<STRUCT<first_us: BIGINT, last_us: BIGINT, n: INT, slot: BIGINT>>"
_HELD = "events ARRAY<STRUCT<ts_us: BIGINT, event_id: BIGINT, value: STRING>>"


def _ends(ts_us: int) -> int:
    """End of the time bucket of an event."""
    return (ts_us // (BUCKET_MS * 1000) + 1) * BUCKET_MS


def _level(ts_us: int, now_ms: int) -> int:
    """How far an event lies behind the watermark, in powers of two of buckets."""
    return max(0, (ts_us // 1000 - now_ms) // BUCKET_MS).bit_length()


class Machine(StatefulProcessor):
    """Replays the events of a key by its rules once the watermark has passed them.

    ``keep_ms`` after its last event an ended key is forgotten, ``forget_ms`` after it any
    key; None keeps them. An event behind that starts the key anew.

    A run covers events of one level, so what the watermark cuts off and writes again is at
    most as wide as its distance, and an event is written again once per level at most.
    """

    def __init__(self, rules: Any, keep_ms: int | None, forget_ms: int | None) -> None:
        self._rules, self._keep_ms, self._forget_ms = rules, keep_ms, forget_ms
        names = [field.split()[0] for field in rules.output.split(", ")]
        self._row = Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", f"{_STATE}, timer_ms BIGINT, {_RUNS}")
        self._held = handle.getMapState("held", "slot BIGINT", _HELD)

    def _load(self) -> tuple[State, int | None, int | None, list[tuple]]:
        """State of the key, time of its last event, its timer and its runs."""
        status, attempt, deadline, last, timer, runs = self._state.get() or (None, 0, None, None, None, None)
        return (status, attempt, deadline), last, timer, [tuple(run) for run in runs or ()]

    def _take(self, run: tuple) -> list[tuple]:
        return [tuple(event) for event in self._held.getValue((run[3],))[0]]

    def _hold(self, runs: list[tuple], events: list[tuple], now_ms: int) -> None:
        """Add events to the runs of the key; one run per level is filled up."""
        levels: dict[int, list[tuple]] = {}
        for event in events:
            levels.setdefault(_level(event[0], now_ms), []).append(event)
        for level, new in levels.items():
            for run in runs:
                inside = _level(run[0], now_ms) == level == _level(run[1], now_ms)
                if inside and run[2] + len(new) <= SLOT:
                    new = self._take(run) + new
                    runs.remove(run)
                    self._held.removeKey((run[3],))
                    break
            new.sort()
            for start in range(0, len(new), SLOT):
                part = new[start : start + SLOT]
                slot = max((run[3] for run in runs), default=-1) + 1
                self._held.updateValue((slot,), (part,))
                runs.append((part[0][0], part[-1][0], len(part), slot))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues):
        now_ms = timerValues.getCurrentWatermarkInMs()
        state, last, timer, runs = self._load()
        taken: list[tuple] = []
        for row in rows:
            taken.append((row.ts_us, row.event_id, row.value))
            if len(taken) == TAKEN:
                self._hold(runs, taken, now_ms)
                taken = []
        self._hold(runs, taken, now_ms)
        due = _ends(min(run[0] for run in runs))
        if timer is None or due < timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(due)
            timer = due
        self._state.update((*state, last, timer, runs))
        return iter(())

    def _due(self, runs: list[tuple], until_us: int) -> Iterator[tuple]:
        """Held events before a time, in order; they leave the state and the runs."""
        ready = sorted(run for run in runs if run[0] < until_us)
        heap: list[tuple] = []
        later: list[tuple] = []
        for run in ready:
            # No run that is still to come has events before the start of this one.
            while heap and heap[0][0] < run[0]:
                yield heapq.heappop(heap)
            for event in self._take(run):
                if event[0] < until_us:
                    heapq.heappush(heap, event)
                else:
                    later.append(event)
            self._held.removeKey((run[3],))
            runs.remove(run)
        if later:
            self._hold(runs, later, until_us // 1000)
        while heap:
            yield heapq.heappop(heap)

    def handleExpiredTimer(
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ):
        now_ms = timerValues.getCurrentWatermarkInMs()
        state, last, _, runs = self._load()
        for event in self._due(runs, now_ms * 1000):
            state, rows = self._rules.on_event(tuple(key), state, *event)
            last = event[0]
            yield from (self._row(*row) for row in rows)
        if state[2] is not None and state[2] // 1000 + 1 <= now_ms:
            state, row = self._rules.on_deadline(tuple(key), state)
            yield self._row(*row)
        times = [_ends(min(run[0] for run in runs))] if runs else []
        if last is not None:
            limits = [self._forget_ms, self._keep_ms if self._rules.ended(state) else None]
            leaves = min((last // 1000 + x + 1 for x in limits if x is not None), default=None)
            if leaves is not None and leaves <= now_ms:
                state, last = (None, 0, None), None
            else:
                times += [x for x in (leaves, state[2] and state[2] // 1000 + 1) if x is not None]
        if last is None and not runs:
            self._state.clear()
            return
        timer = min(times, default=None)
        if timer is not None:
            self._handle.registerTimer(timer)
        self._state.update((*state, last, timer, runs))

    def close(self) -> None:
        pass


class AtOnce(StatefulProcessor):
    """Handles events in the order in which their batches come; nothing is held."""

    def __init__(self, rules: Any) -> None:
        self._rules = rules
        self._row = Row(*[field.split()[0] for field in rules.output.split(", ")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues):
        state = tuple(self._state.get())[:3] if self._state.exists() else (None, 0, None)
        for row in sorted(rows, key=lambda r: (r.ts_us, r.event_id)):
            state, made = self._rules.on_event(tuple(key), state, row.ts_us, row.event_id, row.value)
            yield from (self._row(*m) for m in made)
        if state[0] is not None:
            self._state.update((*state, None))

    def close(self) -> None:
        pass


def _timed(events: DataFrame, rules: Any) -> DataFrame:
    return events.select(
        *rules.keys, "event_id", "ts", F.unix_micros("ts").alias("ts_us"), F.col(rules.value).alias("value")
    )


def _followed(
    events: DataFrame, rules: Any, delay: str, keep_seconds: int | None, forget_seconds: int | None
) -> DataFrame:
    millis = lambda s: None if s is None else s * 1000
    machine = Machine(rules, millis(keep_seconds), millis(forget_seconds))
    timed = _timed(events.withWatermark("ts", delay), rules)
    return timed.groupBy(*rules.keys).transformWithState(machine, rules.output, "Append", "EventTime")


def stream_jobs(
    events: DataFrame,
    delay: str,
    lease_seconds: int = 600,
    max_attempts: int = 3,
    keep_seconds: int | None = None,
    forget_seconds: int | None = None,
) -> DataFrame:
    """``events``: ``job_id BIGINT, event_id, ts, status``."""
    return _followed(events, JobRules(lease_seconds, max_attempts), delay, keep_seconds, forget_seconds)


def stream_deliveries(
    events: DataFrame,
    max_attempts: int = 3,
    delay: str | None = None,
    keep_seconds: int | None = None,
    forget_seconds: int | None = None,
) -> DataFrame:
    """``events``: ``job_id, artifact_id, event_id, ts, state``.

    Without a delay batches are taken in the order in which they come.
    """
    rules = DeliveryRules(max_attempts)
    if delay is not None:
        return _followed(events, rules, delay, keep_seconds, forget_seconds)
    return _timed(events, rules).groupBy(*rules.keys).transformWithState(
        AtOnce(rules), rules.output, "Append", "None"
    )


def drain(session: SparkSession, checkpoint: str, rules: Any) -> DataFrame:
    """Rows that the events still held by an ended run give, read from its state store.

    ``checkpoint`` is that of a finished query with a state; deadlines that lie behind the
    last event of their key are left to the stream.
    """

    def read(name: str) -> DataFrame:
        reader = session.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
        return (reader.option("flattenCollectionTypes", "true") if name == "held" else reader).load()

    keys = list(rules.keys)
    held = read("held").select("key.*", F.inline("user_map_value.events"))
    states = read("state").select("key.*", "value.status", "value.attempt", "value.deadline_us")
    # A key has one state row and few held events, so the join is between narrow rows.
    joined = held.join(states, keys, "left")

    def step(state: dict, row: Any) -> tuple:
        key = tuple(int(getattr(row, k)) for k in keys)
        if "now" not in state:
            known = isinstance(row.status, str)
            deadline = row.deadline_us
            state["now"] = (
                row.status if known else None,
                int(row.attempt) if known else 0,
                int(deadline) if known and deadline == deadline and deadline is not None else None,
            )
        state["now"], rows = rules.on_event(key, state["now"], row.ts_us, row.event_id, row.value)
        return (rows,)

    kinds = rules.output.replace(" BIGINT", ": BIGINT").replace(" STRING", ": STRING").replace(" INT", ": INT")
    folded = fold_rows(joined, keys, ["ts_us", "event_id"], dict, step, f"made ARRAY<STRUCT<{kinds}>>")
    return folded.select(F.inline("made"))
