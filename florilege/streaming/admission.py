"""Admission of requests: pause, daily cap, sliding-window cap and spacing, on a ladder that refusals climb and clean runs descend.

One step function serves the batch replay and the stateful stream. Time is event time, so both agree. A key's state is
forgotten `FORGET_S` after its last event: the stream lets go of it then, and both start anew with the key's next event."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_S, DAY_S, DAY_MOST = 600, 86_400, 150
#: Fixed values: (seconds between requests, most in a window) by level.
LADDER = ((6.0, 20), (12.0, 10), (30.0, 6), (60.0, 3))
CLEAN_TO_DESCEND, INCIDENTS_KEPT = 100, 30
#: Seconds without an event after which a key is as if new; longer than any pause.
FORGET_S = 30 * DAY_S
#: Pauses in seconds by what a response was.
PAUSES = {"blocked": 6 * 3600, "challenge": 24 * 3600, "error": 30 * 60, "unreadable": 3600, "timeout": 0}


@dataclass
class State:
    requests: list[float] = field(default_factory=list)
    paused_until: float = 0.0
    reason: str = ""
    incidents: list[dict] = field(default_factory=list)
    level: int = 0
    clean: int = 0
    last: float | None = None


def restored(text: str | None, now: float) -> State:
    """A state from its JSON, pruned to a day and clamped; what cannot be read is a pause at the top of the ladder."""
    if not text:
        return State()
    try:
        raw = json.loads(text)
        return State(
            [float(t) for t in raw["requests"] if 0 <= now - float(t) < DAY_S],
            float(raw.get("paused_until") or 0),
            str(raw.get("reason") or ""),
            [i for i in raw.get("incidents") or [] if isinstance(i, dict)][-INCIDENTS_KEPT:],
            min(max(int(raw.get("level") or 0), 0), len(LADDER) - 1),
            max(int(raw.get("clean") or 0), 0),
            None if raw.get("last") is None else float(raw["last"]),
        )
    except (ValueError, TypeError, KeyError, AttributeError):
        return State([], now + PAUSES["unreadable"], "unreadable state", [], len(LADDER) - 1, 0)


def classified(status: int, challenge: bool = False, timeout: bool = False) -> str:
    """What a response was, a key of PAUSES; an ordinary one is `ok`."""
    if timeout:
        return "timeout"
    if challenge:
        return "challenge"
    return "blocked" if status in (403, 429) else "ok" if 200 <= status < 300 else "error"


def asked(state: State, now: float) -> str:
    """`admitted`, or why not: `paused`, `day`, `window`, `spacing`. An admitted request is recorded."""
    state.requests = [t for t in state.requests if 0 <= now - t < DAY_S]
    spacing, most = LADDER[state.level]
    if state.paused_until > now:
        return "paused"
    if len(state.requests) >= DAY_MOST:
        return "day"
    if sum(now - t < WINDOW_S for t in state.requests) >= most:
        return "window"
    if state.requests and max(state.requests) + spacing > now:
        return "spacing"
    state.requests.append(now)
    return "admitted"


def answered(state: State, now: float, kind: str) -> None:
    """A clean answer counts towards the next step down; a refusal pauses, and climbs unless it was a timeout."""
    if kind == "ok":
        if state.level:
            state.clean += 1
            if state.clean >= CLEAN_TO_DESCEND:
                state.level, state.clean = state.level - 1, 0
        return
    if PAUSES[kind]:
        state.paused_until = max(state.paused_until, now + PAUSES[kind])
        state.reason = kind
    state.incidents = [*state.incidents, {"at": now, "reason": kind}][-INCIDENTS_KEPT:]
    if kind in ("blocked", "challenge"):
        state.level, state.clean = min(state.level + 1, len(LADDER) - 1), 0


def step(state: State, now: float, refused: bool) -> tuple[State, str, int]:
    """One request of a log and its answer: (state after it, decision, level after it)."""
    if state.last is not None and now - state.last >= FORGET_S:
        state = State()
    state.last = now
    decision = asked(state, now)
    if decision == "admitted":
        answered(state, now, "blocked" if refused else "ok")
    return state, decision, state.level


def sliding_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """`events` with `recent`: those of the key in the last `seconds`, this one and its peers in time included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("recent", F.count("*").over(W.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)))


OUT = "decision string, level int"


def log_rows(events: DataFrame, key: str, ts: str, refused: Column, id_col: str) -> DataFrame:
    return events.select(F.col(key).alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), F.coalesce(refused, F.lit(False)).alias("refused"), F.col(id_col).cast("long").alias("id"))


def replay(events: DataFrame, key: str, ts: str, refused: Column, id_col: str) -> DataFrame:
    """key, id, decision, level: a whole log, each key's events in order of time. A key's log is sequential by nature: its events are
    sorted by Spark, which spills, and go by one at a time, so a key of any number of events takes the memory of its state."""
    rows = log_rows(events, key, ts, refused, id_col)
    kind = dict(rows.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, before = State(), object()
        for pdf in frames:
            made = []
            for name, at, no in zip((None if pd.isna(k) else k for k in pdf["key"]), pdf["at"], pdf["refused"]):
                if name != before:
                    state, before = State(), name
                state, decision, level = step(state, at, no)
                made.append((decision, level))
            yield pdf[["key", "id"]].assign(decision=[d for d, _ in made], level=[n for _, n in made])

    ordered = rows.repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, f"key {kind}, id long, {OUT}")


def stream(events: DataFrame, key: str, ts: str, refused: Column, id_col: str, late: str = "1 hour") -> DataFrame:
    """The same over a stream of events, `late` the most they may lag: the state of a key is its JSON, and goes FORGET_S after its last event."""
    rows = log_rows(events, key, ts, refused, id_col).withColumn("_at", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_at", late)

    def run(name: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "id"])
        state, made = restored(kept.get[0] if kept.exists else None, float(pdf["at"].iloc[0])), []
        for at, no in zip(pdf["at"], pdf["refused"]):
            state, decision, level = step(state, at, no)
            made.append((decision, level))
        kept.update((json.dumps(asdict(state)),))
        kept.setTimeoutTimestamp(max(int((state.last + FORGET_S) * 1000), kept.getCurrentWatermarkMs() + 1))
        yield pdf[["key", "id"]].assign(decision=[d for d, _ in made], level=[n for _, n in made])

    schema = f"key {dict(rows.dtypes)['key']}, id long, {OUT}"
    return rows.groupBy("key").applyInPandasWithState(run, schema, "state string", "append", "EventTimeTimeout")
