"""Progress of chats as a stream: stage events in, monotone progress out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.ingest import STAGES, TERMINAL
from weft.session import ship_package

#: Order of stages on delivery; the end is one place however it comes.
ORDER = {"pending": 0, **{name: k for k, name in enumerate(STAGES, 1)}, "completed": 5, "answered": 5, "failed": 5}
DONE = ("completed", "answered")
OUT = "chat_id long, event_id long, stage string, progress int, accepted boolean, delivered boolean"
STATE = "stage string, progress int, seen string, seen_progress int"


def overall(stage: str, percent: int) -> int:
    if stage in STAGES:
        low, high = STAGES[stage]
        return low + int(max(0, min(100, percent)) / 100 * (high - low))
    return 100 if stage in DONE else 0


def next_state(state: tuple[str, int] | None, stage: str, progress: int) -> tuple[tuple[str, int] | None, bool]:
    """(state as stored, whether the event changes it).

    An ingestion stage opens a completed or answered chat again, whatever its
    place; nothing else changes an ended chat. A failure keeps the last
    progress. No stage gives way to an earlier one, and within a stage progress
    never falls.
    """
    if state is None:
        return (stage, progress), True
    now, reached = state
    if now in TERMINAL:
        opens = stage in STAGES and now != "failed"
        return ((stage, progress), True) if opens else (state, False)
    if stage == "failed":
        return (stage, reached), True
    if ORDER.get(stage, -1) < ORDER.get(now, -1):
        return state, False
    return (stage, max(progress, reached) if stage == now else progress), True


def deliver(seen: tuple[str, int] | None, stage: str, progress: int) -> tuple[tuple[str, int] | None, bool]:
    """(last event shown, whether this one is shown): none but an end after completed or answered, no stage or progress behind the last, a failure always."""
    if seen is not None:
        if seen[0] in DONE and stage not in DONE:
            return seen, False
        if stage != "failed" and (ORDER.get(stage, -1), progress) < (ORDER.get(seen[0], -1), seen[1]):
            return seen, False
    return (stage, progress), True


def step(state: tuple, stage: str, percent: int) -> tuple[tuple, bool, bool]:
    """Both rules on one event; state: (stored, shown)."""
    progress = overall(stage, percent)
    stored, accepted = next_state(state[0], stage, progress)
    if stage == "failed" and state[0]:
        progress = state[0][1]
    shown, delivered = deliver(state[1], stage, progress)
    return (stored, shown), accepted, delivered


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = tuple(state.get) if state.exists else (None,) * 4
    now = tuple((a, b) if a is not None else None for a, b in (held[:2], held[2:]))
    # a chat's events of one trigger can span batches: they are put in order together
    events = pd.concat([b[["event_id", "stage", "percent"]] for b in batches]).sort_values("event_id")
    rows = []
    for e in events.itertuples(index=False):
        now, accepted, delivered = step(now, e.stage, int(e.percent))
        rows.append((key[0], e.event_id, *now[0], accepted, delivered))
    if rows:
        yield pd.DataFrame(rows, columns=["chat_id", "event_id", "stage", "progress", "accepted", "delivered"])
        state.update((*now[0], *(now[1] or (None, None))))


def track(events: DataFrame) -> DataFrame:
    """Events (chat_id, event_id, stage, percent), streaming, to the state after each, whether it changed the state and whether it is delivered."""
    ship_package(events.sparkSession)
    return events.groupBy("chat_id").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_stages(source: DataFrame, stages: list, checkpoint: str):
    """A stage DAG over what is new: each batch goes through the stages in turn; a failed batch is run again from its offsets."""

    def batch(rows: DataFrame, number: int) -> None:
        for stage in stages:
            rows = stage(rows, number)

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
