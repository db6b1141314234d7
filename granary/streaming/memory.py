"""Conversation memory as keyed state of a stream.

Messages (session_id, seq, role, content) arrive in any order; each session keeps
its last 2 * turns messages by seq, and every batch emits the sessions it changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.operators.context import NO_HISTORY
from granary.operators.memory import MAX_TURNS

OUTPUT = "session_id string, messages int, history string"
STATE = "seqs array<bigint>, roles array<string>, contents array<string>"
ROLES = {"user": "User", "assistant": "Assistant"}


def updater(turns: int, idle_hours: float | None = None):  # noqa: ANN201
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held += zip(b["seq"].astype("int64"), b["role"], b["content"].fillna("").str.strip())
        held = sorted(dict(((s, (s, r, c)) for s, r, c in held)).values())[-2 * turns :]
        state.update(tuple(list(x) for x in zip(*held)))
        if idle_hours is not None:
            state.setTimeoutDuration(int(idle_hours * 3_600_000))
        lines = [f"{ROLES[r]}: {c}" for _, r, c in held if r in ROLES]
        yield pd.DataFrame({"session_id": [key[0]], "messages": [len(held)], "history": ["\n".join(lines) or NO_HISTORY]})

    return update


def histories(messages: DataFrame, turns: int = MAX_TURNS, idle_hours: float | None = None) -> DataFrame:
    """Stream of (session_id, messages, history) after each change. A message whose seq came before replaces it, so replays change nothing. With idle_hours a session without messages for so long is forgotten; such a stream watches the clock and never ends by itself, so one that reads what is there and stops goes without."""
    rows = messages.selectExpr("cast(session_id as string) as session_id", "cast(seq as bigint) as seq", "role", "content")
    return rows.groupBy("session_id").applyInPandasWithState(updater(turns, idle_hours), OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout if idle_hours is None else GroupStateTimeout.ProcessingTimeTimeout)
