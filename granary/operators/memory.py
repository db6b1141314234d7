"""Conversation memory over a table of messages (session_id, seq, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.operators.context import NO_HISTORY, history

MAX_TURNS = 5


def recent(messages: DataFrame, turns: int = MAX_TURNS, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """The last 2 * turns messages of each session, stripped. 0 turns keep all, as does anything below."""
    last = Window.partitionBy(session).orderBy(F.col(seq).desc())
    rows = messages.withColumn("content", t.strip(F.col("content")))
    return rows if turns <= 0 else rows.withColumn("__at", F.row_number().over(last)).where(F.col("__at") <= 2 * turns).drop("__at")


def formatted(messages: DataFrame, turns: int = MAX_TURNS, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, history): the recent messages as lines, without roles that are neither user nor assistant."""
    rows = recent(messages, turns, session, seq).groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), "role", "content"))).alias("m"))
    return rows.select(session, F.coalesce(F.nullif(history(F.col("m"), unknown=False), F.lit("")), F.lit(NO_HISTORY)).alias("history"))


def with_turn(messages: DataFrame, turns: DataFrame, most: int = MAX_TURNS, session: str = "session_id", seq: str = "seq") -> DataFrame:
    """messages after turns (session, question, answer) were added, trimmed."""
    last = messages.groupBy(session).agg(F.max(seq).alias("last"))
    at = F.coalesce("last", F.lit(0))
    rows = turns.join(last, session, "left").select(session, F.explode(F.array(F.struct((at + 1).alias(seq), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct((at + 2).alias(seq), F.lit("assistant").alias("role"), F.col("answer").alias("content")))).alias("m"))
    return recent(messages.select(session, seq, "role", "content").unionByName(rows.select(session, f"m.{seq}", "m.role", "m.content")), most, session, seq)


def sessions(messages: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, messages, has_history): what each session holds."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), (F.count(F.lit(1)) > 0).alias("has_history"))


def cleared(messages: DataFrame, gone: DataFrame, session: str = "session_id") -> DataFrame:
    return messages.join(gone.select(session).distinct(), session, "left_anti")
