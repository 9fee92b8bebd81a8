"""Structured Streaming: ticket states, daily traces, proposals with support, sessions of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def ticket_states(events: DataFrame) -> DataFrame:
    """(ticket_id, status) whenever a ticket's status changes, from events (ticket_id, pos, kind, outcome).

    A claim counts on a pending ticket, a submission on a claimed one; other events are void.
    """
    ship(events.sparkSession)

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState):
        (status,) = state.get if state.exists else ("pending",)
        before = status if state.exists else None
        for pdf in frames:
            for kind, outcome in pdf.sort_values("pos")[["kind", "outcome"]].itertuples(index=False):
                if kind == "claim" and status == "pending":
                    status = "claimed"
                elif kind == "submit" and status == "claimed":
                    status = {"error": "failed", "review": "needs_review"}.get(outcome, "completed")
        state.update((status,))
        if status != before:
            yield pd.DataFrame({"ticket_id": [key[0]], "status": [status]})

    return events.groupBy("ticket_id").applyInPandasWithState(advance, "ticket_id long, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day and kind; days are closed when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def proposals(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each content once, by a hash, while the watermark holds it; rows have ts and content."""
    return rows.withWatermark("ts", late).withColumn("hash", F.substring(F.sha2("content", 256), 1, 16)).dropDuplicatesWithinWatermark(["hash"])
