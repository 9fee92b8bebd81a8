"""Work queues as event tables: state is what the events of a ticket add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["pending", "claimed", "completed", "failed", "needs_review", "rejected"]


def states(events: DataFrame) -> DataFrame:
    """(ticket_id, stage, status) from events (ticket_id, stage, pos, kind, outcome).

    A claim counts on a pending ticket; a submission counts on a claimed one and gives failed,
    needs_review or completed by its outcome (error, review, else). Later events of a kind are void.
    """
    first = lambda kind, after: F.min(F.when((F.col("kind") == kind) & after, F.col("pos")))
    claims = events.groupBy("ticket_id", "stage").agg(first("claim", F.lit(True)).alias("claimed"))
    joined = events.join(claims, ["ticket_id", "stage"])
    counted = (F.col("kind") == "submit") & (F.col("pos") > F.col("claimed"))
    out = joined.groupBy("ticket_id", "stage").agg(F.first("claimed").alias("claimed"), F.min_by(F.when(counted, F.coalesce("outcome", F.lit("ok"))), F.when(counted, F.col("pos"))).alias("outcome"))
    status = F.when(F.col("outcome") == "error", "failed").when(F.col("outcome") == "review", "needs_review").when(F.col("outcome").isNotNull(), "completed").when(F.col("claimed").isNotNull(), "claimed").otherwise("pending")
    return out.select("ticket_id", "stage", status.alias("status"))


def queue_status(tickets: DataFrame) -> DataFrame:
    """A row a stage with the number of tickets in each status."""
    return tickets.groupBy("stage").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES), F.count("*").alias("total"))


def next_claims(tickets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pending tickets of each stage."""
    w = Window.partitionBy("stage").orderBy("ticket_id")
    return tickets.where("status = 'pending'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def follow_ups(tickets: DataFrame, after: dict[str, str]) -> DataFrame:
    """A pending ticket of the next stage for each completed one."""
    table = F.create_map(*(F.lit(x) for pair in after.items() for x in pair))
    done = tickets.where("status = 'completed'").withColumn("next", F.try_element_at(table, F.col("stage"))).where("next IS NOT NULL")
    return done.select(F.concat_ws("_", "ticket_id", "next").alias("ticket_id"), F.col("next").alias("stage"), F.lit("pending").alias("status"))
