"""Connected components of a link table, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(tables: Tables, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for each end of ``links`` (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label next to it, hands it to its own label's node, and
    skips to its label's label, so that rounds grow as the logarithm of a component's width.
    Null ends and links of a node with itself count for nothing; no links give no rows.
    """
    links = links.where("a <> b").select("a", "b").distinct()
    both = tables.keep(links.union(links.select("b", "a")), "links")
    state = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        told = state.join(near, "node").withColumn("best", F.least("label", "near"))
        offers = told.select("node", F.col("best").alias("offer")).union(told.select(F.col("label").alias("node"), F.col("best").alias("offer")))
        merged = offers.groupBy("node").agg(F.min("offer").alias("label"))
        jumped = merged.join(merged.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.least("label", "next").alias("label"))
        new = tables.keep(jumped, "labels")
        moved = new.join(state.select("node", F.col("label").alias("old")), "node").where("label <> old").limit(1).count()
        tables.drop(state)
        state = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    tables.drop(both)
    return state
