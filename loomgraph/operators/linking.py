"""Joining graph ends to entries, growing graphs, and compiling finished work into nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .analytics import cut


def link_candidates(ends: DataFrame, entries: DataFrame, each: int = 3, least: float = 0.5) -> DataFrame:
    """(terminus, entry, score): the ``each`` best entries of each end by how well emotions follow.

    Ends (id, emotion) meet the small table of emotion pairs, then the first entries of each emotion:
    for one end only the first ``each`` entries of an emotion can be among its best.
    """
    w = Window.partitionBy("emotion").orderBy("id")
    first = entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each + 1).select(F.col("id").alias("entry"), F.col("emotion").alias("entry_emotion"))
    pairs = ends.select("emotion").distinct().join(F.broadcast(first.select("entry_emotion").distinct()))
    pairs = pairs.withColumn("score", S.compatibility(F.col("emotion"), F.col("entry_emotion"))).where(F.col("score") >= least)
    offered = ends.join(F.broadcast(pairs), "emotion").join(F.broadcast(first), "entry_emotion").where("id <> entry")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "entry")
    return offered.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= each).select(F.col("id").alias("terminus"), "entry", "score")


def chosen_links(candidates: DataFrame, most: int = 20, rounds: int = 50) -> DataFrame:
    """One entry for each terminus, none used more than ``most`` times: in rounds each takes its best that is free."""
    left, out, used = candidates, None, None
    for _ in range(rounds):
        if used is not None:
            left = left.join(used.where(F.col("n") >= most).select("entry"), "entry", "left_anti")
        best = left.groupBy("terminus").agg(F.min_by(F.struct("entry", "score"), F.struct(-F.col("score"), F.col("entry"))).alias("b")).select("terminus", "b.entry", "b.score")
        room = best if used is None else best.join(used, "entry", "left")
        n = F.lit(0) if used is None else F.coalesce("n", F.lit(0))
        w = Window.partitionBy("entry").orderBy(F.desc("score"), "terminus")
        taken = cut(room.withColumn("rn", F.row_number().over(w)).where(F.col("rn") + n <= most).select("terminus", "entry", "score"))
        if not taken.limit(1).count():
            break
        out = taken if out is None else cut(out.unionByName(taken))
        used = cut(out.groupBy("entry").agg(F.count("*").alias("n")))
        left = cut(left.join(out.select("terminus"), "terminus", "left_anti"))
    return out


def bridges(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of finished bridge requests (terminus, entry, text, emotion): terminus to bridge to entry."""
    done = requests.where("text IS NOT NULL AND text <> ''").withColumn("id", F.concat(F.lit("bridge_"), S.short_hash(F.concat_ws("_", "terminus", "entry"))))
    nodes = done.select("id", "text", S.canonical_emotion(F.col("emotion")).alias("emotion"), F.lit(True).alias("is_bridge"))
    edge = F.explode(F.array(F.struct(F.col("terminus").alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), F.col("entry").alias("dst"))))
    return nodes, done.select(edge.alias("e")).select("e.src", "e.dst", F.lit("bridge").alias("kind"))


def topic_hubs(nodes: DataFrame, key: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Hub nodes over entry nodes (id, beat_index) that share a key, and their edges to them."""
    entries = nodes.where("beat_index = 0").withColumn("hub_key", F.coalesce(F.col(key), F.lit("unknown")))
    big = entries.groupBy("hub_key").agg(F.count("*").alias("aggregates")).where(F.col("aggregates") >= least)
    hubs = big.select(F.concat(F.lit("hub_"), S.short_hash(F.col("hub_key"))).alias("id"), "hub_key", "aggregates")
    return hubs, entries.join(hubs.select("hub_key", F.col("id").alias("hub")), "hub_key").select(F.col("hub").alias("src"), F.col("id").alias("dst"), F.lit("hub").alias("kind"))


def compiled(tickets: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of finished tickets (run_id, ticket_id, texts, emotions); nodes that exist stay as they are, edges are always added."""
    n = F.least(F.size("texts"), F.size("emotions"))
    beats = tickets.where("status = 'completed'").withColumn("n", n).where("n > 0").select("run_id", "ticket_id", F.posexplode(F.arrays_zip(F.slice("texts", 1, n).alias("text"), F.slice("emotions", 1, n).alias("emotion"))).alias("beat_index", "beat"))
    beats = beats.select("run_id", "ticket_id", "beat_index", F.col("beat").getField("0").alias("text"), F.col("beat").getField("1").alias("raw")) if "0" in beats.schema["beat"].dataType.names else beats.select("run_id", "ticket_id", "beat_index", "beat.text", F.col("beat.emotion").alias("raw"))
    ids = beats.withColumn("id", F.concat(F.lit("syn_"), S.short_hash(F.concat_ws("_", "run_id", "ticket_id", F.col("beat_index").cast("string"))))).withColumn("emotion", S.canonical_emotion(F.col("raw")))
    w = Window.partitionBy("run_id", "ticket_id").orderBy("beat_index")
    edges = ids.select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst"), F.concat(F.lag("emotion").over(w), F.lit("->"), F.col("emotion")).alias("transition")).where("src IS NOT NULL")
    return ids.join(existing.select("id"), "id", "left_anti"), edges
