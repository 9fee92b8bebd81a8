"""Growth of a graph by walks that close its gaps to a reference, and reports on such graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import listings, results, stats
from .analytics import cut

TRANSITION = ["src_emotion", "dst_emotion"]


def transition_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_emotion, dst_emotion, n) of edges (src, dst) whose both ends are nodes (id, emotion); a missing emotion is neutral."""
    end = lambda side: nodes.select(F.col("id").alias(side), F.coalesce("emotion", F.lit("neutral")).alias(f"{side}_emotion"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").groupBy(*TRANSITION).agg(F.count("*").alias("n"))


def target_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n, p): transitions, emotions and self-loops of a graph; a graph without edges has only its emotions.

    p is the share within a kind; of self-loops the share of all transitions.
    """
    pairs = cut(transition_counts(nodes, edges))
    emotions = nodes.groupBy(F.coalesce("emotion", F.lit("neutral")).alias("value")).agg(F.count("*").alias("n"))
    loops = pairs.agg(F.sum(F.when(F.col("src_emotion") == F.col("dst_emotion"), F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("all")).where("all > 0")
    share = lambda df: df.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "value", "n", "p")
    moves = share(pairs.select(F.concat_ws("->", *TRANSITION).alias("value"), "n"))
    selfs = loops.select(F.lit("all").alias("value"), "n", F.round(F.col("n") / F.col("all"), 6).alias("p"))
    return named(moves, "transition").unionByName(named(share(emotions), "emotion")).unionByName(named(selfs, "self_loops"))


def grown(nodes: DataFrame, edges: DataFrame, reference: DataFrame, beats: DataFrame, target: int, batch: int = 100, rounds: int = 20, seed: str = "grow") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, emotion, text) and edges (src, dst) after batches of walks have been attached, until there are ``target`` nodes.

    reference (src_emotion, dst_emotion, n); beats (walk_id, place, emotion, text). Each round takes walks by the share of
    each transition's gap, none twice, and hangs each on a node drawn among those of its first emotion; without one it stands
    alone. The whole batch is added at once, so a round may go past the target; growth ends early where no gap or no unused
    walk is left.
    """
    nodes, edges = cut(nodes.select("id", "emotion", "text")), cut(edges.select("src", "dst"))
    beats = cut(beats.select("walk_id", "place", "emotion", "text"))
    w = Window.partitionBy("walk_id").orderBy("place")
    moves = beats.select("walk_id", F.concat_ws("->", F.col("emotion"), F.lead("emotion").over(w)).alias("key"), F.lead("emotion").over(w).alias("next"))
    unused = cut(moves.where("next IS NOT NULL").select("walk_id", "key").distinct())
    wanted = cut(stats.share(reference, TRANSITION))
    for step in range(rounds):
        if nodes.count() >= target:
            break
        has = stats.share(transition_counts(nodes, edges), TRANSITION)
        gaps = stats.gaps(wanted, has, TRANSITION).select(F.concat_ws("->", *TRANSITION).alias("key"), "gap")
        taken = cut(results.gap_samples(gaps, unused, batch, f"{seed}:{step}").select("walk_id").distinct())
        if not taken.limit(1).count():
            break
        name = F.concat(F.lit("syn_"), S.short_hash(F.concat_ws(":", F.lit(seed), F.col("walk_id").cast("string"), F.col("place").cast("string"))))
        fresh = cut(beats.join(taken, "walk_id").select("walk_id", "place", name.alias("id"), F.coalesce("emotion", F.lit("neutral")).alias("emotion"), "text"))
        inside = fresh.select(F.lag("id").over(w).alias("src"), F.col("id").alias("dst")).where("src IS NOT NULL")
        heads = fresh.groupBy("walk_id").agg(F.min_by(F.struct("id", "emotion"), "place").alias("h")).select("h.*")
        hold = nodes.groupBy(F.coalesce("emotion", F.lit("neutral")).alias("emotion")).agg(F.min_by("id", S.draw(F.lit(f"{seed}:at:{step}"), F.col("id"))).alias("src"))
        hung = heads.join(hold, "emotion").select("src", F.col("id").alias("dst"))
        edges = cut(edges.unionByName(inside).unionByName(hung))
        nodes = cut(nodes.unionByName(fresh.select("id", "emotion", "text")))
        unused = cut(unused.join(taken, "walk_id", "left_anti"))
    return nodes, edges


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean edges a node and the commonest emotion."""
    emotions = nodes.groupBy(F.coalesce("emotion", F.lit("neutral")).alias("emotion")).agg(F.count("*").alias("n"))
    one = emotions.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.max_by("emotion", F.struct("n", "emotion")).alias("commonest"))
    both = one.join(edges.agg(F.count("*").alias("edges")))
    return both.withColumn("avg_degree", F.round(F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0), 6))


def bridge_statistics(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): lines and edges of each game, cells of emotion pairs, and those that more than one game has."""
    per = lambda df, kind: df.groupBy(F.col("game").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    games = edges.groupBy(*TRANSITION).agg(F.count_distinct("game").alias("games"))
    cells = games.agg(F.count("*").alias("cells"), F.count(F.when(F.col("games") > 1, 1)).alias("bridges"))
    both = cells.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit("all").alias("value"), F.col(k).alias("n")) for k in ("cells", "bridges")))).alias("c")).select("c.*")
    return per(lines, "lines").unionByName(per(edges, "edges")).unionByName(both)


def stopped_walks(walks: DataFrame) -> DataFrame:
    """Walks (walk_id, step, id) up to, and without, the first node that they come back to."""
    first = walks.groupBy("walk_id", "id").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.sort_array(F.collect_set("step")).alias("steps"))
    back = first.where(F.size("steps") > 1).groupBy("walk_id").agg(F.min(F.col("steps")[1]).alias("back"))
    return walks.join(back, "walk_id", "left").where("back IS NULL OR step < back").drop("back")


def frequent_topics(nodes: DataFrame, counts: str, drop_share: float = 0.0, least: int = 1) -> DataFrame:
    """Topics with ``least`` lines or more, without those at or over the count that ``drop_share`` of the topics reach."""
    kept = nodes.where(F.col(counts) >= least)
    if drop_share <= 0:
        return kept
    return kept.join(listings.top_share(nodes, counts, drop_share).select("game", "topic"), ["game", "topic"], "left_anti")


def run_walks(walks: DataFrame, count: int | None = None, rate: float | None = None, seed: str = "run") -> DataFrame:
    """(walk_id, game, place): a run's walks (walk_id, game), shared out evenly to the games by draws.

    ``count``, else a share ``rate`` of all walks, else ten; the first games by name get one more where it does not come out even.
    """
    games = walks.groupBy("game").agg(F.count("*").alias("size"))
    totals = games.agg(F.count("*").alias("games"), F.sum("size").alias("all"))
    wanted = F.lit(count) if count is not None else F.floor(F.col("all") * rate) if rate is not None else F.lit(10)
    share = games.withColumn("rank", F.row_number().over(Window.orderBy("game")) - 1).join(totals)
    share = share.select("game", (F.floor(wanted / F.col("games")) + F.when(F.col("rank") < wanted % F.col("games"), 1).otherwise(0)).alias("n"))
    w = Window.partitionBy("game").orderBy("u", "walk_id")
    ranked = walks.join(share, "game").withColumn("u", S.draw(F.lit(seed), F.col("walk_id").cast("string"))).withColumn("place", F.row_number().over(w))
    return ranked.where("place <= n").select("walk_id", "game", "place")
