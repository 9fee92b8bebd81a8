"""Graph analytics in rounds of joins: components, ranks, paths, cycles, centralities, walks.

Edges have src and dst, and weight where it counts. Rounds cut their lineage by checkpoint().
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; a local session may go without it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-rounds-"))
    return df.checkpoint()


def weak_components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that can be reached, edges taken both ways; nodes: (id)."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    state = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(state.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        told = state.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("best"))
        offers = told.select("id", F.col("best").alias("offer")).union(told.select(F.col("component").alias("id"), F.col("best").alias("offer")))
        merged = offers.groupBy("id").agg(F.min("offer").alias("component"))
        jumped = merged.join(merged.select(F.col("id").alias("component"), F.col("component").alias("next")), "component").select("id", F.least("component", "next").alias("component"))
        new = cut(jumped)
        if not new.join(state.select("id", F.col("component").alias("old")), "id").where("component <> old").limit(1).count():
            return new
        state = new
    raise RuntimeError("components did not settle")


def strong_components(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): the largest id of each strongly connected component.

    Nodes without an edge in or out are components of their own and are trimmed. For the others the
    largest id that reaches a node colours it; what reaches the colour's own node within the colour
    is one component; the rest is coloured anew.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    open_ = cut(nodes.select("id").distinct())
    done = []
    for _ in range(rounds):
        if not open_.limit(1).count():
            break
        inner = open_.join(left.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        inner = cut(inner)
        lone = open_.join(inner, "id", "left_anti")
        if lone.limit(1).count():
            done.append(cut(lone.select("id", F.col("id").alias("component"))))
        else:
            colour = cut(inner.select("id", F.col("id").alias("c")))
            while True:
                come = left.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("come"))
                new = cut(colour.join(come, "id", "left").select("id", F.greatest("c", "come").alias("c")))
                moved = new.join(colour.withColumnRenamed("c", "old"), "id").where("c <> old").limit(1).count()
                colour = new
                if not moved:
                    break
            reach = cut(colour.where("id = c"))
            within = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("c"))
            within = cut(within)
            while True:
                more = within.join(reach.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct().join(reach.select("id"), "id", "left_anti")
                more = cut(more)
                if not more.limit(1).count():
                    break
                reach = cut(reach.unionByName(more))
            done.append(cut(reach.select("id", F.col("c").alias("component"))))
        gone = done[-1].select("id")
        open_ = cut(open_.join(gone, "id", "left_anti"))
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    out = nodes.select("id", F.col("id").alias("component")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a number of rounds; the rank of nodes without edges out is dealt to all."""
    sums = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    share = cut(edges.join(sums, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    state = nodes.select("id").distinct()
    count = state.count()
    if not count:
        return state.withColumn("rank", F.lit(None).cast("double"))
    state = cut(state.join(sums.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left").withColumn("rank", F.lit(1.0 / count)))
    for _ in range(rounds):
        lost = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        come = share.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("come"))
        new = state.join(come, "id", "left").join(F.broadcast(lost))
        state = cut(new.select("id", "out", (F.lit((1 - damping) / count) + damping * (F.coalesce("come", F.lit(0.0)) + F.col("lost") / count)).alias("rank")))
    return state.select("id", "rank")


def distances(edges: DataFrame, start: str, most: int = 50) -> DataFrame:
    """(id, hops, parent) of what can be reached from a node; of several parents the smallest."""
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst").distinct())
    seen = spark.createDataFrame([(start, 0, None)], "id string, hops int, parent string")
    edge_of = seen
    for hop in range(1, most + 1):
        more = e.join(edge_of.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        more = cut(more.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "parent"))
        if not more.limit(1).count():
            break
        seen, edge_of = cut(seen.unionByName(more)), more
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, most_nodes: int = 20) -> list[str] | None:
    """Nodes of a shortest path, or None where there is none of at most so many nodes."""
    seen = distances(edges, start, most_nodes - 1)
    path, at = [], end
    while at is not None:
        row = seen.where(F.col("id") == at).first()
        if row is None:
            return None
        path.insert(0, at)
        at = row["parent"]
    return path


def ego(edges: DataFrame, start: str, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within radius - 1 hops, edges taken both ways, and the edges between them."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = distances(both, start, max(0, radius - 1)).select("id") if radius > 1 else edges.sparkSession.createDataFrame([(start,)], "id string")
    inside = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return near, inside


def cycles(edges: DataFrame, most: int = 4) -> DataFrame:
    """(cycle, length): simple cycles of 2 to ``most`` nodes, each from its smallest node on."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    paths = e.where("src < dst").select("src", F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    out = None
    for n in range(2, most + 1):
        closed = paths.join(e.select(F.col("src").alias("at"), F.col("dst").alias("back")), "at").where("back = src").select("path")
        out = closed if out is None else out.union(closed)
        if n < most:
            step = e.select(F.col("src").alias("at"), F.col("dst").alias("next"))
            paths = paths.join(step, "at").where("next > src").where(~F.array_contains("path", F.col("next"))).select("src", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
    return out.select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("length"))


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, closeness) by incoming distance, scaled by the share of nodes that reach it."""
    pairs = all_distances(edges)
    n = nodes.select("id").distinct().agg(F.count("*").alias("n"))
    per = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("reach"), F.sum("hops").alias("total"))
    score = F.col("reach") / F.col("total") * F.col("reach") / (F.col("n") - 1)
    return nodes.select("id").distinct().join(per, "id", "left").join(F.broadcast(n)).select("id", F.coalesce(score, F.lit(0.0)).alias("closeness"))


def all_distances(edges: DataFrame, most: int = 50) -> DataFrame:
    """(src, dst, hops) for all pairs that are connected; for graphs of topics, not of lines."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    seen = last = cut(e.withColumn("hops", F.lit(1)))
    for hop in range(2, most + 1):
        more = last.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct()
        more = cut(more.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        if not more.limit(1).count():
            break
        seen, last = cut(seen.unionByName(more)), more
    return seen


def betweenness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, betweenness): shares of shortest paths through a node, over all ordered pairs."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    pairs = all_distances(edges)
    ways = cut(e.join(pairs.where("hops = 1"), ["src", "dst"]).select("src", "dst", F.lit(1).alias("hops"), F.lit(1).cast("long").alias("ways")))
    last, hop = ways, 1
    while True:
        hop += 1
        step = last.select("src", F.col("dst").alias("mid"), "ways").join(e.select(F.col("src").alias("mid"), "dst"), "mid")
        step = step.join(pairs.where(F.col("hops") == hop).select("src", "dst"), ["src", "dst"]).groupBy("src", "dst").agg(F.sum("ways").alias("ways"))
        step = cut(step.select("src", "dst", F.lit(hop).alias("hops"), "ways"))
        if not step.limit(1).count():
            break
        ways, last = cut(ways.unionByName(step)), step
    a = ways.select("src", F.col("dst").alias("mid"), F.col("hops").alias("h1"), F.col("ways").alias("w1"))
    b = ways.select(F.col("src").alias("mid"), "dst", F.col("hops").alias("h2"), F.col("ways").alias("w2"))
    through = a.join(b, "mid").where("src <> dst").join(ways, ["src", "dst"]).where("h1 + h2 = hops")
    sums = through.groupBy(F.col("mid").alias("id")).agg(F.sum(F.col("w1") * F.col("w2") / F.col("ways")).alias("s"))
    n = nodes.select("id").distinct().agg(F.count("*").alias("n"))
    return nodes.select("id").distinct().join(sums, "id", "left").join(F.broadcast(n)).select("id", F.coalesce(F.col("s") / ((F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("betweenness"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation: a node takes the label of most weight around it, of equals the smallest."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    both = cut(both)
    state = cut(nodes.select("id", F.col("id").alias("community")).distinct())
    for _ in range(rounds):
        votes = both.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        w = Window.partitionBy("id").orderBy(F.desc("w"), "community")
        best = votes.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", F.col("community").alias("new"))
        new = cut(state.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
        moved = new.join(state.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        state = new
        if not moved:
            break
    return state


def modularity(state: DataFrame, edges: DataFrame) -> float:
    """Of communities (id, community) on undirected weights."""
    e = edges.select("src", "dst", "weight").where("src <> dst")
    two_m = 2 * (e.agg(F.sum("weight")).first()[0] or 0)
    if not two_m:
        return 0.0
    own = lambda side: state.select(F.col("id").alias(side), F.col("community").alias(f"{side}_c"))
    joined = e.join(own("src"), "src").join(own("dst"), "dst")
    inside = joined.where("src_c = dst_c").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0] * 2
    ends = joined.select(F.col("src_c").alias("c"), "weight").union(joined.select("dst_c", "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / two_m - ends.agg(F.sum(F.pow(F.col("d") / two_m, F.lit(2)))).first()[0]


def walks(edges: DataFrame, starts: DataFrame, steps: int, seed: str = "walk", revisit: bool = False) -> DataFrame:
    """(walk_id, step, id): walks from starts (walk_id, id); the next edge is drawn by weight from a hash of seed, walk and step.

    A walk without ``revisit`` draws among nodes that it has not seen; it ends where none is left.
    """
    state = starts.select("walk_id", "id", F.array("id").alias("path"))
    out = starts.select("walk_id", F.lit(0).alias("step"), "id")
    for step in range(1, steps + 1):
        options = state.join(edges.select(F.col("src").alias("id"), "dst", "weight"), "id")
        if not revisit:
            options = options.where(~F.array_contains("path", F.col("dst")))
        w = Window.partitionBy("walk_id").orderBy("dst")
        whole = Window.partitionBy("walk_id")
        options = options.withColumn("upto", F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("weight").over(whole)).withColumn("u", S.draw(F.lit(seed), F.col("walk_id").cast("string"), F.lit(str(step))))
        chosen = options.where("u * all <= upto").groupBy("walk_id").agg(F.min_by(F.struct("dst", "path"), "dst").alias("c"))
        state = chosen.select("walk_id", F.col("c.dst").alias("id"), F.concat("c.path", F.array("c.dst")).alias("path"))
        if step % 4 == 0:
            state = cut(state)
        out = out.unionByName(state.select("walk_id", F.lit(step).alias("step"), "id"))
    return out


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows without replacement, likelier by weight: the smallest of -ln(u) / weight."""
    u = F.greatest(S.draw(F.lit(seed), F.col(key).cast("string")), F.lit(2.0**-32))
    return rows.withColumn("draw", -F.log(u) / F.col(weight)).orderBy("draw", key).limit(n).drop("draw")
