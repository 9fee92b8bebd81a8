"""Walks that cross games, topic walks and linear topic chains.

Draws are hashes of seed, walk and step, so that walks repeat. One option is drawn for a walk with a single aggregation
(the smallest draw), never by gathering its options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .analytics import cut
from .graphs import parts_for

#: A cell's edges are numbered slot by slot; a slot is what one task sorts.
SLOTS = 1024


def _draw(seed: str, *parts: Column) -> Column:
    return S.draw(F.lit(seed), *(p.cast("string") for p in parts))


def _number(below: Column, seed: str, *parts: Column) -> Column:
    """A whole number from a key, 0 to ``below`` - 1 (null where that is none): what 60 bits of SHA-256 leave over."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    return F.pmod(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), F.nullif(below.cast("long"), F.lit(0).cast("long")))


def numbered_ends(edges: DataFrame, seed: str) -> DataFrame:
    """(src_emotion, dst_emotion, to_game, number, jump): the end of every edge, numbered from 0 in its emotion pair and game.

    Order is by slot (a draw from the edge), src, dst. Slots are sorted each for itself, and their counts give the numbers
    before them, so that no task sorts a whole cell, whose size grows with the data.
    """
    cell = ["src_emotion", "dst_emotion", "to_game"]
    e = edges.withColumnRenamed("game", "to_game").withColumn("slot", F.floor(_draw(seed, F.col("src"), F.col("dst")) * SLOTS).cast("int"))
    counts = e.groupBy(*cell, "slot").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*cell).orderBy("slot")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy(*cell, "slot").orderBy("src", "dst")) - 1
    return e.withColumn("place", place).join(before, [*cell, "slot"]).select(*cell, (F.col("before") + F.col("place")).alias("number"), F.col("dst").alias("jump"))


def bridge_walks(edges: DataFrame, starts: DataFrame, steps: int, cross: float = 0.3, seed: str = "bridge") -> DataFrame:
    """(walk_id, step, game, id, crossed): walks that may jump to another game where that has an edge of the same emotions.

    edges (game, src, dst, src_emotion, dst_emotion), ids unique over games; starts (walk_id, game, id). At each step an edge
    out of the node is drawn. With probability ``cross`` (less than a third of that between two neutral lines) the walk jumps
    to the end of an edge of the same emotion pair in another game, unless it was there. Otherwise it follows the edge, or
    where that leads back an edge to a node it has not seen; without any it ends. A jump draws one of the other games, each as
    likely, then one of all that game's edges of the pair, each as likely, by number; so a jump is one row of a join.
    """
    e = cut(edges.select("game", "src", "dst", "src_emotion", "dst_emotion"))
    pair = ["src_emotion", "dst_emotion"]
    ends = cut(numbered_ends(e, seed))
    sizes = e.groupBy(*pair, "game").agg(F.count("*").alias("n"))
    cells = F.broadcast(cut(sizes.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("game", "n"))).alias("games"))))
    state = starts.select("walk_id", "game", "id", F.array("id").alias("path"))
    out = [starts.select("walk_id", F.lit(0).alias("step"), "game", "id", F.lit(False).alias("crossed"))]
    parts = parts_for(starts)
    for step in range(1, steps + 1):
        at = F.lit(step)
        options = state.join(e.select(F.col("src").alias("id"), F.col("dst"), *pair), "id").withColumn("seen", F.array_contains("path", F.col("dst")))
        u = _draw(seed + ":edge", F.col("walk_id"), at, F.col("dst"))
        choice = options.repartition(parts, "walk_id").groupBy("walk_id").agg(
            F.min_by(F.struct("game", "path", "dst", "seen", *pair), F.struct(u, F.col("dst"))).alias("c"),
            F.min_by("dst", F.when(~F.col("seen"), F.struct(u, F.col("dst")))).alias("other"),
        )
        chosen = choice.select("walk_id", "c.*", "other")
        odds = F.when((F.col("src_emotion") == "neutral") & (F.col("dst_emotion") == "neutral"), cross * 0.3).otherwise(cross)
        wants = _draw(seed + ":cross", F.col("walk_id"), at) < odds
        others = F.filter("games", lambda g: g["game"] != F.col("game"))
        game = F.get("others", _number(F.size("others"), seed + ":game", F.col("walk_id"), at).cast("int"))
        chosen = chosen.join(cells, pair, "left").withColumn("others", F.when(wants, others)).withColumn("to", game).drop("games", "others")
        chosen = cut(chosen.select("*", F.col("to.game").alias("to_game"), _number(F.col("to.n"), seed + ":jump", F.col("walk_id"), at).alias("number")).drop("to"))
        # walks that stay are not joined: their keys are null and would go to one task
        both = chosen.where("number IS NOT NULL").join(ends, [*pair, "to_game", "number"]).unionByName(chosen.where("number IS NULL"), allowMissingColumns=True)
        leaps = F.col("jump").isNotNull() & ~F.array_contains("path", F.col("jump"))
        follow = F.when(F.col("seen"), F.col("other")).otherwise(F.col("dst"))
        moved = both.select("walk_id", F.when(leaps, F.col("to_game")).otherwise(F.col("game")).alias("game"), F.when(leaps, F.col("jump")).otherwise(follow).alias("id"), F.coalesce(leaps, F.lit(False)).alias("crossed"), "path")
        moved = cut(moved.where("id IS NOT NULL"))
        out.append(moved.select("walk_id", F.lit(step).alias("step"), "game", "id", "crossed"))
        state = moved.select("walk_id", "game", "id", F.concat("path", F.array("id")).alias("path"))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def walk_coverage(walks: DataFrame, games: int) -> DataFrame:
    """(walk_id, nodes, games, crossings, coverage) of walks; coverage is the share of ``games`` visited."""
    counts = walks.groupBy("walk_id").agg(F.count("*").alias("nodes"), F.count_distinct("game").alias("games"), F.count(F.when(F.col("crossed"), 1)).alias("crossings"))
    return counts.withColumn("coverage", F.round(F.col("games") / games, 6))


def topic_walks(edges: DataFrame, topic_games: DataFrame, starts: DataFrame, steps: int, cross: bool = True, seed: str = "topics") -> DataFrame:
    """(walk_id, step, topic): walks over topic edges (src, dst) to topics not yet seen, by draws.

    topic_games (topic, games): with ``cross``, a topic that has a game the current one lacks goes before the others.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    own, far = topic_games.select(F.col("topic"), F.col("games").alias("g")), topic_games.select(F.col("topic").alias("dst"), F.col("games").alias("h"))
    options = cut(e.join(own, e.src == own.topic, "left").join(far, "dst", "left").select(F.col("src").alias("topic"), "dst", F.coalesce(F.size(F.array_except("h", "g")) > 0, F.lit(False)).alias("new_game")))
    state = starts.select("walk_id", "topic", F.array("topic").alias("path"))
    out = starts.select("walk_id", F.lit(0).alias("step"), "topic")
    for step in range(1, steps + 1):
        near = state.join(options, "topic").where(~F.array_contains("path", F.col("dst")))
        rank = F.struct(~F.col("new_game") if cross else F.lit(False), _draw(seed, F.col("walk_id"), F.lit(step), F.col("dst")), F.col("dst"))
        moved = near.groupBy("walk_id").agg(F.min_by(F.struct("dst", "path"), rank).alias("c"))
        state = cut(moved.select("walk_id", F.col("c.dst").alias("topic"), F.concat("c.path", F.array("c.dst")).alias("path")))
        out = out.unionByName(state.select("walk_id", F.lit(step).alias("step"), "topic"))
    return out


def linear_chains(edges: DataFrame, least: int = 3) -> DataFrame:
    """(chain, place, topic): longest runs of topics where each has one successor and that has one predecessor.

    No topic is in two runs, and the result does not depend on the order of topics; a ring has no run. A run is named by its first topic.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    one = lambda end: e.groupBy(end).agg(F.count("*").alias("n")).where("n = 1").select(end)
    links = cut(e.join(one("src"), "src", "left_semi").join(one("dst"), "dst", "left_semi"))
    heads = links.join(links.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("chain"), F.lit(0).cast("long").alias("place"), F.col("src").alias("topic"))
    # doubling: each node's jump over 2^k links, from the head's own place
    jump, placed = links.select("src", "dst", F.lit(1).cast("long").alias("hops")), cut(heads)
    while True:
        jump = cut(jump)
        if not jump.limit(1).count():
            break
        reached = placed.join(jump.withColumnRenamed("src", "topic"), "topic").select("chain", (F.col("place") + F.col("hops")).alias("place"), F.col("dst").alias("topic"))
        if not reached.limit(1).count():
            break
        placed = cut(placed.unionByName(reached))  # those reached lie beyond all that are placed
        far = jump.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("hops").alias("more"))
        jump = jump.join(far, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst"), (F.col("hops") + F.col("more")).alias("hops"))
    size = F.count("*").over(Window.partitionBy("chain"))
    return placed.withColumn("size", size).where(F.col("size") >= least).drop("size")


def sampled_by(rows: DataFrame, key: str, group: str | None, n: int, seed: str = "dialogue") -> DataFrame:
    """n rows by draws, of each group or of all."""
    drawn = rows.withColumn("u", _draw(seed, F.col(key)))
    if group is None:
        return drawn.orderBy("u", key).limit(n).drop("u")
    w = Window.partitionBy(group).orderBy("u", key)
    return drawn.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn", "u")


def walk_index(steps: DataFrame) -> DataFrame:
    """(walk_id, key): the emotion transitions (``a->b``) of walks (walk_id, step, emotion), each once a walk."""
    w = Window.partitionBy("walk_id").orderBy("step")
    pairs = steps.select("walk_id", F.concat_ws("->", F.col("emotion"), F.lead("emotion").over(w)).alias("key"), F.lead("emotion").over(w).alias("next"))
    return pairs.where("next IS NOT NULL").select("walk_id", "key").distinct()
