"""Graph views over lines: edges of a line graph, topic graphs, emotion bridges, bipartite topic graphs.

Lines have game, pos, form_id, topic, speaker, quest, emotion and, where conditions gate them,
stage. Edges have game, src, dst, kind, weight. A null or empty quest or topic counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def decoded_conditions(conditions: DataFrame) -> DataFrame:
    """Names for raw conditions (function, type, param1, value, run_on); other columns stay."""
    number = F.col("function").cast("string")
    return conditions.withColumns({
        "function_name": S.code_name(F.col("function"), S.FUNCTION_NAMES, F.concat(F.lit("Function_"), number)),
        "comparison": S.code_name(F.col("type").bitwiseAND(15), S.COMPARISONS, "?"),
        "run_on_name": S.code_name(F.col("run_on"), S.RUN_ON, F.concat(F.lit("run_on_"), F.col("run_on").cast("string"))),
    })


#: Rows of a task that sorts.
TASK_ROWS = 100_000


def parts_for(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over tasks whose number grows with the rows; Spark does not put such tasks together again."""
    return rows.repartition(parts_for(rows), *keys)


def sequential_edges(lines: DataFrame) -> DataFrame:
    """Each line to the next of its topic, by stage (none is 0), then position."""
    w = Window.partitionBy("game", "topic").orderBy(F.coalesce("stage", F.lit(0.0)), "pos")
    return spread(lines.select("game", "topic", "stage", "pos", "form_id"), "game", "topic").select("game", F.col("form_id").alias("src"), F.lead("form_id").over(w).alias("dst"), F.lit("sequential").alias("kind"), F.lit(1.0).alias("weight")).where("dst IS NOT NULL")


def first_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and form_id of the line with the smallest pos; rows with a null key are left out.

    The smallest pos comes from an aggregation in a hash table. Strings beside it would have each task sort all its rows.
    """
    least = lines.groupBy(*keys).agg(F.min("pos").alias("pos"))
    return lines.join(least, [*keys, "pos"]).groupBy(*keys).agg(F.min("form_id").alias("form_id"))


def branch_edges(lines: DataFrame, hub: str = "GREETING") -> DataFrame:
    """Each line of the hub topic to the first line of each other topic of its quest."""
    kept = lines.where("quest IS NOT NULL AND quest <> ''")
    others = kept.select("game", "quest", "topic", "pos", "form_id").where(F.col("topic") != hub)
    firsts = first_lines(others, ["game", "quest", "topic"]).select("game", "quest", F.col("form_id").alias("dst"))
    hubs = kept.where(F.col("topic") == hub).select("game", "quest", F.col("form_id").alias("src"))
    return hubs.join(firsts, ["game", "quest"]).select("game", "src", "dst", F.lit("topic_branch").alias("kind"), F.lit(0.5).alias("weight"))


def gate_edges(lines: DataFrame) -> DataFrame:
    """Both ways between the first lines of each two states of a (quest, topic); lines without a condition are one state."""
    state = F.coalesce(F.col("stage").cast("string"), F.lit(""))
    named = lines.select("game", F.coalesce("quest", F.lit("")).alias("quest"), "topic", state.alias("state"), "pos", "form_id")
    firsts = first_lines(named, ["game", "quest", "topic", "state"]).withColumnRenamed("form_id", "id")
    other = firsts.select("game", "quest", "topic", F.col("state").alias("other"), F.col("id").alias("dst"))
    return firsts.join(other, ["game", "quest", "topic"]).where("state <> other").select("game", F.col("id").alias("src"), "dst", F.lit("condition_gate").alias("kind"), F.lit(0.3).alias("weight"))


def line_edges(lines: DataFrame) -> DataFrame:
    return sequential_edges(lines).unionByName(branch_edges(lines)).unionByName(gate_edges(lines))


def collapsed(edges: DataFrame) -> DataFrame:
    """One edge a pair: of parallel edges the last kind in building order wins."""
    rank = F.when(F.col("kind") == "sequential", 1).when(F.col("kind") == "topic_branch", 2).otherwise(3)
    dealt = edges.repartition("game", "src", "dst")  # before the aggregation, whose tasks sort their rows
    return dealt.groupBy("game", "src", "dst").agg(F.max_by(F.struct("kind", "weight"), rank).alias("e")).select("game", "src", "dst", "e.kind", "e.weight")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(game, id) with distinct neighbours out_deg, in_deg and edge counts out_edges, in_edges; no edges give zeros."""
    end = lambda side, id, other: F.struct(F.lit(side).alias("side"), F.col(id).alias("id"), F.col(other).alias("other"))
    ends = edges.select("game", F.explode(F.array(end(1, "src", "dst"), end(2, "dst", "src"))).alias("e")).select("game", "e.*").where("game IS NOT NULL AND id IS NOT NULL")
    named = nodes.select("game", F.lit(0).alias("side"), F.col("form_id").alias("id"), F.lit(None).cast("string").alias("other"))
    # one exchange for both aggregations: a row for each neighbour, then a row for each node
    pairs = named.unionByName(ends).repartition(parts_for(nodes), "game", "id").groupBy("game", "id", "side", "other").agg(F.count("*").alias("n"))
    of = lambda side, n: F.coalesce(F.sum(F.when(F.col("side") == side, n)), F.lit(0))
    known = F.col("other").isNotNull().cast("long")
    sums = pairs.groupBy("game", "id").agg(of(0, F.col("n")).alias("times"), of(1, known).alias("out_deg"), of(1, F.col("n")).alias("out_edges"), of(2, known).alias("in_deg"), of(2, F.col("n")).alias("in_edges"))
    return sums.withColumn("times", F.explode(F.expr("CASE WHEN times > 0 THEN sequence(1, times) END"))).drop("times")


def topic_edges(lines: DataFrame) -> DataFrame:
    """Moves between topics in the talk of one speaker of one quest, by form_id; weight is one more than their number."""
    w = Window.partitionBy("game", "quest", "speaker").orderBy("form_id", "pos")
    named = lines.where("topic IS NOT NULL AND topic <> ''").withColumns({"quest": F.coalesce("quest", F.lit("_no_quest")), "speaker": F.coalesce("speaker", F.lit("_no_speaker"))})
    moves = named.withColumn("next", F.lead("topic").over(w)).where("next <> topic")
    return moves.groupBy("game", F.col("topic").alias("src"), F.col("next").alias("dst")).agg(
        (F.count("*") + 1).alias("weight"), F.count_distinct("quest").alias("quests"), F.count_distinct("speaker").alias("speakers")
    )


def strength() -> Column:
    return F.col("weight") + F.lit(0.1) * F.col("quests") + F.lit(0.05) * F.col("speakers")


def dominant(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, emotion, n of the commonest emotion; of equals the one seen first."""
    counts = lines.groupBy(*keys, "emotion").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct("emotion", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select(*keys, F.col("b.emotion").alias("emotion"), F.col("b.n").alias("n"))


def topic_nodes(lines: DataFrame) -> DataFrame:
    """Each topic's lines, speakers, quests, dominant emotion and first texts."""
    named = lines.where("topic IS NOT NULL AND topic <> ''")
    agg = named.groupBy("game", "topic").agg(F.count("*").alias("line_count"), F.count_distinct("speaker").alias("speakers"), F.count_distinct("quest").alias("quests"))
    w = Window.partitionBy("game", "topic").orderBy("pos")
    texts = named.where("text <> ''").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    texts = texts.groupBy("game", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.substring("text", 1, 100).alias("t")))), lambda x: x.t), "|").alias("samples"))
    return agg.join(dominant(named, ["game", "topic"]).select("game", "topic", "emotion"), ["game", "topic"]).join(texts, ["game", "topic"], "left")


def without_hubs(nodes: DataFrame, edges: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A topic graph without the topics of ``drop`` (game, topic); edges need both ends."""
    kept = nodes.join(drop, ["game", "topic"], "left_anti")
    ends = kept.select("game", "topic")
    e = edges.join(ends.withColumnRenamed("topic", "src"), ["game", "src"], "left_semi").join(ends.withColumnRenamed("topic", "dst"), ["game", "dst"], "left_semi")
    return kept, e


def topic_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("game", F.col("src").alias("topic"), F.col("dst").alias("other")).union(edges.select("game", "dst", "src"))
    return ends.groupBy("game", "topic").agg(F.count_distinct("other").alias("degree"))


def emotion_edges(lines: DataFrame) -> DataFrame:
    """Consecutive lines of a topic in file order, with both emotions; an id seen twice counts once, as last seen."""
    named = lines.select("game", "form_id", "topic", "emotion", "pos").where("form_id IS NOT NULL AND form_id <> ''")
    same = Window.partitionBy("game", "form_id")
    seen = spread(named, "game", "form_id").withColumns({"first": F.min("pos").over(same), "later": F.lead(F.lit(True)).over(same.orderBy("pos"))})
    last = seen.where("later IS NULL").drop("later", "pos")
    w = Window.partitionBy("game", "topic").orderBy("first")
    e = last.repartition(parts_for(named), "game", "topic").select("game", F.col("form_id").alias("src"), F.lead("form_id").over(w).alias("dst"), F.col("emotion").alias("src_emotion"), F.lead("emotion").over(w).alias("dst_emotion"))
    return e.where("dst IS NOT NULL")


def cells(edges: DataFrame) -> DataFrame:
    """Emotion pairs with their edges and games; a bridge is a pair of more than one game."""
    return edges.groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("edges"), F.count_distinct("game").alias("games")).withColumn("is_bridge", F.col("games") > 1)


def dense_matrix(edges: DataFrame, domain: list[str]) -> DataFrame:
    """All pairs of the domain's emotions with their counts, zero where none; a row for each game and for all (game null)."""
    spark = edges.sparkSession
    all_ = spark.createDataFrame([(e,) for e in domain], "e string")
    games = edges.select("game").distinct().union(spark.createDataFrame([(None,)], "game string"))
    pairs = F.broadcast(all_.select(F.col("e").alias("src_emotion"))).join(F.broadcast(all_.select(F.col("e").alias("dst_emotion"))))
    counts = edges.groupingSets([["game", "src_emotion", "dst_emotion"], ["src_emotion", "dst_emotion"]], "game", "src_emotion", "dst_emotion").agg(F.count("*").alias("n"))
    want = games.join(pairs).alias("w")
    same = F.expr("w.game <=> c.game AND w.src_emotion = c.src_emotion AND w.dst_emotion = c.dst_emotion")
    return want.join(counts.alias("c"), same, "left").select("w.game", "w.src_emotion", "w.dst_emotion", F.coalesce("c.n", F.lit(0)).alias("n"))


def cell_flow(edges: DataFrame) -> DataFrame:
    """Cells that can follow one another: the first ends where the second starts, and they share a game."""
    c = edges.groupBy("src_emotion", "dst_emotion").agg(F.array_sort(F.collect_set("game")).alias("g"), F.count("*").alias("n"))
    a, b = c.alias("a"), c.alias("b")
    joined = a.join(b, F.col("a.dst_emotion") == F.col("b.src_emotion")).where(F.arrays_overlap("a.g", "b.g"))
    return joined.select(F.col("a.src_emotion").alias("first"), F.col("a.dst_emotion").alias("through"), F.col("b.dst_emotion").alias("last"), F.size(F.array_intersect("a.g", "b.g")).alias("games"), (F.col("a.n") + F.col("b.n")).alias("weight"))


def lifted(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Line edges as topic edges with counts; ends without a topic and moves within one are left out."""
    end = lambda side: lines.select("game", F.col("form_id").alias(side), F.col("topic").alias(f"{side}_topic"))
    both = edges.join(end("src"), ["game", "src"]).join(end("dst"), ["game", "dst"])
    return both.where("src_topic <> dst_topic").groupBy("src_topic", "dst_topic").agg(F.count("*").alias("n"))


def query_topics(lines: DataFrame) -> DataFrame:
    """Topics with rows, distinct texts, games and category."""
    return lines.where("topic <> '' AND form_id <> ''").groupBy("topic").agg(F.count("*").alias("responses"), F.count_distinct("game", "form_id").alias("texts"), F.count_distinct("game").alias("games")).withColumn("category", S.topic_category(F.col("topic")))


def linkable(lines: DataFrame) -> DataFrame:
    """Emotions found in two games or more, with totals and the smallest and largest game."""
    per = lines.groupBy("emotion", "game").agg(F.count("*").alias("n"))
    return per.groupBy("emotion").agg(F.count("*").alias("games"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most")).where("games >= 2")
