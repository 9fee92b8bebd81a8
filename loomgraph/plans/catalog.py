"""Registered queries over the driver's tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chains, filters, graphs, linking, stats, tickets
from ..operators import analytics as A
from .views import LINES, TALK, event_lines, table, talk_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# SQL views that several queries share
SEQ = """seq AS (
  SELECT * FROM (SELECT game, form_id AS src, lead(form_id) OVER (PARTITION BY game, topic ORDER BY coalesce(stage, 0.0), pos) AS dst,
    'sequential' AS kind, 1.0::DOUBLE AS weight FROM lines) WHERE dst IS NOT NULL)"""
BRANCH = """branch AS (
  SELECT h.game, h.form_id AS src, f.dst, 'topic_branch' AS kind, 0.5::DOUBLE AS weight
  FROM lines h JOIN (SELECT game, quest, topic, arg_min(form_id, pos) AS dst FROM lines WHERE topic <> 'GREETING' AND quest <> '' GROUP BY ALL) f
    ON h.game = f.game AND h.quest = f.quest WHERE h.topic = 'GREETING' AND h.quest <> '')"""
GATE = """firsts AS (
  SELECT game, coalesce(quest, '') AS quest, topic, stage, arg_min(form_id, pos) AS id FROM lines GROUP BY ALL
), gate AS (
  SELECT a.game, a.id AS src, b.id AS dst, 'condition_gate' AS kind, 0.3::DOUBLE AS weight FROM firsts a JOIN firsts b
    ON a.game = b.game AND a.quest = b.quest AND a.topic = b.topic AND a.stage IS DISTINCT FROM b.stage)"""
EDGES = f"{LINES}, {SEQ}, {BRANCH}, {GATE}, edges AS (SELECT * FROM seq UNION ALL SELECT * FROM branch UNION ALL SELECT * FROM gate)"
DEG = """deg AS (
  SELECT l.game, l.form_id AS id, coalesce(o.out_deg, 0) AS out_deg, coalesce(i.in_deg, 0) AS in_deg, coalesce(o.out_edges, 0) AS out_edges, coalesce(i.in_edges, 0) AS in_edges
  FROM lines l LEFT JOIN (SELECT game, src, count(DISTINCT dst) AS out_deg, count(*) AS out_edges FROM edges GROUP BY ALL) o ON l.game = o.game AND l.form_id = o.src
  LEFT JOIN (SELECT game, dst, count(DISTINCT src) AS in_deg, count(*) AS in_edges FROM edges GROUP BY ALL) i ON l.game = i.game AND l.form_id = i.dst)"""
TOPIC = """topic_e AS (
  SELECT game, topic AS src, nxt AS dst, count(*) + 1 AS weight, count(DISTINCT quest) AS quests, count(DISTINCT speaker) AS speakers
  FROM (SELECT *, lead(topic) OVER (PARTITION BY game, quest, speaker ORDER BY form_id, pos) AS nxt FROM lines) WHERE nxt <> topic GROUP BY ALL)"""
#: Topics of all games as one graph: nodes are game:topic.
TGRAPH = f"{LINES}, {TOPIC}, te AS (SELECT game || ':' || src AS src, game || ':' || dst AS dst, CAST(weight AS DOUBLE) AS weight FROM topic_e), tn AS (SELECT DISTINCT game || ':' || topic AS id FROM lines)"
EMO = """emo AS (
  SELECT * FROM (SELECT game, form_id AS src, lead(form_id) OVER w AS dst, emotion AS src_emotion, lead(emotion) OVER w AS dst_emotion
  FROM lines WINDOW w AS (PARTITION BY game, topic ORDER BY pos)) WHERE dst IS NOT NULL)"""


def topic_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst, weight) of the topics of all games."""
    lines = event_lines(spark, sf_dir)
    at = lambda c: F.concat_ws(":", "game", c)
    edges = graphs.topic_edges(lines).select(at("src").alias("src"), at("dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return lines.select(at("topic").alias("id")).distinct(), edges


# --- lines, line graph -------------------------------------------------------------------------


@query(f"WITH {LINES}, {EMO} SELECT src_emotion, dst_emotion, count(*) AS n FROM emo GROUP BY ALL")
def emotion_transitions(spark, d):
    return graphs.emotion_edges(event_lines(spark, d)).groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, {SEQ} SELECT game, src, dst, weight FROM seq")
def sequential_edges(spark, d):
    return graphs.sequential_edges(event_lines(spark, d)).select("game", "src", "dst", "weight")


@query(f"WITH {LINES}, {BRANCH} SELECT game, src, dst, weight FROM branch")
def branch_edges(spark, d):
    return graphs.branch_edges(event_lines(spark, d)).select("game", "src", "dst", "weight")


@query(f"WITH {LINES}, {GATE} SELECT game, src, dst, weight FROM gate")
def gate_edges(spark, d):
    return graphs.gate_edges(event_lines(spark, d)).select("game", "src", "dst", "weight")


@query(f"WITH {EDGES}, e AS (SELECT *, CASE kind WHEN 'sequential' THEN 1 WHEN 'topic_branch' THEN 2 ELSE 3 END AS o FROM edges) SELECT game, src, dst, arg_max(kind, o) AS kind, arg_max(weight, o) AS weight FROM e GROUP BY game, src, dst")
def collapsed_edges(spark, d):
    return graphs.collapsed(graphs.line_edges(event_lines(spark, d)))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'GetStage' WHEN event_id % 7 = 1 THEN 'GetIsID' ELSE 'Function_' || CAST(500 + event_id % 7 AS VARCHAR) END AS function_name,
  ['==', '!=', '>', '>=', '<', '<=', '?', '?'][(event_id + 32) % 8 + 1] AS comparison,
  CASE WHEN event_id % 6 < 4 THEN ['subject', 'target', 'reference', 'combat_target'][event_id % 6 + 1] ELSE 'run_on_' || CAST(event_id % 6 AS VARCHAR) END AS run_on_name FROM events""")
def condition_decode(spark, d):
    i = F.col("event_id")
    raw = table(spark, d, "events").select("event_id", F.when(i % 7 == 0, 43).when(i % 7 == 1, 72).otherwise((500 + i % 7).cast("int")).alias("function"), (((i + 32) % 8) + 32).cast("int").alias("type"), (i % 6).cast("int").alias("run_on"))
    return graphs.decoded_conditions(raw).select("event_id", "function_name", "comparison", "run_on_name")


@query(f"WITH {EDGES}, {DEG} SELECT game, id, out_deg, in_deg, out_edges, in_edges FROM deg")
def node_degrees(spark, d):
    lines = event_lines(spark, d)
    return graphs.degrees(lines, graphs.line_edges(lines))


@query(f"""WITH {EDGES}, {DEG} SELECT game, count(*) AS nodes, round(avg(out_deg), 6) AS avg_out, round(avg(in_deg), 6) AS avg_in, max(out_deg) AS max_out, max(in_deg) AS max_in,
  count(*) FILTER (WHERE out_deg + in_deg = 0) AS isolated, round(median(out_deg + in_deg), 6) AS median FROM deg GROUP BY game""")
def line_graph_stats(spark, d):
    lines = event_lines(spark, d)
    both = F.col("out_deg") + F.col("in_deg")
    return graphs.degrees(lines, graphs.line_edges(lines)).groupBy("game").agg(
        F.count("*").alias("nodes"), F.round(F.avg("out_deg"), 6).alias("avg_out"), F.round(F.avg("in_deg"), 6).alias("avg_in"), F.max("out_deg").alias("max_out"), F.max("in_deg").alias("max_in"),
        F.count(F.when(both == 0, 1)).alias("isolated"), F.round(F.median(both), 6).alias("median"),
    )


@query(f"WITH {EDGES} SELECT game, kind, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY ALL")
def edge_kinds(spark, d):
    return graphs.line_edges(event_lines(spark, d)).groupBy("game", "kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


@query(f"WITH {EDGES}, {DEG} SELECT game, id, out_deg + in_deg AS degree FROM deg WHERE out_deg + in_deg >= 6 ORDER BY degree DESC, id")
def hubs(spark, d):
    lines = event_lines(spark, d)
    many = graphs.degrees(lines, graphs.line_edges(lines)).select("game", "id", (F.col("out_deg") + F.col("in_deg")).alias("degree")).where("degree >= 6")
    # a sort reads its rows twice, first for the ranges; the exchange keeps the degrees from being counted twice
    return many.repartition("id").orderBy(F.desc("degree"), "id")


@query(f"WITH {EDGES}, {DEG} SELECT game, id, in_deg, out_deg FROM deg WHERE in_deg >= 3 AND out_deg >= 3")
def bottlenecks(spark, d):
    lines = event_lines(spark, d)
    return graphs.degrees(lines, graphs.line_edges(lines)).where("in_deg >= 3 AND out_deg >= 3").select("game", "id", "in_deg", "out_deg")


@query(f"WITH {EDGES}, {DEG}, x AS (SELECT out_deg + in_deg AS degree, row_number() OVER (ORDER BY out_deg + in_deg, game, id) - 1 AS k, count(*) OVER () AS n FROM deg) SELECT degree AS threshold FROM x WHERE k = CAST(floor(n * 0.95) AS BIGINT)")
def hub_threshold(spark, d):
    lines = event_lines(spark, d)
    hist = graphs.degrees(lines, graphs.line_edges(lines)).groupBy((F.col("out_deg") + F.col("in_deg")).alias("degree")).agg(F.count("*").alias("n"))
    # ranks come from the counts of the few degree values
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.where(F.col("upto") > F.floor(F.col("all") * 0.95)).agg(F.min("degree").alias("threshold"))


@query(f"""WITH {EDGES}, {DEG} SELECT count(*) AS nodes, CAST(sum(out_edges) AS BIGINT) AS edges, round(avg(CASE WHEN out_edges = 1 AND in_edges = 1 THEN 1.0 ELSE 0.0 END), 6) AS chain,
  round(avg(CASE WHEN out_edges = 0 THEN 1.0 ELSE 0.0 END), 6) AS leaf, round(avg(CASE WHEN out_edges > 5 OR in_edges > 5 THEN 1.0 ELSE 0.0 END), 6) AS hub,
  round(avg(CASE WHEN in_edges = 0 AND out_edges > 0 THEN 1.0 ELSE 0.0 END), 6) AS entry, round(sum(out_edges) / count(*), 6) AS edges_per_node, max(out_edges) AS max_out, max(in_edges) AS max_in FROM deg""")
def structural_metrics(spark, d):
    lines = event_lines(spark, d)
    out = stats.structural_metrics(graphs.degrees(lines, graphs.line_edges(lines)))
    return out.select("nodes", "edges", r6("chain"), r6("leaf"), r6("hub"), r6("entry"), r6("edges_per_node"), "max_out", "max_in")


@query(f"""WITH {EDGES}, {DEG}, h AS (SELECT out_edges, count(*) AS n, count(*) / (SELECT count(*) FROM deg) AS p FROM deg GROUP BY 1), r AS (SELECT out_edges, row_number() OVER (ORDER BY out_edges) - 1 AS k, count(*) OVER () AS n FROM deg)
  SELECT round(coalesce(sum(p) FILTER (WHERE out_edges = 0), 0), 6) AS leaf, round(coalesce(sum(p) FILTER (WHERE out_edges > 2), 0), 6) AS hub, round(coalesce(sum(p) FILTER (WHERE out_edges >= 2), 0), 6) AS branching,
  (SELECT out_edges FROM r WHERE k = n // 2) AS median, round(-sum(p * log2(p)), 6) AS entropy FROM h""")
def topology_entropy(spark, d):
    lines = event_lines(spark, d)
    out = stats.topology(graphs.degrees(lines, graphs.line_edges(lines)))
    return out.select(r6("leaf"), r6("hub"), r6("branching"), "median", r6("entropy"))


@query(f"""WITH {EDGES}, {DEG} SELECT CASE WHEN out_edges <= 2 THEN CAST(out_edges AS VARCHAR) WHEN out_edges <= 5 THEN '3-5' WHEN out_edges <= 10 THEN '6-10' WHEN out_edges <= 20 THEN '11-20' ELSE '21+' END AS bucket,
  count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM deg), 2) AS pct FROM deg GROUP BY 1""")
def topology_buckets(spark, d):
    lines = event_lines(spark, d)
    counts = graphs.degrees(lines, graphs.line_edges(lines)).groupBy(stats.degree_bucket(F.col("out_edges")).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query(f"WITH {EDGES}, {DEG} SELECT game, id, out_edges, CASE WHEN out_edges = 0 THEN 'leaf' ELSE 'underlinked' END AS state FROM deg WHERE out_edges < 2")
def underlinked(spark, d):
    lines = event_lines(spark, d)
    deg = graphs.degrees(lines, graphs.line_edges(lines)).where("out_edges < 2")
    return deg.select("game", "id", "out_edges", F.when(F.col("out_edges") == 0, "leaf").otherwise("underlinked").alias("state"))


# --- topic graph -------------------------------------------------------------------------------


@query(f"WITH {LINES}, {TOPIC} SELECT game, src, dst, weight, quests, speakers, round(weight + 0.1 * quests + 0.05 * speakers, 6) AS strength FROM topic_e")
def topic_edges(spark, d):
    return graphs.topic_edges(event_lines(spark, d)).withColumn("strength", F.round(graphs.strength(), 6))


@query(f"""WITH {LINES}, c AS (SELECT game, topic, emotion, count(*) AS n, min(pos) AS first FROM lines GROUP BY ALL), best AS (SELECT game, topic, emotion FROM c QUALIFY row_number() OVER (PARTITION BY game, topic ORDER BY n DESC, first) = 1),
  s AS (SELECT game, topic, string_agg(substr(text, 1, 100), '|' ORDER BY pos) AS samples FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY game, topic ORDER BY pos) <= 5) GROUP BY ALL)
  SELECT l.game, l.topic, count(*) AS line_count, count(DISTINCT speaker) AS speakers, count(DISTINCT quest) AS quests, any_value(b.emotion) AS emotion, any_value(s.samples) AS samples
  FROM lines l JOIN best b ON l.game = b.game AND l.topic = b.topic JOIN s ON l.game = s.game AND l.topic = s.topic GROUP BY l.game, l.topic""")
def topic_nodes(spark, d):
    return graphs.topic_nodes(event_lines(spark, d))


@query(f"""WITH {LINES}, {TOPIC}, ends AS (SELECT game, src AS topic, dst AS other FROM topic_e UNION ALL SELECT game, dst, src FROM topic_e), dg AS (SELECT game, topic, count(DISTINCT other) AS degree FROM ends GROUP BY ALL),
  top AS (SELECT game, topic FROM dg QUALIFY row_number() OVER (PARTITION BY game ORDER BY degree DESC, topic) <= 2)
  SELECT e.game, e.src, e.dst, e.weight FROM topic_e e ANTI JOIN top a ON e.game = a.game AND e.src = a.topic ANTI JOIN top b ON e.game = b.game AND e.dst = b.topic""")
def topic_filter_topk(spark, d):
    lines = event_lines(spark, d)
    edges = graphs.topic_edges(lines)
    w = Window.partitionBy("game").orderBy(F.desc("degree"), "topic")
    top = graphs.topic_degrees(edges).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("game", "topic")
    return graphs.without_hubs(lines.select("game", "topic").distinct(), edges, top)[1].select("game", "src", "dst", "weight")


@query(f"WITH {LINES}, {TOPIC} SELECT game, src, dst, weight FROM topic_e WHERE src <> 'GREETING' AND dst <> 'GREETING'")
def topic_filter_hubs(spark, d):
    lines = event_lines(spark, d)
    nodes = lines.select("game", "topic").distinct()
    return graphs.without_hubs(nodes, graphs.topic_edges(lines), nodes.where(F.col("topic").isin(S.HUB_TOPICS)))[1].select("game", "src", "dst", "weight")


@query(f"""WITH {LINES}, {TOPIC}, ends AS (SELECT game, src AS topic, dst AS other FROM topic_e UNION ALL SELECT game, dst, src FROM topic_e), dg AS (SELECT game, topic, count(DISTINCT other) AS degree FROM ends GROUP BY ALL)
  SELECT game, count(*) AS topics, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, (SELECT count(*) FROM topic_e e WHERE e.game = dg.game) AS edges FROM dg GROUP BY game""")
def topic_stats(spark, d):
    edges = graphs.topic_edges(event_lines(spark, d))
    deg = graphs.topic_degrees(edges).groupBy("game").agg(F.count("*").alias("topics"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))
    return deg.join(edges.groupBy("game").agg(F.count("*").alias("edges")), "game")


@query(f"""WITH {LINES}, {TOPIC}, c AS (SELECT game, topic, emotion, count(*) AS n, min(pos) AS first FROM lines GROUP BY ALL), best AS (SELECT game, topic, emotion FROM c QUALIFY row_number() OVER (PARTITION BY game, topic ORDER BY n DESC, first) = 1)
  SELECT e.game, src, dst, weight, a.emotion AS src_emotion, b.emotion AS dst_emotion FROM (SELECT * FROM topic_e QUALIFY row_number() OVER (PARTITION BY game, src ORDER BY weight DESC, dst) <= 3) e
  JOIN best a ON e.game = a.game AND e.src = a.topic JOIN best b ON e.game = b.game AND e.dst = b.topic""")
def topic_paths(spark, d):
    lines = event_lines(spark, d)
    w = Window.partitionBy("game", "src").orderBy(F.desc("weight"), "dst")
    e = graphs.topic_edges(lines).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    best = graphs.dominant(lines, ["game", "topic"])
    own = lambda s: best.select("game", F.col("topic").alias(s), F.col("emotion").alias(f"{s}_emotion"))
    return e.join(own("src"), ["game", "src"]).join(own("dst"), ["game", "dst"]).select("game", "src", "dst", "weight", "src_emotion", "dst_emotion")


# --- bridges and query graph -------------------------------------------------------------------


@query(f"WITH {LINES}, {EMO} SELECT src_emotion, dst_emotion, count(*) AS edges, count(DISTINCT game) AS games, count(DISTINCT game) > 1 AS is_bridge FROM emo GROUP BY ALL")
def bridge_cells(spark, d):
    return graphs.cells(graphs.emotion_edges(event_lines(spark, d)))


@query(f"""WITH {LINES}, {EMO}, dom AS (SELECT unnest(['anger', 'disgust', 'fear', 'happy', 'neutral', 'pained', 'sad', 'surprise']) AS e), g AS (SELECT DISTINCT game FROM emo UNION ALL SELECT NULL)
  SELECT g.game, a.e AS src_emotion, b.e AS dst_emotion, (SELECT count(*) FROM emo WHERE (g.game IS NULL OR emo.game = g.game) AND emo.src_emotion = a.e AND emo.dst_emotion = b.e) AS n FROM g, dom a, dom b""")
def emotion_matrix_dense(spark, d):
    return graphs.dense_matrix(graphs.emotion_edges(event_lines(spark, d)), sorted([*S.CANONICAL, "pained"]))


@query(f"""WITH {LINES}, {EMO}, c AS (SELECT src_emotion, dst_emotion, list(DISTINCT game) AS g, count(*) AS n FROM emo GROUP BY ALL)
  SELECT a.src_emotion AS first, a.dst_emotion AS through, b.dst_emotion AS last, len(list_intersect(a.g, b.g)) AS games, a.n + b.n AS weight FROM c a JOIN c b ON a.dst_emotion = b.src_emotion WHERE len(list_intersect(a.g, b.g)) > 0""")
def bridge_cell_flow(spark, d):
    return graphs.cell_flow(graphs.emotion_edges(event_lines(spark, d))).withColumn("games", F.col("games").cast("long"))


@query(f"WITH {LINES}, p AS (SELECT emotion, game, count(*) AS n FROM lines GROUP BY ALL) SELECT emotion, count(*) AS games, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, max(n) AS most FROM p GROUP BY emotion HAVING count(*) >= 2")
def crossgame_linkable(spark, d):
    return graphs.linkable(event_lines(spark, d))


@query(f"WITH {LINES} SELECT game, emotion, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY game), 6) AS fraction FROM lines GROUP BY game, emotion")
def emotion_distribution(spark, d):
    counts = event_lines(spark, d).groupBy("game", "emotion").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("game")), 6))


@query(f"WITH {LINES}, c AS (SELECT game, topic, emotion, count(*) AS n, min(pos) AS first FROM lines GROUP BY ALL) SELECT game, topic, emotion, n FROM c QUALIFY row_number() OVER (PARTITION BY game, topic ORDER BY n DESC, first) = 1")
def dominant_emotion(spark, d):
    return graphs.dominant(event_lines(spark, d), ["game", "topic"])


@query(f"WITH {TALK} SELECT topic, count(*) AS responses, count(DISTINCT game || '/' || form_id) AS texts, count(DISTINCT game) AS games, CASE WHEN lower(topic) LIKE '%greeting%' OR lower(topic) LIKE '%hello%' THEN 'GREETING' END AS category FROM talk GROUP BY topic")
def query_topics(spark, d):
    return graphs.query_topics(talk_lines(spark, d))


@query("""SELECT o_orderpriority AS topic, count(*) AS n, CASE WHEN lower(o_orderpriority) LIKE '%sell%' OR lower(o_orderpriority) LIKE '%shop%' THEN 'TRADE' END AS category FROM orders GROUP BY 1
  UNION ALL SELECT p_name, count(*), CASE WHEN regexp_matches(lower(p_name), 'greeting|hello') THEN 'GREETING' WHEN regexp_matches(lower(p_name), 'goodbye|farewell|bye') THEN 'FAREWELL' WHEN regexp_matches(lower(p_name), 'attack|combat|fight|hostile') THEN 'COMBAT'
  WHEN regexp_matches(lower(p_name), 'trade|barter|buy|sell|shop') THEN 'TRADE' WHEN regexp_matches(lower(p_name), 'rumor|news|gossip') THEN 'RUMORS' WHEN regexp_matches(lower(p_name), 'quest|task|mission|job') THEN 'QUEST' WHEN regexp_matches(lower(p_name), 'idle|ambient') THEN 'AMBIENT'
  WHEN regexp_matches(lower(p_name), 'service|train|repair') THEN 'SERVICE' WHEN regexp_matches(lower(p_name), 'follow|wait|dismiss') THEN 'COMPANION' WHEN regexp_matches(lower(p_name), 'crime|bounty|arrest|guard') THEN 'CRIME' END FROM part GROUP BY 1""")
def topic_category(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("topic")).union(table(spark, d, "part").select("p_name"))
    return names.groupBy("topic").agg(F.count("*").alias("n")).withColumn("category", S.topic_category(F.col("topic")))


@query(f"WITH {EDGES} SELECT a.topic AS src_topic, b.topic AS dst_topic, count(*) AS n FROM edges e JOIN lines a ON e.game = a.game AND e.src = a.form_id JOIN lines b ON e.game = b.game AND e.dst = b.form_id WHERE a.topic <> b.topic GROUP BY ALL")
def topic_transitions(spark, d):
    lines = event_lines(spark, d)
    return graphs.lifted(graphs.line_edges(lines), lines)


@query(f"""WITH {LINES}, {TOPIC}, s AS (SELECT src AS topic, CAST(sum(weight) AS BIGINT) AS n, 'source' AS role FROM topic_e GROUP BY 1), k AS (SELECT dst, CAST(sum(weight) AS BIGINT), 'sink' FROM topic_e GROUP BY 1)
  SELECT role, topic, n FROM (SELECT * FROM s UNION ALL SELECT * FROM k) QUALIFY row_number() OVER (PARTITION BY role ORDER BY n DESC, topic) <= 10""")
def transition_topk(spark, d):
    e = graphs.topic_edges(event_lines(spark, d))
    s = e.groupBy(F.col("src").alias("topic")).agg(F.sum("weight").alias("n")).withColumn("role", F.lit("source"))
    k = e.groupBy(F.col("dst").alias("topic")).agg(F.sum("weight").alias("n")).withColumn("role", F.lit("sink"))
    w = Window.partitionBy("role").orderBy(F.desc("n"), "topic")
    return s.unionByName(k).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("role", "topic", "n")


@query(f"""WITH {LINES}, c AS (SELECT topic, game, count(*) AS n FROM lines GROUP BY ALL)
  SELECT topic, game, n FROM c WHERE topic IN (SELECT topic FROM c GROUP BY topic HAVING count(*) > 1)""")
def crossgame_topics(spark, d):
    """Counts by game of the topics that more than one game has."""
    counts = event_lines(spark, d).groupBy("topic", "game").agg(F.count("*").alias("n"))
    several = counts.groupBy("topic").agg(F.count("*").alias("games")).where("games > 1")
    return counts.join(several.select("topic"), "topic", "left_semi")


# --- chains and windows ------------------------------------------------------------------------


@query(f"""WITH {LINES}, v AS (SELECT game, quest, topic, speaker, count(*) AS n FROM lines GROUP BY ALL), b AS (SELECT game, quest, topic, speaker FROM v QUALIFY row_number() OVER (PARTITION BY game, quest, topic ORDER BY n DESC, speaker) = 1)
  SELECT l.game, l.quest, l.topic, count(*) AS length, any_value(b.speaker) AS speaker, count(stage) AS staged, string_agg(form_id, '>' ORDER BY coalesce(stage, 0.0), pos) AS ids,
  string_agg(l.speaker || CASE WHEN emotion <> 'neutral' THEN '(' || emotion || ')' ELSE '' END || ': ' || text, chr(10) ORDER BY coalesce(stage, 0.0), pos) AS transcript
  FROM lines l JOIN b ON l.game = b.game AND l.quest = b.quest AND l.topic = b.topic GROUP BY l.game, l.quest, l.topic HAVING count(*) >= 2""")
def quest_chains(spark, d):
    return chains.quest_chains(event_lines(spark, d))


@query(f"WITH {LINES} SELECT game, speaker, quest, topic, count(*) AS length FROM lines GROUP BY ALL HAVING count(*) >= 2")
def speaker_chains(spark, d):
    return chains.speaker_chains(event_lines(spark, d))


@query(f"WITH {LINES}, c AS (SELECT count(*) AS n FROM lines GROUP BY game, quest, topic HAVING count(*) >= 2) SELECT CASE WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' WHEN n <= 10 THEN '7-10' ELSE '10+' END AS bucket, count(*) AS chains, CAST(sum(n) AS BIGINT) AS lines FROM c GROUP BY 1")
def chain_buckets(spark, d):
    grouped = event_lines(spark, d).groupBy("game", "quest", "topic").agg(F.count("*").alias("length")).where("length >= 2")
    return chains.length_buckets(grouped)


@query(f"""WITH {TALK}, r AS (SELECT *, row_number() OVER (PARTITION BY game, quest ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY game, quest) AS n FROM talk), s AS (SELECT DISTINCT game, quest, rn AS start FROM r WHERE rn % 3 = 0 AND rn <= n - 3)
  SELECT s.game, s.quest, s.start, count(*) AS n, string_agg(r.form_id, '>' ORDER BY r.rn) AS ids FROM s JOIN r ON s.game = r.game AND s.quest = r.quest AND r.rn BETWEEN s.start AND s.start + 4 GROUP BY s.game, s.quest, s.start""")
def walk_windows(spark, d):
    return chains.strided_windows(talk_lines(spark, d), ["game", "quest"])


@query(f"""WITH {TALK}, a AS (SELECT quest, list(emotion ORDER BY pos) AS e FROM talk GROUP BY quest)
  SELECT quest, CASE WHEN len(e) < 2 THEN 'single' WHEN len(list_distinct(e)) = 1 THEN 'flat_' || e[1] ELSE 'transition_' || e[1] || '_to_' || (SELECT arg_max(x, i) FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS i) WHERE list_position(e, x) = i + 1) END AS shape FROM a""")
def arc_shapes(spark, d):
    return chains.arcs(talk_lines(spark, d), ["quest"]).select("quest", S.arc_transition(F.col("emotions")).alias("shape"))


@query(f"""WITH {TALK}, a AS (SELECT quest, list(emotion ORDER BY pos) AS e FROM talk GROUP BY quest)
  SELECT CASE WHEN list_contains(e[greatest(len(e) - 1, 1):], 'anger') AND e[1] = 'neutral' THEN 'escalating_threat' WHEN e[-1] = 'neutral' AND list_contains(e[1:2], 'anger') THEN 'de_escalation'
  WHEN len(list_filter(e, lambda x: x = 'neutral')) / len(e) >= 0.7 THEN 'information_exchange' WHEN list_contains(e, 'fear') OR list_contains(e, 'sad') THEN 'supplication' WHEN list_contains(e, 'surprise') THEN 'revelation' ELSE 'information_exchange' END AS shape, count(*) AS n FROM a GROUP BY 1""")
def arc_inventory(spark, d):
    return chains.arcs(talk_lines(spark, d), ["quest"]).groupBy(S.arc_prose(F.col("emotions")).alias("shape")).agg(F.count("*").alias("n"))
