"""Registered queries, sixth part: walks across games, topic walks, chains, samples, extraction of plugins and works."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T
from ..operators import crossings as C
from ..operators import analytics as A
from ..operators import graphs, growth
from ..operators import results as R
from ..sources import stores
from .catalog import EDGES, EMO, query, topic_graph
from .catalog_more import U
from .views import LINES, TALK, event_lines, table, talk_lines


@query()
def bridge_walks(spark, d):
    """A walk from every line of the first game; held against a plain walk in the tests."""
    lines = event_lines(spark, d)
    starts = lines.where("game = 'g0'").select(F.col("form_id").alias("walk_id"), "game", F.col("form_id").alias("id"))
    return C.bridge_walks(graphs.emotion_edges(lines), starts, 5)


@query()
def bridge_coverage(spark, d):
    return C.walk_coverage(bridge_walks(spark, d), 4)


@query()
def topic_walks(spark, d):
    lines = event_lines(spark, d)
    games = lines.groupBy("topic").agg(F.collect_set("game").alias("games"))
    return C.topic_walks(graphs.topic_edges(lines), games, games.select(F.col("topic").alias("walk_id"), "topic"), 4)


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND kind = 'sequential'), l AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY src HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY dst HAVING count(*) = 1)),
  c AS (SELECT src AS chain, 0 AS place, src AS topic FROM l WHERE src NOT IN (SELECT dst FROM l) UNION ALL SELECT chain, place + 1, l.dst FROM c JOIN l ON l.src = c.topic)
  SELECT * FROM c WHERE chain IN (SELECT chain FROM c GROUP BY chain HAVING count(*) >= 3)""")
def linear_chains(spark, d):
    lines = event_lines(spark, d)
    return C.linear_chains(graphs.line_edges(lines).where("kind = 'sequential'"), 3)


@query(f"WITH {TALK} SELECT emotion, form_id FROM talk QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY {U.format("'dialogue:' || form_id")}, form_id) <= 4")
def dialogue_sample(spark, d):
    return C.sampled_by(talk_lines(spark, d).select("form_id", "emotion"), "form_id", "emotion", 4)


@query(f"WITH {TALK}, t AS (SELECT quest AS walk_id, emotion || '->' || lead(emotion) OVER (PARTITION BY quest ORDER BY pos) AS key FROM talk) SELECT DISTINCT walk_id, key FROM t WHERE key IS NOT NULL")
def walk_index(spark, d):
    return C.walk_index(talk_lines(spark, d).select(F.col("quest").alias("walk_id"), F.col("pos").alias("step"), "emotion"))


@query("""WITH c AS (SELECT doc_id, lang, [text, text || text, substr(text, 1, 50), text] AS c FROM documents), p AS (SELECT doc_id, unnest([0, 1, 2]) AS place, c, lang FROM c)
  SELECT doc_id, place, substr(trim(c[place + 1]), 1, 2000) AS text FROM p WHERE lang = 'en' AND length(trim(c[place + 1])) >= 200""")
def work_chapters(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.array("text", F.concat("text", "text"), F.substring("text", 1, 50), "text").alias("chapters"), F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")).alias("language"))
    return R.chapters(rows, "doc_id")


@query("""SELECT o_orderstatus AS plugin, o_orderpriority AS topic, CAST(l_linenumber - 1 AS INTEGER) AS place, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS form_id, l_returnflag AS text,
  CASE WHEN l_suppkey % 2 = 0 THEN s_name ELSE CAST(l_suppkey AS VARCHAR) END AS speaker, l_linestatus AS quest
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1""")
def plugin_lines(spark, d):
    line = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("form_id"), F.col("l_returnflag").alias("text"), F.col("l_suppkey").cast("string").alias("speaker"), F.col("l_linestatus").alias("quest"))
    first = table(spark, d, "lineitem").where("l_linenumber = 1").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    topics = first.select(F.col("o_orderstatus").alias("plugin"), F.col("o_orderpriority").alias("topic"), F.array(line).alias("lines"))
    npcs = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return stores.plugin_lines(topics, npcs, npcs.where("false"))


@query(f"WITH {LINES}, {TALK} SELECT 'main' AS source, 0 AS load_order, count(*) AS n FROM lines UNION ALL SELECT 'addon', 1, count(*) FROM talk")
def united_plugins(spark, d):
    parts = {"main": event_lines(spark, d).select("form_id", "stage"), "addon": talk_lines(spark, d).select("form_id")}
    return stores.united_plugins(parts).groupBy("source", "load_order").agg(F.count("*").alias("n"))


@query("SELECT doc_id, '## Names' || chr(10) || chr(10) || '  - ' || lang || chr(10) || chr(10) || '## Sides' || chr(10) || ' ' || source AS excerpt FROM documents")
def bible_excerpts(spark, d):
    text = F.concat(F.lit("names:\n  - "), "lang", F.lit("\nother:\n  x\nsides: "), "source")
    return table(spark, d, "documents").select("doc_id", T.excerpt(text, {"names": "Names", "sides": "Sides"}).alias("excerpt"))


@query(f"""WITH {EDGES}, n AS (SELECT form_id AS id, any_value(emotion) AS emotion FROM lines GROUP BY 1), t AS (SELECT a.emotion AS s, b.emotion AS t, count(*) AS n FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY ALL), m AS (SELECT emotion, count(*) AS n FROM n GROUP BY 1)
  SELECT 'transition' AS kind, s || '->' || t AS value, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (), 6) AS p FROM t UNION ALL SELECT 'emotion', emotion, n, round(n / sum(n) OVER (), 6) FROM m
  UNION ALL SELECT 'self_loops', 'all', CAST(sum(CASE WHEN s = t THEN n ELSE 0 END) AS BIGINT), round(sum(CASE WHEN s = t THEN n ELSE 0 END) / sum(n), 6) FROM t""")
def target_statistics(spark, d):
    lines = event_lines(spark, d)
    return growth.target_statistics(lines.select(F.col("form_id").alias("id"), "emotion"), graphs.line_edges(lines))


@query(f"""WITH {EDGES}, e AS (SELECT mode(emotion ORDER BY emotion DESC) AS commonest, count(*) AS nodes FROM lines)
  SELECT nodes, commonest, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / nodes, 6) AS avg_degree FROM e""")
def graph_summary(spark, d):
    lines = event_lines(spark, d)
    return growth.graph_summary(lines.select(F.col("form_id").alias("id"), "emotion"), graphs.line_edges(lines))


@query(f"""WITH {LINES}, {EMO}, c AS (SELECT count(DISTINCT game) AS g FROM emo GROUP BY src_emotion, dst_emotion)
  SELECT 'lines' AS kind, game AS value, count(*) AS n FROM lines GROUP BY game UNION ALL SELECT 'edges', game, count(*) FROM emo GROUP BY game
  UNION ALL SELECT 'cells', 'all', count(*) FROM c UNION ALL SELECT 'bridges', 'all', count(*) FILTER (WHERE g > 1) FROM c""")
def bridge_statistics(spark, d):
    lines = event_lines(spark, d)
    return growth.bridge_statistics(lines, graphs.emotion_edges(lines))


@query(f"""WITH {LINES}, g AS (SELECT game, row_number() OVER (ORDER BY game) - 1 AS r, count(*) OVER () AS k FROM (SELECT DISTINCT game FROM lines)), s AS (SELECT game, 30 // k + CASE WHEN r < 30 % k THEN 1 ELSE 0 END AS n FROM g),
  w AS (SELECT form_id AS walk_id, l.game, n, row_number() OVER (PARTITION BY l.game ORDER BY {U.format("'run:' || form_id")}, form_id) AS place FROM lines l JOIN s ON s.game = l.game) SELECT walk_id, game, place FROM w WHERE place <= n""")
def run_walks(spark, d):
    return growth.run_walks(event_lines(spark, d).select(F.col("form_id").alias("walk_id"), "game"), 30)


@query()
def stopped_walks(spark, d):
    nodes, edges = topic_graph(spark, d)
    return growth.stopped_walks(A.walks(edges, nodes.select(F.col("id").alias("walk_id"), "id"), 6, revisit=True))


@query()
def grown_graph(spark, d):
    """The talk's quests as walks, hung on the events of one game until there are as many nodes again."""
    lines, talk = event_lines(spark, d), talk_lines(spark, d)
    own = lines.where("game = 'g0'")
    reference = graphs.emotion_edges(lines).groupBy(*growth.TRANSITION).agg(F.count("*").alias("n"))
    beats = talk.select(F.col("quest").alias("walk_id"), F.col("pos").alias("place"), "emotion", "text")
    edges = graphs.line_edges(lines).where("game = 'g0'")
    nodes, grown = growth.grown(own.select(F.col("form_id").alias("id"), "emotion", "text"), edges, reference, beats, 2 * own.count(), 20, 3)
    return nodes.select("id", "emotion").join(grown.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id", "left")
