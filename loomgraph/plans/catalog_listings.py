"""Registered queries, fourth part: listings, filters, paging and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import chains, graphs, listings
from .catalog import DEG, EDGES, SQL, TGRAPH, query, topic_graph
from .catalog_more import U
from .views import LINES, TALK, event_lines, table, talk_lines

#: Categories of the topics of these tables: only GREETING has one.
CATEGORY = "CASE WHEN topic = 'GREETING' THEN 'GREETING' END"
#: events as traces of runs.
TRACES = """traces AS (
  SELECT event_id, CAST(ts AS DATE) AS day, user_id % 4 AS game,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'rejected' ELSE 'completed' END AS status,
         ['parse', 'translate', 'curate'][event_id % 3 + 1] AS stage, value AS cost FROM events)"""
ARCS = "arcs AS (SELECT quest, list(emotion ORDER BY pos) AS e FROM talk GROUP BY quest)"


def traces(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "rejected").otherwise("completed")
    stage = F.element_at(F.array(*(F.lit(s) for s in ("parse", "translate", "curate"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", F.to_date("ts").alias("day"), (F.col("user_id") % 4).alias("game"), status.alias("status"), stage.alias("stage"), F.col("value").alias("cost")
    )


@query(f"WITH {LINES} SELECT form_id, emotion FROM lines WHERE topic = 'GREETING' AND game = 'g1'")
def topic_responses(spark, d):
    return listings.responses(event_lines(spark, d), "GREETING", "g1").select("form_id", "emotion")


@query(f"WITH {TALK} SELECT topic, count(DISTINCT game) AS games, count(*) AS n FROM (SELECT * FROM talk UNION ALL SELECT 'only', 0, '', 'lone', '', '', '', '') GROUP BY topic HAVING count(DISTINCT game) > 1")
def shared_topics(spark, d):
    lines = talk_lines(spark, d)
    lone = spark.range(1).select(F.lit("only").alias("game"), F.lit("lone").alias("topic"))
    return listings.cross_game_topics(lines.select("game", "topic").unionByName(lone))


@query(f"WITH {LINES} SELECT topic, count(*) AS n FROM lines WHERE {CATEGORY} = 'GREETING' GROUP BY topic")
def category_topics(spark, d):
    return listings.topics_of_category(event_lines(spark, d), "greeting")


@query(f"WITH {LINES} SELECT topic, {CATEGORY} AS category, count(DISTINCT game) AS games, count(*) AS n FROM lines GROUP BY topic ORDER BY n DESC, topic LIMIT 5")
def topic_listing(spark, d):
    return listings.topic_listing(event_lines(spark, d), most=5)


@query(f"""WITH {TALK}, t AS (SELECT * FROM talk WHERE emotion = 'happy')
  SELECT form_id, text, (SELECT count(*) FROM t) AS total FROM t ORDER BY form_id LIMIT 20 OFFSET 10""")
def dialogue_page(spark, d):
    rows = talk_lines(spark, d).where("emotion = 'happy'").select("form_id", "text")
    return listings.page(rows, ["form_id"], 10, 20)


@query(f"WITH {EDGES} SELECT form_id, game FROM lines l WHERE emotion = 'anger' AND quest = 'Q3' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = l.form_id)")
def start_nodes(spark, d):
    lines = event_lines(spark, d)
    return listings.start_nodes(lines, graphs.line_edges(lines), "Q3", "anger").select("form_id", "game")


@query(f"WITH {TRACES} SELECT event_id, status FROM traces WHERE status IN ('failed', 'rejected') AND stage = 'translate'")
def failures_by_stage(spark, d):
    return listings.failures(traces(spark, d), "translate").select("event_id", "status")


@query(f"SELECT quest FROM ({SQL['arc_shapes']}) WHERE shape = 'transition_neutral_to_happy'")
def quests_by_shape(spark, d):
    arcs = chains.arcs(talk_lines(spark, d), ["quest"])
    return arcs.where(S.arc_transition(F.col("emotions")) == "transition_neutral_to_happy").select("quest")


@query(f"WITH {TALK}, {ARCS} SELECT quest FROM arcs WHERE len(list_filter(range(1, len(e)), lambda i: e[i] = 'anger' AND e[i + 1] = 'sad')) > 0")
def quests_with_transition(spark, d):
    arcs = chains.arcs(talk_lines(spark, d), ["quest"])
    return arcs.where(listings.has_transition(F.col("emotions"), "anger", "sad")).select("quest")


@query(f"WITH {TALK} SELECT DISTINCT quest FROM talk WHERE speaker = 'user'")
def quests_from_source(spark, d):
    groups = talk_lines(spark, d).groupBy("quest").agg(F.collect_set("speaker").alias("speakers"))
    return listings.from_source(groups, "speakers", "user").select("quest")


@query(f"""WITH {EDGES}, {DEG},
  i AS (SELECT 'in' AS side, game, id, in_deg AS degree FROM deg ORDER BY in_deg DESC, game, id LIMIT 10),
  o AS (SELECT 'out' AS side, game, id, out_deg AS degree FROM deg ORDER BY out_deg DESC, game, id LIMIT 10)
  SELECT * FROM i UNION ALL SELECT * FROM o""")
def top_degrees(spark, d):
    lines = event_lines(spark, d)
    return listings.top_degrees(graphs.degrees(lines, graphs.line_edges(lines)), 10)


@query("""WITH c AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1),
  r AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS k, count(*) OVER () AS whole FROM c)
  SELECT part, n FROM c WHERE n >= (SELECT min(n) FROM r WHERE k = CAST(floor(whole * 0.1) AS BIGINT))""")
def top_share_parts(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return listings.top_share(counts, "n", 0.1)


@query(f"""WITH {TRACES} SELECT stage AS key, CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) - count(*) FILTER (WHERE status <> 'completed') AS gap
  FROM traces GROUP BY stage ORDER BY CASE stage WHEN 'curate' THEN 0 ELSE 1 END, gap DESC, stage LIMIT 2""")
def gap_priorities(spark, d):
    done = F.count(F.when(F.col("status") == "completed", 1))
    gaps = traces(spark, d).groupBy(F.col("stage").alias("key")).agg((done - (F.count("*") - done)).alias("gap"))
    return listings.gap_ranking(gaps, 2, F.when(F.col("key") == "curate", 0).otherwise(1))


@query(f"WITH {TRACES} SELECT event_id, day FROM traces ORDER BY day DESC, event_id LIMIT 25")
def recent_traces(spark, d):
    return listings.recent(traces(spark, d).select("event_id", "day"), "day", "event_id", 25)


@query(f"""WITH {TRACES} SELECT game, stage, count(*) AS n, count(*) FILTER (WHERE status <> 'completed') AS failed,
  round(sum(cost), 4) AS cost, round(avg(cost), 6) AS avg_cost, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS success
  FROM traces GROUP BY ROLLUP (game, stage)""")
def trace_statistics(spark, d):
    return listings.trace_statistics(traces(spark, d), ["game", "stage"])


@query(f"WITH {LINES} SELECT emotion AS source, topic AS target, count(*) AS n, arg_min(form_id, pos) AS rationale FROM lines GROUP BY ALL HAVING count(*) >= 20")
def concept_mappings(spark, d):
    rows = event_lines(spark, d).select(F.col("emotion").alias("source"), F.col("topic").alias("target"), F.col("form_id").alias("rationale"), "pos")
    return listings.concept_mappings(rows, 20)


@query("SELECT doc_id AS ticket_id, i AS place, w[i + 1] AS concern FROM (SELECT doc_id, string_split(source || ',' || lang, ',') AS w, unnest([0, 1]) AS i FROM documents)")
def ticket_concerns(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ticket_id"), F.array("source", "lang").alias("concerns"))
    return listings.flattened_concerns(rows)


@query("""WITH d AS (SELECT source AS cluster, quality AS ok, lower(string_split(lang || ' text', ' ')[1]) AS word FROM documents JOIN labels USING (doc_id)),
  w AS (SELECT cluster, word, count(*) AS n, sum(ok) AS ok FROM d GROUP BY ALL)
  SELECT cluster, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS approved, round(sum(ok) / sum(n), 6) AS rate,
  (SELECT word FROM w x WHERE x.cluster = w.cluster ORDER BY n DESC, word DESC LIMIT 1) AS reason FROM w GROUP BY cluster""")
def curator_report(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return listings.curator_report(rows.select(F.col("source").alias("cluster"), F.col("quality").alias("approved"), F.concat_ws(" ", "lang", F.lit("text")).alias("reason")))


@query(f"WITH {LINES}, c AS (SELECT game, emotion, count(*) AS n FROM lines GROUP BY ALL) SELECT game, emotion, n, round(n / sum(n) OVER (PARTITION BY game), 6) AS p FROM c")
def reference_shares(spark, d):
    return listings.normalised(event_lines(spark, d).groupBy("game", "emotion").agg(F.count("*").alias("n")), ["game"])


@query(f"""WITH {EDGES}, n AS (SELECT count(*) FILTER (WHERE game = 'g0') AS a, count(*) FILTER (WHERE game = 'g1') AS b FROM lines),
  e AS (SELECT count(*) FILTER (WHERE game = 'g0') AS c, count(*) FILTER (WHERE game = 'g1') AS d FROM edges)
  SELECT a AS old_nodes, b AS new_nodes, c AS old_edges, d AS new_edges, b - a AS nodes, d - c AS edges FROM n, e""")
def version_difference(spark, d):
    lines = event_lines(spark, d)
    edges = graphs.line_edges(lines)
    of = lambda df, game: df.where(F.col("game") == game)
    return listings.version_difference(of(lines, "g0"), of(edges, "g0"), of(lines, "g1"), of(edges, "g1"))


@query(f"""WITH {LINES}, s AS (SELECT form_id AS a, lpad(CAST(pos * 2 AS VARCHAR), 10, '0') AS b FROM lines)
  SELECT a || CASE WHEN CAST(a AS BIGINT) % 2 = 0 THEN '->' ELSE ' → ' END || b AS site, a AS src, b AS dst FROM s WHERE b IN (SELECT form_id FROM lines)""")
def extension_sites(spark, d):
    lines = event_lines(spark, d)
    arrow = F.when(F.col("pos") % 2 == 0, "->").otherwise(" → ")
    sites = lines.select(F.concat("form_id", arrow, F.lpad((F.col("pos") * 2).cast("string"), 10, "0")).alias("site"))
    sites = sites.unionByName(spark.range(1).select(F.lit("no arrow").alias("site")))
    return listings.extension_sites(sites, lines.select(F.col("form_id").alias("id")))


@query("""SELECT DISTINCT n_name AS noun, upper(n_name) IN (SELECT upper(r_name) FROM region UNION SELECT upper(n_name) FROM nation WHERE n_nationkey % 2 = 0) AS known FROM nation""")
def known_nouns(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    existing = region.select(F.initcap(F.lower("r_name")).alias("noun")).unionByName(nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("noun")))
    return listings.known_nouns(nation.select(F.col("n_name").alias("noun")).distinct(), existing)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unresolved_orders(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return listings.unresolved(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query(f"""WITH {TALK}, c AS (SELECT quest, count(*) AS length FROM talk GROUP BY quest HAVING count(*) >= 3)
  SELECT quest, length FROM c ORDER BY {U.format("'chain:' || quest")}, quest LIMIT 30""")
def chain_sample(spark, d):
    rows = talk_lines(spark, d).groupBy("quest").agg(F.count("*").alias("length"))
    return listings.chain_sample(rows, "quest", 3, 30)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS param1, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value
  FROM events WHERE event_id % 4 IN (1, 2)""")
def stage_conditions(spark, d):
    code = F.element_at(F.array(F.lit(14), F.lit(43), F.lit(79), F.lit(72)), (F.col("event_id") % 4 + 1).cast("int"))
    held = F.array(F.struct(code.alias("function"), F.col("user_id").alias("param1"), "value"), F.struct(F.lit(38).alias("function"), F.lit(-1).cast("bigint").alias("param1"), F.lit(0.0).alias("value")))
    rows = table(spark, d, "events").select("event_id", F.explode(listings.stages_of(held)).alias("s"))
    return rows.select("event_id", F.col("s.param1").cast("bigint").alias("param1"), "s.value")


@query("SELECT lang AS tier, count(*) AS items, count(*) * 350 AS tokens, count(*) * 1750 AS bytes, round(count(*) * 350 * 0.25 / 1e6, 6) AS cost FROM documents GROUP BY lang")
def split_estimate(spark, d):
    return listings.split_estimate(table(spark, d, "documents").select(F.col("lang").alias("tier")), 350, 0.25)


@query(f"""WITH {TGRAPH} SELECT count(*) AS nodes, (SELECT count(*) FROM te) AS edges,
  (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM lines GROUP BY game, topic)) AS responses FROM tn""")
def query_graph_statistics(spark, d):
    nodes, edges = topic_graph(spark, d)
    sizes = event_lines(spark, d).groupBy("game", "topic").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("responses"))
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"))).join(sizes)


@query(f"""WITH RECURSIVE {TGRAPH}, reach AS (SELECT id AS a, id AS b FROM tn UNION SELECT r.a, te.dst FROM reach r JOIN te ON te.src = r.b),
  s AS (SELECT r.a, min(r.b) AS label FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a),
  two_way AS (SELECT src, dst FROM te UNION SELECT dst, src FROM te),
  near AS (SELECT id AS a, id AS b FROM tn UNION SELECT r.a, x.dst FROM near r JOIN two_way x ON x.src = r.b),
  w AS (SELECT a, min(b) AS label FROM near GROUP BY a)
  SELECT 'strong' AS kind, count(DISTINCT label) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY label)) AS largest FROM s
  UNION ALL SELECT 'weak', count(DISTINCT label), (SELECT max(n) FROM (SELECT count(*) AS n FROM w GROUP BY label)) FROM w""")
def component_report(spark, d):
    nodes, edges = topic_graph(spark, d)
    parts = []
    for kind, found in (("strong", A.strong_components(nodes, edges)), ("weak", A.weak_components(nodes, edges))):
        label = next(c for c in found.columns if c != "id")
        sizes = found.groupBy(label).agg(F.count("*").alias("n"))
        parts.append(sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest")).select(F.lit(kind).alias("kind"), "components", "largest"))
    return parts[0].unionByName(parts[1])
