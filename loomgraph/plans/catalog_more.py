"""Registered queries, second part: distances, analytics, walks, linking, filters, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytics as A
from ..operators import chains, filters, graphs, linking, stats, tickets
from .catalog import DEG, EDGES, EMO, TGRAPH, query, r6, topic_graph
from .views import LINES, TALK, event_lines, table, talk_lines

U = "(('0x' || substr(sha256({}), 1, 8))::BIGINT / 4294967296)"


# --- distances and gaps ------------------------------------------------------------------------

PQ = f"""{LINES}, {EMO}, a AS (SELECT src_emotion, dst_emotion, count(*) / sum(count(*)) OVER () AS p FROM emo WHERE game IN ('g0', 'g1') GROUP BY ALL),
  b AS (SELECT src_emotion, dst_emotion, count(*) / sum(count(*)) OVER () AS q FROM emo WHERE game = 'g2' GROUP BY ALL),
  j AS (SELECT coalesce(a.src_emotion, b.src_emotion) AS s, coalesce(a.dst_emotion, b.dst_emotion) AS t, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b ON a.src_emotion = b.src_emotion AND a.dst_emotion = b.dst_emotion)"""


def two_distributions(spark, d):
    e = graphs.emotion_edges(event_lines(spark, d))
    part = lambda where: stats.share(e.where(where).groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("n")), ["src_emotion", "dst_emotion"])
    return part("game IN ('g0', 'g1')"), part("game = 'g2'"), ["src_emotion", "dst_emotion"]


@query(f"""WITH {PQ}, e AS (SELECT CASE WHEN p > 0 THEN p ELSE 1e-10 END AS p, CASE WHEN q > 0 THEN q ELSE 1e-10 END AS q, (p + q) / 2 AS m, abs(p - q) AS d FROM j)
  SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sum(q * ln(q / p)), 6) AS kl_reverse, round(sum(d) / 2, 6) AS tv, round((sum(p * ln(p / m)) + sum(q * ln(q / m))) / 2, 6) AS js FROM e""")
def transition_distances(spark, d):
    return stats.distances(*two_distributions(spark, d)).select(r6("kl"), r6("kl_reverse"), r6("tv"), r6("js"))


@query(f"WITH {PQ} SELECT s AS src_emotion, t AS dst_emotion, round(p, 6) AS reference, round(q, 6) AS target, round(p - q, 6) AS gap FROM j WHERE p > 0.001 AND p - q > 0.001")
def transition_gaps(spark, d):
    p, q, keys = two_distributions(spark, d)
    return stats.gaps(p, q, keys, 0.001).select(*keys, r6("reference"), r6("target"), r6("gap"))


@query(f"""WITH {EDGES}, {DEG}, a AS (SELECT out_deg AS k, count(*) / sum(count(*)) OVER () AS p FROM deg WHERE game = 'g0' GROUP BY 1), b AS (SELECT out_deg AS k, count(*) / sum(count(*)) OVER () AS q FROM deg WHERE game = 'g1' GROUP BY 1),
  j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM a FULL JOIN b USING (k))
  SELECT round((coalesce(sum(p * ln(p / (m + 1e-10) + 1e-10)) FILTER (WHERE p > 0), 0) + coalesce(sum(q * ln(q / (m + 1e-10) + 1e-10)) FILTER (WHERE q > 0), 0)) / 2, 6) AS js, round(sum(abs(p - q)) / 2, 6) AS tv, count(*) FILTER (WHERE p > 0 AND q > 0) AS shared FROM j""")
def degree_divergence(spark, d):
    lines = event_lines(spark, d)
    deg = graphs.degrees(lines, graphs.line_edges(lines))
    part = lambda g: stats.share(deg.where(F.col("game") == g).groupBy("out_deg").agg(F.count("*").alias("n")), ["out_deg"])
    return stats.degree_divergence(part("g0"), part("g1"), ["out_deg"]).select(r6("js"), r6("tv"), "shared")


@query(f"""WITH {LINES}, {EMO}, c AS (SELECT game, src_emotion, dst_emotion, count(*) AS n FROM emo GROUP BY ALL), g AS (SELECT src_emotion, dst_emotion, n / sum(n) OVER (PARTITION BY game) AS p, sum(n) OVER (PARTITION BY game) AS edges FROM c)
  SELECT src_emotion, dst_emotion, round(sum(p * edges) / sum(edges), 6) AS p FROM g GROUP BY ALL""")
def pooled_reference(spark, d):
    counts = graphs.emotion_edges(event_lines(spark, d)).groupBy("game", "src_emotion", "dst_emotion").agg(F.count("*").alias("n"))
    per = counts.withColumn("edges", F.sum("n").over(Window.partitionBy("game"))).withColumn("p", F.col("n") / F.col("edges"))
    return stats.weighted_pool(per, ["src_emotion", "dst_emotion"]).select("src_emotion", "dst_emotion", r6("p"))


# --- analytics ---------------------------------------------------------------------------------


@query()
def order_components(spark, d):
    """Components of customers and the days-and-groups on which they ordered: their sizes."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) * 7 + F.col("o_custkey") % 97
    e = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("d"), day.cast("string")).alias("dst"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    sizes = A.weak_components(nodes, e).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {TGRAPH}, both_ AS (SELECT src AS a, dst AS b FROM te UNION SELECT dst, src FROM te), reach AS (SELECT id, id AS r FROM tn UNION SELECT reach.id, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
  SELECT id, min(r) AS component FROM reach GROUP BY id""")
def weak_components(spark, d):
    return A.weak_components(*topic_graph(spark, d))


@query(f"""WITH RECURSIVE {TGRAPH}, h AS (SELECT src, dst FROM te WHERE weight >= 12), reach AS (SELECT id, id AS r FROM tn UNION SELECT reach.id, h.dst FROM reach JOIN h ON reach.r = h.src)
  SELECT a.id, max(b.id) AS component FROM reach a JOIN reach b ON a.r = b.id AND a.id = b.r GROUP BY a.id""")
def strong_components(spark, d):
    nodes, edges = topic_graph(spark, d)
    return A.strong_components(nodes, edges.where("weight >= 12"))


@query(f"""WITH RECURSIVE {TGRAPH}, cnt AS (SELECT count(*) AS n FROM tn), s AS (SELECT te.src, dst, weight / sum(weight) OVER (PARTITION BY te.src) AS share FROM te), dang AS (SELECT id FROM tn ANTI JOIN te ON tn.id = te.src),
  pr AS (SELECT 0 AS k, id, 1.0::DOUBLE / n AS rank FROM tn, cnt UNION ALL
    SELECT k + 1, id, 0.15 / n + 0.85 * (come + lost / n) FROM (SELECT k, tn.id, coalesce((SELECT sum(p.rank * s.share) FROM pr p JOIN s ON p.id = s.src WHERE s.dst = tn.id), 0) AS come,
      coalesce((SELECT sum(p.rank) FROM pr p JOIN dang ON p.id = dang.id), 0) AS lost, n FROM (SELECT DISTINCT k FROM pr), tn, cnt) WHERE k < 20)
  SELECT id, round(rank, 6) AS rank FROM pr WHERE k = 20""")
def pagerank_20(spark, d):
    return A.pagerank(*topic_graph(spark, d)).select("id", r6("rank"))


@query(f"""WITH RECURSIVE {TGRAPH}, h AS (SELECT src, dst FROM te WHERE weight >= 12), bfs AS (SELECT 'g0:GREETING' AS id, 0 AS hops UNION SELECT h.dst, hops + 1 FROM bfs JOIN h ON bfs.id = h.src WHERE hops < 12)
  SELECT id, min(hops) AS hops FROM bfs GROUP BY id""")
def bfs_distance(spark, d):
    edges = topic_graph(spark, d)[1].where("weight >= 12")
    return A.distances(edges, "g0:GREETING").select("id", "hops")


@query(f"WITH {TGRAPH}, near AS (SELECT 'g1:T3' AS id UNION SELECT dst FROM te WHERE src = 'g1:T3' UNION SELECT src FROM te WHERE dst = 'g1:T3') SELECT src, dst, weight FROM te WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)")
def ego_subgraph(spark, d):
    return A.ego(topic_graph(spark, d)[1], "g1:T3", 2)[1].select("src", "dst", "weight")


@query(f"""WITH RECURSIVE {TGRAPH}, h AS (SELECT src, dst FROM te WHERE weight >= 12), p AS (SELECT src, dst AS last, [src, dst] AS path FROM h WHERE src < dst UNION ALL SELECT p.src, h.dst, list_append(path, h.dst) FROM p JOIN h ON p.last = h.src WHERE len(path) < 4 AND h.dst > p.src AND NOT list_contains(path, h.dst))
  SELECT array_to_string(path, '>') AS cycle, len(path) AS length FROM p JOIN h ON p.last = h.src AND h.dst = p.src""")
def topic_cycles(spark, d):
    return A.cycles(topic_graph(spark, d)[1].where("weight >= 12")).withColumn("length", F.col("length").cast("long"))


@query(f"""WITH RECURSIVE {TGRAPH}, h AS (SELECT src, dst FROM te WHERE weight >= 12), b AS (SELECT src, dst, 1 AS hops FROM h UNION SELECT b.src, h.dst, hops + 1 FROM b JOIN h ON b.dst = h.src WHERE hops < 12), dd AS (SELECT src, dst, min(hops) AS hops FROM b WHERE src <> dst GROUP BY ALL),
  c AS (SELECT dst AS id, count(*) AS reach, sum(hops) AS total FROM dd GROUP BY 1), n AS (SELECT count(*) AS n FROM tn)
  SELECT tn.id, round(coalesce(reach / total * reach / (n - 1), 0), 6) AS closeness FROM tn LEFT JOIN c ON tn.id = c.id, n""")
def closeness(spark, d):
    nodes, edges = topic_graph(spark, d)
    return A.closeness(edges.where("weight >= 12"), nodes).select("id", r6("closeness"))


@query()
def betweenness(spark, d):
    nodes, edges = topic_graph(spark, d)
    return A.betweenness(edges.where("weight >= 12"), nodes).select("id", r6("betweenness"))


@query()
def communities(spark, d):
    nodes, edges = topic_graph(spark, d)
    return A.communities(nodes, edges)


WALK = """w AS (
  SELECT 'w' || i AS walk_id, 0 AS step, id, [id] AS path FROM (SELECT id, row_number() OVER (ORDER BY id) AS i FROM tn)
  UNION ALL
  SELECT walk_id, step, dst, list_append(path, dst) FROM (
    SELECT w.walk_id, w.step + 1 AS step, te.dst, w.path, sum(te.weight) OVER (PARTITION BY w.walk_id ORDER BY te.dst) AS upto, sum(te.weight) OVER (PARTITION BY w.walk_id) AS total
    FROM w JOIN te ON w.id = te.src WHERE w.step < 4 AND NOT list_contains(w.path, te.dst))
  WHERE {u} * total <= upto QUALIFY row_number() OVER (PARTITION BY walk_id ORDER BY dst) = 1)"""


@query(f"WITH RECURSIVE {TGRAPH}, {WALK.format(u=U.format("'walk:' || walk_id || ':' || step"))} SELECT walk_id, step, id FROM w")
def random_walks(spark, d):
    nodes, edges = topic_graph(spark, d)
    starts = nodes.select(F.concat(F.lit("w"), F.row_number().over(Window.orderBy("id")).cast("string")).alias("walk_id"), "id")
    return A.walks(edges, starts, 4)


@query(f"SELECT p_partkey, p_size FROM (SELECT *, -ln(greatest({U.format("'sample:' || p_partkey")}, 2.0 ** -32)) / p_size AS k FROM part) ORDER BY k, p_partkey LIMIT 100")
def weighted_sample(spark, d):
    return A.weighted_sample(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 100)


@query(f"""WITH {LINES}, r AS (SELECT emotion, game, form_id, row_number() OVER (PARTITION BY emotion, game ORDER BY {U.format("'pair:' || form_id")}, form_id) AS rn FROM lines)
  SELECT a.emotion, a.form_id AS first, b.form_id AS second FROM r a JOIN r b ON a.emotion = b.emotion AND a.rn = b.rn AND a.game = 'g0' AND b.game = 'g1' WHERE a.rn <= 5""")
def cross_pairs(spark, d):
    w = Window.partitionBy("emotion", "game").orderBy(S.draw(F.lit("pair"), F.col("form_id")), "form_id")
    r = event_lines(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    a = r.where("game = 'g0'").select("emotion", "rn", F.col("form_id").alias("first"))
    return a.join(r.where("game = 'g1'").select("emotion", "rn", F.col("form_id").alias("second")), ["emotion", "rn"]).select("emotion", "first", "second")


# --- linking, growth, queues -------------------------------------------------------------------


@query(f"""WITH {LINES}, fit AS (SELECT * FROM (VALUES ('neutral','neutral',1.0),('neutral','happy',0.8),('neutral','sad',0.7),('neutral','anger',0.6),('neutral','surprise',0.7),('happy','happy',1.0),('happy','neutral',0.8),('happy','surprise',0.7),('sad','sad',1.0),('sad','neutral',0.7),
    ('anger','anger',1.0),('anger','neutral',0.6),('surprise','surprise',1.0),('surprise','neutral',0.7)) t(a, b, s)), t AS (SELECT form_id AS id, emotion FROM lines WHERE stage IS NOT NULL), e AS (SELECT form_id AS id, emotion FROM lines WHERE topic = 'GREETING'),
  f AS (SELECT id, emotion FROM e QUALIFY row_number() OVER (PARTITION BY emotion ORDER BY id) <= 4),
  c AS (SELECT t.id AS terminus, f.id AS entry, CAST(coalesce(x.s, y.s * 0.9, 0.4) AS DOUBLE) AS score FROM t JOIN f ON t.id <> f.id LEFT JOIN fit x ON x.a = t.emotion AND x.b = f.emotion LEFT JOIN fit y ON y.a = f.emotion AND y.b = t.emotion)
  SELECT terminus, entry, round(score, 6) AS score FROM c WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY terminus ORDER BY score DESC, entry) <= 3""")
def link_candidates(spark, d):
    lines = event_lines(spark, d).select(F.col("form_id").alias("id"), "emotion", "stage", "topic")
    return linking.link_candidates(lines.where("stage IS NOT NULL"), lines.where("topic = 'GREETING'")).withColumn("score", F.round("score", 6))


@query()
def chosen_links(spark, d):
    lines = event_lines(spark, d).select(F.col("form_id").alias("id"), "emotion", "stage", "topic")
    c = linking.link_candidates(lines.where("stage IS NOT NULL"), lines.where("topic = 'GREETING'"))
    return linking.chosen_links(c).withColumn("score", F.round("score", 6))


@query(f"""WITH {TALK}, k AS (SELECT topic AS hub_key, count(*) AS aggregates FROM talk GROUP BY 1 HAVING count(*) >= 3) SELECT 'hub_' || substr(sha256(hub_key), 1, 12) AS src, form_id AS dst FROM talk JOIN k ON topic = hub_key""")
def topic_hubs(spark, d):
    nodes = talk_lines(spark, d).select(F.col("form_id").alias("id"), "topic", F.lit(0).alias("beat_index"))
    return linking.topic_hubs(nodes, "topic")[1].select("src", "dst")


@query(f"""WITH {TALK}, b AS (SELECT quest, emotion, text, row_number() OVER (PARTITION BY quest ORDER BY pos) - 1 AS i FROM talk), n AS (SELECT *, 'syn_' || substr(sha256('run1_' || quest || '_' || i), 1, 12) AS id FROM b)
  SELECT * FROM (SELECT lag(id) OVER w AS src, id AS dst, lag(emotion) OVER w || '->' || emotion AS transition FROM n WINDOW w AS (PARTITION BY quest ORDER BY i)) WHERE src IS NOT NULL""")
def compiled_edges(spark, d):
    rows = talk_lines(spark, d).groupBy("quest").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "emotion"))).alias("r"))
    done = rows.select(F.lit("run1").alias("run_id"), F.col("quest").alias("ticket_id"), F.lit("completed").alias("status"), F.transform("r", lambda x: x.text).alias("texts"), F.transform("r", lambda x: x.emotion).alias("emotions"))
    none = spark.createDataFrame([], "id string")
    return linking.compiled(done, none)[1]


STATE = """ev AS (SELECT l_orderkey AS ticket_id, ['parse', 'translate', 'link'][l_orderkey % 3 + 1] AS stage, l_partkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity < 15 THEN 'create' WHEN l_quantity < 30 THEN 'claim' ELSE 'submit' END AS kind,
    CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'review' END AS outcome FROM (SELECT l_orderkey, l_partkey, l_linenumber, any_value(l_quantity) AS l_quantity, any_value(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL HAVING count(*) = 1)),
  cl AS (SELECT ticket_id, stage, min(pos) FILTER (WHERE kind = 'claim') AS claimed FROM ev GROUP BY ALL),
  st AS (SELECT ev.ticket_id, ev.stage, any_value(claimed) AS claimed, arg_min(coalesce(outcome, 'ok'), pos) FILTER (WHERE kind = 'submit' AND pos > claimed) AS outcome FROM ev JOIN cl ON ev.ticket_id = cl.ticket_id AND ev.stage = cl.stage GROUP BY ev.ticket_id, ev.stage),
  tk AS (SELECT ticket_id, stage, CASE WHEN outcome = 'error' THEN 'failed' WHEN outcome = 'review' THEN 'needs_review' WHEN outcome IS NOT NULL THEN 'completed' WHEN claimed IS NOT NULL THEN 'claimed' ELSE 'pending' END AS status FROM st)"""


def ticket_events(spark, d):
    once = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_quantity").alias("q"), F.first("l_returnflag").alias("f")).where("n = 1")
    return once.select(
        F.col("l_orderkey").alias("ticket_id"), F.element_at(F.array(F.lit("parse"), F.lit("translate"), F.lit("link")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("stage"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("q") < 15, "create").when(F.col("q") < 30, "claim").otherwise("submit").alias("kind"), F.when(F.col("f") == "R", "error").when(F.col("f") == "A", "review").alias("outcome"),
    )


@query(f"WITH {STATE} SELECT ticket_id, stage, status FROM tk")
def ticket_states(spark, d):
    return tickets.states(ticket_events(spark, d))


@query(f"""WITH {STATE} SELECT stage, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'claimed') AS claimed, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) AS total FROM tk GROUP BY stage""")
def queue_status(spark, d):
    return tickets.queue_status(tickets.states(ticket_events(spark, d)))


@query(f"WITH {STATE} SELECT ticket_id || '_' || CASE stage WHEN 'parse' THEN 'translate' ELSE 'curate' END AS ticket_id, CASE stage WHEN 'parse' THEN 'translate' ELSE 'curate' END AS stage, 'pending' AS status FROM tk WHERE status = 'completed' AND stage IN ('parse', 'translate')")
def ticket_follow_ups(spark, d):
    return tickets.follow_ups(tickets.states(ticket_events(spark, d)), {"parse": "translate", "translate": "curate"})


# --- scalars and filters -----------------------------------------------------------------------


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'anger' WHEN 'view' THEN 'fear' WHEN 'click' THEN 'happy' ELSE 'neutral' END AS emotion, CASE event_type WHEN 'error' THEN 'valid' WHEN 'view' THEN 'mapped' WHEN 'click' THEN 'mapped' ELSE 'defaulted' END AS status FROM events""")
def emotion_repair(spark, d):
    raw = F.when(F.col("event_type") == "error", " Anger ").when(F.col("event_type") == "view", "Bureaucratic_Dread").when(F.col("event_type") == "click", "joyful").otherwise("cosmic_horror")
    return table(spark, d, "events").select("event_id", S.canonical_emotion(raw).alias("emotion"), S.emotion_status(raw).alias("status"))


def _like(words):
    return "(" + " OR ".join(f"contains(t, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"""WITH {TALK}, x AS (SELECT *, lower(text) AS t FROM talk) SELECT form_id, CASE WHEN {_like(S.OBLIGE)} AND emotion IN ('anger', 'threat') THEN 'threaten' WHEN {_like(S.PLEAD)} THEN 'plead' WHEN {_like(S.CLOCK)} AND emotion IN ('anger', 'neutral') THEN 'react' WHEN {_like(S.ASSENT)} THEN 'comply'
  WHEN {_like(S.REFUSAL)} THEN 'refuse' WHEN {_like(S.ASKING)} THEN 'query' WHEN {_like(S.PARTING)} THEN 'farewell' WHEN emotion = 'neutral' AND length(text) < 40 THEN 'bark' WHEN emotion IN ('anger', 'disgust') THEN 'threaten' ELSE 'deliver_information' END AS function,
  CASE WHEN {_like(S.COUNTDOWN)} THEN 'countdown' WHEN {_like(S.CONFRONTATION)} THEN 'confrontation' WHEN {_like(S.NEGOTIATION)} THEN 'negotiation' ELSE 'ambient' END AS barrier, 'stranger_to_stranger' AS relation FROM x""")
def beat_parse(spark, d):
    return talk_lines(spark, d).select("form_id", S.beat_function(F.col("text"), F.col("emotion")).alias("function"), S.barrier_type(F.col("text")).alias("barrier"), S.archetype_relation(F.col("speaker")).alias("relation"))


GRADE = "round(0.39::DOUBLE * w / greatest(1, s) + 11.8::DOUBLE * v / w - 15.59::DOUBLE, 6)"
TEXTS = "x AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w, length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS s, length(text) - length(regexp_replace(text, '[aeiouAEIOU]', '', 'g')) AS v FROM documents)"


@query(f"WITH {TEXTS} SELECT doc_id, CASE WHEN w > 0 THEN {GRADE} END AS grade FROM x")
def reading_grade(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(S.reading_grade(F.col("text")), 6).alias("grade"))


@query(f"""WITH {TEXTS}, g AS (SELECT *, lower(text) AS t, CASE WHEN w > 0 THEN 0.39::DOUBLE * w / greatest(1, s) + 11.8::DOUBLE * v / w - 15.59::DOUBLE END AS grade FROM x)
  SELECT doc_id, CASE WHEN w < 30 THEN 'too_short' WHEN w > 400 THEN 'too_long' WHEN {_like(S.META)} THEN 'meta_commentary' WHEN abs(grade - 12) > 1.5 THEN 'grade_mismatch' END AS reject_reason FROM g""")
def grade_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.grade_reason(F.col("text"), F.lit(12)).alias("reject_reason"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 100)")
def prefix_distinct(spark, d):
    return filters.prefix_distinct(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("SELECT substr(sha256(text), 1, 16) AS hash, min(doc_id) AS first, count(*) AS support_count FROM documents GROUP BY 1")
def support_counts(spark, d):
    return filters.supported(table(spark, d, "documents"), "text", "doc_id")


@query(f"WITH {TALK} SELECT field, value, count(*) AS n FROM (SELECT 'speaker' AS field, speaker AS value FROM talk UNION ALL SELECT 'emotion', emotion FROM talk) WHERE NOT (field = 'speaker' AND value IN ('user', 'assistant')) AND NOT (field = 'emotion' AND value IN ('neutral', 'happy')) GROUP BY ALL")
def schema_report(spark, d):
    return filters.domain_report(talk_lines(spark, d), {"speaker": ["user", "assistant"], "emotion": ["neutral", "happy"]})


@query(f"WITH {TALK} SELECT quest, string_agg('\"' || trim(text) || '\"', chr(10) ORDER BY pos) AS text FROM talk GROUP BY quest")
def flattened_walks(spark, d):
    rows = talk_lines(spark, d).groupBy("quest").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text).alias("beats"))
    return rows.select("quest", filters.flattened(F.col("beats")).alias("text"))


@query("SELECT p, greatest(2, CAST(floor(25.0 / (1.0 + exp(-10.0 * (p - 0.3)))) AS INTEGER)) AS allowed FROM (SELECT DISTINCT l_discount * 10 AS p FROM lineitem)")
def warm_up(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("p")).distinct().withColumn("allowed", S.warm_up(F.col("p")))


@query("""SELECT c_custkey, c_acctbal FROM (SELECT *, coalesce(sum(greatest(c_acctbal, 0)) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM customer WHERE c_mktsegment = 'BUILDING') WHERE before < 100000""")
def sample_to_size(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").withColumn("size", F.greatest("c_acctbal", F.lit(0.0)))
    return stats.until_size(c, "c_custkey", "size", 100000).select("c_custkey", "c_acctbal")


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_traces(spark, d):
    rows = table(spark, d, "events").groupBy(F.window(F.col("ts"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""SELECT vec_id, round(30.0 * tanh((sum(x * w) / sqrt(sum(x * x) / 64 + 1e-6)) / 30.0), 4) AS score FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, ((unnest(range(64)) % 7) - 3) / 10.0 AS w FROM embeddings) GROUP BY vec_id""")
def reward_head(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.transform("e", lambda x, i: x * ((i % 7) - 3) / F.lit(10.0)))
    norm = F.sqrt(total(F.transform("e", lambda x: x * x)) / 64 + F.lit(1e-6))
    return e.select("vec_id", F.round(F.lit(30.0) * F.tanh(dot / norm / 30.0), 4).alias("score"))
