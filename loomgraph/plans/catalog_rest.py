"""Registered queries, third part: reports on runs, samples, splits and text extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs, listings
from ..operators import results as R
from ..sources import sinks
from .catalog import EMO, query
from .catalog_more import U
from .views import LINES, TALK, event_lines, table, talk_lines


@query("""WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'valid' WHEN 'view' THEN 'mapped' WHEN 'click' THEN 'mapped' ELSE 'defaulted' END AS status FROM events) SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM s GROUP BY status""")
def emotion_validation(spark, d):
    raw = F.when(F.col("event_type") == "error", " Anger ").when(F.col("event_type") == "view", "Bureaucratic_Dread").when(F.col("event_type") == "click", "joyful").otherwise("cosmic_horror")
    counts = table(spark, d, "events").groupBy(S.emotion_status(raw).alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.l_orderkey < b.l_orderkey GROUP BY ALL HAVING count(*) >= 2)
  SELECT a, b, shared FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 5""")
def shared_sources(spark, d):
    """Pairs of orders that share two parts or more, five partners each at most."""
    pairs = R.sharing(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    w = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query(f"""WITH {LINES}, {EMO}, a AS (SELECT src_emotion, dst_emotion, count(*) AS n FROM emo WHERE game = 'g0' GROUP BY ALL), b AS (SELECT src_emotion, dst_emotion, count(*) AS m FROM emo WHERE game = 'g1' GROUP BY ALL)
  SELECT coalesce(a.src_emotion, b.src_emotion) AS src_emotion, coalesce(a.dst_emotion, b.dst_emotion) AS dst_emotion, coalesce(n, 0) - coalesce(m, 0) AS change FROM a FULL JOIN b ON a.src_emotion = b.src_emotion AND a.dst_emotion = b.dst_emotion WHERE abs(coalesce(n, 0) - coalesce(m, 0)) > 5""")
def run_comparison(spark, d):
    e = graphs.emotion_edges(event_lines(spark, d))
    part = lambda g, n: e.where(F.col("game") == g).groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias(n))
    both = part("g0", "n").join(part("g1", "m"), ["src_emotion", "dst_emotion"], "full_outer").fillna(0)
    return both.withColumn("change", F.col("n") - F.col("m")).where("abs(change) > 5").select("src_emotion", "dst_emotion", "change")


@query(f"""WITH {LINES}, {EMO}, {TALK}, exp AS (SELECT src_emotion, dst_emotion, count(*) AS expected FROM emo GROUP BY ALL), t AS (SELECT emotion AS s, lead(emotion) OVER (PARTITION BY quest ORDER BY pos) AS t FROM talk), act AS (SELECT s, t, count(*) AS actual FROM t WHERE t IS NOT NULL GROUP BY ALL)
  SELECT src_emotion, dst_emotion, expected, coalesce(actual, 0) AS actual FROM exp LEFT JOIN act ON s = src_emotion AND t = dst_emotion WHERE coalesce(actual, 0) < 0.1 * expected""")
def missing_transitions(spark, d):
    expected = graphs.emotion_edges(event_lines(spark, d)).groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("expected"))
    w = Window.partitionBy("quest").orderBy("pos")
    actual = talk_lines(spark, d).select(F.col("emotion").alias("src_emotion"), F.lead("emotion").over(w).alias("dst_emotion")).where("dst_emotion IS NOT NULL").groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("actual"))
    return expected.join(actual, ["src_emotion", "dst_emotion"], "left").fillna(0, ["actual"]).where("actual < 0.1 * expected")


@query(f"""WITH {LINES}, r AS (SELECT topic, game, form_id, row_number() OVER (PARTITION BY topic, game ORDER BY {U.format("'answers:' || form_id")}, form_id) AS rn FROM lines) SELECT topic, game, form_id FROM r WHERE rn <= 2""")
def topic_answers(spark, d):
    w = Window.partitionBy("topic", "game").orderBy(S.draw(F.lit("answers"), F.col("form_id")), "form_id")
    return event_lines(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("topic", "game", "form_id")


@query(f"""WITH {LINES}, {EMO} SELECT game, count(*) AS edges, round(avg(CASE WHEN src_emotion = dst_emotion THEN 1.0 ELSE 0.0 END), 6) AS self_loops, count(DISTINCT src_emotion || '>' || dst_emotion) AS pairs FROM emo GROUP BY game""")
def wave_stats(spark, d):
    e = graphs.emotion_edges(event_lines(spark, d))
    return e.groupBy("game").agg(F.count("*").alias("edges"), F.round(F.avg(F.when(F.col("src_emotion") == F.col("dst_emotion"), 1.0).otherwise(0.0)), 6).alias("self_loops"), F.count_distinct("src_emotion", "dst_emotion").alias("pairs"))


@query("SELECT event_id, json_extract_string(regexp_extract('note ```json ' || props || '``` end', '(\\{.*\\})', 1), '$.k') AS k FROM events")
def json_extraction(spark, d):
    text = F.concat(F.lit("note ```json "), F.col("props"), F.lit("``` end"))
    return table(spark, d, "events").select("event_id", F.get_json_object(F.regexp_extract(text, r"(\{.*\})", 1), "$.k").alias("k"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence FROM documents),
  w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(sentence, '\s+', ' ', 'g')), ' '), lambda x: x <> '')[2:]) AS word FROM s),
  n AS (SELECT DISTINCT doc_id, word FROM w WHERE regexp_matches(word, '^\p{Lu}\p{L}+$'))
  SELECT d.doc_id, coalesce((SELECT string_agg(word, '|' ORDER BY word) FROM n WHERE n.doc_id = d.doc_id), '') AS nouns FROM documents d""")
def proper_nouns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(listings.proper_nouns(F.col("text")), "|").alias("nouns"))


@query("SELECT doc_id FROM documents ORDER BY sha256('split1:' || doc_id), doc_id LIMIT 200")
def split_render(spark, d):
    return sinks.split_of(table(spark, d, "documents").select("doc_id"), "doc_id", "split1", 200)


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS source_ref, length(text) AS size FROM documents")
def hashed_sources(spark, d):
    rows, _ = sinks.hashed_sources(table(spark, d, "documents").select("doc_id", "text", F.length("text").cast("long").alias("size")), "text")
    return rows.select("doc_id", "source_ref", "size")


@query("""WITH s AS (SELECT l.quality, l.toxic, d.n_chars / 1000.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)), p AS (SELECT avg(score) AS p FROM s WHERE quality = 1 AND toxic = 0)
  SELECT toxic, quality, count(*) AS n, round(avg(ln(1 + exp(score - p))), 6) AS loss, round(avg(ln(score * score + 1e-6)), 6) AS spread FROM s, p GROUP BY toxic, quality""")
def ranking_losses(spark, d):
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", "toxic", (F.col("n_chars") / F.lit(1000.0)).alias("score"))
    p = s.where("quality = 1 AND toxic = 0").agg(F.avg("score").alias("p"))
    return s.join(F.broadcast(p)).groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.round(F.avg(F.log(1 + F.exp(F.col("score") - F.col("p")))), 6).alias("loss"), F.round(F.avg(F.log(F.col("score") * F.col("score") + 1e-6)), 6).alias("spread"))


@query(f"""WITH {TALK}, t AS (SELECT *, lag(emotion) OVER (PARTITION BY quest ORDER BY pos) AS came FROM talk) SELECT form_id, emotion, came AS transition_from, CASE row_number() OVER (PARTITION BY quest ORDER BY pos) % 2 WHEN 1 THEN 'A' ELSE 'B' END AS voice FROM t""")
def beat_rows(spark, d):
    w = Window.partitionBy("quest").orderBy("pos")
    return talk_lines(spark, d).select("form_id", "emotion", F.lag("emotion").over(w).alias("transition_from"), F.when(F.row_number().over(w) % 2 == 1, "A").otherwise("B").alias("voice"))


@query("""SELECT quality, toxic, lang, count(*) AS n, round(avg(n_chars), 6) AS size FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((quality, toxic), (lang), ())""")
def corpus_report(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupingSets([["quality", "toxic"], ["lang"], []], "quality", "toxic", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("size"))


@query(f"""WITH {LINES}, {EMO}, pc AS (SELECT src_emotion, dst_emotion, count(*) AS n FROM emo GROUP BY ALL), pr AS (SELECT src_emotion, dst_emotion, n / sum(n) OVER (PARTITION BY src_emotion) AS p FROM pc), t AS (SELECT form_id AS terminus, emotion FROM lines WHERE stage IS NOT NULL),
  c AS (SELECT t.terminus, p.dst_emotion, -ln(greatest({U.format("'guide:' || t.terminus || ':' || p.dst_emotion")}, 2.0 ** -32)) / greatest(p.p, 0.01) AS k FROM t JOIN pr p ON t.emotion = p.src_emotion)
  SELECT terminus, dst_emotion FROM c QUALIFY row_number() OVER (PARTITION BY terminus ORDER BY k, dst_emotion) <= 2""")
def guided_targets(spark, d):
    lines = event_lines(spark, d)
    counts = graphs.emotion_edges(lines).groupBy("src_emotion", "dst_emotion").agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src_emotion")))
    ends = lines.where("stage IS NOT NULL").select(F.col("form_id").alias("terminus"), F.col("emotion").alias("src_emotion"))
    u = F.greatest(S.draw(F.lit("guide"), F.col("terminus"), F.col("dst_emotion")), F.lit(2.0**-32))
    c = ends.join(F.broadcast(p), "src_emotion").withColumn("k", -F.log(u) / F.greatest("p", F.lit(0.01)))
    w = Window.partitionBy("terminus").orderBy("k", "dst_emotion")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("terminus", "dst_emotion")
