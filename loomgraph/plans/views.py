"""The driver's tables as annotated lines: DataFrames, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines: game, pos, form_id, topic, speaker, quest, emotion, text, stage (of a gating condition, or null)."""
    k = F.get_json_object("props", "$.k").cast("int")
    emotion = F.create_map(*(F.lit(x) for pair in {"view": "neutral", "click": "happy", "error": "anger", "signup": "surprise"}.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("game"),
        F.col("event_id").alias("pos"),
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("form_id"),
        F.when(k % 10 == 0, "GREETING").otherwise(F.concat(F.lit("T"), (k % 10).cast("string"))).alias("topic"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("speaker"),
        F.concat(F.lit("Q"), F.dayofmonth("ts").cast("string")).alias("quest"),
        F.coalesce(F.try_element_at(emotion, F.col("event_type")), F.lit("sad")).alias("emotion"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double")).alias("stage"),
    )


LINES = """lines AS (
  SELECT 'g' || CAST(user_id % 4 AS VARCHAR) AS game, event_id AS pos, lpad(CAST(event_id AS VARCHAR), 10, '0') AS form_id,
         CASE WHEN k % 10 = 0 THEN 'GREETING' ELSE 'T' || CAST(k % 10 AS VARCHAR) END AS topic,
         'u' || CAST(user_id AS VARCHAR) AS speaker, 'Q' || CAST(day(ts) AS VARCHAR) AS quest,
         CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'happy' WHEN 'error' THEN 'anger' WHEN 'signup' THEN 'surprise' ELSE 'sad' END AS emotion,
         event_type || ' ' || props AS text,
         CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS DOUBLE) END AS stage
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as lines; the emotion is by the text's length."""
    names = F.array(*(F.lit(e) for e in ("neutral", "happy", "anger", "sad", "fear", "surprise", "disgust")))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("game"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("form_id"),
        F.when(F.col("turn") == 0, "GREETING").otherwise(F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string"))).alias("topic"),
        F.col("role").alias("speaker"),
        F.col("conv_id").cast("string").alias("quest"),
        F.element_at(names, (F.length("text") % 7 + 1).cast("int")).alias("emotion"),
        "text",
    )


TALK = """talk AS (
  SELECT 'c' || CAST(conv_id % 3 AS VARCHAR) AS game, conv_id * 1000 + turn AS pos,
         lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS form_id,
         CASE WHEN turn = 0 THEN 'GREETING' ELSE 'turn' || CAST(turn % 3 AS VARCHAR) END AS topic,
         role AS speaker, CAST(conv_id AS VARCHAR) AS quest,
         ['neutral', 'happy', 'anger', 'sad', 'fear', 'surprise', 'disgust'][length(text) % 7 + 1] AS emotion, text
  FROM conversations
)"""
