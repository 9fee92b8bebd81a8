"""Readers of corpus files, JSON lines and graphs; each gives a DataFrame with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def struct_of(fields: str) -> T.StructType:
    """A schema from "name type, ...", without a session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


CONDITION = struct_of("type int, function int, value double, param1 long, param2 long, run_on int")
LINE = struct_of("form_id string, text string, speaker string, emotion string, emotion_value int, topic string, quest string, source string")
LINE.add("conditions", T.ArrayType(CONDITION))
CORPUS = T.StructType([T.StructField("game", T.StringType()), T.StructField("total_lines", T.IntegerType()), T.StructField("dialogue", T.ArrayType(LINE))])
NODE = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
GRAPH = T.StructType([T.StructField("nodes", NODE), T.StructField("edges", NODE)])


def read_corpora(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of corpus files: game, pos and LINE.

    The game is the file's own, else its name without ``_full_dialogue.json`` or ``_dialogue.json``.
    A missing emotion is neutral, a missing topic, text or id is empty; a JSON null stays null only
    where a text is null. Where a game has a ``_full_`` file, its plain files of the same name are left
    out; all other files of a game are united, in the order of their names.
    """
    files = spark.read.schema(CORPUS).option("multiLine", True).json(list(paths)).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    stem = F.regexp_replace("file", r"(_full)?_dialogue\.json$|\.json$", "")
    files = files.withColumn("game", F.coalesce("game", stem))
    plain = F.regexp_replace("file", "_full_", "_")
    files = files.withColumn("whole", F.max(F.col("file").contains("_full_")).over(Window.partitionBy("game", plain)))
    files = files.where(~F.col("whole") | F.col("file").contains("_full_"))
    w = Window.partitionBy("game").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("before", F.coalesce(F.sum(F.size("dialogue")).over(w), F.lit(0)))
    lines = files.select("game", "before", F.posexplode("dialogue").alias("pos", "l")).select("game", (F.col("before") + F.col("pos")).cast("long").alias("pos"), "l.*")
    return lines.fillna({"emotion": "neutral", "topic": "", "form_id": ""})


def discovered(spark: SparkSession, *paths: str) -> DataFrame:
    """(game, file, records) of each corpus file; files that cannot be read are left out."""
    files = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "DROPMALFORMED").json(list(paths))
    return files.select("game", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.coalesce(F.size("dialogue"), F.lit(0)).alias("records"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file; of equal ids the last node counts, a node without an id has its place for one.

    Edges may name their ends source and target, or from and to.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("pos", "n")).select("pos", F.coalesce(F.col("n")["id"], F.col("pos").cast("string")).alias("id"), F.col("n").alias("fields"))
    nodes = nodes.groupBy("id").agg(F.max_by("fields", "pos").alias("fields"), F.max("pos").alias("pos"))
    end = lambda a, b: F.coalesce(F.col("e")[a], F.col("e")[b])
    edges = raw.select(F.posexplode("edges").alias("pos", "e")).select("pos", end("source", "from").alias("src"), end("target", "to").alias("dst"), F.coalesce(F.col("e")["type"], F.lit("edge")).alias("kind"))
    return nodes, edges


def read_tiers(spark: SparkSession, path: str, tier: str | None = None, limit: int | None = None) -> DataFrame:
    """(tier, text) of training records: the first of prose, text, content; texts of 50 characters or fewer and broken rows are left out."""
    rows = spark.read.schema("tier string, prose string, text string, content string").option("mode", "DROPMALFORMED").json(path)
    rows = rows.select("tier", F.coalesce(F.nullif("prose", F.lit("")), F.nullif("text", F.lit("")), "content").alias("text")).where(F.length(F.trim("text")) > 50)
    if tier:
        rows = rows.where(F.col("tier").contains(tier))
    return rows.limit(limit) if limit is not None else rows


def decoded(rows: DataFrame, text, language: str | None = None, least: int = 0, most: int = 2000) -> DataFrame:
    """(text): an external stream's texts over ``least`` characters, cut at ``most``; ``language`` must be in the lang column."""
    if language:
        rows = rows.where(F.lower("lang").contains(language.lower()))
    return rows.select(text.alias("text")).where(F.length("text") > least).select(F.substring("text", 1, most).alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, pos, rank, freq): content words of a frequency list; of a lemma's parts of speech the first counts."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    rows = rows.select(F.lower("lemma").alias("lemma"), F.lower("pos").alias("pos"), F.col("rank").cast("int").alias("rank"), F.col("freq").cast("long").alias("freq"))
    kept = rows.where("pos IN ('n', 'v', 'j', 'r') AND length(lemma) >= 2 AND lemma RLIKE '^[a-z]+$'")
    w = Window.partitionBy("lemma").orderBy("rank")
    return kept.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
