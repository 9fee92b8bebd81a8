"""Stores of runs: graph versions, rendered splits, ticket queues, traces and plugin extractions, as folders of tables.

A store is a folder that every executor can reach; listings go through Spark's own file readers.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKET = "ticket_id string, stage string, status string, setting string, concerns array<string>"
TRACE = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in
    {"trace_id": "string", "timestamp": "string", "status": "string", "game": "string", "model": "string", "input_tokens": "long", "output_tokens": "long", "latency_ms": "double"}.items()]})
VERSION = "setting string, version int, parent int, nodes long, edges long, run_id string, note string, step int"
PARTS = ("nodes", "edges")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _file_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def graph_format(spark: SparkSession, path: str) -> str:
    """"graph" for a JSON object with nodes and edges, else "corpus"."""
    names = set(spark.read.option("multiLine", True).json(path).columns)
    return "graph" if {"nodes", "edges"} <= names else "corpus"


def versions(spark: SparkSession, root: str, setting: str | None = None) -> DataFrame:
    """(setting, version, parent, nodes, edges, run_ids) of every version, as its last metadata row says."""
    path = f"{root}/metadata"
    rows = spark.read.schema(VERSION).json(path) if _exists(spark, path) else spark.createDataFrame([], VERSION)
    rows = rows.where(F.col("setting") == setting) if setting else rows
    last = lambda c: F.max_by(c, "step").alias(c)
    return rows.groupBy("setting", "version").agg(F.min_by("parent", "step").alias("parent"), last("nodes"), last("edges"), F.array_sort(F.collect_set("run_id")).alias("run_ids"))


def latest_version(spark: SparkSession, root: str, setting: str) -> int | None:
    return versions(spark, root, setting).agg(F.max("version")).first()[0]


def _graph_path(root: str, setting: str, version: int, part: str) -> str:
    return f"{root}/{part}/setting={setting}/version={version}"


def read_version(spark: SparkSession, root: str, setting: str, version: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, text, emotion) and edges (src, dst, kind) of a version; an empty version has none."""
    out = []
    for part, schema in zip(PARTS, ("id string, text string, emotion string", "src string, dst string, kind string")):
        path = _graph_path(root, setting, version, part)
        out.append(spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema))
    return out[0], out[1]


def _note(spark: SparkSession, root: str, setting: str, version: int, parent: int | None, run_id: str | None, note: str) -> None:
    nodes, edges = read_version(spark, root, setting, version)
    step = versions_steps(spark, root, setting, version) + 1
    row = (setting, version, parent, nodes.count(), edges.count(), run_id, note, step)
    spark.createDataFrame([row], VERSION).coalesce(1).write.mode("append").json(f"{root}/metadata")


def versions_steps(spark: SparkSession, root: str, setting: str, version: int) -> int:
    """How many metadata rows a version has."""
    path = f"{root}/metadata"
    if not _exists(spark, path):
        return 0
    return spark.read.schema(VERSION).json(path).where((F.col("setting") == setting) & (F.col("version") == version)).count()


def new_version(spark: SparkSession, root: str, setting: str, note: str = "", parent: int | None = None) -> int:
    """The number of a new, empty version."""
    version = (latest_version(spark, root, setting) or 0) + 1
    _note(spark, root, setting, version, parent, None, note)
    return version


def extend_version(spark: SparkSession, root: str, setting: str, version: int, nodes: DataFrame, edges: DataFrame, run_id: str | None = None) -> None:
    """Append nodes and edges to a version; files of a version are only ever added."""
    nodes.select("id", "text", "emotion").write.mode("append").parquet(_graph_path(root, setting, version, "nodes"))
    edges.select("src", "dst", "kind").write.mode("append").parquet(_graph_path(root, setting, version, "edges"))
    _note(spark, root, setting, version, None, run_id, "")


def branch_version(spark: SparkSession, root: str, setting: str, source: int, note: str = "") -> int:
    """A new version that begins as a copy of another."""
    if not versions(spark, root, setting).where(F.col("version") == source).limit(1).count():
        raise ValueError(f"version {source} of {setting} not found")
    nodes, edges = read_version(spark, root, setting, source)
    version = new_version(spark, root, setting, note, source)
    extend_version(spark, root, setting, version, nodes, edges)
    return version


def split_id(source: str, kind: str, **request) -> str:
    """source_kind_hash, the hash of the whole request as JSON with sorted keys."""
    text = json.dumps({"source": source, "split_type": kind, **request}, sort_keys=True)
    return f"{source}_{kind}_{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def write_split(rows: DataFrame, root: str, name: str) -> None:
    """A split's rows as JSON lines."""
    rows.write.mode("overwrite").json(f"{root}/{name}")


def split_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(split_id, source, split_type, items, tokens, bytes) of every split under a folder, told from its lines and its name.

    A name of fewer than three parts has an unknown type; of fewer than two it is its own source.
    """
    lines = spark.read.text(f"{root}/*").select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("split_id"), "value")
    words = F.size(F.regexp_extract_all(F.coalesce(F.get_json_object("value", "$.text"), F.lit("")), F.lit(r"(\S+)"), 1))
    sums = lines.groupBy("split_id").agg(F.count("*").alias("items"), F.sum(words).alias("tokens"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    parts = F.split("split_id", "_")
    source = F.when(F.size(parts) >= 3, F.regexp_replace("split_id", r"_[^_]*_[^_]*$", "")).otherwise(F.get(parts, F.lit(0)))
    kind = F.when(F.size(parts) >= 3, F.element_at(parts, -2)).otherwise("unknown")
    return sums.select("split_id", source.alias("source"), kind.alias("split_type"), "items", "tokens", "bytes")


def split_chunk(spark: SparkSession, root: str, name: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(place, value): lines of a split from a row offset on, in the order of files and lines."""
    rows = spark.read.text(f"{root}/{name}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    ordered = rows.orderBy("file", "block", "row").offset(offset)
    return (ordered.limit(limit) if limit is not None else ordered).select("value")


def append_store(rows: DataFrame, path: str) -> None:
    """Append rows to a store of JSON lines."""
    rows.write.mode("append").json(path)


def read_queue(spark: SparkSession, *paths: str) -> DataFrame:
    """Tickets of queue files: an array for each stage (``parse_tickets``, ...), or all in ``tickets``, as rows with their run."""
    stages = ("parse", "translate", "curate", "link_stitch", "extension_resolve")
    schema = "run_id string, tickets array<struct<T>>, " + ", ".join(f"{s}_tickets array<struct<T>>" for s in stages)
    ticket = ", ".join("{}: {}".format(*f.split(" ")) for f in TICKET.split(", "))
    raw = spark.read.schema(schema.replace("struct<T>", f"struct<{ticket}>")).option("multiLine", True).json(list(paths))
    named = lambda column, stage: F.transform(F.coalesce(column, F.array()), lambda t: t.withField("stage", F.coalesce(t["stage"], stage)))
    parts = [F.coalesce("tickets", F.array().cast(raw.schema["tickets"].dataType))]
    parts += [named(F.coalesce(f"{s}_tickets", F.array().cast(raw.schema["tickets"].dataType)), F.lit(s)) for s in stages]
    return raw.select("run_id", F.explode(F.concat(*parts)).alias("t")).select("run_id", "t.*")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a folder of daily files with day, from the file's name (``2024-01-31.jsonl``, with any prefix)."""
    rows = spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("day", F.regexp_extract(_file_name(), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def compiled_settings(dialogues: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(setting, lines, trajectories) of compiled files (file, records): each dialogue file with its trajectories, if any."""
    named = lambda df, tail, n: df.select(F.regexp_extract("file", rf"^synthetic_(.+)_{tail}\.json$", 1).alias("setting"), F.col("records").alias(n)).where("setting <> ''")
    return named(dialogues, "dialogue", "lines").join(named(trajectories, "trajectories", "trajectories"), "setting", "left")


def plugin_lines(topics: DataFrame, npcs: DataFrame, quests: DataFrame) -> DataFrame:
    """Lines of topics (plugin, topic, lines) with names of speakers and quests (id, name), the id where there is none."""
    each = topics.select("plugin", "topic", F.posexplode("lines").alias("place", "l")).select("plugin", "topic", "place", "l.*")
    name = lambda df, to: df.groupBy(F.col("id").alias(to)).agg(F.min("name").alias(f"{to}_name"))
    joined = each.join(name(npcs, "speaker"), "speaker", "left").join(name(quests, "quest"), "quest", "left")
    return joined.select("plugin", "topic", "place", "form_id", "text", F.coalesce("speaker_name", "speaker").alias("speaker"), F.coalesce("quest_name", "quest").alias("quest"))


def united_plugins(parts: dict[str, DataFrame]) -> DataFrame:
    """Lines of plugins in one, with their source and its place in the order given."""
    out = None
    for order, (name, df) in enumerate(parts.items()):
        part = df.withColumns({"source": F.lit(name), "load_order": F.lit(order)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no plugins")
    return out
