"""A corpus pipeline of the training-data operators: STAGES in order, run() applies them to documents.

A stage gets the documents that the one before has kept, as read back from Parquet. Each stage takes
nulls in any column, empty texts, repeated rows and empty tables as its operator does; see there. Of
ties, the operators' own rules decide: the smallest doc_id stays of near duplicates, and a repeated
string stays where the smallest doc_id has it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.mixing import pfair_mix
from loomgraph.llm.near_dedup import one_of_each
from loomgraph.llm.quality_classifier import kept_documents
from loomgraph.llm.sentencepieces import sentencepiece_encode
from loomgraph.llm.shared import Tables, documents
from loomgraph.llm.suffix_dedup import suffix_array_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts and languages without trusted rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept_documents(docs.select(*COLUMNS), labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, by shingles of five words. Texts without words stay."""
    return one_of_each(docs.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds; n_chars is counted anew, null for a null text."""
    kept = suffix_array_dedup(docs, keep_text=True, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, from the first written file to the last. A null source is one."""
    return pfair_mix(docs.select(*COLUMNS)).orderBy("mix_slot", "mix_place").select(*COLUMNS)


def placed(docs: DataFrame) -> DataFrame:
    """docs with mix_part and mix_row: the file and the row of it at which a document stands in the mix.

    So the mix outlives a reading in any order. Documents that come from no file have no place (null).
    """
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        return docs.select(*COLUMNS, part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        return docs.select(*COLUMNS, F.lit(None).cast("int").alias("mix_part"), F.lit(None).cast("long").alias("mix_row"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_part, mix_row, n_chars, ids, decodes of each document; (mix_part, mix_row) is its place in the mix."""
    return sentencepiece_encode(placed(docs), ["doc_id", "lang", "source", "mix_part", "mix_row"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]
#: Language models, components and merges are beyond SQL. tests/llm holds each stage's operator against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each on the written result of the one before."""
    tables, docs = Tables(spark), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.keep(docs, name)
    return docs
