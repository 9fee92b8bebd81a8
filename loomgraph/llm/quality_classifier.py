"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and quantiles of its perplexity.

The model is counted on labelled rows of good quality and kept in shards; every document's perplexity
comes from a join of its n-grams with the shards' counts. A document is rejected when its perplexity
lies outside limits that quantiles of its language's trusted text set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kneser_ney import language, means, modelled, quantiles, scored, smoothed
from .shared import Tables, documents, sieved, unused

#: The share of trusted text beyond the quantiles on either side, and how much farther from the median
#: than they the limits lie: quantiles of a sample lie inside those of what it is drawn from.
OUTSIDE, FARTHER = 0.01, 0.5


def classified(docs: DataFrame, labels: DataFrame, columns: list[str], outside: float = OUTSIDE) -> DataFrame:
    """``columns`` of docs with perplexity, threshold and kept; see ``quality_classifier``."""
    tables = Tables(docs.sparkSession)
    columns = [c for c in columns if c not in ("perplexity", "threshold", "kept")]
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL")
    ids = docs.select("doc_id", language().alias("lang_of")).distinct()
    known = tables.keep(ids.join(good.select("doc_id"), "doc_id").select(F.col("doc_id").alias("trusted_id"), "lang_of", F.shiftright(F.xxhash64("doc_id"), 11).alias("h")), "trusted")
    # the smaller half of a language's hashes is fitted
    halves = known.groupBy("lang_of").agg(F.percentile_approx("h", 0.5, 100_000).alias("middle"))
    split = tables.keep(known.join(halves, "lang_of").select("trusted_id", "lang_of", (F.col("h") <= F.col("middle")).alias("fit")), "split")
    fit = split.where("fit").select("trusted_id", "lang_of")
    keyed = docs.select("doc_id", language().alias("lang"), "text").where("text IS NOT NULL")
    texts = sieved(keyed, fit, ["doc_id", "lang"], ["doc_id", "lang", "pack"])
    texts = texts.join(fit, (F.col("doc_id") == F.col("trusted_id")) & (F.col("lang") == F.col("lang_of"))).select("lang", "pack")
    models = modelled(tables, texts)
    scores = tables.keep(scored(docs, models, list(dict.fromkeys(["doc_id", *columns]))), "scores")
    mine = (F.col("id") == F.col("trusted_id")) & (F.col("key") == F.col("lang_of"))
    brief = scores.select(F.col("own.doc_id").alias("id"), "key", "bits", "symbols")
    seen = tables.keep(brief.join(split, mine).select("key", "bits", "symbols", "fit"), "seen")
    unseen = seen.where("NOT fit")
    mean = tables.keep(means(unseen), "means")
    # fitted rows score lower than others, so that the lower limit is taken from all trusted rows
    limit = lambda q: (F.col(q) + FARTHER * (F.col(q) - F.col("middle"))).alias(q)
    low = quantiles(smoothed(seen, mean), low=outside, middle=0.5).select(F.col("of").alias("low_of"), limit("low"))
    high = quantiles(smoothed(unseen, mean), high=1 - outside, middle=0.5).select("of", limit("high"))
    limits = tables.keep(high.join(low, F.col("of") == F.col("low_of")).select("of", "low", "high"), "limits")
    out = smoothed(scores, mean).join(F.broadcast(limits), F.col("key") == F.col("of"), "left")
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True))
    two = F.lit(2.0)
    return out.select(*(F.col(f"own.`{c}`") for c in columns), F.pow(two, "score").alias("perplexity"), F.pow(two, "high").alias("threshold"), inside.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, outside: float = OUTSIDE) -> DataFrame:
    """The rows of docs that ``quality_classifier`` keeps; all columns as they are.

    Texts are not written a second time: the rejected rows' ids and hashes are taken out of docs.
    """
    text_hash, gone_id, gone_hash = unused(docs, "text_hash", "gone_id", "gone_hash")
    judged = classified(docs.withColumn(text_hash, F.xxhash64("text")), labels, ["doc_id", text_hash], outside)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col(text_hash).alias(gone_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & F.xxhash64("text").eqNullSafe(F.col(gone_hash))
    return docs.join(gone, same, "left_anti")


def quality_classifier(docs: DataFrame, labels: DataFrame, outside: float = OUTSIDE) -> DataFrame:
    """doc_id, lang, perplexity (a symbol, of the text with as much average text as PRIOR), threshold, kept.

    The threshold is the upper limit; a document below the lower one is not kept either. They lie as
    far from the median as the quantiles ``outside`` and 1 - ``outside`` of the language's trusted
    rows, and FARTHER times that farther.

    Trusted rows are those labelled quality 1 and toxic 0 (of repeated labels the worst counts). By a
    hash of the id, half of each language's fit its model, and all others give its mean and upper
    limit; so both grow with the labels. Scores and limits cover all rows.

    A null or empty text has null perplexity and is kept. Documents whose language (null is
    one) has no trusted rows have null perplexity or threshold and are kept. Repeated rows are scored
    alike. Empty tables give empty results. Other columns are ignored.
    """
    return classified(docs, labels, ["doc_id", "lang"], outside)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
