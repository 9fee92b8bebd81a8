"""Quality rules: counts of a text, and perplexity bands of a modified Kneser-Ney model of the corpus.

Spark counts the n-grams of all documents that pass the plain rules; the model is kept in shards of
sorted arrays. Each language has an upper and a lower band, from quantiles over all those documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .kneser_ney import language, means, modelled, quantiles, scored, smoothed
from .shared import Tables, documents, tidy
from .suffix_dedup import covered
from .words import SEPARATOR, word_values
from .spans import powers

#: The symbols that are counted (fixed values).
COUNTED = np.zeros(256, bool)
COUNTED[list(b"#*$%&|<>")] = True
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(values: np.ndarray) -> int:
    """Words in windows of five that the text holds twice or more."""
    n = len(values) - WINDOW + 1
    if n < 2:
        return 0
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    keys = (sums[WINDOW:] - sums[:n]) * down[:n]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(covered(np.flatnonzero(twice), WINDOW, len(values)).sum())


def text_counts(texts: list) -> list[list[int]]:
    """COUNTS of each text."""
    raw = [(t or "").encode() for t in texts]
    out = []
    for t, data, values in zip(texts, raw, word_values(raw)):
        arr = np.frombuffer(data, np.uint8)
        lines = [x for x in data.split(b"\n") if x.strip()] if data else []
        out.append([len(values), len(t or "") - int(SEPARATOR[arr].sum()), int(COUNTED[arr].sum()), len(lines) - len(set(lines)), repeated_words(values)])
    return out


def base_failed(c: list[int]) -> bool:
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def plain(c: list[int]) -> bool:
    """Whether a text passes the base rules and has few symbols: such texts make the model and the bands."""
    return not base_failed(c) and 100 * c[2] <= 2 * c[1]


#: How far the bands reach, in half-widths of the middle 80 %.
WIDTH = 4


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity.

    Counts are of whole texts, as the contract of the query has them. The model is counted on the
    documents that do not fail the base rules and whose counted symbols are at most 2 % of their
    word characters; its bands come from the same documents: from a language's median they reach
    WIDTH times as far as its ten-percent and its ninety-percent quantile lie. A document is kept when
    it passes the base rules and its perplexity lies in its language's band.

    A null or empty text has no words and fails. A null lang is a language of its own; a language of
    which no document is counted has no band, and its documents pass. Repeated rows are judged
    alike. Empty tables give empty results. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")

    def only_plain(batches):
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            good = [plain(c) for c in text_counts(batch.column("text").to_pylist())]
            batch = batch.filter(pa.array(good, pa.bool_()))
            packs = [zstandard.ZstdCompressor(level=1).compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packs, pa.binary())], ["lang", "pack"])

    def counts_of(texts: list) -> dict[str, pa.Array]:
        counts = text_counts(texts)
        cols = {name: pa.array([c[k] for c in counts], pa.int64()) for k, name in enumerate(COUNTS)}
        return cols | {"base_failed": pa.array([base_failed(c) for c in counts], pa.bool_()), "plain": pa.array([plain(c) for c in counts], pa.bool_())}

    ship(docs.sparkSession)
    models = modelled(tables, docs.select(language().alias("lang"), "text").mapInArrow(tidy(only_plain), "lang string, pack binary"))
    schema = f"{', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, plain boolean"
    judged = tables.keep(scored(docs, models, ["doc_id"], counts_of, schema), "judged")
    mean = tables.keep(means(judged.where("plain")), "means")
    scores = smoothed(judged, mean)
    cut = quantiles(scores.where("plain"), q10=0.1, q50=0.5, q90=0.9)
    band = [(F.col("q50") + WIDTH * (F.col(q) - F.col("q50"))).alias(name) for q, name in (("q10", "low"), ("q90", "high"))]
    limits = tables.keep(cut.select("of", *band), "limits")
    out = scores.join(F.broadcast(limits), F.col("key") == F.col("of"), "left")
    inside = F.coalesce(F.col("score").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("own.doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(2.0), "score").alias("perplexity"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
