"""Writers: JSON lines, compiled corpora, graph text, statistics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

STYLES = {"sequential": "solid", "topic_branch": "dashed", "condition_gate": "dotted"}


def write_lines(rows: DataFrame, path: str, emotion: str | None = None) -> None:
    (rows.where(F.col("emotion") == emotion) if emotion else rows).write.mode("overwrite").json(path)


def training_rows(flat: DataFrame, prose: DataFrame, failed: bool = False) -> DataFrame:
    """Both tiers in one; rejected prose only if asked for."""
    kept = prose if failed else prose.where("passed_filters")
    return flat.unionByName(kept, allowMissingColumns=True)


def run_stats(prose: DataFrame) -> DataFrame:
    """(outcome, n, share): passed, or the reason up to its first underscore."""
    outcome = F.when(F.col("reject_reason").isNull(), "passed").otherwise(F.split("reject_reason", "_")[0])
    counts = prose.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("outcome", "n", (F.col("n") / F.col("all")).alias("share"))


def hashed_sources(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a reference in the place of a source text, and the table of references."""
    ref = S.short_hash(F.col(text), 16)
    return rows.withColumn("source_ref", ref).drop(text), rows.groupBy(ref.alias("source_ref")).agg(F.first(text).alias(text))


def dot(nodes: DataFrame, edges: DataFrame, most: int = 100) -> str:
    """A graph of the first ``most`` nodes (pos, id, text) as DOT text."""
    some = nodes.orderBy("pos").limit(most)
    kept = edges.join(some.select(F.col("id").alias("src")), "src", "left_semi").join(some.select(F.col("id").alias("dst")), "dst", "left_semi")
    label = lambda t: (t or "")[:40].replace("\\", "\\\\").replace('"', '\\"')
    out = [f'  "{r["id"]}" [label="{label(r["text"])}"];' for r in some.collect()]
    out += [f'  "{r["src"]}" -> "{r["dst"]}" [style={STYLES.get(r["kind"], "solid")}];' for r in kept.orderBy("src", "dst").collect()]
    return "\n".join(["digraph lines {", *out, "}"])


def split_of(rows: DataFrame, key: str, seed: str, most: int | None = None) -> DataFrame:
    """Rows in the order of a seeded hash of their key, at most so many."""
    shuffled = rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key)
    return shuffled.limit(most) if most is not None else shuffled
