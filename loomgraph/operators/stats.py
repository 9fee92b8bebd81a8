"""Statistics of graphs, distances between distributions, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-10


def share(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys, p: each count's share of all; no rows give no rows."""
    total = counts.agg(F.sum(n).alias("all"))
    return counts.join(F.broadcast(total)).select(*keys, (F.col(n) / F.col("all")).alias("p"))


def aligned(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """Two distributions side by side; a key that one lacks is 0 there."""
    both = p.withColumnRenamed("p", "pp").join(q.withColumnRenamed("p", "qq"), keys, "full_outer")
    return both.select(*keys, F.coalesce("pp", F.lit(0.0)).alias("p"), F.coalesce("qq", F.lit(0.0)).alias("q"))


def _kl(p, q):
    a, b = F.when(p > 0, p).otherwise(EPSILON), F.when(q > 0, q).otherwise(EPSILON)
    return F.sum(a * F.log(a / b))


def distances(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """kl, kl_reverse, tv, js in nats; a missing share counts as a tiny one on both sides."""
    both = aligned(p, q, keys).withColumn("m", (F.col("p") + F.col("q")) / 2)
    out = both.agg(_kl(F.col("p"), F.col("q")).alias("kl"), _kl(F.col("q"), F.col("p")).alias("kl_reverse"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), ((_kl(F.col("p"), F.col("m")) + _kl(F.col("q"), F.col("m"))) / 2).alias("js"))
    return out


def degree_divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """js over keys with a share, tv, shared keys; two empty distributions are 1, 1 and 0."""
    both = aligned(p, q, keys).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("m") + EPSILON) + EPSILON)).otherwise(0.0))
    return both.agg(
        F.coalesce((part("p") + part("q")) / 2, F.lit(1.0)).alias("js"),
        F.coalesce(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, F.lit(1.0)).alias("tv"),
        F.count(F.when((F.col("p") > 0) & (F.col("q") > 0), 1)).alias("shared"),
    )


def gaps(reference: DataFrame, target: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Keys whose reference share and its lead over the target's are above ``least``, largest gap first."""
    both = aligned(reference, target, keys).withColumn("gap", F.col("p") - F.col("q"))
    return both.where((F.col("p") > least) & (F.col("gap") > least)).select(*keys, F.col("p").alias("reference"), F.col("q").alias("target"), "gap").orderBy(F.desc("gap"), *keys)


def structural_metrics(degrees: DataFrame) -> DataFrame:
    """Shares of chain, leaf, hub and entry nodes, edges a node and largest counts, by edge counts; from (out_edges, in_edges)."""
    out, into = F.col("out_edges"), F.col("in_edges")
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return degrees.agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum(out), F.lit(0)).alias("edges"), part((out == 1) & (into == 1)).alias("chain"), part(out == 0).alias("leaf"),
        part((out > 5) | (into > 5)).alias("hub"), part((into == 0) & (out > 0)).alias("entry"), (F.sum(out) / F.count("*")).alias("edges_per_node"), F.max(out).alias("max_out"), F.max(into).alias("max_in"),
    )


def topology(degrees: DataFrame) -> DataFrame:
    """Ratios, upper median and entropy (bits) of out-degrees."""
    n = degrees.agg(F.count("*").alias("all"))
    hist = degrees.groupBy("out_edges").agg(F.count("*").alias("n")).join(F.broadcast(n)).withColumn("p", F.col("n") / F.col("all"))
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("out_edges")))
    return upto.agg(
        F.sum(F.when(F.col("out_edges") == 0, F.col("p")).otherwise(0.0)).alias("leaf"), F.sum(F.when(F.col("out_edges") > 2, F.col("p")).otherwise(0.0)).alias("hub"),
        F.sum(F.when(F.col("out_edges") >= 2, F.col("p")).otherwise(0.0)).alias("branching"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("out_edges"))).alias("median"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"),
    )


def degree_bucket(n):
    return F.when(n <= 2, n.cast("string")).when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


def weighted_pool(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Distributions (keys, p, edges) pooled by their edges."""
    return parts.groupBy(*keys).agg((F.sum(F.col("p") * F.col("edges")) / F.sum("edges")).alias("p"))


def topology_score(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Sum of absolute differences of (metric, value) where the reference is positive."""
    both = reference.withColumnRenamed("value", "r").join(target.withColumnRenamed("value", "t"), "metric").where("r > 0")
    return both.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("t"))), F.lit(0.0)).alias("score"))


def until_size(samples: DataFrame, order: str, size: str, most: int) -> DataFrame:
    """Samples in order until their sizes add up to ``most``; the one that reaches it is in."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("before") < most).drop("before")
