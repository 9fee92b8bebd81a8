"""Chains of lines, and windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quest_chains(lines: DataFrame) -> DataFrame:
    """(game, quest, topic, length, speaker, staged, ids, transcript): lines of a quest's topic by stage and position; two at least.

    The speaker is the commonest, of equals the smallest.
    """
    kept = lines.where("quest IS NOT NULL AND quest <> ''")
    keys = ["game", "quest", "topic"]
    row = F.struct(F.coalesce("stage", F.lit(0.0)).alias("s"), "pos", "form_id", F.concat(F.coalesce("speaker", F.lit("?")), F.when(F.col("emotion") != "neutral", F.concat(F.lit("("), F.col("emotion"), F.lit(")"))).otherwise(""), F.lit(": "), F.coalesce("text", F.lit(""))).alias("t"))
    chains = kept.groupBy(*keys).agg(F.count("*").alias("length"), F.count("stage").alias("staged"), F.array_sort(F.collect_list(row)).alias("rows")).where("length >= 2")
    votes = kept.where("speaker IS NOT NULL").groupBy(*keys, "speaker").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "speaker")
    best = votes.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*keys, "speaker")
    joined = chains.join(best, keys, "left")
    return joined.select(*keys, "length", "speaker", "staged", F.array_join(F.transform("rows", lambda x: x.form_id), ">").alias("ids"), F.array_join(F.transform("rows", lambda x: x.t), "\n").alias("transcript"))


def speaker_chains(lines: DataFrame) -> DataFrame:
    """(game, speaker, quest, topic, length): two lines at least of a speaker in a quest's topic."""
    return lines.where("speaker IS NOT NULL").groupBy("game", "speaker", "quest", "topic").agg(F.count("*").alias("length")).where("length >= 2")


def length_buckets(chains: DataFrame) -> DataFrame:
    n = F.col("length")
    bucket = F.when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("10+")
    return chains.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("chains"), F.sum("length").alias("lines"))


def strided_windows(lines: DataFrame, keys: list[str], size: int = 5, step: int = 3) -> DataFrame:
    """(keys, start, ids, n): windows of at most ``size`` lines that start each ``step``, while two more lines follow the start."""
    w = Window.partitionBy(*keys)
    ranked = lines.withColumn("rn", F.row_number().over(w.orderBy("pos")) - 1).withColumn("all", F.count("*").over(w)).where("all >= 3")
    # a line lies in the windows whose start is at most size - 1 before it
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // step)), lambda k: (F.floor(F.col("rn") / step) - k) * step), lambda s: (s >= 0) & (F.col("rn") - s < size) & (s <= F.col("all") - 3))
    placed = ranked.withColumn("start", F.explode(starts))
    return placed.groupBy(*keys, "start").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "form_id"))), lambda x: x.form_id), ">").alias("ids"))


def arcs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, emotions): emotions of a group's lines in the order of their positions."""
    return lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "emotion"))), lambda x: x.emotion).alias("emotions"))
