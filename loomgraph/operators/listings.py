"""Listings, filters and reports over lines, topics, arcs, traces and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FAILED = ["failed", "rejected"]


def responses(lines: DataFrame, topic: str, game: str | None = None) -> DataFrame:
    """Lines that answer a topic, of one game or of all."""
    found = lines.where(F.col("topic") == topic)
    return found.where(F.col("game") == game) if game else found


def cross_game_topics(lines: DataFrame) -> DataFrame:
    """(topic, games, n) of topics that more than one game has."""
    counts = lines.groupBy("topic", "game").agg(F.count("*").alias("n"))
    return counts.groupBy("topic").agg(F.count("*").alias("games"), F.sum("n").alias("n")).where("games > 1")


def topics_of_category(lines: DataFrame, category: str) -> DataFrame:
    """(topic, n) of topics in a category."""
    counts = lines.groupBy("topic").agg(F.count("*").alias("n"))
    return counts.where(S.topic_category(F.col("topic")) == category.upper())


def topic_listing(lines: DataFrame, category: str | None = None, cross_game: bool = False, most: int = 50) -> DataFrame:
    """(topic, category, games, n): topics of several games, or of a category, or the most frequent.

    The first two come in the order of their names.
    """
    by_game = lines.groupBy("topic", "game").agg(F.count("*").alias("n"))
    topics = by_game.groupBy("topic").agg(F.count("*").alias("games"), F.sum("n").alias("n"))
    topics = topics.select("topic", S.topic_category(F.col("topic")).alias("category"), "games", "n")
    if cross_game:
        return topics.where("games > 1").orderBy("topic").limit(most)
    if category:
        return topics.where(F.col("category") == category.upper()).orderBy("topic").limit(most)
    return topics.orderBy(F.desc("n"), "topic").limit(most)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in an order, each with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


def start_nodes(lines: DataFrame, edges: DataFrame, quest: str | None = None, emotion: str | None = None) -> DataFrame:
    """Lines of a quest and an emotion that have an outgoing edge (src)."""
    found = lines
    for column, value in (("quest", quest), ("emotion", emotion)):
        if value:
            found = found.where(F.col(column) == value)
    return found.join(edges.select(F.col("src").alias("form_id")).distinct(), "form_id", "left_semi")


def failures(traces: DataFrame, stage: str | None = None) -> DataFrame:
    """Traces (status, stage) that failed or were rejected, at one stage or at any."""
    found = traces.where(F.col("status").isin(FAILED))
    return found.where(F.col("stage") == stage) if stage else found


def has_transition(emotions: Column, first: str, second: str) -> Column:
    """Whether ``second`` follows right after ``first`` in an array."""
    size = F.size(emotions)
    pairs = F.zip_with(F.slice(emotions, 1, F.greatest(size - 1, F.lit(0))), F.slice(emotions, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: (a == first) & (b == second))
    return F.exists(pairs, lambda x: x)


def from_source(rows: DataFrame, sources: str, node: str) -> DataFrame:
    """Rows whose array of sources holds a node."""
    return rows.where(F.array_contains(sources, node))


def top_degrees(degrees: DataFrame, n: int = 10) -> DataFrame:
    """(side, game, id, degree): the n nodes with the largest degree on either side."""
    sides = []
    for side, column in (("in", "in_deg"), ("out", "out_deg")):
        part = degrees.select(F.lit(side).alias("side"), "game", "id", F.col(column).alias("degree"))
        sides.append(part.orderBy(F.desc("degree"), "game", "id").limit(n))
    return sides[0].unionByName(sides[1])


def top_share(counts: DataFrame, n: str, share: float) -> DataFrame:
    """Rows whose count is at least the one at place floor(rows * share) from the largest.

    Ranks come from the counts of the few distinct values, not from sorting all rows.
    """
    values = counts.groupBy(F.col(n).alias("value")).agg(F.count("*").alias("times"))
    upto = values.withColumn("upto", F.sum("times").over(Window.orderBy(F.desc("value")))).withColumn("all", F.sum("times").over(Window.partitionBy()))
    least = upto.where(F.col("upto") > F.floor(F.col("all") * share)).agg(F.max("value").alias("least"))
    return counts.join(F.broadcast(least), F.col(n) >= F.col("least")).drop("least")


def gap_ranking(gaps: DataFrame, n: int, priority: Column | None = None) -> DataFrame:
    """The n largest gaps (key, gap), by priority first where one is given."""
    order = [F.desc("gap"), F.col("key")]
    return gaps.orderBy(*([priority] if priority is not None else []), *order).limit(n)


def recent(rows: DataFrame, day: str, order: str, n: int) -> DataFrame:
    """The n rows of the newest days, oldest first within a day."""
    return rows.orderBy(F.desc(day), order).limit(n)


def trace_statistics(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, cost, latency and the share of successes, for each group and, with null keys, for all."""
    failed = F.col("status").isin(FAILED)
    return traces.rollup(*keys).agg(
        F.count("*").alias("n"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.round(F.sum("cost"), 4).alias("cost"),
        F.round(F.avg("cost"), 6).alias("avg_cost"),
        F.round(F.avg(F.when(failed, 0.0).otherwise(1.0)), 6).alias("success"),
    )


def concept_mappings(mappings: DataFrame, least: int) -> DataFrame:
    """(source, target, n, rationale) of mappings (source, target, rationale, pos); the first rationale stands for all."""
    found = mappings.groupBy("source", "target").agg(F.count("*").alias("n"), F.min_by("rationale", "pos").alias("rationale"))
    return found.where(F.col("n") >= least)


def flattened_concerns(tickets: DataFrame) -> DataFrame:
    """(ticket_id, place, concern) of tickets (ticket_id, concerns)."""
    return tickets.select("ticket_id", F.posexplode("concerns").alias("place", "concern"))


def curator_report(decisions: DataFrame) -> DataFrame:
    """(cluster, n, approved, rate, reason) of decisions (cluster, approved, reason); reason is the commonest first word."""
    word = F.lower(F.element_at(F.split("reason", " "), 1))
    by_word = decisions.select("cluster", F.col("approved").cast("int").alias("ok"), word.alias("word")).groupBy("cluster", "word").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    best = F.max_by("word", F.struct(F.col("n"), F.col("word")))
    return by_word.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("ok").alias("approved"), F.round(F.sum("ok") / F.sum("n"), 6).alias("rate"), best.alias("reason"))


def normalised(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, value, n) with p: the share of a group; a group without a count has shares of zero."""
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("p", F.round(F.col("n") / F.greatest(total, F.lit(1)), 6))


def version_difference(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """One row: how many nodes and edges each version has, and the differences."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(old_nodes, "old_nodes").join(count(new_nodes, "new_nodes")).join(count(old_edges, "old_edges")).join(count(new_edges, "new_edges"))
    return one.withColumns({"nodes": F.col("new_nodes") - F.col("old_nodes"), "edges": F.col("new_edges") - F.col("old_edges")})


def resolved_links(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results (src, dst) whose both ends are nodes (id)."""
    for end in ("src", "dst"):
        results = results.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return results


def extension_sites(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(site, src, dst) of sites written ``a->b`` or with an arrow sign, where both ends are nodes (id)."""
    ends = F.split("site", r"\s*(?:->|→)\s*")
    two = sites.withColumn("ends", ends).where(F.size("ends") == 2)
    return resolved_links(two.select("site", F.trim(F.get("ends", F.lit(0))).alias("src"), F.trim(F.get("ends", F.lit(1))).alias("dst")), nodes)


def known_nouns(nouns: DataFrame, existing: DataFrame) -> DataFrame:
    """nouns (noun) with known: whether existing (noun) has it in any case."""
    lower = existing.select(F.lower("noun").alias("lower")).distinct().withColumn("hit", F.lit(True))
    found = nouns.join(lower, F.lower("noun") == F.col("lower"), "left")
    return found.select(*nouns.columns, F.coalesce("hit", F.lit(False)).alias("known"))


def unresolved(tickets: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Tickets whose site is not resolved."""
    return tickets.join(resolved.select(key).distinct(), key, "left_anti")


def chain_sample(chains: DataFrame, key: str, least: int, n: int, seed: str = "chain") -> DataFrame:
    """Chains (key, length) of at least ``least`` lines: all, or n by keyed draws where there are more."""
    return chains.where(F.col("length") >= least).orderBy(S.draw(F.lit(seed), F.col(key)), key).limit(n)


def stages_of(conditions: Column) -> Column:
    """(param1, value) of the conditions that test a quest's stage (functions 43 and 79)."""
    held = F.filter(conditions, lambda c: c["function"].isin(43, 79))
    return F.transform(held, lambda c: F.struct(c["param1"].alias("param1"), c["value"].alias("value")))


def split_estimate(rows: DataFrame, tokens: int, price: float) -> DataFrame:
    """(tier, items, tokens, bytes, cost) of rows (tier): five bytes a token, the price for a million."""
    counts = rows.groupBy("tier").agg(F.count("*").alias("items")).withColumn("tokens", F.col("items") * tokens)
    return counts.withColumns({"bytes": F.col("tokens") * 5, "cost": F.round(F.col("tokens") * F.lit(price) / 1e6, 6)})


def proper_nouns(text: Column) -> Column:
    """Capitalised words of letters only, two and more, that do not begin a sentence; sorted, each once.

    Sentences end at a full stop and a space.
    """
    words = lambda s: F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda w: w != "")
    later = F.flatten(F.transform(F.split(text, r"\. "), lambda s: F.slice(words(s), 2, 1_000_000_000)))
    return F.array_sort(F.array_distinct(F.filter(later, lambda w: w.rlike(r"^\p{Lu}\p{L}+$"))))
