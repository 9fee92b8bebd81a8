"""What finished tickets add to a graph, and what is made of runs: links, extensions, translations, additions, training rows.

Positions say what came first: a ticket's pos, and place, the index in its list. Results are rows, one for each list entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as T
from ..shipping import ship
from .analytics import cut
from .graphs import parts_for


def _firsts(rows: DataFrame) -> DataFrame:
    """Of rows (id, pos, place, ...) with one id the first."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("pos", "place")).alias("r")).select("id", "r.*")


def link_results(nodes: DataFrame, generated: DataFrame, links: DataFrame, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """New nodes (id, text, emotion, ticket) and edges (src, dst, kind, ticket) of link tickets.

    nodes (id); generated (ticket, pos, place, id, text, emotion); links (ticket, pos, place, status, src, dst, via, text, emotion).
    Declined links and those without both ends are left out, and so is a link whose start is not known when its turn comes:
    a node, or one generated by its ticket or an earlier one, or the bridge of an earlier link. A bridged link makes two edges
    over its bridge, which becomes a node only if it has a text; a direct link makes one edge, whatever its end.
    """
    made = generated.where("id IS NOT NULL AND id <> ''").select("id", "text", F.coalesce("emotion", F.lit("neutral")).alias("emotion"), "ticket", "pos", F.lit(-1).cast("long").alias("place"))
    whole = F.coalesce("status", F.lit("")).isin("direct", "bridged") & (F.col("src") != "") & (F.col("dst") != "") & ((F.col("status") == "direct") | (F.col("via") != ""))
    asked = cut(links.where(whole).withColumn("place", F.col("place").cast("long")))
    old = nodes.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("emotion"), F.lit(None).cast("string").alias("ticket"), F.lit(-1).cast("long").alias("pos"), F.lit(-1).cast("long").alias("place"))
    base = old.unionByName(made.withColumn("pos", F.col("pos").cast("long")).withColumn("ticket", F.col("ticket").cast("string")))
    known, size = cut(_firsts(base)), -1
    for _ in range(rounds):
        starts = known.select(F.col("id").alias("src"), F.struct("pos", "place").alias("since"))
        taken = cut(asked.join(starts, "src").where(F.col("since") < F.struct(F.col("pos").cast("long"), F.col("place"))).drop("since"))
        found = taken.count()
        if found == size:
            break
        size = found
        bridges = taken.where("status = 'bridged' AND text <> ''").select(F.col("via").alias("id"), "text", F.coalesce("emotion", F.lit("neutral")).alias("emotion"), F.col("ticket").cast("string").alias("ticket"), F.col("pos").cast("long").alias("pos"), "place")
        known = cut(_firsts(base.unionByName(bridges)))
    else:
        raise RuntimeError("link results did not settle")
    step = lambda a, b, kind: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"))
    steps = F.when(F.col("status") == "direct", F.array(step("src", "dst", "direct_link"))).otherwise(F.array(step("src", "via", "bridge_out"), step("via", "dst", "bridge_in")))
    edges = taken.select("ticket", F.explode(steps).alias("e")).select("e.*", "ticket")
    return known.where("pos >= 0").select("id", "text", "emotion", "ticket"), edges


def extension_results(nodes: DataFrame, tickets: DataFrame, bridges: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New nodes (id, text, emotion, emotion_raw, arc, ticket) and edges (src, dst, kind, ticket) of successful extensions.

    tickets (ticket, status, applied, success, arc); bridges (ticket, pos, place, id, text, emotion); edges (ticket, src, dst, kind).
    An emotion outside the canonical ones is mapped, and kept as emotion_raw. Of equal ids the first counts; known ids do not.
    """
    good = tickets.where((F.col("status") == "completed") & ~F.coalesce("applied", F.lit(False)) & F.coalesce("success", F.lit(False))).select("ticket", "arc")
    fresh = _firsts(bridges.where("id IS NOT NULL AND id <> ''").join(good, "ticket")).join(nodes.select("id").distinct(), "id", "left_anti")
    raw = F.coalesce("emotion", F.lit("neutral"))
    mapped = S.canonical_emotion(raw)
    added = fresh.select("id", "text", mapped.alias("emotion"), F.when(S.emotion_status(raw) != "valid", raw).alias("emotion_raw"), "arc", "ticket")
    linked = edges.where("src <> '' AND dst <> ''").join(good.select("ticket"), "ticket", "left_semi")
    return added, linked.select("src", "dst", F.coalesce("kind", F.lit("extension_bridge")).alias("kind"), "ticket")


def translated_walks(tickets: DataFrame) -> DataFrame:
    """(ticket, texts, emotions, sources) of completed, unapplied tickets (ticket, status, applied, texts, emotions, sources).

    Texts and emotions of unlike number are cut to the shorter, unless there are no emotions; tickets without texts are left out.
    """
    n = F.when(F.size("emotions") > 0, F.least(F.size("texts"), F.size("emotions"))).otherwise(F.size("texts"))
    kept = tickets.where((F.col("status") == "completed") & ~F.coalesce("applied", F.lit(False)) & (F.size("texts") > 0))
    return kept.withColumn("n", n).select("ticket", *(F.slice(c, 1, F.col("n")).alias(c) for c in ("texts", "emotions", "sources")))


def attached_walks(walks: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, text, emotion, source_ref) and edges (src, dst, kind) of walks (ticket, texts, emotions, sources, ``at``).

    Ids are hashes of ticket, place and text. The first node hangs on node ``at``, where there is one.
    """
    beats = walks.select("ticket", at, "emotions", F.posexplode(F.arrays_zip("texts", "sources")).alias("place", "b")).where("b.texts IS NOT NULL AND b.sources IS NOT NULL")
    emotion = F.coalesce(F.get("emotions", F.col("place")), F.lit("neutral"))
    name = lambda place, text: F.concat(F.lit("syn_"), S.short_hash(F.concat_ws("_", "ticket", place.cast("string"), text)))
    rows = beats.select("ticket", at, "place", name(F.col("place"), F.col("b.texts")).alias("id"), F.col("b.texts").alias("text"), emotion.alias("emotion"), S.short_hash(F.col("b.sources"), 16).alias("source_ref"))
    w = Window.partitionBy("ticket").orderBy("place")
    before = F.when(F.col("place") == 0, F.col(at)).otherwise(F.lag("id").over(w))
    edges = rows.select(before.alias("src"), F.col("id").alias("dst"), F.when(F.col("place") == 0, "attach").otherwise("chain").alias("kind")).where("src IS NOT NULL")
    return rows.select("id", "text", "emotion", "source_ref"), edges


def merged_additions(additions: DataFrame) -> DataFrame:
    """(setting, kind, cluster, value, first, support) of approved additions (setting, kind, cluster, value, status, pos).

    Each value counts once in its kind and cluster; proper nouns without a cluster go to misc, empty values are left out.
    """
    cluster = F.coalesce("cluster", F.when(F.col("kind") == "proper_noun", "misc").otherwise(""))
    kept = additions.where("status = 'approved' AND value <> ''").withColumn("cluster", cluster)
    return kept.groupBy("setting", "kind", "cluster", "value").agg(F.min("pos").alias("first"), F.count("*").alias("support"))


def bible_context(merged: DataFrame, clusters: int = 10, names: int = 5, most: int = 3000) -> DataFrame:
    """(setting, context): the first names of the first clusters, a line each, at most ``most`` characters."""
    nouns = merged.where("kind = 'proper_noun'")
    ranked = nouns.withColumn("rn", F.row_number().over(Window.partitionBy("setting", "cluster").orderBy("first", "value"))).where(F.col("rn") <= names)
    lines = ranked.groupBy("setting", "cluster").agg(F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("v"))
    placed = lines.withColumn("rn", F.row_number().over(Window.partitionBy("setting").orderBy("first", "cluster"))).where(F.col("rn") <= clusters)
    line = F.concat(F.lit("- "), F.col("cluster"), F.lit(": "), F.array_join(F.transform("v", lambda x: x["value"]), ", "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n")
    return placed.groupBy("setting").agg(F.substring(joined, 1, most).alias("context"))


def curator_batch(additions: DataFrame, each: int) -> DataFrame:
    """The first ``each`` pending additions (setting, status, pos) of every setting."""
    w = Window.partitionBy("setting").orderBy("pos")
    return additions.where("status = 'pending'").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each).drop("rn")


def vetoed(rows: DataFrame, nouns: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(approved rows, rejections): a row falls if the curator refuses one of its nouns; nouns (key, noun, approved, reason)."""
    refused = nouns.where(~F.coalesce("approved", F.lit(False)))
    return rows.join(refused.select(key).distinct(), key, "left_anti"), rows.join(refused.select(key, "noun", "reason"), key)


def warm_up_progress(done: DataFrame, keys: list[str], order: str, target: int) -> DataFrame:
    """(keys, order, total, progress, concurrency) of done (keys, order, n): running totals over a target, one at most.

    Counts are added up by key and order before the running sum, so that a window holds one row an order value.
    """
    daily = done.groupBy(*keys, order).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys).orderBy(order))
    rows = daily.withColumn("total", total).withColumn("progress", F.least(F.lit(1.0), F.col("total") / target))
    return rows.select(*keys, order, "total", F.round("progress", 6).alias("progress"), S.warm_up(F.col("progress")).alias("concurrency"))


def training_rows(lines: DataFrame, setting: str) -> DataFrame:
    """Lines (text, speaker, emotion, emotion_value, topic, quest, form_id) as training rows; intensity is a share of 100."""
    return lines.select(
        F.coalesce("text", F.lit("")).alias("text"), "speaker", F.coalesce("emotion", F.lit("neutral")).alias("emotion"),
        (F.coalesce("emotion_value", F.lit(50)) / 100.0).alias("emotion_intensity"), F.coalesce("topic", F.lit("SYNTHETIC")).alias("topic"),
        F.col("quest").alias("quest_context"), F.lit(f"synthetic_{setting}").alias("source"), F.coalesce("form_id", F.lit("")).alias("form_id"),
    )


def trajectory_rows(beats: DataFrame) -> DataFrame:
    """Beats (ticket, place, emotion, function, source_text, target_text) with the source text as a hash."""
    return beats.select("ticket", "place", F.coalesce("emotion", F.lit("neutral")).alias("emotion"), "function", S.short_hash(F.coalesce("source_text", F.lit("")), 16).alias("source_ref"), "target_text")


def trajectory_statistics(runs: DataFrame, beats: DataFrame) -> DataFrame:
    """(kind, value, n) of shapes and emotions; runs (ticket, shape), beats (ticket, emotion)."""
    shapes = runs.groupBy(F.coalesce("shape", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    emotions = beats.groupBy(F.col("emotion").alias("value")).agg(F.count("*").alias("n"))
    return shapes.select(F.lit("shape").alias("kind"), "value", "n").unionByName(emotions.select(F.lit("emotion").alias("kind"), "value", "n"))


def tier_mix(walks: DataFrame, levels: list[int]) -> DataFrame:
    """Walks (walk_id, text) as flattened rows and, for each reading level, as rows that ask for a story (id, walk_id, tier, level, text)."""
    entry = lambda tier, level: F.struct(F.lit(tier).alias("tier"), F.lit(level).cast("int").alias("level"))
    tiers = F.array(entry("flattened", None), *(entry("story", n) for n in levels))
    rows = walks.select("walk_id", "text", F.explode(tiers).alias("t"))
    name = F.when(F.col("t.tier") == "flattened", F.concat(F.lit("flat_"), "walk_id")).otherwise(F.concat(F.lit("fk_"), "walk_id", F.lit("_grade"), F.col("t.level").cast("string")))
    return rows.select(name.alias("id"), "walk_id", "t.tier", "t.level", "text")


def head_negatives(own: DataFrame, shared: DataFrame, heads: list[str]) -> DataFrame:
    """(head, tier, id) of every head: its own negatives (head, tier, id) and all shared ones (tier, id)."""
    return own.select("head", "tier", "id").unionByName(shared.select(F.explode(F.array(*map(F.lit, heads))).alias("head"), "tier", "id"))


def pool_batches(pool: DataFrame, key: str, steps: int, batch: int) -> DataFrame:
    """(tier, step, slot, key): each step takes the next rows of a tier's pool (tier, key), from the start again after its end.

    A pool smaller than a batch gives all its rows in each step. Places are counted by hash cells, so that no task sorts a
    whole tier.
    """
    cells = pool.withColumn("cell", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3))
    counts = cells.groupBy("tier", "cell").agg(F.count("*").alias("n"))
    before = counts.select("tier", "cell", (F.sum("n").over(Window.partitionBy("tier").orderBy("cell")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("tier")).alias("size"))
    inside = F.row_number().over(Window.partitionBy("tier", "cell").orderBy(F.sha2(F.col(key).cast("string"), 256), key)) - 1
    placed = cells.withColumn("inside", inside).join(before, ["tier", "cell"]).withColumn("place", F.col("before") + F.col("inside"))
    taken = F.least(F.lit(batch), F.col("size"))
    # the uses of a row are the draws place, place + size, ... below steps * taken
    times = F.when(F.col("place") < steps * taken, F.sequence(F.col("place"), steps * taken - 1, F.col("size")))
    uses = placed.withColumn("taken", taken).select("tier", key, "taken", F.explode(times).alias("draw"))
    return uses.select("tier", F.floor(F.col("draw") / F.col("taken")).alias("step"), F.pmod("draw", "taken").alias("slot"), key)


def mock_completion(prompt: str) -> str:
    """A stand-in for a language model: the prompt's quoted lines as a plain story; the same for the same prompt."""
    quoted = prompt.split('"')[1::2]
    return " ".join(f'Someone said, "{line}"' for line in quoted) or "Nothing was said."


def completions(rows: DataFrame, prompt: str, call: Callable[[str], str] = mock_completion) -> DataFrame:
    """rows with completion, latency_ms and error of a call for each prompt, run on the executors.

    ``call`` is any function of a prompt that a worker can unpickle. A call that fails gives its message as error and a null
    completion; a null prompt is not called.
    """
    ship(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", completion string, latency_ms double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            done = []
            for text in batch[prompt]:
                start = time.perf_counter()
                try:
                    done.append((None if text is None else call(text), (time.perf_counter() - start) * 1000, None))
                except Exception as e:  # the row tells what went wrong
                    done.append((None, (time.perf_counter() - start) * 1000, str(e)[:50]))
            out = batch.copy()
            out["completion"], out["latency_ms"], out["error"] = zip(*done) if done else ((), (), ())
            yield out

    return rows.mapInPandas(run, schema)


#: Ways to finish a ticket by the name of a backend.
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def backend(name: str):
    """Register a function of tickets under a backend's name."""

    def register(f):
        BACKENDS[name] = f
        return f

    return register


@backend("rules")
def rule_backend(tickets: DataFrame) -> DataFrame:
    """Beats (ticket, place, text, emotion) parsed by rules: with function and transition_from."""
    w = Window.partitionBy("ticket").orderBy("place")
    return tickets.withColumn("function", T.reply_function(F.col("text"), F.col("place"))).withColumn("transition_from", F.lag("emotion").over(w))


@backend("mock")
def mock_backend(tickets: DataFrame) -> DataFrame:
    """Tickets (prompt) with a mock completion."""
    return completions(tickets, "prompt")


def dispatched(tickets: DataFrame, name: str) -> DataFrame:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](tickets)


def wave_gaps(edges: DataFrame, arcs: DataFrame, rate: float, spread: float, expected: list[str]) -> DataFrame:
    """(kind, detail): a self-loop rate above the reference's by more than its spread, and each expected shape that is missing."""
    loops = edges.agg(F.avg(F.when(F.col("src_emotion") == F.col("dst_emotion"), 1.0).otherwise(0.0)).alias("r")).where(F.col("r") > rate + spread)
    want = edges.sparkSession.createDataFrame([(s,) for s in expected], "shape string")
    missing = want.join(arcs.select("shape").distinct(), "shape", "left_anti")
    return loops.select(F.lit("add_emotional_transitions").alias("kind"), F.round("r", 6).cast("string").alias("detail")).unionByName(missing.select(F.lit("add_arc_shapes").alias("kind"), F.col("shape").alias("detail")))


def gap_allocation(gaps: DataFrame, count: int) -> DataFrame:
    """gaps (key, gap) with n: samples by the share of a gap, one at least."""
    total = F.sum("gap").over(Window.partitionBy())
    return gaps.withColumn("n", F.greatest(F.lit(1), F.floor(F.col("gap") * count / total)).cast("int"))


def gap_samples(gaps: DataFrame, index: DataFrame, count: int, seed: str = "gap") -> DataFrame:
    """(key, walk_id): for each gap its share of walks (walk_id, key) by keyed draws, ``count`` in all at most, largest gaps first.

    Gaps are few (pairs of emotions, shapes). Each keeps the smallest draws of its walks, so no list of a key is sorted whole
    beyond what Spark prunes before its window.
    """
    most = F.broadcast(gap_allocation(gaps, count))
    w = Window.partitionBy("key").orderBy("u", "walk_id")
    ranked = index.select("walk_id", "key").distinct().join(most, "key").withColumn("u", S.draw(F.lit(seed), F.col("key"), F.col("walk_id").cast("string"))).withColumn("rn", F.row_number().over(w)).where("rn <= n AND rn <= " + str(count))
    return ranked.orderBy(F.desc("gap"), "key", "rn").limit(count).select("key", "walk_id")


def node_context(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, back: bool = False) -> DataFrame:
    """(start, place, id): up to ``depth`` nodes along the first edge (by pos) out of or into each node; earliest first.

    An end that is no node is passed over but followed.
    """
    near, far = ("dst", "src") if back else ("src", "dst")
    dealt = edges.select(F.col(near).alias("at"), far, "pos").repartition(parts_for(starts), "at")  # before the aggregation, whose tasks sort their rows
    first = dealt.groupBy("at").agg(F.min_by(far, "pos").alias("next"))
    state = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    parts = []
    for hop in range(1, depth + 1):
        state = state.join(first, "at").select("start", F.col("next").alias("at"))
        parts.append(state.select("start", F.lit(depth - hop if back else hop - 1).alias("place"), F.col("at").alias("id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(nodes.select("id").distinct(), "id", "left_semi").select("start", "place", "id")


def word_walks(words: DataFrame, beats: DataFrame, best: int = 2) -> DataFrame:
    """(word, walk_id, score) of the best walks for words (word, forms): ten for each form that occurs, by an equi-join on forms.

    beats (walk_id, text).
    """
    forms = words.select("word", F.explode(F.array_distinct(F.transform("forms", F.lower))).alias("token"))
    held = beats.select("walk_id", F.explode(T.tokens(S.clean_text(F.col("text")))).alias("token")).join(F.broadcast(forms.select("token").distinct()), "token", "left_semi").distinct()
    scores = held.join(forms, "token").groupBy("word", "walk_id").agg((F.count("*") * 10).alias("score"))
    w = Window.partitionBy("word").orderBy(F.desc("score"), "walk_id")
    return scores.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= best).drop("rn")


def words_in(texts: DataFrame, key: str, inflections: DataFrame) -> DataFrame:
    """(key, word, rank) of vocabulary words (word, rank, form) whose forms stand in texts (key, text)."""
    found = texts.select(key, F.explode(T.tokens(F.col("text"))).alias("form")).join(inflections, "form")
    return found.groupBy(key, "word").agg(F.min("rank").alias("rank"))


def chapters(rows: DataFrame, key: str, least: int = 200, first: int = 3, most: int = 2000) -> DataFrame:
    """(key, place, text) of the first chapters (chapters, language) of English or unmarked works, cut at ``most`` characters."""
    kept = rows.where(F.upper(F.coalesce("language", F.lit(""))).isin("", "ENG"))
    each = kept.select(key, F.posexplode(F.slice("chapters", 1, first)).alias("place", "text")).withColumn("text", F.trim("text"))
    return each.where(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))


def passages(rows: DataFrame, least: int = 100, most: int = 1500) -> DataFrame:
    """Rows (text) that are no heading (`` =``) and long enough, trimmed and cut at ``most`` characters."""
    kept = rows.where(F.col("text").isNotNull() & ~F.col("text").startswith(" =") & (F.length(F.trim("text")) >= least))
    return kept.withColumn("text", F.substring(F.trim("text"), 1, most))


def run_statistics(rows: DataFrame) -> DataFrame:
    """(kind, value, n, share) of a run's rows by game, shape and barrier, and of its emotion transitions; n counts.

    rows (game, shape, barrier, emotions).
    """
    e = F.col("emotions")
    size = F.greatest(F.size(e) - 1, F.lit(0))
    steps = F.zip_with(F.slice(e, F.lit(1), size), F.slice(e, F.lit(2), size), lambda a, b: F.concat(a, F.lit("->"), b))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    facts = F.concat(F.array(pair("game", F.col("game")), pair("shape", F.col("shape")), pair("barrier", F.col("barrier"))), F.transform(steps, lambda s: pair("transition", s)))
    counts = rows.select(F.explode(facts).alias("f")).groupBy("f.kind", "f.value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))


def compared(reference: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: nodes, edges and edges a node of two graphs (nodes, edges), and the target's share of the reference's."""
    count: Callable[[DataFrame, str], DataFrame] = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(reference[0], "ref_nodes").join(count(reference[1], "ref_edges")).join(count(target[0], "nodes")).join(count(target[1], "edges"))
    share: Callable[[Column, Column], Column] = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    c = F.col
    return one.withColumns({"edges_per_node": share(c("edges"), c("nodes")), "ref_edges_per_node": share(c("ref_edges"), c("ref_nodes")), "node_share": share(c("nodes"), c("ref_nodes")), "edge_share": share(c("edges"), c("ref_edges"))})


def aesop_report(rows: DataFrame) -> DataFrame:
    """(reason, n, avg_walks, avg_words): passed rows with null, failed ones by the first word of their reason."""
    reason = F.when(F.col("reason").isNotNull(), F.substring_index("reason", "_", 1))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("walks"), 6).alias("avg_walks"), F.round(F.avg("words"), 6).alias("avg_words"))


def sharing(rows: DataFrame, item: str, key: str) -> DataFrame:
    """(a, b, shared): pairs of items, the smaller first, that have two keys or more in common, and how many.

    Items meet through pairs of their keys, which only those with two common keys do. c common pairs come from
    (1 + sqrt(1 + 8 c)) / 2 common keys. An item of k keys has k (k - 1) / 2 rows in the exchange.
    """
    held = rows.select(F.col(item).alias("item"), F.col(key).alias("x")).where("item IS NOT NULL AND x IS NOT NULL").repartition("item").distinct()
    two = held.join(held.withColumnRenamed("x", "y"), "item").where("x < y")
    both = two.withColumnRenamed("item", "a").join(two.withColumnRenamed("item", "b"), ["x", "y"]).where("a < b")
    counts = both.groupBy("a", "b").agg(F.count("*").alias("c"))
    return counts.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long").alias("shared"))
