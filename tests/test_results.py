import hashlib
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import texts as T
from loomgraph.operators import crossings as C
from loomgraph.operators import results as R
from loomgraph.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_payload(spark):
    long = "A quiet road. " * 10
    cases = [("short", "{}", (None, "empty")), (None, None, (None, "empty")), (long, '{"prose": null, "error": "truncated"}', (None, "truncated")), (long, "not json", (long, None)),
             ("Let me write: " + long, "not json", ("" or None, "malformed")), (long, None, (long, None))]
    for raw, reply, (prose, error) in cases:
        got = one(spark, T.payload(F.lit(raw).cast("string"), F.lit(reply).cast("string")))
        assert (got["prose"], got["error"]) == (prose, error)
    text = one(spark, T.payload(F.lit(long), F.lit("```json\n" + json.dumps({"prose": "p" * 60, "notes": "n"}) + "\n```")))
    assert (text["prose"], text["notes"]) == ("p" * 60, "n")


def test_words(spark):
    assert one(spark, T.named_phrases(F.lit("The Iron Bureau met Enachäber and Bo. This"))) == ["The Iron Bureau"]
    assert one(spark, T.named_phrases(F.lit(None).cast("string"))) == []
    defined = lambda text, word, forms: one(spark, T.word_defined(F.lit(text), F.lit(word), F.array(*map(F.lit, forms))))
    assert defined("To *haggle* is to argue.", "haggle", ["haggle", "haggles"]) is True
    assert defined("They haggle. It means nothing.", "haggle", ["haggle"]) is False
    assert one(spark, T.walk_used(F.array(F.lit("{Sad} the long road home"), F.lit("hi")), F.lit("A LONG, long ROAD"))) is True
    assert one(spark, T.walk_used(F.array(F.lit("short line")), F.lit("short line"))) is False
    assert one(spark, T.setting_spec(F.lit("plains"))).asDict() == {"setting": "plains", "version": None}


def test_prose(spark):
    beat = "struct<text:string,emotion:string,function:string,speaker:string>"
    rows = spark.createDataFrame([([("Go now", "anger", "x", "ann"), ("Why?", "odd", "threaten", None), ("Because it rains today. And it is late.", "neutral", "x", "")],)], f"b array<{beat}>")
    text = rows.select(T.prose(F.col("b"), F.lit("Dusk."), F.array(F.lit("x"), F.lit("y")), {"neutral": ["said"], "anger": ["snapped"]}, {"threaten": "Slowly: "})).first()[0]
    assert text.split("\n\n") == ["Dusk.", 'Ann snapped, "Go now"', 'Slowly: "Why?" Y said.', '"Because it rains today," X said. "And it is late."']
    context = rows.select(T.walk_context(F.col("b"), {"emotion": "Mood", "speaker": "Speakers"})).first()[0]
    assert context == "Mood: anger, odd, neutral\nSpeakers: ann"


def naive_links(nodes, tickets):
    known, out = set(nodes), []
    for made, links in tickets:
        known |= {i for i in made if i}
        for status, a, b, via, text in links:
            if status == "declined" or not a or not b or a not in known:
                continue
            if status == "bridged" and via:
                if text:
                    known.add(via)
                out += [(a, via, "bridge_out"), (via, b, "bridge_in")]
            elif status == "direct":
                out.append((a, b, "direct_link"))
    return sorted(out), sorted(known - set(nodes))


def test_link_results(spark):
    tickets = [
        (["g1"], [("bridged", "a", "z", "v1", "t"), ("direct", "v1", "b", None, ""), ("direct", "g2", "b", None, ""), ("declined", "a", "b", None, "")]),
        (["g2", ""], [("bridged", "v1", "b", "v2", ""), ("direct", "v2", "b", None, ""), ("direct", "g2", None, None, ""), ("bridged", "g1", "a", None, "t"), (None, "a", "b", None, "")]),
        ([], [("bridged", "v3", "a", "v4", "t"), ("bridged", "v1", "a", "v3", "t"), ("direct", "v3", "b", None, ""), ("direct", "v3", "b", None, "")]),
    ]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    made = [(f"t{i}", i, k, g, "x", None) for i, (gs, _) in enumerate(tickets) for k, g in enumerate(gs)]
    links = [(f"t{i}", i, k, *link[:4], link[4], None) for i, (_, ls) in enumerate(tickets) for k, link in enumerate(ls)]
    added, edges = R.link_results(
        nodes, spark.createDataFrame(made, "ticket string, pos int, place int, id string, text string, emotion string"),
        spark.createDataFrame(links, "ticket string, pos int, place int, status string, src string, dst string, via string, text string, emotion string"),
    )
    want_edges, want_nodes = naive_links(["a", "b"], tickets)
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == want_edges
    assert sorted(r["id"] for r in added.collect()) == want_nodes


def test_extension_results(spark):
    nodes = spark.createDataFrame([("a",)], "id string")
    tickets = spark.createDataFrame([("t", "completed", None, True, "rise"), ("u", "completed", None, False, None), ("w", "completed", True, True, None)], "ticket string, status string, applied boolean, success boolean, arc string")
    bridges = spark.createDataFrame([("t", 0, 0, "a", "x", "sad"), ("t", 0, 1, "n", "x", "joyful"), ("t", 0, 2, "n", "y", "sad"), ("u", 1, 0, "m", "x", None)], "ticket string, pos int, place int, id string, text string, emotion string")
    edges = spark.createDataFrame([("t", "a", "n", None), ("t", "a", None, None), ("u", "a", "m", "k")], "ticket string, src string, dst string, kind string")
    added, linked = R.extension_results(nodes, tickets, bridges, edges)
    assert [(r["id"], r["text"], r["emotion"], r["emotion_raw"], r["arc"]) for r in added.collect()] == [("n", "x", "happy", "joyful", "rise")]
    assert [(r["src"], r["dst"], r["kind"]) for r in linked.collect()] == [("a", "n", "extension_bridge")]


def test_translated_walks(spark):
    rows = [("t", "completed", None, ["x", "y", "z"], ["sad", "happy"], ["a", "b", "c"]), ("u", "completed", True, ["x"], ["sad"], ["a"]), ("v", "completed", None, [], ["sad"], ["a"])]
    cut = R.translated_walks(spark.createDataFrame(rows, "ticket string, status string, applied boolean, texts array<string>, emotions array<string>, sources array<string>"))
    assert [(r["ticket"], r["texts"], r["emotions"]) for r in cut.collect()] == [("t", ["x", "y"], ["sad", "happy"])]
    nodes, edges = R.attached_walks(cut.withColumn("at", F.lit("root")), "at")
    ids = [r["id"] for r in nodes.orderBy("text").collect()]
    assert [(r["src"], r["dst"], r["kind"]) for r in edges.orderBy("kind").collect()] == [("root", ids[0], "attach"), (ids[0], ids[1], "chain")]


def test_completions(spark):
    rows = spark.createDataFrame([(1, 'Say "hi"'), (2, None), (3, "")], "k int, prompt string")

    def broken(prompt):
        raise ValueError("no model")

    got = {r["k"]: r for r in R.completions(rows, "prompt").collect()}
    assert got[1]["completion"] == 'Someone said, "hi"' and got[2]["completion"] is None and got[3]["completion"] == "Nothing was said."
    assert {r["error"] for r in R.completions(rows, "prompt", broken).collect()} == {"no model", None}
    assert R.completions(rows.limit(0), "prompt").count() == 0
    with pytest.raises(ValueError):
        R.dispatched(rows, "none")


def test_linear_chains(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "n0"), ("y", "n0"), ("r", "s"), ("s", "r"), ("p", "q"), ("n9", "n9")]
    got = C.linear_chains(spark.createDataFrame(pairs, "src string, dst string")).orderBy("place").collect()
    assert [(r["chain"], r["place"], r["topic"]) for r in got] == [("n0", i, f"n{i}") for i in range(10)]
    assert C.linear_chains(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_bridge_walks(spark):
    edges = [("g", f"a{i}", f"a{i + 1}", "sad", "happy") for i in range(6)] + [("h", f"b{i}", f"b{i + 1}", "sad", "happy") for i in range(6)] + [("g", "loop", "loop", "sad", "sad")]
    starts = [(f"w{i}", "g", "a0") for i in range(30)] + [("end", "h", "b6"), ("loop", "g", "loop")]
    walks = C.bridge_walks(spark.createDataFrame(edges, "game string, src string, dst string, src_emotion string, dst_emotion string"), spark.createDataFrame(starts, "walk_id string, game string, id string"), 5)
    by = {}
    for r in walks.orderBy("walk_id", "step").collect():
        by.setdefault(r["walk_id"], []).append(r)
    follows = {(a, b) for _, a, b, _, _ in edges}
    assert len(by["end"]) == len(by["loop"]) == 1
    for rows in by.values():
        ids = [r["id"] for r in rows]
        assert len(set(ids)) == len(ids)
        for a, b in zip(rows, rows[1:]):
            assert b["step"] == a["step"] + 1
            if b["crossed"]:
                assert a["game"] != b["game"] and b["id"] in {e[2] for e in edges if e[0] == b["game"]}
            else:
                assert (a["id"], b["id"]) in follows and a["game"] == b["game"]
    crossings = sum(r["crossed"] for rows in by.values() for r in rows)
    assert 10 < crossings < 80
    assert all(r["coverage"] in (0.5, 1.0) for r in C.walk_coverage(walks, 2).collect())


def test_topic_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("a", "a")], "src string, dst string")
    games = spark.createDataFrame([("a", ["g"]), ("b", ["g"]), ("c", ["g", "h"]), ("d", ["g"])], "topic string, games array<string>")
    starts = spark.createDataFrame([("w", "a"), ("v", "b")], "walk_id string, topic string")
    got = C.topic_walks(edges, games, starts, 4).orderBy("walk_id", "step").collect()
    assert [(r["walk_id"], r["topic"]) for r in got] == [("v", "b"), ("v", "a"), ("v", "c"), ("v", "d"), ("w", "a"), ("w", "c"), ("w", "d")]


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    nodes = spark.createDataFrame([("a", "x", "sad")], "id string, text string, emotion string")
    edges = spark.createDataFrame([("a", "a", "chain")], "src string, dst string, kind string")
    assert stores.latest_version(spark, root, "s") is None
    assert stores.new_version(spark, root, "s") == 1
    stores.extend_version(spark, root, "s", 1, nodes, edges, "run1")
    assert stores.branch_version(spark, root, "s", 1) == 2
    stores.extend_version(spark, root, "s", 2, nodes, edges, "run2")
    got = {r["version"]: (r["parent"], r["nodes"], r["edges"], r["run_ids"]) for r in stores.versions(spark, root, "s").collect()}
    assert got == {1: (None, 1, 1, ["run1"]), 2: (1, 2, 2, ["run2"])}
    with pytest.raises(ValueError):
        stores.branch_version(spark, root, "s", 9)


def test_splits(spark, tmp_path):
    name = stores.split_id("my_corpus", "prose", count=2)
    stores.write_split(spark.createDataFrame([("one two",), ("three",)], "text string").coalesce(1), str(tmp_path), name)
    row = stores.split_manifest(spark, str(tmp_path)).first()
    assert (row["split_id"], row["source"], row["split_type"], row["items"], row["tokens"], row["bytes"]) == (name, "my_corpus", "prose", 2, 3, 36)
    assert [json.loads(r["value"])["text"] for r in stores.split_chunk(spark, str(tmp_path), name, 1).collect()] == ["three"]


def test_queues_and_traces(spark, tmp_path):
    (tmp_path / "queue.json").write_text(json.dumps({"run_id": "r", "parse_tickets": [{"ticket_id": "a", "status": "pending"}], "tickets": [{"ticket_id": "b", "stage": "curate"}]}))
    assert sorted((r["run_id"], r["ticket_id"], r["stage"]) for r in stores.read_queue(spark, str(tmp_path / "queue.json")).collect()) == [("r", "a", "parse"), ("r", "b", "curate")]
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "traces_2024-01-31.jsonl").write_text('{"trace_id": "t", "status": "failed"}\n')
    assert [(r["trace_id"], str(r["day"])) for r in stores.read_traces(spark, str(tmp_path / "traces")).collect()] == [("t", "2024-01-31")]
    (tmp_path / "g.json").write_text('{"nodes": [], "edges": []}')
    assert stores.graph_format(spark, str(tmp_path / "g.json")) == "graph" and stores.graph_format(spark, str(tmp_path / "queue.json")) == "corpus"
    files = spark.createDataFrame([("synthetic_x_dialogue.json", 3), ("synthetic_x_trajectories.json", 2), ("synthetic_y_dialogue.json", 1)], "file string, records long")
    assert {r["setting"]: (r["lines"], r["trajectories"]) for r in stores.compiled_settings(files, files).collect()} == {"x": (3, 2), "y": (1, None)}


def test_empty_and_null_results(spark):
    empty = spark.createDataFrame([], "setting string, kind string, cluster string, value string, status string, pos long")
    assert R.merged_additions(empty).count() == R.bible_context(R.merged_additions(empty)).count() == R.curator_batch(empty, 3).count() == 0
    rows = spark.createDataFrame([(None, "proper_noun", None, "X", "approved", 1), (None, "proper_noun", None, "X", "approved", 2), ("s", "idiom", None, "", "approved", 3)], empty.schema)
    assert [(r["cluster"], r["first"], r["support"]) for r in R.merged_additions(rows).collect()] == [("misc", 1, 2)]


def test_word_reason(spark):
    from loomgraph.operators import filters

    story = "To haggle is to argue. " + "They met. He sat. She ran. " * 7
    reason = lambda text, *forms: one(spark, filters.word_reason(F.lit(text), F.lit("haggle"), F.array(*map(F.lit, forms)) if forms else None))
    assert reason(story) is None
    assert reason("To haggle is to argue.") == "too_short"
    assert reason(story.replace("haggle", "haggled")) == "word_missing"
    assert reason(story.replace("To haggle is to argue.", "They haggled all the day, as ever."), "haggle", "haggled") == "no_definition"


def test_growth(spark):
    from loomgraph.operators import growth

    nodes = spark.createDataFrame([("a", "sad", "x"), ("b", "sad", "y")], "id string, emotion string, text string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    reference = spark.createDataFrame([("sad", "happy", 3), ("sad", "sad", 1)], "src_emotion string, dst_emotion string, n long")
    beats = [(w, i, e, f"{w}{i}") for w in "pqrs" for i, e in enumerate(["sad", "happy"])] + [("t", 0, "sad", "t"), ("t", 1, "sad", "t")]
    walks = spark.createDataFrame(beats, "walk_id string, place int, emotion string, text string")
    more, linked = growth.grown(nodes, edges, reference, walks, 6, 1)
    got = {r["id"]: r["emotion"] for r in more.collect()}
    assert len(got) == 6 and sorted(got.values()) == ["happy", "happy", "sad", "sad", "sad", "sad"]
    ends = [(r["src"], r["dst"]) for r in linked.collect()]
    assert len(ends) == 5 and all(got[a] == "sad" for a, _ in ends) and all(a in got and b in got for a, b in ends)
    rest, _ = growth.grown(nodes, edges, reference, walks, 100, 10)
    assert rest.count() == 10  # only walks that close a gap
    stats = {(r["kind"], r["value"]): r["p"] for r in growth.target_statistics(more, linked).collect()}
    assert stats["self_loops", "all"] == 0.6 and stats["emotion", "sad"] == 0.666667
    empty = growth.target_statistics(nodes, edges.limit(0)).collect()
    assert {r["kind"] for r in empty} == {"emotion"}


def test_stopped_walks(spark):
    from loomgraph.operators import growth

    rows = [("w", i, n) for i, n in enumerate("abcbd")] + [("v", 0, "a"), ("v", 1, "b"), ("u", 0, "a"), ("u", 1, "a")]
    got = growth.stopped_walks(spark.createDataFrame(rows, "walk_id string, step int, id string")).orderBy("walk_id", "step").collect()
    assert "".join(r["walk_id"] + r["id"] for r in got) == "uavavbwawbwc"
    topics = spark.createDataFrame([("g", f"t{i}", i) for i in range(10)], "game string, topic string, n long")
    assert {r["n"] for r in growth.frequent_topics(topics, "n", 0.2, 2).collect()} == {2, 3, 4, 5, 6}


def test_fable_filter(spark, tmp_path):
    import duckdb

    from loomgraph import registry

    texts = ["Here is " + "a word " * 50, "a word " * 50, "let me " * 100, "let me", "word " * 700]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 4)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.QUERIES["fable_filter"](spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["fable_filter"]).fetchall(), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorting_aggregations_come_after_the_exchange(spark):
    """Strings beside an aggregation make its tasks sort their rows; such tasks are dealt by rows, not those that read."""
    from loomgraph.operators import graphs

    lines = spark.createDataFrame([("g", k, f"f{k}", f"t{k % 2}", "q", "sad", 1.0 * (k % 3)) for k in range(9)], "game string, pos long, form_id string, topic string, quest string, emotion string, stage double")
    edges = spark.createDataFrame([("g", "a", "b", "sequential", 1.0), ("g", "a", "b", "condition_gate", 0.3), ("g", "b", None, "x", 0.1)], "game string, src string, dst string, kind string, weight double")
    assert "min_by" not in plan(graphs.branch_edges(lines)) + plan(graphs.gate_edges(lines)) and "max_by" not in plan(graphs.emotion_edges(lines))
    for text, name in ((plan(graphs.collapsed(edges)), "partial_max_by"), (plan(R.node_context(edges.withColumn("pos", F.col("dst")), edges.select(F.col("src").alias("id")), edges.select(F.col("src").alias("id")))), "partial_min_by")):
        first = text.index(name)
        assert "Exchange" in text[first:].split("Scan")[0]
    nodes = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("g", None), ("h", "a")], "game string, form_id string")
    got = graphs.degrees(nodes, edges)
    assert plan(got).count("Scan") == 2  # nodes and edges once each
    assert sorted(map(tuple, got.select("game", "id", "out_deg", "out_edges", "in_deg", "in_edges").collect()), key=repr) == sorted(
        [("g", "a", 1, 2, 0, 0), ("g", "b", 0, 1, 1, 2), ("g", "b", 0, 1, 1, 2), ("g", None, 0, 0, 0, 0), ("h", "a", 0, 0, 0, 0)], key=repr
    )


def test_sharing(spark):
    rows = [(a, k) for a, keys in {1: "abcde", 2: "abc", 3: "abx", 4: "z", 5: "edcba"}.items() for k in keys * 2] + [(6, None), (None, "a")]
    got = {(r["a"], r["b"]): r["shared"] for r in R.sharing(spark.createDataFrame(rows, "i long, k string"), "i", "k").collect()}
    assert got == {(1, 2): 3, (1, 3): 2, (1, 5): 5, (2, 3): 2, (2, 5): 3, (3, 5): 2}


def test_jumps_sort_no_options(spark, monkeypatch):
    plans, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append(plan(df)) or cut(df))
    edges = spark.createDataFrame([(g, f"{g}{i}", f"{g}{i + 1}", "sad", "sad") for g in "gh" for i in range(3)], "game string, src string, dst string, src_emotion string, dst_emotion string")
    C.bridge_walks(edges, spark.createDataFrame([("w", "g", "g0")], "walk_id string, game string, id string"), 2, cross=1.0)
    assert not any("partial_min_by(struct(to_game" in p or "partial_min_by(named_struct(to_game" in p for p in plans)


def test_chains_take_no_distinct_rows(spark, monkeypatch):
    plans, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append((df.columns, plan(df))) or cut(df))
    C.linear_chains(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string"))
    assert not any("Union" in p and "HashAggregate" in p for columns, p in plans if "place" in columns)


EDGE = "game string, src string, dst string, src_emotion string, dst_emotion string"


def test_jumps_reach_every_edge(spark):
    """Each edge of a cell is as likely, in a cell of far more edges than slots had representatives."""
    cell = [("h", f"b{i}", f"c{i}", "sad", "happy") for i in range(300)] + [("k", "k0", "k1", "sad", "happy"), ("h", "d", "d1", "sad", "sad"), ("g", "a0", "a1", "sad", "happy")]
    edges = spark.createDataFrame(cell, EDGE)
    numbers = C.numbered_ends(edges, "s").where("to_game = 'h' AND dst_emotion = 'happy'").collect()
    assert sorted(r["number"] for r in numbers) == list(range(300)) and len({r["jump"] for r in numbers}) == 300
    starts = spark.range(12000).selectExpr("concat('w', id) AS walk_id", "'g' AS game", "'a0' AS id")
    ends = Counter(r["id"] for r in C.bridge_walks(edges, starts, 1, cross=1.0).where("step = 1 AND crossed").collect())
    assert ends.total() == 12000 and 5600 < ends.pop("k1") < 6400
    assert set(ends) == {f"c{i}" for i in range(300)} and max(ends.values()) < 50


def plain_walks(edges, starts, steps, cross=0.3, seed="bridge"):
    """bridge_walks over lists, one walk at a time."""
    sha = lambda *parts: hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()
    draw, whole = lambda *parts: int(sha(*parts)[:8], 16) / 2**32, lambda *parts: int(sha(*parts)[:15], 16)
    out, cells = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for e in edges:
        out[e[1]].append(e)
        cells[e[3:]][e[0]].append((int(draw(seed, e[1], e[2]) * 1024), e[1], e[2]))
    for games in cells.values():
        for members in games.values():
            members.sort()
    rows = []
    for walk, game, at in starts:
        path = [at]
        rows.append((walk, 0, game, at, False))
        for step in range(1, steps + 1):
            options = sorted((draw(seed + ":edge", walk, step, e[2]), e[2], e) for e in out[at])
            if not options:
                break
            e, crossed = options[0][2], False
            to = next((d for _, d, _ in options if d not in path), None) if e[2] in path else e[2]
            games = sorted(g for g in cells[e[3:]] if g != game)
            if games and draw(seed + ":cross", walk, step) < cross * (0.3 if e[3:] == ("neutral", "neutral") else 1):
                far = games[whole(seed + ":game", walk, step) % len(games)]
                jump = cells[e[3:]][far][whole(seed + ":jump", walk, step) % len(cells[e[3:]][far])][2]
                if jump not in path:
                    to, game, crossed = jump, far, True
            if to is None:
                break
            at = to
            path.append(at)
            rows.append((walk, step, game, at, crossed))
    return rows


def test_bridge_coverage_plain(spark, sf):
    from loomgraph import registry
    from loomgraph.operators import graphs
    from loomgraph.plans.views import event_lines

    lines = event_lines(spark, sf)
    edges = [tuple(r) for r in graphs.emotion_edges(lines).select("game", "src", "dst", "src_emotion", "dst_emotion").collect()]
    starts = [(r["form_id"], r["game"], r["form_id"]) for r in lines.where("game = 'g0'").collect()]
    by = defaultdict(list)
    for r in plain_walks(edges, starts, 5):
        by[r[0]].append(r)
    want = [(w, len(rows), len({r[2] for r in rows}), sum(r[4] for r in rows), round(len({r[2] for r in rows}) / 4, 6)) for w, rows in by.items()]
    got = registry.QUERIES["bridge_coverage"](spark, sf).select("walk_id", "nodes", "games", "crossings", "coverage").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hubs_are_all_there(spark, sf):
    from loomgraph import registry

    nodes = registry.QUERIES["node_degrees"](spark, sf).collect()
    want = sorted(((r["game"], r["id"], r["out_deg"] + r["in_deg"]) for r in nodes if r["out_deg"] + r["in_deg"] >= 6), key=lambda r: (-r[2], r[1]))
    assert len(want) > 50 and [tuple(r) for r in registry.QUERIES["hubs"](spark, sf).collect()] == want


def test_bridge_walks_plain(spark, sf):
    from loomgraph import registry
    from loomgraph.operators import graphs
    from loomgraph.plans.views import event_lines

    lines = event_lines(spark, sf)
    edges = [tuple(r) for r in graphs.emotion_edges(lines).select("game", "src", "dst", "src_emotion", "dst_emotion").collect()]
    starts = [(r["form_id"], r["game"], r["form_id"]) for r in lines.where("game = 'g0'").collect()]
    got = registry.QUERIES["bridge_walks"](spark, sf).select("walk_id", "step", "game", "id", "crossed").collect()
    assert sorted(map(tuple, got)) == sorted(plain_walks(edges, starts, 5))
    # ends that are null, games with no partner, parallel edges and pairs without an emotion
    odd = [("g", "a", "b", "sad", None), ("g", "a", "b", "sad", "sad"), ("g", "a", "b", "sad", "sad"), ("h", "c", None, "sad", "sad"), ("h", "d", "e", "sad", None), (None, "n", "m", "sad", "sad"), ("g", "b", "a", "happy", "sad")]
    begun = spark.range(50).selectExpr("concat('w', id) AS walk_id", "'g' AS game", "'a' AS id")
    rows = C.bridge_walks(spark.createDataFrame(odd, EDGE), begun, 3, cross=1.0).collect()
    assert len(rows) == 100 and {(r["step"], r["game"], r["id"], r["crossed"]) for r in rows} == {(0, "g", "a", False), (1, "g", "b", False)}

