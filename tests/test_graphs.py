import pytest

from loomgraph import registry
from loomgraph.operators import analytics as A
from loomgraph.operators import chains, filters, graphs, linking, stats, tickets

LINES = [
    ("g", 0, "a", "GREETING", "Q1", "S1", "neutral", None), ("g", 1, "b", "GREETING", None, "S1", "happy", None), ("g", 2, "c", "T1", "Q1", "S1", "anger", 20.0),
    ("g", 3, "d", "T1", "Q1", "S2", "neutral", 10.0), ("g", 4, "e", "T2", "Q1", "S2", "sad", None), ("g", 5, "f", "T1", "Q2", "S2", "anger", None),
]
SCHEMA = "game string, pos long, form_id string, topic string, quest string, speaker string, emotion string, stage double"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, SCHEMA).selectExpr("*", "form_id AS text")


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_edges(lines):
    assert pairs(graphs.sequential_edges(lines)) == [("a", "b"), ("d", "c"), ("f", "d")]
    assert pairs(graphs.branch_edges(lines)) == [("a", "c"), ("a", "e")]
    assert pairs(graphs.gate_edges(lines)) == [("c", "d"), ("d", "c")]
    kept = {(r["src"], r["dst"]): (r["kind"], r["weight"]) for r in graphs.collapsed(graphs.line_edges(lines)).collect()}
    assert len(kept) == 6 and kept["d", "c"] == ("condition_gate", 0.3)


def test_degrees(lines):
    deg = {r["id"]: r for r in graphs.degrees(lines, graphs.line_edges(lines)).collect()}
    assert [deg[x]["out_deg"] for x in "abcdef"] == [3, 0, 1, 1, 0, 1]
    assert [deg[x]["in_deg"] for x in "abcdef"] == [0, 1, 2, 2, 1, 0]
    assert (deg["d"]["out_edges"], deg["c"]["in_edges"]) == (2, 3)


def test_topics(lines):
    got = {(r["src"], r["dst"]): r["weight"] for r in graphs.topic_edges(lines).collect()}
    assert got == {("GREETING", "T1"): 2, ("T1", "T2"): 2}
    assert {r["topic"]: r["emotion"] for r in graphs.dominant(lines, ["topic"]).collect()} == {"GREETING": "neutral", "T1": "anger", "T2": "sad"}


def test_analytics(spark, lines):
    e, n = graphs.collapsed(graphs.line_edges(lines)), lines.selectExpr("form_id AS id")
    assert {r["component"] for r in A.weak_components(n, e).collect()} == {"a"}
    strong = {r["id"]: r["component"] for r in A.strong_components(n, e).collect()}
    assert strong["c"] == strong["d"] == "d" and len(set(strong.values())) == 5
    assert A.shortest_path(e, "f", "c") == ["f", "d", "c"] and A.shortest_path(e, "f", "e") is None and A.shortest_path(e, "f", "c", 2) is None
    near, inside = A.ego(e, "a", 2)
    assert sorted(r["id"] for r in near.collect()) == ["a", "b", "c", "e"] and pairs(inside) == [("a", "b"), ("a", "c"), ("a", "e")]
    assert [r["cycle"] for r in A.cycles(e).collect()] == ["c>d"]
    assert sum(r["rank"] for r in A.pagerank(n, e, 30).collect()) == pytest.approx(1.0)
    walked = A.walks(e, spark.createDataFrame([("w", "a")], "walk_id string, id string"), 5).collect()
    assert walked[0]["id"] == "a" and len({r["id"] for r in walked}) == len(walked)


def test_empty(spark):
    lines = spark.createDataFrame([], SCHEMA + ", text string")
    assert not graphs.line_edges(lines).count() and not graphs.topic_edges(lines).count() and not chains.quest_chains(lines).count()
    none = spark.createDataFrame([], "id string")
    edges = spark.createDataFrame([], "src string, dst string, weight double")
    assert not A.weak_components(none, edges).count() and not A.strong_components(none, edges).count() and not A.pagerank(none, edges).count()


def test_chains(lines):
    (chain,) = chains.quest_chains(lines).collect()
    assert (chain["quest"], chain["topic"], chain["ids"], chain["speaker"], chain["staged"]) == ("Q1", "T1", "d>c", "S1", 2)
    assert not chains.speaker_chains(lines).count()


@pytest.mark.parametrize("n,starts", [(2, []), (3, [0]), (5, [0]), (6, [0, 3]), (8, [0, 3])])
def test_windows(spark, n, starts):
    rows = spark.createDataFrame([("k", i, f"{i}") for i in range(n)], "k string, pos long, form_id string")
    got = {r["start"]: r["ids"] for r in chains.strided_windows(rows, ["k"]).collect()}
    assert got == {s: ">".join(str(i) for i in range(s, min(n, s + 5))) for s in starts}


def test_distances(spark):
    dist = lambda **p: spark.createDataFrame(list(p.items()), "k string, p double")
    got = stats.distances(dist(x=0.5, y=0.5), dist(x=1.0), ["k"]).first()
    assert [round(v, 6) for v in got] == [10.819778, 0.693147, 0.5, 0.215762]
    none = spark.createDataFrame([], "k string, p double")
    assert tuple(stats.degree_divergence(none, none, ["k"]).first()) == (1.0, 1.0, 0)


def test_links(spark):
    ends = spark.createDataFrame([(f"t{i}", "neutral") for i in range(5)], "id string, emotion string")
    entries = spark.createDataFrame([("e1", "neutral"), ("e2", "happy"), ("e3", "disgust"), ("e4", "odd")], "id string, emotion string")
    c = linking.link_candidates(ends, entries)
    assert {(r["entry"], r["score"]) for r in c.collect()} == {("e1", 1.0), ("e2", 0.8), ("e3", 0.5)}
    chosen = {r["terminus"]: r["entry"] for r in linking.chosen_links(c, most=2).collect()}
    assert [chosen[f"t{i}"] for i in range(5)] == ["e1", "e1", "e2", "e2", "e3"]


def test_chosen_links(spark, sf):
    """The query takes all termini: as one that gives each its best free entry, entry by entry, 20 at most."""
    d = sf.replace("sf0.001", "sf0.01")
    left, used, want = {}, {}, set()
    for r in registry.QUERIES["link_candidates"](spark, d).collect():
        left.setdefault(r["terminus"], []).append((-r["score"], r["entry"]))
    while left:
        best = {t: min(free) for t, c in left.items() if (free := [x for x in c if used.get(x[1], 0) < 20])}
        left = {t: left[t] for t in best}
        for t, (score, entry) in sorted(best.items(), key=lambda x: (x[1][0], x[0])):
            if used.get(entry, 0) < 20:
                used[entry] = used.get(entry, 0) + 1
                want.add((t, entry, -score))
                del left[t]
    assert {(r["terminus"], r["entry"], r["score"]) for r in registry.QUERIES["chosen_links"](spark, d).collect()} == want
    assert max(t for t, *_ in want) > "0000001000"


def test_compiled(spark):
    t = spark.createDataFrame([("r", "t", "completed", ["x", "y", "z"], ["Anger", "joyful"]), ("r", "u", "pending", ["x"], ["sad"])], "run_id string, ticket_id string, status string, texts array<string>, emotions array<string>")
    nodes, edges = linking.compiled(t, spark.createDataFrame([], "id string"))
    assert [(r["text"], r["emotion"]) for r in nodes.orderBy("beat_index").collect()] == [("x", "anger"), ("y", "happy")]
    assert [r["transition"] for r in edges.collect()] == ["anger->happy"]


def test_tickets(spark):
    rows = [(1, "p", 0, "create", None), (1, "p", 1, "submit", None), (2, "p", 0, "claim", None), (2, "p", 1, "submit", "error"), (3, "p", 0, "claim", None)]
    events = spark.createDataFrame(rows, "ticket_id long, stage string, pos long, kind string, outcome string")
    assert {r["ticket_id"]: r["status"] for r in tickets.states(events).collect()} == {1: "pending", 2: "failed", 3: "claimed"}


def test_filters(spark):
    prose = " ".join(["word"] * 20)
    rows = spark.createDataFrame([(1, prose, 5.0), (2, prose * 30, 5.0), (3, "as an ai " * 20, 5.0), (4, None, 5.0)], "id long, prose string, target double")
    got = {r["id"]: r["r"] for r in rows.select("id", filters.grade_reason(rows["prose"], rows["target"]).alias("r")).collect()}
    assert got[1] == "too_short" and got[2] == "too_long" and got[3] == "meta_commentary"
    texts = spark.createDataFrame([(1, "x" * 100 + "a"), (2, "x" * 100 + "b"), (3, "y")], "id long, t string")
    assert sorted(r["id"] for r in filters.prefix_distinct(texts, "t", "id").collect()) == [1, 3]


