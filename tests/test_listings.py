import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import listings
from loomgraph.sources import corpus


def nouns(text):
    """As a person would look for them: words of letters that do not begin a sentence."""
    found = set()
    for sentence in text.split(". "):
        for i, word in enumerate(sentence.split()):
            if i > 0 and word[0].isupper() and word.isalpha() and len(word) > 1:
                found.add(word)
    return sorted(found)


@pytest.mark.parametrize("text", ["The Bald King met Ana. Then Rex left", "A. B c. D", "", "  Über Älter Straße x1 O'Neil Ab", "end. New\nLine Word"])
def test_proper_nouns(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(listings.proper_nouns(F.col("text")).alias("n")).first()
    assert row["n"] == nouns(text)


def test_transitions(spark):
    rows = [(["a", "b"],), (["b", "a", "a"],), (["a"],), ([],), (None,), (["a", "c", "b"],)]
    df = spark.createDataFrame(rows, "e array<string>")
    got = [r["t"] for r in df.select(listings.has_transition(F.col("e"), "a", "b").alias("t")).collect()]
    assert got == [True, False, False, False, None, False]


def test_page_beyond_the_end(spark):
    rows = spark.range(7)
    assert [(r["id"], r["total"]) for r in listings.page(rows, ["id"], 5, 10).collect()] == [(5, 7), (6, 7)]
    assert listings.page(rows, ["id"], 50, 10).count() == 0


def test_top_share(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([9, 7, 7, 5, 1, 1, 1, 1, 1, 1])], "k int, n long")
    assert sorted(r["k"] for r in listings.top_share(df, "n", 0.1).collect()) == [0, 1, 2]
    assert listings.top_share(df.limit(0), "n", 0.1).count() == 0


def test_extension_sites(spark):
    sites = spark.createDataFrame([("a->b",), ("a → b",), ("a->x",), ("a",), (None,), ("a->b->c",)], "site string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(r["site"] for r in listings.extension_sites(sites, nodes).collect()) == sorted(["a->b", "a → b"])


def test_add_ons_are_united(spark, tmp_path):
    """All files of a game count, in order; a whole file stands for the plain one of its name."""
    line = lambda t: {"form_id": t, "text": t}
    for name, texts in (("x_dialogue.json", ["old"]), ("x_full_dialogue.json", ["m1", "m2"]), ("y_addon.json", ["d1"])):
        (tmp_path / name).write_text(json.dumps({"game": "g", "dialogue": [line(t) for t in texts]}))
    rows = corpus.read_corpora(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in rows] == [(0, "m1"), (1, "m2"), (2, "d1")]
