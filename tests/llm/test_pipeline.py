import corpus_pipeline
from loomgraph.llm.mixing import pfair_mix


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, names = docs.count(), list(docs.columns)
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert sorted(docs.columns) == sorted(names)
            texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(texts["near_duplicates"]) < len(texts["quality"]) < before
    assert texts["repeated_strings"].keys() == texts["near_duplicates"].keys() and texts["repeated_strings"] != texts["near_duplicates"]
    assert texts["mixed_sources"] == texts["repeated_strings"]
    assert {r["doc_id"] for r in docs.where("decodes").collect()} == texts["mixed_sources"].keys()


def test_queries():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_mix_outlives_the_last_stage(spark, sf, tmp_path):
    """The last stage's places give the order of the mix, and the order keeps to the targets."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = pfair_mix(docs.select(*corpus_pipeline.COLUMNS)).orderBy("mix_slot", "mix_place").select("doc_id").collect()
    corpus_pipeline.mixed_sources(spark, docs, sf).write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed")).repartition(3)
    got = corpus_pipeline.encoded(spark, again, sf).orderBy("mix_part", "mix_row").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixed]
    bare = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.placed(bare).first()["mix_row"] is None


def test_stages_take_nulls_and_nothing(spark, sf):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e f", None, None, 11), (2, "a b c d e f", None, None, 11), (3, "a b c d e f", "en", "s", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, sf), stage(spark, none, sf)
        assert none.count() == 0
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 2, 2]
