import json
import struct
import zlib

from loomgraph.sources import binaries, corpus, sinks


def test_corpora(spark, tmp_path):
    line = {"form_id": "0x1", "text": "hi", "topic": "GREETING", "conditions": [{"type": 35, "function": 43, "value": 1.0}]}
    (tmp_path / "x_full_dialogue.json").write_text(json.dumps({"dialogue": [line, {"text": None}]}))
    (tmp_path / "x_dialogue.json").write_text(json.dumps({"dialogue": [line]}))
    rows = corpus.read_corpora(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["game"], r["pos"], r["emotion"], r["topic"]) for r in rows] == [("x", 0, "neutral", "GREETING"), ("x", 1, "neutral", "")]
    assert {r["file"]: r["records"] for r in corpus.discovered(spark, str(tmp_path)).collect()} == {"x_full_dialogue.json": 2, "x_dialogue.json": 1}


def test_graph(spark, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "a", "v": "1"}, {"id": "a", "v": "2"}, {"v": "3"}], "edges": [{"from": "a", "to": "2"}, {"source": "a", "target": "a", "type": "t"}]}))
    nodes, edges = corpus.read_graph(spark, str(tmp_path / "graph.json"))
    assert {r["id"]: r["fields"]["v"] for r in nodes.collect()} == {"a": "2", "2": "3"}
    assert sorted((r["src"], r["dst"], r["kind"]) for r in edges.collect()) == [("a", "2", "edge"), ("a", "a", "t")]


def test_tiers(spark, tmp_path):
    long = "x" * 60
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps({"tier": "fk_normed", "prose": long}), "{broken", json.dumps({"tier": "flattened", "text": "short"}), json.dumps({"tier": "flattened", "content": long})]))
    assert corpus.read_tiers(spark, str(tmp_path / "t.jsonl")).count() == 2
    assert corpus.read_tiers(spark, str(tmp_path / "t.jsonl"), "fk").count() == 1


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.csv").write_text("﻿rank,lemma,PoS,freq\n1,The,d,9\n2,run,v,8\n3,run,n,7\n4,x-y,n,6\n", encoding="utf-8")
    assert [(r["lemma"], r["pos"]) for r in corpus.read_vocabulary(spark, str(tmp_path / "v.csv")).collect()] == [("run", "v")]


def test_string_tables(spark, tmp_path):
    texts = b"one\0two\0"
    (tmp_path / "a.strings").write_bytes(struct.pack("<IIIIII", 2, len(texts), 7, 0, 8, 4) + texts)
    body = struct.pack("<I", 5) + b"long\0"
    (tmp_path / "a.dlstrings").write_bytes(struct.pack("<IIII", 1, len(body), 7, 0) + body)
    got = binaries.merged_strings(binaries.read_string_tables(spark, str(tmp_path)))
    assert {r["id"]: r["text"] for r in got.collect()} == {7: "one", 8: "two"}


def test_archives(spark, tmp_path):
    data, packed = b"hello", struct.pack("<I", 3) + zlib.compress(b"abc")
    folder = b"dir\0"
    head = 36
    records = head + 16
    block = records + 1 + len(folder) + 2 * 16
    names = b"x.txt\0y.txt\0"
    start = block + len(names)
    out = struct.pack("<4sIIIIIIIHH", b"BSA\0", 104, head, 3, 1, 2, len(folder), len(names), 0, 0) + struct.pack("<QII", 1, 2, records)
    out += bytes([len(folder)]) + folder + struct.pack("<QII", 1, len(data), start) + struct.pack("<QII", 2, len(packed) | 0x40000000, start + len(data)) + names + data + packed
    (tmp_path / "a.bsa").write_bytes(out)
    got = {r["path"]: bytes(r["content"]) for r in binaries.read_archives(spark, str(tmp_path), "TXT").collect()}
    assert got == {"dir/x.txt": b"hello", "dir/y.txt": b"abc"}


def test_sinks(spark):
    prose = spark.createDataFrame([("a", None, True), ("b", "too_short", False), ("c", "too_long", False)], "id string, reject_reason string, passed_filters boolean")
    assert {r["outcome"]: r["n"] for r in sinks.run_stats(prose).collect()} == {"passed": 1, "too": 2}
    nodes = spark.createDataFrame([(0, "a", 'say "x"'), (1, "b", None)], "pos long, id string, text string")
    edges = spark.createDataFrame([("a", "b", "topic_branch"), ("a", "z", "sequential")], "src string, dst string, kind string")
    text = sinks.dot(nodes, edges)
    assert '"a" -> "b" [style=dashed];' in text and '"z"' not in text
