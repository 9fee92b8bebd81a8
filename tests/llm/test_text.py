import gzip
import hashlib
import io
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
import sentencepiece
import zstandard

from loomgraph.llm import kneser_ney as kn
from loomgraph.llm import merkle, page_text, quality_rules, sentencepieces, warc
from loomgraph.llm.mixing import pfair_mix, schedule, shares_of
from loomgraph.llm.quality_classifier import kept_documents, quality_classifier
from loomgraph.llm.shared import Tables

ODD = ["", "  lead", "a  b\n\tc ", "x y   z", "é ﬁ ½ 　z", "日本語 テスト", "😀 ok", "\n\n  \n x", " ", "x▁y", "▁", "ab▁ c", "\0 \0x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


# --- WARC ----------------------------------------------------------------------------------------


def test_warc(spark):
    long = "<p>é</p>" * 200
    rows = [(1, "http://a/1", long), (9, "http://a/2", long), (3, None, long), (4, "http://b\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (9, "http://a/2", long)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    n = len(long.encode())
    assert by == Counter({(1, "revisit", 9, n): 1, (3, "revisit", 9, n): 1, (None, "revisit", 9, n): 1, (9, "response", None, n): 2, (4, "response", None, 5): 1, (5, "response", None, 5): 1, (6, "response", None, 0): 1})
    assert all(r["payload_digest"] == hashlib.sha1((r["payload"] or "").encode()).hexdigest() for r in got if r["record_type"] == "response")
    assert not warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count()


def test_archives(spark, tmp_path):
    """A stream of one or more members is rewritten a member a record, and the index finds each."""
    whole = [warc.record(k, f"http://x/{k}", (f"<p>{k}</p>" * k * 500).encode(), None, False) for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(whole[:3])) + gzip.compress(b"".join(whole[3:])))
    members = warc.normalised(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string"), str(tmp_path / "out")).collect()
    data = open(members[0]["path"], "rb").read()
    assert members[0]["n"] == 5 and gzip.decompress(data) == b"".join(whole)
    import json

    for line, record in zip(open(members[0]["index"]), whole):
        e = json.loads(line)
        assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) == record
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[0][:-20]])))
    assert list(warc.inflated(io.BytesIO(b""))) == []
    assert pafs.FileSystem.from_uri(str(tmp_path))


# --- mixing ---------------------------------------------------------------------------------------


def test_pfair(spark):
    sizes = spark.createDataFrame([("=a", 900), ("=b", 300), ("=c", 37), ("null", 5)], "src string, n long")
    rows = schedule(shares_of(sizes, None)).collect()
    period = rows[0]["period"]
    assert sorted(r["pos"] for r in rows) == list(range(period))
    for src in {r["src"] for r in rows}:
        own = sorted(r["pos"] for r in rows if r["src"] == src)
        q = len(own)
        for t in range(period + 1):
            assert abs(sum(p < t for p in own) - t * q / period) < 1


def test_mix(spark):
    rows = [(k, f"t{k}", ["a", "a", "a", "b", None][k % 5]) for k in range(500)] + [(7, "t7", "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pfair_mix(docs, {"a": 3, "b": 1}, block=4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert max(Counter((r["mix_slot"], r["mix_place"]) for r in got).values()) == 1
    assert len({(r["mix_slot"], r["source"]) for r in got}) == len({r["mix_slot"] for r in got})
    assert not pfair_mix(docs.limit(0)).count()


def test_mix_keeps_to_given_weights(spark):
    """Over ten periods of weights that 1000 shares can't express, each source is less than a block off."""
    weights = {"a": 948, "b": 556, "c": 194, "d": 23}
    whole = sum(weights.values())
    sizes = spark.createDataFrame([(f"={s}", 10**6) for s in weights], "src string, n long")
    rows = schedule(shares_of(sizes, weights)).collect()
    assert sorted(r["pos"] for r in rows) == list(range(whole))
    order = [r["src"][1:] for r in sorted(rows, key=lambda r: r["pos"])] * 10
    had = dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert all(abs(had[k] * whole - t * w) < whole for k, w in weights.items())
    with pytest.raises(ValueError):
        shares_of(sizes, {"a": 10**7})


def test_mix_in_order_of_slots(spark):
    """The rows of the mix, taken in order, keep to the weights as long as they are balanced."""
    docs = spark.createDataFrame([(k, f"t{k}", "ab"[k % 3 == 0]) for k in range(600)], "doc_id long, text string, source string")
    rows = pfair_mix(docs, {"a": 5, "b": 3}, block=4).where("mix_balanced").orderBy("mix_slot", "mix_place").collect()
    assert len(rows) > 400
    for t in range(4, len(rows) + 1, 4):
        assert abs(sum(r["source"] == "a" for r in rows[:t]) - t * 5 / 8) < 4


def test_mix_keeps_clashing_columns(spark):
    names = ["rank", "Pos", "end", "period", "before", "rn", "row", "src", "cell", "cells", "hash", "own_q", "a.b"]
    rows = [(k, None if k % 7 == 0 else f"t{k}", "x", *(f"{n}{k}" for n in names)) for k in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = pfair_mix(docs)
    assert got.columns[:-4] == docs.columns
    assert sorted(tuple(r)[:-4] for r in got.collect()) == sorted(rows)


# --- pieces ---------------------------------------------------------------------------------------


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces(spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(200).collect()]
    rows = np.arange(len(texts), dtype=np.uint64)
    vocab = sentencepieces.vocabulary(sentencepieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    plain = split(*sentencepieces.Encoder(*vocab, 0.0, 1).encode(texts, rows))
    assert [a == library.encode(t) for a, t in zip(plain, texts) if "▁" not in t] == [True] * sum("▁" not in t for t in texts)
    one, same, two = (sentencepieces.Encoder(*vocab, 0.2, seed) for seed in (1, 1, 2))
    dropped = split(*one.encode(texts, rows))
    assert dropped == split(*same.encode(texts, rows)) and dropped != split(*two.encode(texts, rows))
    assert sum(map(len, dropped)) > sum(map(len, plain))
    assert [one.decode(i) for i in dropped] == [f" {t}".encode() if t else b"" for t in texts]


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> shift) * factor % 2**64
    return x


def plain_pieces(text, row, pieces, scores, byte_ids, rate, seed):
    """The agenda of each chunk walked over plain lists, one candidate at a time."""
    golden, other = 0x9E3779B97F4A7C15, 0x94D049BB133111EB
    ids = {p: i for i, p in enumerate(pieces) if p and i not in byte_ids}
    text, out = (" " + text if text else ""), []
    for m in re.finditer("\n|\u2581| *[^ \n\u2581]+| +", text):
        s = [c if c != " " else "\u2581" for c in m[0]]
        literal = m[0] == "\u2581"
        draw = mixed((mixed((row + mixed(seed * golden % 2**64)) % 2**64) + m.start() * golden) % 2**64)
        gap = lambda turn: int(math.log(((mixed((draw + turn * other) % 2**64) if turn else draw) // 2048 + 1) / 2**53) / math.log1p(-rate))
        passed, seen, turn, skip = [False] * len(s), 0, 0, gap(0)
        while not literal:
            open_ = [(-scores[ids[s[k] + s[k + 1]]], k) for k in range(len(s) - 1) if not passed[k] and s[k] in ids and s[k + 1] in ids and s[k] + s[k + 1] in ids]
            if not open_:
                break
            k = min(open_)[1]
            if seen == skip:
                passed[k], turn = True, turn + 1
                skip += 1 + gap(turn)
            else:
                s[k : k + 2] = [s[k] + s[k + 1]]
                del passed[k]
                passed[k] = False
                if k:
                    passed[k - 1] = False
            seen += 1
        for x in s:
            out += [ids[x]] if x in ids and not literal else [byte_ids[b] for b in x.encode()]
    return out


@pytest.mark.parametrize(("rate", "wide", "lot"), [(0.1, 48, 1 << 20), (0.4, 4, 50), (0.9, 48, 7)])
def test_dropout_is_a_draw_for_each_occurrence(monkeypatch, rate, wide, lot):
    monkeypatch.setattr(sentencepieces, "WIDE", wide)
    monkeypatch.setattr(sentencepieces, "LOT", lot)
    rng = random.Random(3)
    words = ["the", "nation", "information", "tables", "x" * 9, "übergänge", "日本語", "\n", "", "misunderstandings"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(25)] + [" ".join(["information"] * 60)]
    rows = [rng.randrange(2**64) for _ in texts]
    vocab = sentencepieces.vocabulary(sentencepieces.MODEL)
    got = split(*sentencepieces.Encoder(*vocab, rate, 5).encode(texts, np.array(rows, np.uint64)))
    assert got == [plain_pieces(t, r, *vocab, rate, 5) for t, r in zip(texts, rows)]


def test_a_word_of_a_million_letters():
    """Without a space, and with the memory of its length only."""
    rng, vocab = random.Random(1), sentencepieces.vocabulary(sentencepieces.MODEL)
    text = "".join(rng.choice("etaoin") for _ in range(1_000_000))
    encoder = sentencepieces.Encoder(*vocab, 0.1, 1)
    tracemalloc.start()
    ids, counts = encoder.encode([text, "a b"], np.arange(2, dtype=np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert encoder.decode(ids[: counts[0]]).decode() == " " + text and peak < 500e6


def test_pieces_frame(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    got = sentencepieces.sentencepiece_encode(docs, ["doc_id"]).orderBy("doc_id").collect()
    assert got[0] == got[1] and got[2]["ids"] is None and list(got[3]["ids"]) == [] and got[0]["decodes"]
    assert not sentencepieces.sentencepiece_encode(docs.limit(0), ["doc_id"]).count()


# --- language models ---------------------------------------------------------------------------------


def plain_model(texts):
    """Interpolated modified Kneser-Ney over dictionaries: the bits of a text."""
    fold = lambda t: [kn.START] * 3 + ["0" if c in "0123456789" else c if c < "\U00010000" else ord(c) >> 10 for c in t]
    counts = [None, None, None, None, Counter()]
    for t in texts:
        s = fold(t)
        counts[4].update(tuple(s[k - 3 : k + 1]) for k in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = [None]
    for n in range(1, 5):
        r = [0] + [sum(c == k for c in counts[n].values()) for k in range(1, 5)]
        d = [0, 0.5, 0.5, 0.5]
        if r[1] and r[2]:
            y = r[1] / (r[1] + 2 * r[2])
            d = [0] + [min(k, max(0.1, k - (k + 1) * y * r[k + 1] / r[k])) if r[k] else 0.5 for k in (1, 2, 3)]
        total, freed = defaultdict(int), defaultdict(float)
        for g, c in counts[n].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3)]
        tables.append((d, total, freed))

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(counts[1]) + 1)
        d, total, freed = tables[n]
        ctx, k = gram[:-1], counts[n][gram]
        if not total[ctx]:
            return p(gram[1:])
        return (k - d[min(k, 3)]) / total[ctx] + freed[ctx] / total[ctx] * p(gram[1:])

    def bits(t):
        s = fold(t)
        return -sum(math.log2(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s)))

    return bits


def plain_quantile(scores, q):
    """In thousandths, as the cells have it."""
    cells = sorted(math.floor(x * 1000 + 0.5) for x in scores)
    return next(c for k, c in enumerate(cells, 1) if k >= len(cells) * q) / 1000


def prose(rng, n):
    return [" ".join("".join(rng.choice(["th", "e", "an", "d ", "ou", "r", "é", "1"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))) for _ in range(n)]


@pytest.mark.parametrize(("table", "spread", "held"), [(1 << 26, 512, 2_000_000), (4, 1, 300)])
def test_kneser_ney(spark, monkeypatch, table, spread, held):
    """Bits of texts come out as from dictionaries, whatever the sizes of tables, blocks and lots."""
    for name, value in (("TABLE", table), ("SPREAD", spread), ("HELD", held), ("BLOCK", 4_000_000 if table > 4 else 900)):
        monkeypatch.setattr(kn, name, value)
    rng = random.Random(4)
    texts = prose(rng, 40) + ["日本語 テスト 😀😁", "привет мир"]
    probes = [texts[0], "abzz!q", "A á #9", "слово", "😀😂日", "x", *prose(rng, 30)]
    docs = spark.createDataFrame([("x", t) for t in texts] + [("y", None), (None, "zz")], "lang string, text string")
    asked = spark.createDataFrame([(k, "x", t, k) for k, t in enumerate(probes)] + [(900, None, "zz", 1), (901, "x", None, 1), (902, "y", "zz", 1)], "doc_id long, lang string, text string, bits int")
    packed = docs.rdd.map(lambda r: ("null" if r["lang"] is None else "=" + r["lang"], None if r["text"] is None else kn.zipped(np.frombuffer(r["text"].encode(), np.uint8)))).toDF("lang string, pack binary")
    models = kn.modelled(Tables(spark), packed)
    got = {r["own"]["doc_id"]: r for r in kn.scored(asked, models, ["doc_id", "bits", "text"]).collect()}
    bits = plain_model(texts)
    for k, t in enumerate(probes):
        assert got[k]["bits"] == pytest.approx(bits(t), rel=1e-5) and got[k]["symbols"] == len(t) and got[k]["own"]["text"] == t and got[k]["own"]["bits"] == k
    assert got[900]["bits"] == pytest.approx(plain_model(["zz"])("zz"), rel=1e-5) and got[901]["bits"] is None and got[902]["bits"] is None


def test_classifier_against_dictionaries(spark):
    """kept and threshold as from a plain model and sorted scores."""
    rng = random.Random(9)
    texts = prose(rng, 120) + ["#x** " * 30, "thethethe " * 40, "QQ", "x"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier(docs, labels, outside=0.05).collect()}
    h = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    fit = sorted(range(100), key=h.get)[:50]
    bits = plain_model([texts[k] for k in fit])
    rest = [k for k in range(100) if k not in fit]
    mean = sum(bits(texts[k]) for k in rest) / sum(len(texts[k]) for k in rest)
    score = [(bits(t) + mean * kn.PRIOR) / (len(t) + kn.PRIOR) for t in texts]
    limit = lambda of, q: 1.5 * plain_quantile([score[k] for k in of], q) - 0.5 * plain_quantile([score[k] for k in of], 0.5)
    low, high = limit(range(100), 0.05), limit(rest, 0.95)
    assert {k: r["kept"] for k, r in got.items()} == {k: low <= x <= high for k, x in enumerate(score)}
    assert all(r["threshold"] == pytest.approx(2**high) and r["perplexity"] == pytest.approx(2 ** score[k], rel=1e-5) for k, r in got.items())
    assert not got[120]["kept"]


def test_rules_against_dictionaries(spark):
    rng = random.Random(10)
    texts = [t for t in prose(rng, 90) if len(t.split()) > 3] + ["Q#* " * 3 + "xz kq jv " * 4, "кириллица " * 2 + "и ещё слова того же языка вот так", "a b", "w " * 30]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    counts = quality_rules.text_counts(texts)
    failed = [c[0] < 10 or 100 * c[4] > 20 * c[0] for c in counts]
    plain = [k for k, c in enumerate(counts) if not failed[k] and 100 * c[2] <= 2 * c[1]]
    bits = plain_model([texts[k] for k in plain])
    mean = sum(bits(texts[k]) for k in plain) / sum(len(texts[k]) for k in plain)
    score = [(bits(t) + mean * kn.PRIOR) / (len(t) + kn.PRIOR) for t in texts]
    q10, q50, q90 = (plain_quantile([score[k] for k in plain], q) for q in (0.1, 0.5, 0.9))
    low, high = q50 + quality_rules.WIDTH * (q10 - q50), q50 + quality_rules.WIDTH * (q90 - q50)
    assert {k: r["kept"] for k, r in got.items()} == {k: not failed[k] and low <= x <= high for k, x in enumerate(score)}
    assert len(plain) > 20 and any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_kept_documents(spark):
    """As the classifier says, with columns of any name, repeated rows and two texts of one id."""
    rng = random.Random(12)
    rows = [(k % 55, t, "en", f"g{k}", k) for k, t in enumerate(prose(rng, 60) + ["#x** " * 30, None, "#x** " * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gone_id string, kept int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10, 55)], "doc_id long, quality int, toxic int")
    good = {tuple(r)[:2] for r in quality_classifier(docs, labels).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "kept").where("kept").collect()}
    got = sorted(tuple(r)[4] for r in kept_documents(docs, labels).collect())
    assert set(range(63)) - set(got) >= {60, 62} and 61 in got and all(tuple(rows[k])[:2] in good for k in got)


def test_scripts_stay_apart(spark):
    """Letters in another order are junk in every script."""
    rng = random.Random(11)
    rows = []
    for lang, word in (("ru", ["слово", "дело", "человек", "время"]), ("el", ["λόγος", "άνθρωπος", "ώρα"]), ("zh", ["你好", "世界", "中文", "文字"])):
        rows += [(len(rows) + k, " ".join(rng.choice(word) for _ in range(40)), lang, 1) for k in range(60)]
        for k in range(5):
            letters = list("".join(rng.choice(word) for _ in range(60)))
            rng.shuffle(letters)
            rows.append((len(rows), " ".join("".join(letters[j : j + 4]) for j in range(0, len(letters), 4)), lang, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good int")
    labels = docs.where("good = 1").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier(docs, labels, outside=0.0).collect()}
    assert not any(got[k] for k, *_, good in rows if not good) and sum(got[k] for k, *_, good in rows if good) >= 170


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["the", "and", "there", "then", "that"]) for _ in range(60))
    bad = lambda: " ".join("#" + rng.choice(["xq", "zzk", "qqv"]) + "**" for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good(), "en") for i in range(300)] + [(900, None, "en"), (901, "x", None), (902, "", "de"), (None, good(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier(docs, labels).collect()}
    assert all(got[i] == (i % 5 != 0) for i in range(200, 300)) and got[900] and got[901] and got[902] and got[None]
    assert quality_classifier(docs, labels.limit(0)).where("kept").count() == len(rows)
    assert not quality_classifier(docs.limit(0), labels).count()


def test_classifier_languages(spark):
    """A language with a tiny share of the labels is fitted and judged too; the quantiles are of all rows not fitted."""
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "and", "there", "then", "that"]) for _ in range(60))
    rows = [(i, good(), "xx" if i % 100 == 7 else "en") for i in range(1000)] + [(k, "#xq** zzk qqv " * 20, "xx" if k % 2 else "en") for k in (2000, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_classifier(docs, labels).collect()}
    assert all(r["perplexity"] and r["threshold"] for r in got.values()) and not got[2000]["kept"] and not got[2001]["kept"]


def test_bands(spark, sf):
    """Junk of a few common words has a low perplexity: both queries reject it, and the classifier keeps trusted text."""
    d = sf.replace("sf0.001", "sf0.01")
    rng = random.Random(3)
    junk = [(10**9, "en", "the " * 300)] + [(10**9 + k, "en", " ".join(rng.choice(["the", "and", "that", "this", "then"]) for _ in range(60))) for k in (1, 2)]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text").unionByName(spark.createDataFrame(junk, "doc_id long, lang string, text string"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier(docs, labels).collect()}
    assert not any(got[i] for i, *_ in junk)
    good = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()} - {r["doc_id"] for r in labels.where("quality = 0 OR toxic = 1").collect()}
    good &= got.keys()
    assert sum(got[i] for i in good) > 0.95 * len(good)
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert not any(rules[i]["kept"] for i, *_ in junk) and not rules[10**9 + 1]["base_failed"]


def test_counts(spark):
    def plain(t):
        t = t or ""
        words = t.encode().split()
        again = [False] * len(words)
        seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        for k in range(len(words) - 4):
            if seen[tuple(words[k : k + 5])] > 1:
                again[k : k + 5] = [True] * 5
        lines = [x for x in t.split("\n") if x.encode().split()]
        return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(again)]

    texts = [None, *ODD, "a b c d e " * 5, "x\nx\n\ny\nx", "é# b|c", "w " * 30]
    assert quality_rules.text_counts(texts) == [plain(t) for t in texts]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(rows) == len(texts) and not any(r["kept"] for r in rows.values() if r["base_failed"])
    assert not quality_rules.quality_rules(docs.limit(0)).count()


# --- pages and fingerprints ------------------------------------------------------------------------------


def test_lines():
    html = """<!DOCTYPE html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>
      <article><header><h1>A &amp; B</h1></header><p>One<b> two</b>&nbsp;<br>three<p>Four</p><aside>No</aside><form>No</form><section id="comments"><p>No</p></section></article><footer>No</footer>"""
    assert page_text.lines_of(html) == [(1, "A & B"), (1, "One two three"), (1, "Four")]
    assert page_text.lines_of("<p>a < b</p><p>c") == [(0, "a < b"), (0, "c")] and page_text.lines_of(None) == []


def test_common():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(page_text.common_lines(a, b))
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(a[k] in it for k in got)


def test_common_of_many_equal_lines(monkeypatch):
    """Pages of equal lines take no square of steps; split tables give rows of the same length."""
    assert page_text.common_lines(["x", *["same"] * 30_000, "y"], ["z", *["same"] * 29_000, "w"]).issuperset(range(5000, 9000))
    rng = random.Random(8)
    for _ in range(30):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 40))] for _ in range(2))
        whole = page_text.common_lines(a, b)
        with monkeypatch.context() as m:
            m.setattr(page_text, "ALIGNED", 9)
            parts = page_text.common_lines(a, b)
        it = iter(b)
        assert len(parts) == len(whole) and all(a[k] in it for k in sorted(parts))


def test_short_article_in_a_long_template(spark):
    """A template of most of a page's characters is deleted all the same; a copy deletes nothing."""
    page = lambda own: f"<div>{'menu ' * 80}</div><p>{own}</p><div>{'contact ' * 80}</div>"
    rows = [(k, f"http://h.x/{k}", page(f"own {k}")) for k in range(5)] + [(9, "http://h.x/4", page("own 4")), (20, "http://i.x/a", page("twin")), (21, "http://i.x/b", page("twin"))]
    got = {r["page_id"]: r["text"] for r in page_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"own {k}" for k in range(5)) and "twin" in got[20] and "menu" in got[20]


def test_article_is_differenced_too():
    """Own lines beside an article are text and the template's are not; shared lines of the article stay."""
    page = lambda k: [(0, "contact us"), (1, "shared passage"), (1, f"own {k}"), (0, f"end of story {k}"), (0, "all rights")]
    assert page_text.text_of(page(1), [("/a/0", page(0)), ("/a/2", page(2))], "/a/1") == "shared passage\n\nown 1\n\nend of story 1"
    assert page_text.text_of(page(1), [("/a/0", page(1)), None], "/a/1") == "shared passage\n\nown 1"


@pytest.mark.parametrize("part_bytes", [1 << 20, 800])
def test_pages(spark, part_bytes):
    page = lambda own: f"<div>menu item</div><p>{own}</p><div>contact us</div>"
    rows = [(k, f"http://h{k % 3}.x/en/{k:03d}", page(f"own text of page {k} " * 5)) for k in range(40)] + [(90, None, None), (91, "http://[bad", page("x")), (None, "http://h9.x/en/000", "<article>main</article>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_text.page_text(docs, part_bytes).collect()}
    assert len(got) == len(rows) and all(got[k]["text"] == " ".join(f"own text of page {k} ".split() * 5) for k in range(40))
    assert got[90]["text"] == "" and got[None]["text"] == "main" and got[1]["n_chars"] == len(got[1]["text"])
    assert not page_text.page_text(docs.limit(0)).count()


def test_pages_are_walked_once(spark):
    """One reading and one walk: no step goes over all pages again to put the ends of ranges together."""
    docs = spark.createDataFrame([(k, f"http://h.x/{k:03d}", f"<p>own {k}</p><p>contact</p>") for k in range(40)], "page_id long, url string, html string")
    plan = page_text.page_text(docs, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan and "Window" not in plan


def test_bounds_take_a_sample_of_each_task(spark, monkeypatch):
    """The rows that come to the driver for the bounds do not grow with the tasks."""
    sent, kind = [], type(spark.range(0))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sent.append((self._jdf.queryExecution().executedPlan().toString(), collect(self))) or sent[-1][1])
    pages = spark.range(20_000, numPartitions=8).selectExpr("id AS page_id", "concat('http://h.x/', lpad(id, 6, '0')) AS url", "'' AS html")
    bounds = page_text.bounds_of(pages, 10)
    plan, rows = sent[-1]
    assert "TakeOrdered" not in plan and 100 <= len(rows) <= 300
    assert len(bounds) == 9 and bounds == sorted(bounds) and page_text.bounds_of(pages.limit(0), 10) == page_text.bounds_of(pages, 1) == []


@pytest.mark.parametrize("part_bytes", [1 << 20, 600, 60])
def test_ends_of_ranges(spark, part_bytes):
    """Ranges of any size give each page the neighbours that it has in the whole order, with equal paths, ids and pages among them."""
    rng = random.Random(4)
    page = lambda k: "".join(f"<p>{x}</p>" for x in ["menu", *rng.sample([f"part {j}" for j in range(6)], 3), f"own {k}", "contact"])
    rows = [(rng.choice([k, k, k // 7, None]), rng.choice([None, "http://[bad", *(f"http://h{k % 4}.x/{'en/' * (k % 3)}{k % 11}" for _ in range(6))]), rng.choice([page(k), page(k % 5), None])) for k in range(120)]
    rows += rows[:9]
    squeeze = zstandard.ZstdCompressor(level=3).compress
    keyed = [((*page_text.order_of(*page_text.place_of(u), i), page_text.pack(page_text.lines_of(h), squeeze)), i, u, page_text.lines_of(h)) for i, u, h in rows]
    read = sorted(keyed, key=lambda r: r[0])
    near = lambda k, j: (read[j][0][1], read[j][3]) if 0 <= j < len(read) and read[j][0][0] == read[k][0][0] else None
    want = Counter((i, u, page_text.text_of(lines, [near(k, k - 1), near(k, k + 1)], key[1])) for k, (key, i, u, lines) in enumerate(read))
    got = page_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), part_bytes).collect()
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got) == want


def test_merkle_reuses_paragraphs(monkeypatch):
    """An edited text costs only its cut paragraphs, and has the fingerprint that it has by itself."""
    a, b = "".join(f"Line {k} of a.\n\n" for k in range(20)), "".join(f"Line {k} of b!\n" for k in range(40))
    ours, theirs = {}, {}
    prints = merkle.fingerprint(a, ours), merkle.fingerprint(b, theirs)
    edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    whole, made = merkle.fingerprint(edited), []
    pieces = merkle.pieces_of
    monkeypatch.setattr(merkle, "pieces_of", lambda line: made.append(line) or pieces(line))
    row = merkle.compared(1, a, prints[0], ours, b, prints[1], theirs)
    assert row[4] == whole and len(made) <= 2
    assert row[5] == merkle.likeness(prints[0], whole) and row[6] == merkle.likeness(*prints)


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_merkle(spark, part_bytes):
    rows = [(k * 3 % 31, f"Text {k}. More é of it.\nLine {k}\n\nNext section, line {k}.") for k in range(31)] + [(100, None), (101, ""), (None, "last"), (5, "same id")]
    got = merkle.merkle_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, ep, np_ = (merkle.fingerprint(x) for x in (t, edited, after))
        want.append((i is None, i or 0, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, ep, merkle.likeness(own, ep), merkle.likeness(own, np_)))
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == sorted(want)
    lone = merkle.merkle_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and lone["near_next"] == 1.0
    assert not merkle.merkle_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count()


def test_branches():
    a = "One. Two. Three.\nSecond line here.\n\nThird section."
    b = a.replace("Second", "Other")
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert x.split("|")[0] != y.split("|")[0] and merkle.fingerprint(a) == x and merkle.likeness(x, x) == 1.0
    assert 0.5 < merkle.likeness(x, y) < 1 and merkle.edits(x, y) == [1]


def test_lengths():
    """Likeness does not depend on how long texts are: near copies, and halves whose edited text is short."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdef ") for _ in range(916))
    for n in (100, 511, 513, 900):
        assert merkle.likeness(merkle.fingerprint(text[:n]), merkle.fingerprint(text[: n + 2])) > 0.85
    edited = text[:458] + "A short one."
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(edited)) == pytest.approx(2 * 456 / (916 + 470), abs=0.02)
