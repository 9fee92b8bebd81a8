import hashlib
import random
import re

import pytest

from loomgraph.llm import near_dedup
from loomgraph.llm.near_dedup import minhash_near_dedup, one_of_each
from loomgraph.llm.substring_dedup import shard, substring_dedup
from loomgraph.llm.suffix_dedup import suffix_array_dedup

SCHEMA = "doc_id long, text string, block int, token string, label long, cid long"


def corpus(seed=1, n=60):
    """Invented documents with copies, near copies, shared passages and odd cases; columns whose names clash."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ré", "no", "li", "mu", "sé", "ko"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = rng.choice(docs)
        elif docs and kind < 0.4:
            words = (rng.choice(docs) or "x").split()
            if words:
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(rng.randint(1, 120)))
            if kind > 0.8:
                text += "\n" + passage + " " + word()
        docs.append(text)
    docs += [None, "", "   \n", "x", "aaaa " * 60, "aaaa " * 60, "a" * 300, "a" * 120, docs[0]]
    return [(i, t) for i, t in enumerate(docs)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "t", 2, 3) for i, t in rows], SCHEMA)


def uncovered(rows, width, tokens_of):
    """(id, tokens, covered) by comparing every window with all earlier ones."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        tokens = tokens_of(t or "")
        for p in range(len(tokens) - width + 1):
            first.setdefault(tuple(tokens[p : p + width]), i)
    out = []
    for i, t in rows:
        tokens = tokens_of(t or "")
        gone = [False] * len(tokens)
        for p in range(len(tokens) - width + 1):
            f = first[tuple(tokens[p : p + width])]
            if f is not None and (i is None or f < i):
                gone[p : p + width] = [True] * width
        out.append((i, tokens, gone))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_suffix(spark, block_bytes):
    rows = corpus() + [(3, "other text for a repeated id " * 4), (None, corpus()[0][1])]
    got = suffix_array_dedup(frame(spark, rows), keep_text=True, block_bytes=block_bytes).collect()
    want = []
    for i, data, gone in uncovered(rows, 50, lambda t: list(t.encode())):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want.append((i is None, i or 0, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert all(r["kept_text"] is not None or r["n_bytes"] == 0 for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_substring(spark, block_bytes):
    rows = corpus(2) + [(3, "other text for a repeated id " * 4), (None, corpus(2)[0][1])]
    got = substring_dedup(frame(spark, rows), block_bytes=block_bytes).collect()
    want = []
    for i, words, gone in uncovered(rows, 13, lambda t: t.encode().split()):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want.append((i is None, i or 0, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_substring_first(spark):
    """A passage in mid-text and at text ends, over several blocks: some documents know a later first one than others."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(30))
    some = lambda: " ".join(word() for _ in range(20))
    rows = [(i, f"{some()} {passage}" + (f" {some()}" if i < 12 else "")) for i in range(40)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(spark, rows), block_bytes=3000).collect()}
    assert got == {i: sum(gone) for i, _, gone in uncovered(rows, 13, str.split)}
    words = passage.split()
    for order in ([1, 5], [5, 1]):
        assert [v for _, v in shard([(words, [(0, 30, after)]) for after in order]).iter(f" {passage} ")] == [(30, 1)]


def similar(rows, size, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, size):
    rows = corpus(3, 90) + [(500, "One two THREE"), (501, "one TWO three")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_near_dedup(frame(spark, rows), size=size).collect()}
    assert got == similar(rows, size)


def family(seed: int, n: int) -> list[tuple[int, str]]:
    """Variants of one text, most of them too far from one another to be linked."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 5, 8])):
            words[k] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_family(spark):
    rows = family(5, 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_near_dedup(frame(spark, rows), size=2).collect()}
    assert got == similar(rows, 2)


def test_one_of_each(spark):
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (1, "a b c d e f")]
    kept = one_of_each(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(1, "a b c d e f"), (1, "a b c d e f"), (3, ""), (4, "")]


def test_empty(spark):
    none = frame(spark, [])
    assert not suffix_array_dedup(none).count() and not substring_dedup(none).count() and not minhash_near_dedup(none).count()


def test_near_blocks(spark, monkeypatch):
    """Lists and centres in many blocks give the links that one block gives."""
    rows = family(7, 150)
    want = similar(rows, 2)
    for size in (100_000, 40, 7):
        monkeypatch.setattr(near_dedup, "LIST", size)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_near_dedup(frame(spark, rows), size=2).collect()}
        assert got == want


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c", "x", 1), (2, "a b c", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, Gone_Hash int")
    assert [tuple(r) for r in one_of_each(docs).collect()] == rows[:1]
