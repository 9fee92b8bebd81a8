"""Repeated spans of tokens between documents: exact, in rounds over positions whose prefix repeats.

A *token* is a byte or a word, given as a 64-bit value. A window is ``width`` consecutive tokens of
one document. A window is *repeated* when its token sequence also starts in a document with a
smaller id. The work goes in rounds, as in prefix doubling with discarding: positions are ranked by
a short prefix, positions whose rank is unique are dropped, and only the others are ranked by a
longer prefix, until the prefix is as long as the window.

Round 1 ranks sampled positions only. Every window holds one *anchor*: the position of its smallest
``gram``-token prefix hash. Equal windows have equal anchors at equal places, so that a window whose
anchor rank occurs in one document only cannot repeat. Each anchor stands for a run of windows,
its *context*. Pairs (anchor rank, context rank) are sorted; equal pairs repeat in whole.
Round 2 ranks the single windows of contexts whose anchor repeats in another context.

All exchanges carry packed arrays: one row for each block of documents and each bucket of ranks.
In a block, equal ranks meet before they are sent, so that a passage that all documents share costs
one entry a block. Text moves once: the plan uses the exchange by block three times.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import GOLDEN, MIX_A, mix64, parts_for, text_bytes, tidy_group, tidy_pair

#: Base of the rolling hash: odd, so that it has an inverse modulo 2**64 (fixed values).
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Characters of text that are ranked at a time.
CHUNK = 1 << 18
LAST_ID = np.iinfo(np.int64).max
RANKS = "bucket int, block int, kind int, a binary, c binary, d binary"
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Runs:
    """Anchors of some documents laid end to end: the windows first..last belong to one anchor.

    tokens: 64-bit values; ends: where each document ends.
    """

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, width: int, gram: int):
        n = len(tokens)
        self.width, self.n = width, n
        up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * up[:n], out=self.sums[1:])
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        if n < width:
            return
        grams = self.sums[gram:] - self.sums[: n + 1 - gram]
        grams *= down[: len(grams)]
        grams ^= grams >> np.uint64(32)
        grams *= MIX_A
        grams ^= grams >> np.uint64(29)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, size = width - gram + 1, 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        inside = np.ones(len(at), bool)
        for end in ends.tolist():
            inside[max(0, end - width + 1) : end] = False
        starts = np.concatenate(([0], ends[:-1]))
        for start, end in zip(starts.tolist(), ends.tolist()):
            if end - start >= width:
                inside[start : end - width + 1] = True
        cut = np.ones(len(at) + 1, bool)
        cut[1:-1] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(cut)
        first, last = edges[:-1], edges[1:] - 1
        good = inside[first]
        self.first, self.last = first[good], last[good]
        self.anchor = at[self.first].astype(np.int64)
        self.gram = grams[self.anchor]
        self.ends = ends

    def doc(self) -> np.ndarray:
        """The number of the document of each run."""
        return np.searchsorted(self.ends, self.first, side="right")

    def context(self) -> np.ndarray:
        """The rank of each run's context: a hash of its tokens and where its anchor stands in it."""
        _, down = powers(self.n + 1)
        out = (self.sums[self.last + self.width] - self.sums[self.first]) * down[self.first]
        out += (self.anchor - self.first).astype(np.uint64) * GOLDEN
        out += (self.last - self.first).astype(np.uint64) * MIX_A
        return mix64(out)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of some runs, and each one's run."""
        sizes = self.last[which] - self.first[which] + 1
        run = np.repeat(which, sizes)
        step = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.first[run] + step, run

    def ranks(self, start: np.ndarray) -> np.ndarray:
        """The rank of each window: a hash of its tokens."""
        _, down = powers(self.n + 1)
        return mix64((self.sums[start + self.width] - self.sums[start]) * down[start])


def chunks(ids: np.ndarray, texts: list, tokens_of: Callable[[list], list[np.ndarray]]):
    """Documents in lots of about CHUNK characters: (ids, tokens, ends)."""
    begin = 0
    while begin < len(ids):
        size, stop = 0, begin
        while stop < len(ids) and (stop == begin or size + len(texts[stop] or "") <= CHUNK):
            size += len(texts[stop] or "")
            stop += 1
        lot = tokens_of(texts[begin:stop])
        yield ids[begin:stop], np.concatenate(lot), np.cumsum([len(x) for x in lot])
        begin = stop


def ids_of(table: pa.Table) -> np.ndarray:
    """The documents' ids; a missing id counts as larger than all others."""
    return table.column("doc_id").cast(pa.int64()).fill_null(LAST_ID - 1).to_numpy()


def firsts(a: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of equal pairs (a, c), the place of the one with the smallest d."""
    order = np.lexsort((d, c, a))
    a, c = a[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return np.sort(order[new])


def packed(block: int, kind: int, bucket: np.ndarray, a: np.ndarray, c: np.ndarray, d: np.ndarray) -> pa.Table:
    """One row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, a, c, d = bucket[order], a[order], c[order], d[order]
    names, starts = np.unique(bucket, return_index=True)
    stops = np.append(starts[1:], len(bucket))
    cols = [[x[i:j].tobytes() for i, j in zip(starts, stops)] for x in (a, c, d)]
    return rows(names, np.full(len(names), block), np.full(len(names), kind), *cols)


def rows(bucket, block, kind, a, c, d) -> pa.Table:
    return pa.table(
        [pa.array(bucket, pa.int32()), pa.array(block, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, c, d))],
        ["bucket", "block", "kind", "a", "c", "d"],
    )


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Blocks, ranks a and c and documents d of packed rows."""
    got = table.to_pylist()
    a, c, d = (np.frombuffer(b"".join(r[k] for r in got), t) for k, t in (("a", np.uint32), ("c", np.uint64), ("d", np.int64)))
    return np.repeat(np.array([r["block"] for r in got], np.int32), [len(r["a"]) // 4 for r in got]), a, c, d


def sent_back(bucket: int, kinds: np.ndarray, block: np.ndarray, c: np.ndarray, d: np.ndarray) -> pa.Table:
    """One row for each block and kind, in the order of documents, which packs well."""
    order = np.lexsort((d, kinds, block))
    kinds, block, c, d = kinds[order], block[order], c[order], d[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (kinds[1:] != kinds[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(block))
    cols = [[x[i:j].tobytes() for i, j in zip(starts, stops)] for x in (c, d)]
    return rows(np.full(len(starts), bucket), block[starts], kinds[starts], [b""] * len(starts), *cols)


#: What a rank's bucket tells a block.
WHOLE, SPLIT, SINGLE = 0, 1, 2


def judged(table: pa.Table, single: bool) -> pa.Table:
    """Sort the rank pairs of one bucket; tell each block the ranks that repeat.

    WHOLE: (a, c) starts first in document d. SPLIT: c is the first of several contexts of anchor a
    and its windows must be ranked one by one. SINGLE: as WHOLE, for windows.
    """
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    block, a, c, d = unpacked(table)
    order = np.lexsort((block, d, c, a))
    block, a, c, d = block[order], a[order], c[order], d[order]
    n = len(a)
    new_a = np.ones(n, bool)
    new_a[1:] = a[1:] != a[:-1]
    new = new_a.copy()
    new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    size = np.diff(np.append(starts, n))
    often = size[group] > 1
    out = [(np.full(int(often.sum()), SINGLE if single else WHOLE), block[often], c[often], d[starts][group[often]])]
    if not single and n:
        a_group = np.cumsum(new_a) - 1
        a_starts = np.flatnonzero(new_a)
        contexts = np.bincount(a_group[starts], minlength=len(a_starts))
        mixed = (np.minimum.reduceat(d, a_starts) != np.maximum.reduceat(d, a_starts)) & (contexts > 1)
        at = starts[mixed[a_group[starts]]]
        out.append((np.full(len(at), SPLIT), block[at], c[at], d[at]))
    return sent_back(bucket, *(np.concatenate(x) for x in zip(*out)))


class Marks:
    """What a block has been told of one kind, to be looked up by rank."""

    def __init__(self, table: pa.Table, kind: int):
        got = [r for r in table.select(["kind", "c", "d"]).to_pylist() if r["kind"] == kind]
        c = np.frombuffer(b"".join(r["c"] for r in got), np.uint64)
        order = np.argsort(c)
        self.c, self.d = c[order], np.frombuffer(b"".join(r["d"] for r in got), np.int64)[order]

    def find(self, c: np.ndarray) -> np.ndarray:
        """For each rank the document told for it, else the largest number."""
        out = np.full(len(c), LAST_ID)
        if len(self.c):
            at = np.searchsorted(self.c, c)
            at[at == len(self.c)] = 0
            hit = self.c[at] == c
            out[hit] = self.d[at[hit]]
        return out


def low(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """From the high half of a rank; the low half tells ranks of a bucket apart."""
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def repeated_windows(
    docs: DataFrame, tokens_of: Callable[[list], list[np.ndarray]], finish: Callable, schema: str,
    width: int, gram: int, block_bytes: int,
) -> DataFrame:
    """Run the rounds and call ``finish`` for each block.

    tokens_of: texts -> arrays of 64-bit token values. finish(table, ids, first): gets a
    block's rows, their ids and, for each document, for each window the smallest id of a
    document in which the sequence starts (the largest number where none is known to be smaller);
    it returns the block's result rows in ``schema``.
    """
    ship(docs.sparkSession)
    total = text_bytes(docs)
    blocks = parts_for(total, block_bytes)
    buckets = parts_for(total, 8 << 20)
    by_block = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))

    def lots_of(table: pa.Table):
        return chunks(ids_of(table), table.column("text").to_pylist(), tokens_of)

    def first_round(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        a, c, d, b = [], [], [], []
        for own, values, ends in lots_of(table):
            runs = Runs(values, ends, width, gram)
            if len(runs.first):
                rank = mix64(runs.gram)
                a.append(low(rank))
                b.append(bucket_of(rank, buckets))
                c.append(runs.context())
                d.append(own[runs.doc()])
        if not a:
            return rows([], [], [], [], [], [])
        a, b, c, d = (np.concatenate(x) for x in (a, b, c, d))
        keep = firsts(a, c, d)
        return packed(block, WHOLE, b[keep], a[keep], c[keep], d[keep])

    def second_round(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return rows([], [], [], [], [], [])
        block = table.column("block")[0].as_py()
        split = Marks(told, SPLIT)
        if not len(split.c):
            return rows([], [], [], [], [], [])
        a, b, c, d = [], [], [], []
        for own, values, ends in lots_of(table):
            runs = Runs(values, ends, width, gram)
            if not len(runs.first):
                continue
            rank = mix64(runs.gram)
            which = np.flatnonzero(split.find(runs.context()) == own[runs.doc()])
            if len(which):
                start, run = runs.windows(which)
                a.append(low(rank[run]))
                b.append(bucket_of(rank[run], buckets))
                c.append(runs.ranks(start))
                d.append(own[runs.doc()[run]])
        if not a:
            return rows([], [], [], [], [], [])
        a, b, c, d = (np.concatenate(x) for x in (a, b, c, d))
        keep = firsts(a, c, d)
        return packed(block, SINGLE, b[keep], a[keep], c[keep], d[keep])

    def last_round(table: pa.Table, told: pa.Table) -> pa.Table:
        whole, split, single = (Marks(told, k) for k in (WHOLE, SPLIT, SINGLE))
        lots = [(own, ends, Runs(values, ends, width, gram)) for own, values, ends in lots_of(table)]
        # ranks that meet in the block itself
        a = np.concatenate([low(mix64(r.gram)) if len(r.first) else np.zeros(0, np.uint32) for *_, r in lots] or [np.zeros(0, np.uint32)])
        c = np.concatenate([r.context() if len(r.first) else np.zeros(0, np.uint64) for *_, r in lots] or [np.zeros(0, np.uint64)])
        d = np.concatenate([own[r.doc()] if len(r.first) else np.zeros(0, np.int64) for own, _, r in lots] or [np.zeros(0, np.int64)])
        best = np.minimum(least_by(a, c, d), whole.find(c))
        apart = split.find(c) != LAST_ID
        lone = []  # windows ranked one by one, met in the block itself
        at = 0
        for own, _, runs in lots:
            which = np.flatnonzero(apart[at : at + len(runs.first)])
            if len(which):
                start, run = runs.windows(which)
                lone.append((a[at:][run], runs.ranks(start), own[runs.doc()[run]]))
            at += len(runs.first)
        alone = [np.concatenate(x) for x in zip(*lone)] if lone else [np.zeros(0, t) for t in (np.uint32, np.uint64, np.int64)]
        least = np.minimum(least_by(*alone), single.find(alone[1]))
        first: list[np.ndarray] = []
        at = spent = 0
        for own, ends, runs in lots:
            n = len(runs.first)
            window = np.full(runs.n + 1, LAST_ID)
            if n:
                start, run = runs.windows(np.flatnonzero(best[at : at + n] < own[runs.doc()]))
                window[start] = best[at : at + n][run]
                which = np.flatnonzero(apart[at : at + n])
                if len(which):
                    start, run = runs.windows(which)
                    window[start] = np.minimum(window[start], least[spent : spent + len(start)])
                    spent += len(start)
                at += n
            begins = np.concatenate(([0], ends[:-1]))
            first += [window[i:j] for i, j in zip(begins, ends)]
        return finish(table, ids_of(table), first)

    ranked = by_block.groupBy("block").applyInArrow(tidy_group(first_round), RANKS)
    told = ranked.groupBy("bucket").applyInArrow(tidy_group(lambda t: judged(t, False)), RANKS)
    more = by_block.groupBy("block").cogroup(told.where(F.col("kind") == SPLIT).groupBy("block")).applyInArrow(tidy_pair(second_round), RANKS)
    told_more = more.groupBy("bucket").applyInArrow(tidy_group(lambda t: judged(t, True)), RANKS)
    return by_block.groupBy("block").cogroup(told.unionByName(told_more).groupBy("block")).applyInArrow(tidy_pair(last_round), schema)


def least_by(a: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each row the smallest d among rows with its (a, c)."""
    order = np.lexsort((d, c, a))
    x, y, z = a[order], c[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    out = np.empty(len(d), np.int64)
    out[order] = z[np.flatnonzero(new)][np.cumsum(new) - 1] if len(x) else z
    return out
