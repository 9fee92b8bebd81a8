"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

A text is cut into chunks (a run of spaces with the word after it), which no piece crosses. In a
chunk the agenda's candidate merges come up best first, leftmost first among equals, until none is
left. Each candidate of each occurrence is skipped by a keyed hash of the seed, the row and the
place of the chunk: the hash draws how many candidates go through before the next one that is
skipped, which is the same as a draw for each. A skipped candidate comes up again only when a
neighbour has changed.

What an agenda gives depends on its chunk and on which candidates were skipped. So the results are
held as a tree: a chunk without a skip, then by the number of its first skipped candidate, and so on.
A task looks up the path of every occurrence at once and works out those it has not met.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .shared import GOLDEN, KEPT, MIX_A, MIX_B, documents, mix64, tidy, unused
from .spans import powers

#: The vocabulary that the query uses; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
RATE, SEED = 0.1, 42
NEVER = np.int32(2**31 - 1)
#: Paths kept in a task's memory; symbols of the longest chunk that goes with others; characters of a lot.
HELD, WIDE, LOT = 400_000, 48, 1 << 19
#: A rank of the agenda is a piece's rank times COLUMNS, more than WIDE, plus the column.
COLUMNS = 64


def vocabulary(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, their scores, and the ids of the 256 bytes. Read on the driver, sent with the task."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    other = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)]
    for i in other:
        pieces[i] = ""
    bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
    if len(bytes_) != 256:
        raise ValueError("a vocabulary without byte pieces can't encode without loss")
    return pieces, [model.get_score(i) for i in range(size)], [bytes_[k] for k in range(256)]


class Encoder:
    """Encodes and decodes; see the module."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], rate: float, seed: int):
        self.byte_ids = byte_ids
        self.slope = 0.0 if rate <= 0 else -np.inf if rate >= 1 else float(np.log1p(-rate))
        self.seed = mix64(np.array([seed], np.uint64) * GOLDEN)[0]
        marked = set(byte_ids)
        self.id_of = {p: i for i, p in enumerate(pieces) if p and i not in marked}
        raw = [p.replace(chr(MARK), " ").encode() for p in pieces]
        for k, i in enumerate(byte_ids):
            raw[i] = bytes([k])
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        # symbols are piece ids; characters without a piece get numbers above them and never merge
        self.top = len(pieces)
        self.pairs = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[(a << 32) | b] = i
        self.build()
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.top
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        # a space is the mark, the mark itself is a character without a piece
        self.symbol[32], self.symbol[MARK] = self.symbol[MARK], self.top + MARK
        self.forget()

    def forget(self) -> None:
        """Start the tree anew."""
        self.node_of: dict[int, int] = {}
        self.pops = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.int32)
        self.used = 0

    def gaps(self, draw: np.ndarray) -> np.ndarray:
        """How many candidates go through before the next skipped one."""
        if not self.slope:
            return np.full(len(draw), NEVER, np.int64)
        share = ((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        return np.minimum(np.log(share) / self.slope, float(NEVER)).astype(np.int64)

    def build(self) -> None:
        """Lay the pairs out in a table of slots, so that a look-up is a slot and a few after it."""
        keys = np.array(list(self.pairs), np.uint64)
        merged = np.array(list(self.pairs.values()), np.int32)
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 3))
        slots = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_new = np.zeros(slots + 64, np.uint64), np.full(slots + 64, -1, np.int32)
        slot, left, self.probes = self.slot_of(keys), np.arange(len(keys)), 0
        while len(left):  # those that find their slot taken go on to the next one
            self.probes += 1
            free = left[self.slot_new[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.slot_key[slot[put]], self.slot_new[slot[put]] = keys[put], merged[put]
            left = np.setdiff1d(left, put)
            slot[left] += 1

    def slot_of(self, key: np.ndarray) -> np.ndarray:
        return ((key * GOLDEN) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self.slot_of(key)
        out = np.where(self.slot_key[slot] == key, self.slot_new[slot], np.int32(-1))
        for k in range(1, self.probes):
            open_ = np.flatnonzero((out < 0) & (self.slot_new[slot + k - 1] >= 0))
            if not len(open_):
                break
            at = slot[open_] + k
            out[open_] = np.where(self.slot_key[at] == key[open_], self.slot_new[at], np.int32(-1))
        return out

    def ranked(self, a: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The rank of each pair's merged piece with its column below it, or NEVER."""
        new = self.find(a, b)
        return np.where(new >= 0, self.rank[new] * COLUMNS + column, NEVER)

    def agendas(self, begin: np.ndarray, size: np.ndarray, symbols: np.ndarray, skips: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of chunks of at most WIDE symbols in one row, how many each has, and how many candidates came up.

        skips: the numbers of each chunk's skipped candidates, first to last. A lot of chunks advances
        a candidate at a time; a column holds a chunk, so that the best of all chunks is one minimum.
        """
        ids, counts, pops = [], np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 16384)):
            n, width = len(part), int(size[part].max())
            s = np.full((width + 1, n), np.int32(-1))
            for k in range(width):
                on = np.flatnonzero(size[part] > k)
                s[k, on] = symbols[begin[part[on]] + k]
            rank = np.full((width, n), NEVER)
            for k in range(width - 1):
                on = np.flatnonzero(s[k + 1] >= 0)
                rank[k, on] = self.ranked(s[k, on], s[k + 1, on], np.int32(k))
            after = np.repeat(np.arange(1, width + 1, dtype=np.int16)[:, None], n, axis=1)
            before = np.repeat(np.arange(-1, width, dtype=np.int16)[:, None], n, axis=1)
            skip = np.stack([x[part] for x in skips] + [np.full(n, NEVER, np.int64)])
            turn, seen, col = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
            while len(col):
                best = (rank if len(col) == n else rank[:, col]).min(axis=0)
                col = col[best != NEVER]
                i = (best[best != NEVER] & (COLUMNS - 1)).astype(np.int64)
                drop = skip[turn[col], col] == seen[col]
                seen[col] += 1
                turn[col] += drop
                rank[i[drop], col[drop]] = NEVER
                c, i = col[~drop], i[~drop]
                j = after[i, c].astype(np.int64)
                new = self.find(s[i, c], s[j, c])
                k, h = after[j, c].astype(np.int64), before[i, c].astype(np.int64)
                s[i, c], s[j, c], rank[j, c] = new, -1, NEVER
                after[i, c], before[k, c] = k, i
                # the end's symbol is -1, which merges with none
                rank[i, c] = self.ranked(new, s[k, c], i)
                on = h >= 0
                h, c = h[on], c[on]
                rank[h, c] = self.ranked(s[h, c], new[on], h)
            flat = s[:width].T.ravel()
            ids.append(flat[flat >= 0])
            counts[part], pops[part] = (s[:width] >= 0).sum(axis=0), seen
        flat, starts = np.concatenate(ids), np.zeros(len(size), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        flat = flat[np.arange(len(flat)) + np.repeat(starts - np.cumsum(counts) + counts, counts)]
        return *self.with_bytes(flat, counts), pops

    def long_agenda(self, symbols: np.ndarray, occurrence: int) -> np.ndarray:
        """The pieces of a chunk of any length, by a heap of numbers (rank, place)."""
        s, n = symbols.tolist(), len(symbols)
        after, before, passed = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        rank, pairs = self.rank.tolist(), self.pairs

        def candidate(i: int) -> int:
            new = pairs.get((s[i] << 32) | s[after[i]]) if s[i] >= 0 and after[i] < n else None
            return NEVER if new is None else rank[new]

        never = int(NEVER)
        heap = [(r << 40) | i for i in range(n) if (r := candidate(i)) != never]
        heapq.heapify(heap)
        draw = np.array([occurrence], np.uint64)
        skipped, seen, turn = int(self.gaps(draw)[0]), 0, 0
        while heap:
            top = heapq.heappop(heap)
            i = top & ((1 << 40) - 1)
            if s[i] < 0 or passed[i] or candidate(i) != top >> 40:
                continue
            seen += 1
            if seen - 1 == skipped:
                passed[i], turn = 1, turn + 1
                skipped += 1 + int(self.gaps(mix64(draw + np.array([turn], np.uint64) * MIX_B))[0])
                continue
            j = after[i]
            s[i], s[j] = pairs[(s[i] << 32) | s[j]], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    passed[k] = 0
                    if (r := candidate(k)) != never:
                        heapq.heappush(heap, (r << 40) | k)
        return np.array([x for x in s if x >= 0], np.int32)

    def with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids laid end to end, with characters without a piece as the pieces of their bytes."""
        other = np.flatnonzero(ids >= self.top)
        if not len(other):
            return ids, counts
        size = np.ones(len(ids), np.int64)
        made = [[self.byte_ids[b] for b in chr(i - self.top).encode("utf-8", "surrogatepass")] for i in ids[other].tolist()]
        size[other] = [len(x) for x in made]
        at = np.cumsum(size) - size
        out = np.repeat(ids, size)
        out[np.repeat(at[other], size[other]) + np.concatenate([np.arange(len(x)) for x in made])] = np.concatenate(made)
        return out, np.bincount(np.repeat(np.arange(len(counts)), counts), size, len(counts)).astype(np.int64)

    def nodes(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray, symbols: np.ndarray, skips: list[np.ndarray]) -> np.ndarray:
        """The node of each path; those not met yet are worked out."""
        unique, first, where = np.unique(keys, return_index=True, return_inverse=True)
        got = np.array([self.node_of.get(k, -1) for k in unique.tolist()], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            which = first[new]
            got[new] = self.store(unique[new], *self.agendas(begin[which], size[which], symbols, [x[which] for x in skips]))
        return got[where]

    def store(self, keys: np.ndarray, made: np.ndarray, sizes: np.ndarray, pops: np.ndarray) -> np.ndarray:
        """Add paths to the tree."""
        n = len(self.node_of)
        nodes = np.arange(n, n + len(keys))
        for name, need in (("pops", n + len(keys)), ("at", n + len(keys)), ("size", n + len(keys)), ("pool", self.used + len(made))):
            old = getattr(self, name)
            if need > len(old):
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.pops[nodes], self.size[nodes] = pops, sizes
        self.at[nodes] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(made)] = made
        self.used += len(made)
        self.node_of.update(zip(keys.tolist(), nodes.tolist()))
        return nodes

    def encode_lot(self, parts: list[str], rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in one row, and how many each part has.

        rows: a 64-bit value of each part's row; places: where in its text the part starts.
        """
        sizes = np.array([len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        space, line = codes == 32, (codes == 10) | (codes == MARK)
        start = line.copy()
        start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        first = np.cumsum(sizes) - sizes
        start[first[sizes > 0]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, n))
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64((codes.astype(np.uint64) + np.uint64(1000)) * GOLDEN) * up[:n], out=sums[1:])
        keys = mix64((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64) * GOLDEN)
        symbols = self.symbol[codes]
        part = np.searchsorted(first[sizes > 0], begin, side="right") - 1
        part = np.flatnonzero(sizes > 0)[part]
        place = (begin - first[part] + places[part]).astype(np.uint64)
        draw = mix64(mix64(rows + self.seed)[part] + place * GOLDEN)
        long = np.flatnonzero(size > WIDE)
        alone = {}
        for k in long.tolist():
            made = self.long_agenda(symbols[begin[k] : begin[k] + size[k]], int(draw[k]))
            alone[k] = self.with_bytes(made, np.array([len(made)]))[0]
        short = np.flatnonzero(size <= WIDE)
        if len(self.node_of) > HELD:
            self.forget()
        node = np.zeros(len(begin), np.int64)
        node[short] = self.nodes(keys[short], begin[short], size[short], symbols, [])
        left, skipped = short, self.gaps(draw[short])
        on = skipped < self.pops[node[left]]
        left, skipped, key, turn, skips = left[on], skipped[on], keys[left[on]], 0, []
        while len(left):
            skips.append(skipped)
            key = mix64(key + (skipped + 1).astype(np.uint64) * MIX_A)
            node[left] = self.nodes(key, begin[left], size[left], symbols, skips)
            turn += 1
            skipped = skipped + 1 + self.gaps(mix64(draw[left] + np.array([turn], np.uint64) * MIX_B))
            on = skipped < self.pops[node[left]]
            left, skipped, key, skips = left[on], skipped[on], key[on], [x[on] for x in skips]
        at, count = self.at[node], self.size[node]
        for k, ids in alone.items():
            count[k] = len(ids)
        total = np.cumsum(count)
        step = np.arange(int(total[-1])) - np.repeat(total - count - at, count)
        for k, ids in alone.items():
            step[total[k] - len(ids) : total[k]] = 0
        ids = self.pool[step]
        for k, own in alone.items():
            ids[total[k] - len(own) : total[k]] = own
        return ids, np.bincount(part, count, len(parts)).astype(np.int64)

    def encode(self, texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and how many each text has; rows: a 64-bit value of each text's row."""
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for lot in lots(texts):
            of = np.array([k for k, _, _ in lot])
            ids, n = self.encode_lot([p for _, _, p in lot], rows[of], np.array([at for _, at, _ in lot]))
            out.append(ids)
            np.add.at(counts, of, n)
        return np.concatenate(out), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: a space, then the text as it was."""
        ids = np.asarray(ids, np.int64)
        size = self.raw_size[ids]
        total = np.cumsum(size)
        return self.raw[np.arange(int(total[-1]) if len(ids) else 0) - np.repeat(total - size - self.raw_at[ids], size)].tobytes()


def lots(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Lots of parts (number of the text, where the part starts in it, the part), about LOT characters each.

    A long text is parted before a space that follows another character, or at a line's end, which no
    chunk crosses. Every text has a space put before it; an empty text has no part.
    """
    lot, size = [], 0
    for k, text in enumerate(texts):
        if not text:
            continue
        text, at = " " + text, 0
        while at < len(text):
            stop = at + LOT
            if stop < len(text):
                while stop < len(text) and not (text[stop] == "\n" or text[stop] == " " and text[stop - 1] != " "):
                    stop += 1
            part = text[at:stop]
            lot.append((k, at, part))
            at += len(part)
            size += len(part)
            if size >= LOT:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


def sentencepiece_encode(docs: DataFrame, columns: list[str], model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``columns`` of docs with n_chars, ids (array of int), and decodes (whether ids give the text again).

    Encoding is that of the vocabulary's own library where ``rate`` is 0, but that a mark (U+2581) in
    a text is kept as bytes, so that decoding loses nothing. Skips are drawn by doc_id, text and
    place, so that equal rows get equal pieces and two places of a word get their own.

    A null text has null ids and decodes to null; an empty text has no ids. Texts and words of any
    length are encoded whole, in parts of bounded size. Empty tables give empty results. A column
    named ids, n_chars or decodes is replaced; other columns stay as they are, whatever their names.
    """
    ship(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    columns = [c for c in columns if c not in ("n_chars", "ids", "decodes")]
    text_name, row_name = unused(docs.select(*columns), "text", "row")
    drawn = docs.select(*columns, F.col("text").alias(text_name), F.xxhash64("doc_id", "text").alias(row_name))
    schema = drawn.select(*columns).schema.add("n_chars", "long").add("ids", T.ArrayType(T.IntegerType())).add("decodes", "boolean")

    def run(batches):
        encoder = encoder_of((model, rate, seed), vocab)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(text_name).to_pylist()
                ids, counts = encoder.encode([t or "" for t in texts], batch.column(row_name).to_numpy().view(np.uint64))
                edges = np.concatenate(([0], np.cumsum(counts)))
                good = [encoder.decode(ids[i:j]) == f" {t}".encode("utf-8", "surrogatepass") if t else i == j for t, i, j in zip(texts, edges[:-1], edges[1:])]
                none = np.array([t is None for t in texts])
                offsets = pa.array(edges.astype(np.int32), mask=np.append(none, False))
                n_chars = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                extra = [n_chars, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *extra], [*columns, "n_chars", "ids", "decodes"])

    return drawn.mapInArrow(tidy(run, "pieces"), schema)


_encoders: dict = {}


def encoder_of(key: tuple, vocab) -> Encoder:
    """The worker's encoder for a vocabulary, rate and seed; its tree stays known from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*vocab.value, *key[1:])
        KEPT["pieces"] = _encoders.clear
    return _encoders[key]


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_sha256 (of the ids as little-endian 32-bit numbers in hex), decodes."""
    out = sentencepiece_encode(documents(spark, sf_dir), ["doc_id"])

    def digest(batches):
        for b in batches:
            ids = b.column("ids")
            values, edges = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            made = [hashlib.sha256(values[i:j].tobytes()).hexdigest() for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), pa.array(np.diff(edges), pa.int64()), pa.array(made, pa.string()), b.column("decodes")], ["doc_id", "n_chars", "n_ids", "ids_sha256", "decodes"])

    return out.mapInArrow(tidy(digest), f"doc_id {out.schema['doc_id'].dataType.simpleString()}, n_chars long, n_ids long, ids_sha256 string, decodes boolean")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
SQL: dict[str, str] = {}
