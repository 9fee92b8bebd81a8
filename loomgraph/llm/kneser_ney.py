"""Interpolated modified Kneser-Ney models of characters, counted by Spark, kept in shards of sorted arrays.

A text is a row of symbols, its code points: digits are one symbol, and planes above the first go in
blocks of 1024 code points. An n-gram of four symbols is one 64-bit number, so that n-grams are told
apart exactly and a model grows with what it was counted on. A language's n-grams are put into shards
by their last but one symbol. All that the probability of an n-gram needs, down to order 2, then lies
in its shard; discounts and the counts of order 1 are one small row a language.

Documents are scored by a join of counts: a block of documents asks each shard for the distinct
n-grams of its texts, the shard answers with their bits, and the block adds them up. A shard that many
blocks ask is copied for each SPREAD blocks. No model is sent to the driver or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .shared import Tables, parts_for, text_bytes, tidy, tidy_group, tidy_pair

BITS, ORDER = np.uint64(16), 4
#: Stands before a text, where no character does (fixed value).
START = 0xDFFF
LEAD = chr(START) * (ORDER - 1)
#: Shards of a language; blocks that ask one copy of a shard; n-grams that a map task holds; bytes of text in a block.
SHARDS, SPREAD, HELD, BLOCK = 64, 512, 1_000_000, 2 << 20
#: Cells of the largest table over pairs of pairs of symbols.
TABLE = 1 << 24


def language(name: str = "lang") -> Column:
    """A null language is a language of its own."""
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(name)))


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    high = codes >= 0x10000
    codes[high] = 0xD800 + ((codes[high] - 0x10000) >> 10)
    return codes.astype(np.uint16)


def last_symbols(n: int) -> np.uint64:
    """The bits of an n-gram's last n symbols."""
    return np.uint64((1 << (16 * n)) - 1)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts (sorted), which of them ends at each symbol, and how many symbols each text has."""
    s = symbols("".join(LEAD + t for t in texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    names = np.unique(s)
    small = np.int32 if len(names) < 1 << 15 else np.int64
    own = np.zeros(1 << 16, small)
    own[names] = np.arange(len(names))
    # pairs of symbols, then pairs of pairs, as numbers without gaps and in order
    pair = own[s[:-1]] * len(names) + own[s[1:]]
    seen = np.zeros(len(names) ** 2, bool)
    seen[pair] = True
    pairs = np.flatnonzero(seen)
    small = np.int32 if len(pairs) < 1 << 15 else np.int64
    at = np.zeros(len(seen), small)
    at[pairs] = np.arange(len(pairs))
    pair = at[pair]
    four = pair[:-2] * len(pairs) + pair[2:]
    ends = np.cumsum(sizes + ORDER - 1)
    inside = np.ones(len(four), bool)  # n-grams that end in a text
    for k in range(ORDER - 1):
        at_lead = (ends - sizes - (ORDER - 1)) + k - (ORDER - 1)
        inside[at_lead[(at_lead >= 0) & (at_lead < len(four))]] = False
    four = four[inside]
    if len(pairs) ** 2 <= TABLE:
        seen = np.zeros(len(pairs) ** 2, bool)
        seen[four] = True
        distinct = np.flatnonzero(seen)
        rank = np.zeros(len(seen), np.int32)
        rank[distinct] = np.arange(len(distinct), dtype=np.int32)
        which = rank[four]
    else:
        distinct, which = np.unique(four, return_inverse=True)
    two = (names[pairs // len(names)].astype(np.uint64) << BITS) | names[pairs % len(names)].astype(np.uint64)
    return (two[distinct // len(pairs)] << np.uint64(32)) | two[distinct % len(pairs)], which, sizes


def shard_of(codes: np.ndarray) -> np.ndarray:
    return ((codes >> BITS) & last_symbols(1)).astype(np.int32) % SHARDS


def counted(docs: DataFrame) -> DataFrame:
    """(lang, code, n): how often each n-gram occurs in texts of a language. docs: lang (see ``language``), pack (a compressed text).

    Counts are added up in each map task before they are sent.
    """

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, lots in held.items():
            codes, n = summed(*(np.concatenate(x) for x in zip(*lots)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    def count(batches):
        held: dict = {}
        size = 0
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            for lang, texts in by_language(batch.column("lang").to_pylist(), texts_in(batch)):
                codes, which, _ = grams(texts)
                held.setdefault(lang, []).append((codes, np.bincount(which, minlength=len(codes))))
                size += len(codes)
            if size > HELD:
                held = {k: [summed(*(np.concatenate(x) for x in zip(*lots)))] for k, lots in held.items()}
                size = sum(len(lots[0][0]) for lots in held.values())
                if size > HELD // 2:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    ship(docs.sparkSession)
    rows = docs.select("lang", "pack").mapInArrow(tidy(count), "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def texts_in(rows: pa.RecordBatch | pa.Table) -> list:
    """The texts of a column ``pack``."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if p is None else unpack(p).decode("utf-8", "surrogatepass") for p in rows.column("pack").to_pylist()]


def by_language(langs: list, texts: list) -> Iterator[tuple[str, list[str]]]:
    """Texts that are not empty, in lots of one language and of bounded size."""
    lots: dict = {}
    size: dict = {}
    for lang, text in zip(langs, texts):
        if text:
            lots.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > BLOCK:
                yield lang, lots.pop(lang)
                size.pop(lang)
    yield from lots.items()


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes in one, with the sum of their counts; sorted."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, int)
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def lower_orders(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """N-grams and counts of orders 1 to 4; below 4 an n-gram counts once for each symbol that stands before it."""
    out = [(codes, counts)]
    for n in range(ORDER - 1, 0, -1):
        low = out[0][0] & last_symbols(n)
        out.insert(0, summed(low, np.ones(len(low), np.int64)))
    return out


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2 and over, from how many n-grams have counts 1 to 4."""
    n = [0.0, *map(float, n)]
    if not n[1] or not n[2]:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0] + [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)])


def zipped(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Shard:
    """Part of a language's model: for each order its n-grams (sorted), their probabilities and back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, tops: list[np.ndarray], ones: tuple[np.ndarray, np.ndarray]):
        """tops: the discounts of orders 1 to 4; ones: all symbols of the language with their counts of order 1."""
        self.codes, self.values, self.weights = [], [], []
        used = lower_orders(codes, counts)
        used[0] = ones
        self.flat = 1 / (len(ones[0]) + 1)
        for n, (codes, counts) in enumerate(used, 1):
            context = codes >> BITS
            starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(codes) else np.zeros(0, int)
            total = np.add.reduceat(counts, starts).astype(float) if len(starts) else np.zeros(0)
            discount = tops[n - 1][np.minimum(counts, 3)]
            freed = np.add.reduceat(discount, starts) if len(starts) else np.zeros(0)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
            lower = self.probability(codes & last_symbols(n - 1), n - 1)
            self.codes.append(codes)
            self.values.append((counts - discount) / total[group] + freed[group] / total[group] * lower)
            self.weights.append((context[starts], freed / total))

    def probability(self, codes: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of the last symbol of each n-gram, given the others."""
        if n == 0 or not len(self.codes[n - 1]):
            return np.full(len(codes), self.flat) if n <= 1 else self.probability(codes & last_symbols(n - 1), n - 1)
        own = self.codes[n - 1]
        at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        hit = own[at] == codes
        out = self.values[n - 1][at]
        if not hit.all():
            miss = codes[~hit]
            context, weight = self.weights[n - 1]
            at = np.minimum(np.searchsorted(context, miss >> BITS), len(context) - 1)
            share = np.where(context[at] == miss >> BITS, weight[at], 1)
            out[~hit] = share * self.probability(miss & last_symbols(n - 1), n - 1)
        return out


MODEL = "lang string, shard int, model binary"


def shards(counts: DataFrame) -> DataFrame:
    """(lang, shard, model, tops, ones): all shards of each language; model is null where a shard has no n-gram.

    counts: a written table of ``counted``.
    """
    code = F.expr("CAST(shiftright(code, 16) & 65535 AS int)")
    counts = counts.withColumn("shard", code % SHARDS)

    def pack(table: pa.Table) -> pa.Table:
        codes, n = summed(table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy())
        return pa.table([table.column("lang").slice(0, 1), table.column("shard").slice(0, 1), pa.array([zipped(codes, n)], pa.binary())], ["lang", "shard", "model"])

    def tell(table: pa.Table) -> pa.Table:
        """How many n-grams of each order have counts 1 to 4, and the counts of order 1 of the shard."""
        used = lower_orders(*summed(table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()))
        rows = [(n, r, int((used[n - 1][1] == r).sum())) for n in range(2, ORDER + 1) for r in range(1, 5)]
        rows += [(1, int(s), int(c)) for s, c in zip(*used[0])]
        return pa.table([pa.array([table.column("lang")[0].as_py()] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["lang", "of", "what", "n"])

    def settle(table: pa.Table) -> pa.Table:
        of, what, n = (table.column(c).to_numpy() for c in ("of", "what", "n"))
        order = np.argsort(what, kind="stable")
        of, what, n = of[order], what[order], n[order]
        one = of == 1
        count = lambda k, r: int((n[one] == r).sum()) if k == 1 else int(n[(of == k) & (what == r)].sum())
        tops = np.array([discounts([count(k, r) for r in range(1, 5)]) for k in range(1, ORDER + 1)])
        return pa.table([table.column("lang").slice(0, 1), pa.array([tops.tobytes()], pa.binary()), pa.array([zipped(what[one], n[one])], pa.binary())], ["of_lang", "tops", "ones"])

    packed = counts.groupBy("lang", "shard").applyInArrow(pack, MODEL)
    told = counts.groupBy("lang", "shard").applyInArrow(tell, "lang string, of long, what long, n long")
    settled = told.groupBy("lang", "of", "what").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(settle, "of_lang string, tops binary, ones binary")
    every = settled.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))))
    every = every.join(packed, (F.col("lang") == F.col("of_lang")) & (F.col("shard") == F.col("of")), "left")
    return every.select(F.col("of_lang").alias("lang"), F.col("of").alias("shard"), "model", "tops", "ones")


def shard_from(row: dict) -> Shard:
    both = unzipped(row["model"]) if row["model"] else b""
    n = len(both) // 16
    ones = np.frombuffer(unzipped(row["ones"]), np.int64)
    tops = list(np.frombuffer(row["tops"], np.float64).reshape(ORDER, 4))
    return Shard(np.frombuffer(both, np.uint64, n), np.frombuffer(both, np.int64, n, 8 * n), tops, (ones[: len(ones) // 2].view(np.uint64), ones[len(ones) // 2 :]))


def scored(docs: DataFrame, models: DataFrame, columns: list[str], more: Callable | None = None, schema: str = "") -> DataFrame:
    """own (a struct of ``columns`` of docs), key (the language), bits and symbols (a text's length in both).

    ``more`` gets a list of texts and returns the columns of ``schema`` for them. docs has doc_id,
    lang and text. models: a written table of ``shards``. bits is null where the language has no model
    or the text is null or empty.
    """
    ship(docs.sparkSession)
    blocks = parts_for(text_bytes(docs), BLOCK)
    carried = [c for c in columns if c != "text"]
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    laid = docs.select(block.alias("block"), language().alias("key"), "text", F.struct(*(F.col(f"`{c}`") for c in carried)).alias("own"))

    def squeeze(batches):
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            pack = zstandard.ZstdCompressor(level=1).compress
            packs = pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("key"), packs, batch.column("own")], ["block", "key", "pack", "own"])

    squeezed = T.StructType().add("block", "integer").add("key", "string").add("pack", "binary").add("own", laid.schema["own"].dataType)
    by_block = laid.mapInArrow(tidy(squeeze), squeezed).groupBy("block")

    def lots(keys: list, texts: list) -> Iterator[tuple[str, list[int]]]:
        """Rows with text of each language, sorted by language, as asked() and answered() both go."""
        found: dict = {}
        for k, (key, text) in enumerate(zip(keys, texts)):
            if text:
                found.setdefault(key, []).append(k)
        yield from sorted(found.items())

    def asked(table: pa.Table) -> pa.Table:
        block, texts = table.column("block")[0].as_py(), texts_in(table)
        rows = []
        for key, which in lots(table.column("key").to_pylist(), texts):
            codes, _, _ = grams([texts[k] for k in which])
            shard = shard_of(codes)
            order = np.argsort(shard, kind="stable")
            names, starts = np.unique(shard[order], return_index=True)
            for name, part in zip(names.tolist(), np.split(codes[order], starts[1:])):
                rows.append((key, name, block // SPREAD, block, zipped(np.diff(part, prepend=np.uint64(0)))))
        types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["lang", "shard", "salt", "block", "codes"])

    def answered(batches):
        """Rows of a shard: first its model, then what blocks ask of it."""
        held, model = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = (row["lang"], row["shard"], row["salt"])
                if row["block"] < 0:
                    held, model = name, shard_from(row)
                elif held == name:
                    codes = np.cumsum(np.frombuffer(unzipped(row["codes"]), np.uint64), dtype=np.uint64)
                    bits = -np.log2(model.probability(codes))
                    out.append((row["block"], row["lang"], row["shard"], zipped(bits.astype(np.float32))))
            types = (pa.int32(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["block", "lang", "shard", "bits"])

    def added(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, told = texts_in(table), {}
        for r in answers.select(["lang", "shard", "bits"]).to_pylist():
            told[r["lang"], r["shard"]] = np.frombuffer(unzipped(r["bits"]), np.float32)
        bits: list = [None] * len(texts)
        known = {lang for lang, _ in told}
        for key, which in lots(table.column("key").to_pylist(), texts):
            if key not in known:
                continue
            codes, place, sizes = grams([texts[k] for k in which])
            shard = shard_of(codes)
            cost = np.empty(len(codes))
            for name in np.unique(shard).tolist():
                cost[shard == name] = told[key, name]
            sums = np.add.reduceat(cost[place], np.cumsum(sizes) - sizes)
            for k, x in zip(which, sums.tolist()):
                bits[k] = x
        own = pa.concat_arrays(table.column("own").chunks)
        fields = [pa.array(texts, pa.string()) if c == "text" else own.field(c) for c in columns]
        cols = {"own": pa.StructArray.from_arrays(fields, list(columns)), "key": table.column("key"), "bits": pa.array(bits, pa.float64())}
        return pa.table(cols | {"symbols": pa.array([len(t or "") for t in texts], pa.int64())} | (more(texts) if more else {}))

    wanted = by_block.applyInArrow(tidy_group(asked), "lang string, shard int, salt int, block int, codes binary")
    none = F.lit(None).cast("binary")
    salts = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // SPREAD)))
    models = models.select("lang", "shard", salts.alias("salt"), F.lit(-1).alias("block"), none.alias("codes"), "model", "tops", "ones")
    rows = wanted.select("lang", "shard", "salt", "block", "codes", none.alias("model"), none.alias("tops"), none.alias("ones")).unionByName(models)
    rows = rows.repartition("lang", "shard", "salt").sortWithinPartitions("lang", "shard", "salt", "block")
    answers = rows.mapInArrow(tidy(answered), "block int, lang string, shard int, bits binary")
    own = T.StructType([T.StructField(f.name, f.dataType) for f in docs.select(*(F.col(f"`{c}`") for c in columns)).schema])
    out = T.StructType().add("own", own).add("key", "string").add("bits", "double").add("symbols", "long")
    for name, kind in (x.split() for x in schema.split(", ") if x):
        out = out.add(name, kind)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(tidy_pair(added), out)


#: Symbols of average text that every document is taken to have besides its own, so that short texts
#: are not judged by a few symbols.
PRIOR = 64


def means(known: DataFrame) -> DataFrame:
    """(of, mean): bits a symbol of all texts of a language in known (key, bits, symbols)."""
    return known.where("bits IS NOT NULL").groupBy(F.col("key").alias("of")).agg((F.sum("bits") / F.sum("symbols")).alias("mean"))


def smoothed(scores: DataFrame, mean: DataFrame) -> DataFrame:
    """scores with ``score``: bits a symbol, drawn towards the mean of the language."""
    out = scores.join(F.broadcast(mean), F.col("key") == F.col("of"), "left")
    return out.withColumn("score", (F.col("bits") + F.col("mean") * PRIOR) / (F.col("symbols") + PRIOR)).drop("of", "mean")


def quantiles(scores: DataFrame, **at: float) -> DataFrame:
    """(of, one column for each name): exact quantiles of ``score`` in each language ``key``.

    Scores are put into cells of 0.001 and the cells counted, so that what one task ranks is a
    bounded number of cells, not the documents of a language.
    """
    cells = scores.where("score IS NOT NULL").groupBy(F.col("key").alias("of"), F.round(F.col("score") * 1000).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    ranked = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("of").orderBy("cell"))).withColumn("all", F.sum("n").over(Window.partitionBy("of")))
    cut = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("cell"))) / 1000.0
    return ranked.groupBy("of").agg(*(cut(q).alias(name) for name, q in at.items()))


def modelled(tables: Tables, docs: DataFrame) -> DataFrame:
    """A written table of the models of docs (lang, pack); see ``counted``."""
    return tables.keep(shards(tables.keep(counted(docs), "counts")), "models")
