"""MinHash near-dedup by an inverted join of signature coordinates.

Documents with equal shingle sets form one class. A class is posted under each of its
(coordinate, value) pairs. A pair that one class alone holds can match nothing: a class with fewer
than ``matches`` shared pairs is skipped, and of the others only the rarest pairs are posted, of
which two classes with enough matches must share one (prefix filter).

Posting lists are merged in two rounds. In the first, each list names a centre, and its members are
counted against that centre alone, so that a group of copies becomes one component at a linear cost.
In the second, lists that still hold several components are merged: collisions of two members are
counted over all coordinates, members of one component are skipped, and pairs with ``matches`` or
more are retained, each by the first list that both are posted in. Lists are dealt in blocks of a
bounded size. Every link is confirmed on full shingle sets, in the tasks of the lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import GOLDEN, MIX_A, Tables, documents, mix64, sieved, tidy, unused
from .words import word_values

#: Members of a list, and shingles of their sets, that make a block of it. A task holds two blocks.
LIST, SETS = 2000, 2_000_000


def shingles(values: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles of ``size`` words, sorted; all words as one if there are fewer."""
    if not len(values):
        return values
    size = min(size, len(values))
    out = np.full(len(values) - size + 1, np.uint64(size)) * GOLDEN
    for k in range(size):
        out = mix64(out * MIX_A + values[k : len(values) - size + 1 + k])
    return np.unique(out)


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    return [shingles(v, size) for v in word_values([(t or "").encode() for t in texts], fold=True)]


def seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, coordinates + 1, dtype=np.uint64)
    return mix64(base * GOLDEN), mix64(base * MIX_A) | np.uint64(1)


def signed(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cid (from the whole set), sig (the least hash of each coordinate)."""

    def run(batches):
        shift, factor = seeds(coordinates)
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            n, cid, sig = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                n.append(len(s))
                cid.append(int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True) if len(s) else None)
                sig.append(least(s, shift, factor) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                ["doc_id", "text_hash", "n_shingles", "cid", "sig"],
            )

    return keyed(docs).mapInArrow(tidy(run), "doc_id long, text_hash long, n_shingles long, cid long, sig array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def least(values: np.ndarray, shift: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The signature of a set; long sets go piece by piece."""
    out = np.full(len(shift), np.uint64(2**64 - 1))
    for k in range(0, len(values), 4096):
        np.minimum(out, ((values[k : k + 4096, None] ^ shift) * factor >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32).view(np.int32)


def posting_lists(leads: DataFrame, matches: int) -> DataFrame:
    """(token, cid, n, posted): the lists of two and more classes; posted has a bit for each coordinate of the prefix."""
    token = F.expr("shiftleft(CAST(k AS bigint), 32) | (CAST(v AS bigint) & 4294967295)")
    tokens = leads.select("cid", "n", F.posexplode("sig").alias("k", "v")).select("cid", "n", token.alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    shared = tokens.join(often, "token").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("shared")).where(F.size("shared") >= matches)
    prefix = shared.select("cid", "n", F.transform(F.slice("shared", 1, F.size("shared") - F.lit(matches - 1)), lambda x: x.token).alias("tokens"))
    bits = F.expr("aggregate(tokens, 0L, (bits, t) -> bits | shiftleft(1L, CAST(shiftright(t, 32) AS int)))")
    return prefix.select("cid", "n", bits.alias("posted"), F.explode("tokens").alias("token"))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables that hold each key's rows whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if not len(keys):
            continue
        if held and held[-1].column("key")[-1].as_py() == keys[0] == keys[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def counted(table: pa.Table, percent: int, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of retained pairs in rows sorted by key and set size.

    A pair is retained when its sizes can give ``percent``, its components differ, ``matches``
    coordinates collide, and no earlier list holds both.
    """
    key, n, label, block, posted, k = (table.column(c).to_numpy() for c in ("key", "n", "label", "block", "posted", "k"))
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    bits = (posted.view(np.uint64)[:, None] >> np.arange(sig.shape[1], dtype=np.uint64) & np.uint64(1)).astype(bool)
    alone = table.column("alone").to_numpy(zero_copy_only=False)
    stop = np.searchsorted(key, key, side="right")
    xs, ys = [], []
    x, step = np.arange(len(key)), 0
    while True:
        step += 1
        x = x[x + step < stop[x]]
        x = x[100 * n[x] >= percent * n[x + step]]
        if not len(x):
            break
        apart = x[(label[x] != label[x + step]) & (alone[x] | (block[x] != block[x + step]))]
        for at in range(0, len(apart), 20_000):
            a = apart[at : at + 20_000]
            same = sig[a] == sig[a + step]
            good = np.flatnonzero(same.sum(axis=1) >= matches)
            a, same = a[good], same[good]
            first = (same & bits[a] & bits[a + step]).argmax(axis=1)
            a = a[first == k[a]]
            xs.append(a)
            ys.append(a + step)
    none = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


ASKED = "key long, cid long, own_id long, own_hash long, label long, partners binary"


def asked_rows(table: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """A row for each member of a pair: the partners that it is held against."""
    cid = table.column("cid").to_numpy()
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    who = np.union1d(x, y)
    edges = np.searchsorted(x, np.append(who, len(cid)))
    partners = [cid[y[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:])]
    names = ["key", "cid", "own_id", "own_hash", "label"]
    columns = [table.column(c).take(pa.array(who)).combine_chunks() for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(partners, pa.binary())], [*names, "partners"])


def linked(table: pa.Table, size: int, percent: int) -> list[tuple[int, int]]:
    """Links between the labels of one key's members; of two components one link."""
    cid, label = table.column("cid").to_numpy(), table.column("label").to_pylist()
    cid, first = np.unique(cid, return_index=True)
    unpack = zstandard.ZstdDecompressor().decompress
    packs = table.column("pack").take(first).to_pylist()
    sets = shingle_sets([unpack(p).decode() for p in packs], size)
    sizes = np.array([len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sets = np.split(number, np.cumsum(sizes)[:-1])
    label = [label[i] for i in first.tolist()]
    roots = {x: x for x in label}

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    member = np.zeros(len(number), bool)
    partners: dict[int, list[np.ndarray]] = {}
    for c, p in zip(table.column("cid").to_pylist(), table.column("partners").to_pylist()):
        if p:
            partners.setdefault(int(np.searchsorted(cid, c)), []).append(np.searchsorted(cid, np.frombuffer(p, np.int64)))
    found = []
    for x, lots in partners.items():
        member[sets[x]] = True
        for lot in np.array_split(np.concatenate(lots), max(1, sum(map(len, lots)) // 256)):
            own = root(label[x])
            left = [y for y in lot.tolist() if root(label[y]) != own]
            if not left:
                continue
            hits = member[np.concatenate([sets[y] for y in left])]
            both = np.add.reduceat(hits, np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
            for y in np.array(left)[100 * both >= percent * (sizes[x] + sizes[left] - both)].tolist():
                a, b = root(label[x]), root(label[y])
                if a != b:
                    found.append((label[x], label[y]))
                    roots[b] = a
        member[sets[x]] = False
    return found


def confirmed(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between labels, of the pairs that ``rows`` asks for, from full sets.

    rows: see ASKED. A key's members come together with their texts, which are sieved and
    compressed before they move.
    """
    def hold(batches):
        for table in grouped(batches):
            keys = table.column("key").to_numpy()
            edges = np.unique(np.concatenate(([0, len(keys)], np.flatnonzero(np.diff(keys)) + 1))).tolist()
            links = [x for i, j in zip(edges[:-1], edges[1:]) for x in linked(table.slice(i, j - i), size, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    texts = sieved(keyed(docs), rows.select("own_id", "own_hash"), ["doc_id", "text_hash"], ["text_id", "text_hash", "pack"])
    met = rows.join(texts, F.col("own_id").eqNullSafe(F.col("text_id")) & (F.col("own_hash") == F.col("text_hash")))
    met = met.select("key", "cid", "label", "partners", "pack").repartition("key").sortWithinPartitions("key", "cid")
    return met.mapInArrow(tidy(hold), "a long, b long")


def blocks_of(members: Column, shingles: Column) -> Column:
    """In how many blocks a list is dealt."""
    return F.ceil(F.greatest(members / F.lit(LIST), shingles / F.lit(SETS))).cast("int")


def stars(lists: DataFrame, leads: DataFrame, percent: int, matches: int) -> DataFrame:
    """The first round: each list's members against its centre, where sizes and collisions can give a link.

    The centre is the least by a hash of the class, so that lists of one group name the same one.
    """
    centre = lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("c")).select("token", F.col("c.cid").alias("centre"))
    pairs = lists.select("token", "cid").join(centre, "token").where("cid <> centre").select("cid", "centre").distinct()
    own = leads.select("cid", "n", "sig", "own_id", "own_hash")
    other = own.select(*(F.col(c).alias({"cid": "centre"}.get(c, f"centre_{c}")) for c in own.columns))
    met = pairs.join(own, "cid").join(other, "centre").where(100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n"))
    same = F.size(F.filter(F.zip_with("sig", "centre_sig", lambda x, y: x == y), lambda x: x))
    return met.where(same >= matches).drop("sig", "centre_sig")


def star_rows(met: DataFrame) -> DataFrame:
    """Kept ``stars`` as rows for ``confirmed``; a centre's members are dealt in blocks."""
    dealt = met.groupBy("centre").agg(blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    met = met.join(dealt, "centre").withColumn("key", F.xxhash64("centre", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    # the centre as eight bytes, lowest first
    number = F.unhex(F.expr("concat_ws('', transform(sequence(0, 7), i -> lpad(hex(shiftrightunsigned(centre, 8 * i) & 255), 2, '0')))"))
    members = met.select("key", "cid", "own_id", "own_hash", F.col("cid").alias("label"), number.alias("partners"))
    own = [F.col("centre").alias("cid"), F.col("centre_own_id").alias("own_id"), F.col("centre_own_hash").alias("own_hash"), F.col("centre").alias("label")]
    return members.unionByName(met.select("key", *own, F.unhex(F.lit("")).alias("partners")).distinct())


def crossed(lists: DataFrame, leads: DataFrame, state: DataFrame, percent: int, matches: int) -> DataFrame:
    """The second round's rows for ``confirmed``: retained pairs between components, list by list."""
    open_lists = lists.join(state, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = open_lists.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks_of(F.count("*"), F.sum("n")).alias("blocks")).where("low <> high")
    rows = open_lists.join(mixed.select("token", "blocks"), "token").withColumn("block", F.expr("CAST(pmod(xxhash64(cid), blocks) AS int)"))
    rows = rows.withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)")))
    key = F.xxhash64("token", F.least("block", "x"), F.greatest("block", "x"))
    rows = rows.select(key.alias("key"), "cid", "n", "label", "posted", F.shiftright("token", 32).cast("int").alias("k"), "block", "blocks", "x")
    # a task of one block meets all its pairs, a task of two those between the blocks
    rows = rows.withColumn("alone", F.col("block") == F.col("x")).drop("x", "blocks")
    rows = rows.join(leads.select("cid", "sig", "own_id", "own_hash"), "cid").repartition("key").sortWithinPartitions("key", "n", "cid")

    def run(batches):
        for table in grouped(batches):
            if table.num_rows:
                yield asked_rows(table, *counted(table, percent, matches))

    return rows.mapInArrow(tidy(run), ASKED)


def minhash_near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents with similar shingle sets; see ``near_rows``."""
    return near_rows(docs, size, percent, coordinates, matches).drop("text_hash")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is its component's smallest doc_id; all columns as they are.

    Repeated rows of such a document all stay: they are one document. Rows without words stay.
    """
    gone_id, gone_hash = unused(docs, "gone_id", "gone_hash")
    gone = near_rows(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & F.xxhash64("text").eqNullSafe(F.col(gone_hash))
    return docs.join(gone, same, "left_anti")


def near_rows(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 24) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts with A-Z as a-z. A set holds the distinct
    ``size``-word shingles, or all words as one where there are fewer. Two documents are linked
    when 100 * intersection >= ``percent`` * union. With ``coordinates`` 48 and ``matches`` 24 a
    pair at similarity 0.8 is a candidate with probability over 1 - 2e-6, one at 0.9 over 1 - 1e-13.

    A null or empty text has an empty set: linked with nothing, its own component. Rows with equal
    sets are one class, rows with equal doc_id and different texts are different documents with one
    id. A null doc_id never names a component that has another id. Empty tables give empty results.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.keep(signed(docs, size, coordinates), "signed")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    leads = rows.where("cid IS NOT NULL").groupBy("cid").agg(lead.alias("lead"), F.any_value("sig").alias("sig"), F.any_value("n_shingles").alias("n"))
    leads = tables.keep(leads.select("cid", "n", "sig", F.col("lead.doc_id").alias("own_id"), F.col("lead.text_hash").alias("own_hash")), "leads")
    prefix = tables.keep(posting_lists(leads, matches), "prefix")
    often = prefix.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token")
    lists = tables.keep(prefix.join(often, "token"), "lists")
    met = tables.keep(stars(lists, leads, percent, matches), "stars")
    state = components(tables, tables.keep(confirmed(star_rows(met), docs, size, percent), "links")).select(F.col("node").alias("cid"), "label")
    asked = tables.keep(crossed(lists, leads, state, percent, matches), "asked")
    over = components(tables, tables.keep(confirmed(asked, docs, size, percent), "links")).select(F.col("node").alias("label"), F.col("label").alias("to"))
    named = leads.select("cid", "own_id").join(state, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = named.join(over, "label", "left").select("cid", "own_id", F.coalesce("to", "label").alias("label"))
    ids = named.groupBy("label").agg(F.min("own_id").alias("component_id"))
    named = tables.keep(named.join(ids, "label").select("cid", "component_id"), "named")
    for old in (leads, prefix, lists, met, asked):
        tables.drop(old)
    out = rows.select("doc_id", "text_hash", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(documents(spark, sf_dir), size=2)


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
SQL: dict[str, str] = {}
