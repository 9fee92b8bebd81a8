"""What the training-data operators share: the scratch folder, written tables and block counts."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Odd multipliers of the 64-bit mixers (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the sieve through which texts go before they are exchanged.
SIEVE = 1 << 25


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` of the session names the shared folder. Only a purely local
    session (one machine) may go without it and gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(scratch_dir, "own", None)
        if base is None:
            base = scratch_dir.own = tempfile.mkdtemp(prefix="loomgraph-")
    return f"{base.rstrip('/')}/loomgraph-{uuid.uuid4().hex}"


class Tables:
    """Written tables that cut lineage, in one scratch folder of a run."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.folder, self.count = spark, scratch_dir(spark), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back with the schema it was written with."""
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later result reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._loom_path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


#: What a worker keeps from task to task, by the name of the operator: how to forget it.
KEPT: dict[str, Callable] = {}


def give_back(keep: str = "") -> None:
    """Forget what other operators than ``keep`` have kept in this worker, and hand freed memory back to the system."""
    for name in list(KEPT):
        if name != keep:
            KEPT.pop(name)()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable, keep: str = "") -> Callable:
    """``run``, a function for mapInArrow, with give_back() before and after a task."""

    def tidied(batches):
        give_back(keep)
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return tidied


def tidy_group(run: Callable) -> Callable:
    """``run``, a function of one group for applyInArrow, with give_back() after it."""

    def tidied(table):
        try:
            return run(table)
        finally:
            give_back()

    return tidied


def tidy_pair(run: Callable) -> Callable:
    """``run``, a function of two groups for applyInArrow, with give_back() after it."""

    def tidied(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return tidied


def sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each hash, modulo SIEVE, of the rows of ``keys``. Its size is the same for any number of rows."""
    asked = keys.select((F.pmod(F.xxhash64(*keys.columns), F.lit(SIEVE)) + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part"))
    out = np.zeros((SIEVE >> 15, 4096), np.uint8)
    for part, bits in asked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h"))).collect():
        out[part - 1] = np.frombuffer(bytes(bits), np.uint8)
    return out.ravel()


def sieved(docs: DataFrame, wanted: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys`` and the compressed text of docs' rows whose keys may be in ``wanted``, as ``names``.

    Before texts are exchanged for a join, a sieve of a fixed size takes out most rows that would
    find no partner. The join decides; a full sieve only saves less.
    """
    bits = docs.sparkSession.sparkContext.broadcast(sieve(wanted))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            h = batch.column("h").to_numpy()
            batch = batch.filter(pa.array((bits.value[h >> 3] >> (h & 7) & 1).astype(bool)))
            packs = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(packs, pa.binary())], names)

    rows = docs.select(*keys, "text", F.pmod(F.xxhash64(*keys), F.lit(SIEVE)).alias("h"))
    schema = T.StructType()
    for name, key in zip(names, keys):
        schema = schema.add(name, rows.schema[key].dataType)
    return rows.mapInArrow(tidy(pack), schema.add(names[-1], "binary"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that df does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def parts_for(total: int, each: int) -> int:
    """How many parts of about ``each`` bytes hold ``total`` bytes."""
    return max(1, math.ceil(total / each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
