"""Suffix-array dedup: remove bytes of repeated strings, found by distributed prefix doubling.

See ``spans`` for the rounds: Spark sorts (rank, longer rank) pairs of positions and reranks only
positions whose shorter prefix is not unique, until the prefix has the threshold's length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import GOLDEN, documents, mix64
from .spans import repeated_windows

#: 64-bit values of the 256 bytes.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
GRAM = 20


def byte_tokens(texts: list) -> list[np.ndarray]:
    return [BYTE_VALUES[np.frombuffer((t or "").encode(), np.uint8)] for t in texts]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that starts at one of ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return np.cumsum(delta[:n]) > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Keep each UTF-8 character of which a byte stays."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    starts = np.flatnonzero(lead)
    return np.logical_and.reduceat(gone, starts)[char] if len(starts) else gone


def suffix_array_dedup(docs: DataFrame, length: int = 50, keep_text: bool = False, block_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, whole; strings never cross documents and are judged on the input.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept_text, in
    which a character stays whole if one of its bytes stays. ``carry`` names columns to be passed on.

    A null text is empty. A null doc_id counts as larger than all others. Rows with equal doc_id
    never remove bytes from one another (an id is not smaller than itself). Texts under ``length``
    bytes stay. Empty tables give empty results. Other columns are ignored.
    """

    def finish(table: pa.Table, ids: np.ndarray, first: list) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for i, text in enumerate(table.column("text").to_pylist()):
            raw = (text or "").encode()
            starts = np.flatnonzero(first[i] < ids[i])
            kept, removed, spans = raw, 0, 0
            if len(starts):
                data = np.frombuffer(raw, np.uint8)
                gone = covered(starts, length, len(raw))
                kept = data[~gone].tobytes()
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                text = data[~whole_characters(data, gone)].tobytes().decode() if keep_text else None
            for k, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), text)):
                out[k].append(v)
        cols = {c: table.column(c) for c in ("doc_id", *carry)} | {k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items() if keep_text or k != "kept_text"}
        return pa.table(cols)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    schema = docs.drop("text").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_sha256", "string")
    if keep_text:
        schema = schema.add("kept_text", "string")
    return repeated_windows(docs, byte_tokens, finish, schema, length, min(GRAM, length), block_bytes)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(documents(spark, sf_dir))


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
SQL: dict[str, str] = {}
