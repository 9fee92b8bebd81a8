"""Binary archives and string tables, read by path and content in Python workers."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def string_table(data: bytes, prefixed: bool) -> list[tuple[int, str]]:
    """(id, text) of a table: a count, a size, a directory of ids and offsets, then the texts.

    Texts end with NUL, or are led by a length that counts it.
    """
    count, _ = struct.unpack_from("<II", data)
    base, out = 8 + 8 * count, []
    for k in range(count):
        number, offset = struct.unpack_from("<II", data, 8 + 8 * k)
        at = base + offset
        if prefixed:
            (length,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + max(0, length - 1)]
        else:
            raw = data[at : data.index(b"\0", at)]
        out.append((number, raw.decode("utf-8", "replace")))
    return out


def archive_index(data: bytes) -> list[tuple[str, int, int, bool]]:
    """(path, offset, size, compressed) of the files of an archive of version 103 to 105."""
    magic, version, offset, flags, folders, files = struct.unpack_from("<4sIIIII", data)
    if magic != b"BSA\0":
        raise ValueError("not an archive")
    at, counts = offset, []
    for _ in range(folders):
        counts.append(struct.unpack_from("<QI", data, at)[1])
        at += 24 if version >= 105 else 16
    entries = []
    for count in counts:
        folder = ""
        if flags & 1:
            length = data[at]
            folder = data[at + 1 : at + length].decode("cp1252").replace("\\", "/")
            at += 1 + length
        for _ in range(count):
            _, size, start = struct.unpack_from("<QII", data, at)
            entries.append((folder, start, size & 0x3FFFFFFF, bool(size & 0x40000000) != bool(flags & 4)))
            at += 16
    names = data[at:].split(b"\0")[:files] if flags & 2 else [str(k).encode() for k in range(files)]
    return [(f"{folder}/{name.decode('cp1252')}".lstrip("/"), start, size, packed) for (folder, start, size, packed), name in zip(entries, names)]


def content_of(data: bytes, start: int, size: int, packed: bool) -> bytes:
    raw = data[start : start + size]
    if not packed:
        return raw
    try:
        return zlib.decompress(raw[4:])
    except zlib.error:
        return raw


def read_string_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, id, text) of string table files; kind is the suffix, ``strings`` are NUL-ended."""
    ship(spark)

    def run(frames):
        for pdf in frames:
            rows = [(p, p.rpartition(".")[2].lower(), i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in string_table(bytes(c), not p.lower().endswith(".strings"))]
            yield pd.DataFrame(rows, columns=["file", "kind", "id", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, kind string, id long, text string")


def merged_strings(tables: DataFrame) -> DataFrame:
    """(id, text): strings before ilstrings before dlstrings, of one kind the last file."""
    rank = F.when(F.col("kind") == "strings", 3).when(F.col("kind") == "ilstrings", 2).otherwise(1)
    return tables.groupBy("id").agg(F.max_by("text", F.struct(rank, "file")).alias("text"))


def read_archives(spark: SparkSession, path: str, like: str = "") -> DataFrame:
    """(archive, path, content) of archived files whose path holds ``like``, in any case."""
    ship(spark)

    def run(frames):
        for pdf in frames:
            for p, c in zip(pdf["path"], pdf["content"]):
                data = bytes(c)
                rows = [(p, name, content_of(data, *place)) for name, *place in archive_index(data) if like.lower() in name.lower()]
                yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, content binary")
