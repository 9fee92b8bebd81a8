"""WARC archives: written as one gzip stream each, then normalised to a member a record with a sidecar index.

Archives lie in the shared folder. A task writes its files under a name of its own attempt and
returns the names; only returned names are read, so that a repeated or lost task leaves no trace in
the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Tables, scratch_dir

VERSION = b"WARC/1.1"
#: The date that every record bears (a fixed value: runs are repeatable).
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 4


def opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


def page_name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    value = name[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """A response, or a revisit whose payload another page's response holds."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": page_name(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(" " if c in "\r\n" else c for c in url)
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": page_name(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def inflated(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a piece at a time."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = inflate.decompress(data)
            if out:
                yield out
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break
    if out := inflate.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes, bytes]]:
    """(fields, block, whole record) of each record of an inflated archive."""
    held = bytearray()
    pieces = iter(pieces)

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"no record starts with {lines[0]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if not need(stop + 4):
            raise ValueError("an archive ends within a record")
        yield fields, bytes(held[end + 4 : stop]), bytes(held[: stop + 4])
        del held[: stop + 4]


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def written(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write pages (page_id, url, html, refers_to, revisit) as archives of one gzip stream; (path) of each."""

    def run(batches):
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        out = deflate = None
        size, done = 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    done.append(f"{base}/{uuid.uuid4().hex}.warc.gz")
                    out, deflate, size = fs.open_output_stream(done[-1], compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                data = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], r["revisit"])
                out.write(deflate.compress(data))
                size += len(data)
                if size >= roll_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return pages.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string")


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (path) with a gzip member for each record, beside a sidecar index; (path, index, n) of each.

    A line of the index is JSON: offset, length, id, type, digest of a record's member.
    """

    def run(batches):
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            got: list[tuple] = []
            for path in batch.column("path").to_pylist():
                new, offset, lines = f"{base}/{uuid.uuid4().hex}.member.warc.gz", 0, []
                with fs.open_input_stream(path, compression=None) as raw, fs.open_output_stream(new, compression=None) as out:
                    for fields, _, whole in records(inflated(raw)):
                        member = gzip_member(whole)
                        out.write(member)
                        lines.append(json.dumps({"offset": offset, "length": len(member), "id": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"]}))
                        offset += len(member)
                with fs.open_output_stream(f"{new}.idx") as out:
                    out.write("".join(f"{x}\n" for x in lines).encode())
                got.append((new, f"{new}.idx", len(lines)))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "index", "n"])

    return archives.mapInArrow(run, "path string, index string, n long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_back(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record of normalised archives (path, index), each read at its offset in the sidecar index.

    A response's digest is computed from its payload and must be the one it declares. A revisit has
    the digest and the length that it declares. ``payload``: with the payload of responses.
    """

    def run(batches):
        fs, _ = opened(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                with fs.open_input_stream(index) as f:
                    entries = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(path) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        ((fields, block, _),) = records(iter([zlib.decompress(f.read(e["length"]), 31)]))
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != declared):
                            raise ValueError(f"{fields['WARC-Record-ID']} in {path} is damaged")
                        refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page_of(fields["WARC-Record-ID"]), length, declared, kind, refers, body.decode() if payload and kind == "response" else None))
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    return archives.select("path", "index").mapInArrow(run, READ)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in READ.split(", ")])


def deduplicated(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with refers_to and revisit.

    Of pages with equal payloads of at least ``least_bytes`` bytes the largest page_id is the
    response. A group of copies, however large, is one row of the side that is joined.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.when(F.octet_length(html) >= least_bytes, F.sha1(html)).alias("digest"))
    first = own.where("digest IS NOT NULL").groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = own.join(first, F.col("digest") == F.col("of"), "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))


def warc_round_trip(pages: DataFrame, payload: bool = True) -> DataFrame:
    """Write pages as archives, normalise them, and read all records back; see READ for the columns.

    A null html is an empty payload, a null url leaves the target out. Rows with the response's own
    page_id are responses too. A null page_id is a revisit where its group has any page_id, else a
    response. Empty tables give no archives and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    tables, folder = Tables(spark), scratch_dir(spark)
    raw = tables.keep(written(deduplicated(pages), folder), "archives")
    spread = lambda df: df.repartition(max(1, spark.sparkContext.defaultParallelism * 2))
    members = tables.keep(normalised(spread(raw), folder), "members")
    return read_back(spread(members), folder, payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payload=False).drop("payload")


QUERIES = {"op1_warc": op1_warc}
SQL = {
    "op1_warc": """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
  SELECT payload_digest, max(page_id) AS best_id FROM own WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, own.payload_digest,
       CASE WHEN best_id IS NOT NULL AND page_id IS DISTINCT FROM best_id AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best_id AND payload_bytes >= 1000 THEN best_id END AS refers_to
FROM own LEFT JOIN best ON own.payload_digest = best.payload_digest
"""
}
