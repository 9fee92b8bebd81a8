"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of a paragraph.

A fingerprint is the tree in one line: ``root|section(paragraph[leaf.length,...],...),...``. Roots test
equality; two fingerprints are compared by walking down only where branches differ.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import documents, parts_for, text_bytes

#: A piece ends after a sentence, or at this many code points of one, in texts of every length.
PIECE = 12
SENTENCES = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
SECTION_BREAK = re.compile(r"(\n\s*\n)")
SHORT = 8


def node(kind: bytes, children: list[str]) -> str:
    return sha256(kind + "".join(children).encode()).hexdigest()


def pieces_of(line: str, most: int = PIECE) -> list[str]:
    out = []
    for sentence in SENTENCES.findall(line):
        if len(sentence) <= most:
            out.append(sentence)
        else:
            out += [sentence[k : k + most] for k in range(0, len(sentence), most)]
    return out


def leaf(piece: str) -> str:
    return sha256(b"\0" + piece.encode("utf-8", "surrogatepass")).hexdigest()


def branch(line: str) -> tuple[str, str]:
    """A paragraph's node and its part of the fingerprint."""
    pieces = pieces_of(line)
    leaves = [leaf(p) for p in pieces]
    own = node(b"\1", leaves)
    return own, f"{own[:SHORT]}[{','.join([f'{h[:SHORT]}.{len(p)}' for h, p in zip(leaves, pieces)])}]"


def fingerprint(text: str | None, known: dict[str, tuple[str, str]] | None = None, others: dict[str, tuple[str, str]] | None = None) -> str:
    """The tree of a text; a null text is empty. Equal texts, and only those, have equal roots.

    ``known`` gathers the branches of the text's paragraphs, and gives those that are in it, or in
    ``others``, already.
    """
    text = text or ""
    known = {} if known is None else known
    others = others or {}
    names, out = [], []
    for section in SECTION_BREAK.split(text):
        paragraphs, own = [], []
        for line in section.splitlines(keepends=True):
            name, part = known.get(line) or others.get(line) or known.setdefault(line, branch(line))
            own.append(name)
            paragraphs.append(part)
        names.append(node(b"\2", own))
        out.append(f"{names[-1][:SHORT]}({','.join(paragraphs)})")
    return f"{node(b'\3', names)}|{','.join(out)}"


PARAGRAPHS = re.compile(r"(\w+)\[(.*?)\]")


def differing(ours: list[tuple[str, str]], theirs: list[tuple[str, str]]) -> tuple[list[str], list[str], list[str]]:
    """Branches of two lists (name, what is below): what is below those in both, only in ours, only in theirs."""
    left = Counter(name for name, _ in theirs)
    both, only = [], []
    for name, below in ours:
        if left[name]:
            left[name] -= 1
            both.append(below)
        else:
            only.append(below)
    rest = []
    for name, below in reversed(theirs):
        if left[name]:
            left[name] -= 1
            rest.append(below)
    return both, only, rest


def weight(leaves: str) -> int:
    return sum(map(int, re.findall(r"\.(\d+)", leaves)))


def sections_of(tree: str) -> list[tuple[str, str]]:
    """(name, what is below) of a tree's sections."""
    return [tuple(x.split("(", 1)) for x in tree[:-1].split("),")] if tree else []


def paragraphs_of(belows: list[str]) -> list[tuple[str, str]]:
    """(name, leaves) of the paragraphs below sections."""
    return [tuple(x.split("[", 1)) for below in belows if below for x in below[:-1].split("],")]


def likeness(a: str, b: str, total: int | None = None) -> float:
    """Share of the code points of two texts that stand in equal pieces, from their fingerprints: 0 to 1.

    ``total``: the code points of both texts, where known; else the pieces are added up.
    """
    (root_a, _, tree_a), (root_b, _, tree_b) = a.partition("|"), b.partition("|")
    if root_a == root_b:
        return 1.0
    both, ours, theirs = differing(sections_of(tree_a), sections_of(tree_b))
    common = sum(map(weight, both))
    both, ours, theirs = differing(paragraphs_of(ours), paragraphs_of(theirs))
    common += sum(map(weight, both))
    ours_left, theirs_left = (Counter(",".join(y).split(",")) for y in (ours, theirs))
    common += sum(int(x[SHORT + 1 :]) * min(ours_left[x], theirs_left[x]) for x in ours_left.keys() & theirs_left.keys() if x)
    total = weight(tree_a) + weight(tree_b) if total is None else total
    return min(1.0, 2 * common / total) if total else 1.0


def edits(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of the first text, from 0, whose branches the second one lacks."""
    there = Counter(name for name, _ in PARAGRAPHS.findall(b))
    out = []
    for k, (name, _) in enumerate(PARAGRAPHS.findall(a)):
        there[name] -= 1
        if there[name] < 0:
            out.append(k)
    return out


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id, text: str, own: str, known: dict, after: str, after_print: str, after_known: dict) -> tuple:
    """A document's row, given the next document's text, fingerprint and branches: most paragraphs of the edited text are among theirs."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    print_ = own if edited == text else fingerprint(edited, known, after_known)
    return doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_, len(text) + len(edited)), likeness(own, after_print, len(text) + len(after))


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in COLUMNS.split(", ")])


def merkle_fingerprints(docs: DataFrame, part_bytes: int = 2 << 20) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending doc_id; after the last comes the first. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents go to ranges of doc_id, at most 20,000, whose largest ids are quantiles of all ids.
    The first document of each range goes to the range before too, behind its last document, so that
    each range can be walked by itself and texts move once.

    A null text is empty; a null doc_id comes last. Rows with equal doc_id come in ascending order
    of their texts. A lone document is its own next. Empty tables give empty results. Other columns
    are ignored.
    """
    ship(docs.sparkSession)
    parts = min(20_000, parts_for(text_bytes(docs), part_bytes))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    quantiles = F.percentile_approx("doc_id", [k / parts for k in range(1, parts + 1)], 100 * parts)
    tops = np.array(sorted(set(docs.agg(quantiles).first()[0] or [])), np.int64)  # each is an id of the table

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            # range 0 holds the largest ids; ids that are null go to the last range
            at = np.searchsorted(tops, values)
            part = np.where(known, len(tops) - 1 - at, max(0, len(tops) - 1)).astype(np.int32)
            first = np.flatnonzero(known & (tops[np.minimum(at, len(tops) - 1)] == values)) if len(tops) else np.zeros(0, int)
            yield dealt(batch, part, False)
            if len(first):
                yield dealt(batch.take(pa.array(first)), ((part[first] - 1) % len(tops)).astype(np.int32), True)

    def dealt(batch: pa.RecordBatch, part: np.ndarray, after: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array([after] * len(part)), batch.column("doc_id"), batch.column("text")], ["part", "after", "doc_id", "text"])

    def walk(batches):
        last = first = done = None  # last: the document that waits for its next one
        for batch in batches:
            rows = []
            for part, after, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] != part:
                    rows.append(compared(*last[1:], *first))
                    last = None
                if part == done:
                    continue
                known: dict[str, tuple[str, str]] = {}
                own = fingerprint(text, known)
                if last is not None:
                    rows.append(compared(*last[1:], text, own, known))
                else:
                    first = (text, own, known)
                done, last = (part, None) if after else (done, (part, doc_id, text, own, known))
            yield table_of(rows)
        if last is not None:
            yield table_of([compared(*last[1:], *first)])

    laid = docs.mapInArrow(deal, "part int, after boolean, doc_id long, text string").repartition(parts, "part")
    return laid.sortWithinPartitions("part", "after", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(walk, COLUMNS)


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fingerprints(documents(spark, sf_dir))


QUERIES = {"op10_merkle_fingerprints": op10_merkle_fingerprints}
SQL: dict[str, str] = {}
