"""Substring dedup: repeated-phrase automata over words.

First the rounds of ``spans`` confirm which windows of words recur, and where each starts first.
Adjoining recurring windows form passages. The passages that can occur in a block of documents are
the patterns of that block's shard: an Aho-Corasick automaton of whole passages, with the smallest
id after which all its windows repeat. Every document of the block streams through the shard, and
each occurrence in a later document is removed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .spans import repeated_windows
from .words import word_values

GRAM = 5


def encoded(texts: list) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def passages(window: np.ndarray, own: int, width: int) -> list[tuple[int, int, int]]:
    """Runs of adjoining recurring windows: first word, word after the last, largest first document."""
    hit = np.flatnonzero(window < own)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    firsts, lasts = np.concatenate(([hit[0]], hit[cut + 1])), np.concatenate((hit[cut], [hit[-1]]))
    return [(i, j + width, int(window[i : j + 1].max())) for i, j in zip(firsts.tolist(), lasts.tolist())]


def shard(found: list[tuple[list[str], list[tuple[int, int, int]]]]):
    """The automaton of a block's passages, or None. A pattern is its words between single spaces.

    Documents can know different first documents of one passage; the smallest holds for all.
    """
    automaton = ahocorasick.Automaton()
    for words, spans in found:
        for i, j, after in spans:
            pattern = " " + " ".join(words[i:j]) + " "
            automaton.add_word(pattern, (j - i, min(after, automaton.get(pattern, (0, after))[1])))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def substring_dedup(docs: DataFrame, width: int = 13, keep_text: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """Remove each word covered by a ``width``-word window that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of whole texts, unchanged; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space, UTF-8); with
    ``keep_text`` also kept_text, those words.

    A null text has no words. A null doc_id counts as larger than all others. Rows with equal doc_id
    never remove words from one another. Texts of fewer words than ``width`` stay. Empty tables give
    empty results. Other columns are ignored.
    """

    def finish(table: pa.Table, ids: np.ndarray, first: list) -> pa.Table:
        raw = encoded(table.column("text").to_pylist())
        spans = {i: s for i, (w, own) in enumerate(zip(first, ids.tolist())) if (s := passages(w, own, width))}
        automaton = shard([([w.decode() for w in raw[i].split()], s) for i, s in spans.items()])
        n_words, n_removed, digests, texts = [], [], [], []
        for i, data in enumerate(raw):
            words, removed = data.split(), 0
            if automaton is not None and len(words) >= width:
                stream = f" {b' '.join(words).decode()} "
                hits = [(end, n) for end, (n, after) in automaton.iter(stream) if after < ids[i]]
                if hits:
                    lengths = np.array([len(w) for w in stream.split(" ")[1:-1]])
                    last = np.searchsorted(np.cumsum(lengths + 1), [end for end, _ in hits])
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, last - [n for _, n in hits] + 1, 1)
                    np.add.at(gone, last + 1, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(words)
            n_words.append(len(words) + removed)
            n_removed.append(removed)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode() if keep_text else None)
        cols = {"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(texts, pa.string())} if keep_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return repeated_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda texts: word_values(encoded(texts)), finish, schema, width, min(GRAM, width), block_bytes)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL: dict[str, str] = {}
