"""Texts as codes into chunk dictionaries.

A chunk is a run of documents of one task, cut when its dictionary holds ``WORDS`` different words or its texts ``CHARS``
characters. Words cross the network once per chunk instead of once per occurrence, and come back the same way with what
was found for them; the documents travel as short codes. Chunks follow from the order of the rows in the partitions of a
file scan, which a retried task reads alike; each code row carries the size of its dictionary so far, and a
dictionary that does not fit raises an error instead of giving a wrong result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, CHARS = 300_000, 24_000_000


def pack(codes: np.ndarray) -> bytes:
    """Non-negative whole numbers as bytes of seven bits each, low bits first, the last byte of a number under 128."""
    v = codes.astype(np.uint64)
    n = np.ones(len(v), dtype=np.int64)
    for k in range(1, 5):
        n += v >= np.uint64(1 << (7 * k))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.uint8)
    for k in range(5):
        own = n > k
        if not own.any():
            break
        out[at[own] + k] = ((v[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((n[own] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 128)
    start = np.append(0, ends[:-1] + 1)
    n = ends - start + 1
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(int(n.max())):
        own = n > k
        out[own] |= (b[start[own] + k].astype(np.int64) & 127) << (7 * k)
    return out


class Dictionary(dict):
    """word -> code in order of appearance."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def _chunks(batches, split, most=CHARS):
    """Yields (chunk, dictionary, [(doc_id, codes)]) part by part, and at the end of a chunk with its dictionary."""
    task = TaskContext.get()
    base = (task.partitionId() if task else 0) << 24
    words, chars, number = Dictionary(), 0, 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            tokens = split(text or "")
            codes = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            chars += len(text or "")
            yield base + number, words, doc, codes, False
            if len(words) >= WORDS or chars >= most:
                yield base + number, words, None, None, True
                words, chars, number = Dictionary(), 0, number + 1
    if chars or words:
        yield base + number, words, None, None, True


def word_rows(docs: DataFrame, split, counted=None, most: int = CHARS) -> DataFrame:
    """(chunk, code, word[, n]): the dictionary of every chunk; n: occurrences in documents that ``counted`` accepts."""

    def run(batches):
        names = ["chunk", "code", "word", *["n"] * (counted is not None)]
        n = np.zeros(WORDS, dtype=np.int64)
        for chunk, words, doc, codes, end in _chunks(batches, split, most):
            if not end:
                if len(words) > len(n):
                    n = np.append(n, np.zeros(len(words), dtype=np.int64))
                if counted and counted(doc):
                    np.add.at(n, codes, 1)
                continue
            listed = list(words)
            for k in range(0, len(listed), 50_000):
                part = listed[k : k + 50_000]
                columns = [pa.array(np.full(len(part), chunk)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(n[k : k + len(part)])] * (counted is not None)], names=names)
            n[:] = 0

    schema = "chunk long, code int, word string" + ", n long" * (counted is not None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def code_rows(docs: DataFrame, split, most: int = CHARS) -> DataFrame:
    """(chunk, at, docs, sizes, codes, known): runs of documents from the chunk's number ``at`` on: ids, sizes, codes.

    ``codes`` is compressed; ``known`` is the size of the dictionary that the run needs.
    """

    def run(batches):
        ids, sizes, parts, room, at, known, first = [], [], [], 0, None, 0, 0
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32())

        def batch():
            row = (at, first, ids, sizes, zlib.compress(b"".join(parts), 1), known)
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names=["chunk", "at", "docs", "sizes", "codes", "known"])

        for chunk, words, doc, codes, end in _chunks(batches, split, most):
            if not end:
                at, known = chunk, len(words)
                ids.append(doc)
                sizes.append(len(codes))
                parts.append(pack(codes))
                room += len(parts[-1]) + 16
            if ids and (end or room >= 1_000_000):
                yield batch()
                first = 0 if end else first + len(ids)
                ids, sizes, parts, room = [], [], [], 0
            elif end:
                first = 0
        if ids:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, at long, docs array<long>, sizes array<int>, codes binary, known int")


def documents_of(rows: pa.Table):
    """(doc_id, codes) of every document in the code rows of a chunk, in order."""
    rows = rows.sort_by("at")
    for ids, sizes, data in zip(rows["docs"].to_pylist(), rows["sizes"].to_pylist(), rows["codes"].to_pylist()):
        codes, lo = unpack(zlib.decompress(data)), 0
        for doc, n in zip(ids, sizes):
            yield doc, codes[lo : lo + n]
            lo += n


def in_order(codes: np.ndarray, rows: pa.Table) -> np.ndarray:
    """Places of a chunk's dictionary entries by code; every code is there once, and as many as the documents need."""
    order = np.argsort(codes, kind="stable")
    if not np.array_equal(codes[order], np.arange(len(codes))) or len(codes) != max(rows["known"].to_pylist(), default=0):
        raise RuntimeError("a chunk's dictionary does not fit its documents: the input changed between two reads")
    return order
