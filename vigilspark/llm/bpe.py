"""Byte-level BPE: distinct words meet once, are encoded once, and their ids go back to every position.

Encoding: texts are cut into pre-tokens by the tokenizer's pattern. Each chunk of documents sends its distinct words
into one global shuffle by word, where a word is encoded once; ids are joined back by (chunk, code), and every document,
which is a list of codes in order of position, is put together again. Decoding joins ids with the table of token bytes,
which is as large as the vocabulary and therefore broadcast.

A frequent word costs one row per chunk, not one per occurrence; the shuffle by word is a rebalance that adaptive
execution may split. Cases: NULL and empty texts have no tokens; NULL ids and repeated rows keep their rows (no join by
document); extra columns are not read; an id without token bytes raises an error. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from .base import query, table
from .chunks import code_rows, documents_of, in_order, pack, unpack, word_rows

KNOWN_WORDS = 300_000
#: Words whose ids are packed together, by chunk.
PACKED_WORDS = 200_000


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """A function that cuts a text by the pattern, compiled where it runs."""
    found = []

    def split(text: str) -> list[str]:
        if not found:
            import regex

            found.append(regex.compile(pattern))
        return found[0].findall(text)

    return split


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Pieces flat[start:start + size], one after the other."""
    total = int(sizes.sum())
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(chunk, codes, sizes, ids): words of a chunk met in one task, packed: steps between codes, numbers of ids, ids."""
    wide = f"<u{2 if max(ranks_of(path).values()) < 1 << 16 else 4}"

    def run(batches):
        import tiktoken

        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})._core_bpe
        ids: dict[str, bytes] = {}
        chunks, codes, out = [], [], []

        def batch():
            c, k = np.concatenate(chunks), np.concatenate(codes)
            order = np.lexsort((k, c))
            c, k = c[order], k[order]
            sizes = np.fromiter((len(out[i]) for i in order), dtype=np.int64, count=len(order)) // int(wide[2])
            edges = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            rows = [(int(c[lo]), pack(np.diff(k[lo:hi], prepend=0)), pack(sizes[lo:hi]), b"".join(out[i] for i in order[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:])]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=["chunk", "codes", "sizes", "ids"])

        for b in batches:
            chunks.append(b.column(0).to_numpy())
            codes.append(b.column(1).to_numpy().astype(np.int64))
            for w in b.column(2).to_pylist():
                x = ids.get(w)
                if x is None:
                    if len(ids) >= KNOWN_WORDS:
                        ids.clear()
                    x = ids[w] = np.array(bpe.encode_single_piece(w.encode()), dtype=wide).tobytes()
                out.append(x)
            if len(out) >= PACKED_WORDS:
                yield batch()
                chunks, codes, out = [], [], []
        if out:
            yield batch()

    return words.hint("rebalance", "word").mapInArrow(run, "chunk long, codes binary, sizes binary, ids binary")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    split = splitter(pattern)
    found = encode_words(word_rows(docs, split), path, pattern)

    wide = f"<u{2 if max(ranks_of(path).values()) < 1 << 16 else 4}"

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [np.cumsum(unpack(x)) for x in right["codes"].to_pylist()]
        sizes = [unpack(x) for x in right["sizes"].to_pylist()]
        codes, sizes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, sizes))
        flat = np.frombuffer(b"".join(right["ids"].to_pylist()), dtype=wide).astype(np.int32)
        starts, order = np.cumsum(sizes) - sizes, in_order(codes, left)
        starts, sizes = starts[order], sizes[order]
        docs, out, edges = [], [], [0]
        for doc, own in documents_of(left):
            docs.append(doc)
            out.append(gather(starts[own], sizes[own], flat))
            edges.append(edges[-1] + len(out[-1]))
        ids = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": ids.cast(pa.list_(pa.int32()))})

    return code_rows(docs, split).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>")


def token_bytes(path: str) -> list[bytes | None]:
    """The token-byte table: place k holds the bytes of token k."""
    ranks = ranks_of(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for b, k in ranks.items():
        out[k] = b
    return out


def _decoder(encoded: DataFrame, path: str, columns, kinds):
    """Decode every row; ``columns(doc_id, ids, data)`` gives the values of ``kinds``, pairs of name and Arrow type."""
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(path))

    def run(batches):
        joined = pa.array(shared.value, pa.large_binary())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])
        for b in batches:
            lists, rows, size = b.column(1), [], 0
            for k in range(b.num_rows):
                ids = lists[k].values if lists[k].is_valid else pa.array([], pa.int32())
                pieces = joined.take(ids)
                if pieces.null_count:
                    raise ValueError("an id has no token bytes")
                data = b"".join(pieces.to_pylist()) if len(pieces) < 16 else _joined(pieces)
                rows.append(columns(b.column(0)[k].as_py(), ids, data))
                size += len(data)
                if size >= 8_000_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return encoded.select("doc_id", "ids").mapInArrow(run, from_arrow_schema(pa.schema(kinds)))


def _joined(pieces: pa.Array) -> bytes:
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    return pieces.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, data): the bytes of every document."""
    return _decoder(encoded, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), lambda doc, ids, data: (doc, data), [("doc_id", pa.int64()), ("data", pa.binary())])


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents, decoding each of them."""

    def columns(doc, ids, data):
        raw = ids.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        return doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(data).hexdigest()

    return _decoder(encoded, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), columns, [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@query("op4_byte_bpe")
def op4_byte_bpe(spark, sf_dir):
    return digest(encode(table(spark, sf_dir, "documents")))
