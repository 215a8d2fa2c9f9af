"""Language-model scoring by Katz backoff over word bigrams, learned from all training documents.

P(w | v) = d(r) r / c(v) where the pair was seen r times, else alpha(v) P(w). Counts up to ``K`` get Good-Turing
discounts, larger ones lose a fixed ``TAIL`` of a count, so that every history keeps mass for what it has not seen.
P(w) is discounted alike, and what is left goes to one class of unknown words. alpha(v) is exact: the mass that the
seen pairs of v leave, divided by what P(w) leaves outside of them. A document's start is the history "end".

Passes: (1) distinct words of every chunk meet by word; their counts go back to the chunk (table 1, in the shared folder).
(2) A chunk turns its documents into pairs and sends them, one entry per distinct pair with its documents, to the bucket
of the history. There all counts of a history meet; logs of what does not hang on the discounts are summed by document,
and what does is kept as counts of counts by document and by history (table 2, by kind). (3) Discounts follow from table 2,
then the backoff weights, and the sums by document. A history that is more frequent than a bucket's share is split by its
next words; its statistics are added up again before its weight is computed. A pair of two such words is split by chunk
as well; its parts are counted apart and take their place once a Spark aggregate has added the counts up (kind 4).

Following words are told apart by 48 bits of their hash within a history, histories by 64 bits. Cases: NULL and empty
texts are one end token; a NULL id is a training document; repeated rows count and are scored as often as they stand;
extra columns are not read; without training documents every token is unknown.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import query, stored, table
from .chunks import code_rows, documents_of, in_order, pack, unpack, word_rows
from .hashing import mix

K, TAIL = 5, 0.1
CHARS = 14_000_000
BUCKET_TOKENS = 2_500_000
END = b"\n"


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased; the end token is white space, so no word equals it."""
    return text.encode().lower().split()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def discounts(n: list[float], k: int = K) -> np.ndarray:
    """d(1) .. d(k) from the numbers of things seen 1 .. k + 1 times; where they give no share, r - 1/2 of r counts."""
    out = []
    cut = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


class Unigrams:
    """Base scores and discounted probabilities by count; everything follows from a few totals."""

    def __init__(self, total: float, distinct: float, n: list[float]):
        self.total, self.distinct = total, distinct
        self.d = discounts(n)
        low = sum(r * n[r - 1] * self.d[r - 1] for r in range(1, K + 1))
        high = total - sum(r * n[r - 1] for r in range(1, K + 1)) - TAIL * (distinct - sum(n[:K]))
        self.unknown = 1.0 - (low + high) / total if total else 1.0

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def probability(self, c: np.ndarray) -> np.ndarray:
        small = np.append(np.append(0.0, self.d * np.arange(1, K + 1)), 0.0)[np.minimum(c, K + 1)]
        p = np.where(c > K, c - TAIL, small) / max(self.total, 1.0)
        return np.where(c == 0, self.unknown, p)


def word_counts(docs: DataFrame) -> DataFrame:
    """Table 1: (chunk, codes, counts, hashes) packed by chunk and task, and rows of totals under chunk -1."""
    rows = word_rows(docs, _with_end, lambda doc: not held_out(doc), CHARS)
    rows = rows.select("chunk", "code", "word", F.sum("n").over(W.partitionBy("word")).alias("c"))

    def run(batches):
        import xxhash

        last, total, distinct, n = None, 0, 0, np.zeros(K + 1)
        parts: list[tuple] = []
        names = ["chunk", "codes", "counts", "hashes"]

        def batch():
            c, k, x, h = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((k, c))
            c, k, x, h = c[order], k[order], x[order], h[order]
            edges = np.append(np.flatnonzero(np.append(True, c[1:] != c[:-1])), len(c))
            rows = [(int(c[a]), pack(np.diff(k[a:b], prepend=0)), zlib.compress(pack(x[a:b]), 1), h[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names)

        size = 0
        for b in batches:
            words, counts = b.column(2).to_pylist(), b.column(3).to_numpy()
            hashes = np.empty(len(words), dtype=np.uint64)
            for k, w in enumerate(words):
                if w != last:
                    last, h = w, xxhash.xxh64_intdigest(w.encode())
                    if counts[k]:
                        total += int(counts[k])
                        distinct += 1
                        if counts[k] <= K + 1:
                            n[counts[k] - 1] += 1
                hashes[k] = h
            parts.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), counts, hashes))
            size += len(words)
            if size >= 200_000:
                yield batch()
                parts, size = [], 0
        if parts:
            yield batch()
        sums = np.array([total, distinct, *n], dtype=np.float64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([sums], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=names)

    return stored(rows.mapInArrow(run, "chunk long, codes binary, counts binary, hashes binary"))


def _with_end(text: str) -> list[bytes]:
    return [*tokens(text), END]


def _squeezed(x: np.ndarray) -> bytes:
    return zlib.compress(pack(x), 1)


def _loose(x: bytes) -> np.ndarray:
    return unpack(zlib.decompress(x))


def pair_rows(docs: DataFrame, counts: DataFrame, uni: Unigrams, buckets: int) -> DataFrame:
    """(bucket, chunk, data): per chunk and bucket its pairs, and one row of its documents (with an empty last part)."""
    share = max(1.0, uni.total / buckets)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = left["chunk"][0].as_py()
        codes = [np.cumsum(unpack(x)) for x in right["codes"].to_pylist()]
        codes = np.concatenate(codes) if codes else np.empty(0, np.int64)
        order = in_order(codes, left)
        join = lambda parts: (np.concatenate(parts) if parts else np.empty(0, np.int64))[order]
        c = join([_loose(x) for x in right["counts"].to_pylist()])
        h = join([np.frombuffer(x, dtype=np.uint64) for x in right["hashes"].to_pylist()])
        base, known = uni.base(c), c > 0
        ids, held, n_tokens, n_known, score, before, after, of = [], [], [], [], [], [], [], []
        for k, (doc, own) in enumerate(documents_of(left)):
            ids.append(doc)
            held.append(held_out(doc))
            n_tokens.append(len(own))
            n_known.append(int(known[own].sum()))
            score.append(float(base[own].sum()))
            own = own.astype(np.int32)
            before.append(np.append(own[-1:], own[:-1]))  # the last token is the end, which also stands before the first
            after.append(own)
            of.append(np.full(len(own), 2 * k + held[-1], dtype=np.int32))
        rows = [(int(mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), chunk, [np.array([-1 if x is None else x for x in ids], np.int64).tobytes(), bytes(x is None for x in ids), bytes(held), pack(np.array(n_tokens)), pack(np.array(n_known)), np.array(score).tobytes(), b""])]
        key = np.concatenate(before).astype(np.int64) << 32
        del before
        key |= np.concatenate(after)
        del after
        d = np.concatenate(of)
        del of
        # one entry per (pair, document), then per pair; documents are in order already
        order = np.argsort(key, kind="stable")
        key, d = key[order], d[order]
        new = np.append(True, (key[1:] != key[:-1]) | (d[1:] != d[:-1]))
        at = np.flatnonzero(new)
        times, key, d = np.diff(np.append(at, len(key))), key[at], d[at]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n_docs = np.diff(np.append(first, len(key)))
        pv, pw = key[first] >> 32, key[first] & 0xFFFFFFFF
        split = np.ceil(np.maximum(c[pv], 1) / share).astype(np.uint64)
        salt = np.uint64(chunk) % np.ceil(np.maximum(np.minimum(c[pv], c[pw]), 1) / share).astype(np.uint64)
        salt = mix(salt + np.uint64(1)) * (salt > 0)
        bucket = (mix(h[pv] + (h[pw] % split) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((pw, pv, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(order) else None
        found = range(buckets) if edges is not None else np.unique(bucket)
        for b in found:
            own = order[edges[b] : edges[b + 1]] if edges is not None else order[bucket[order] == b]
            if not len(own):
                continue
            entry = np.repeat(first[own] - (np.cumsum(n_docs[own]) - n_docs[own]), n_docs[own]) + np.arange(int(n_docs[own].sum()))
            x = pv[own]
            head = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            steps = d[entry].astype(np.int64)
            starts = np.cumsum(n_docs[own]) - n_docs[own]
            steps[1:] -= d[entry][:-1]
            steps[starts] = d[entry][starts]
            follow = (h[pw[own]] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((int(b), chunk, [h[x[head]].tobytes(), _squeezed(c[x[head]]), _squeezed(np.diff(np.append(head, len(x)))), follow, _squeezed(c[pw[own]]), _squeezed(n_docs[own]), _squeezed(steps), _squeezed(times[entry])]))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.list_(pa.binary()))})

    codes = code_rows(docs, _with_end, CHARS)
    return codes.groupBy("chunk").cogroup(counts.where("chunk >= 0").withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(run, "bucket long, chunk long, data array<binary>")


OUT = "kind int, key long, nums array<double>, data array<binary>"


def counted_pairs(pairs: DataFrame, uni: Unigrams, buckets: int) -> DataFrame:
    """Table 2: what a bucket knows. kind 0: sums by document; 1: the documents; 2: backed-off histories; 3: counts of counts; 4: parts of pairs that are split by chunk."""
    share = max(1.0, uni.total / buckets)

    def run(group: pa.Table) -> pa.Table:
        rows, parts, number = [], [], []
        for chunk, data in zip(group["chunk"].to_pylist(), group["data"].to_pylist()):
            if data[-1] == b"":
                rows.append((1, chunk, None, data))
            else:
                parts.append(data)
                number.append(chunk)
        if parts:
            rows += _bucket(parts, np.array(number), uni, share)
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.binary()))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("kind", "key", "nums", "data"), kinds))})

    return stored(pairs.groupBy("bucket").applyInArrow(run, OUT))


#: A bucket is counted in so many turns, each over some of its histories, so that little stands in memory at once.
TURNS = 4


def _bucket(parts, chunks, uni: Unigrams, share: float):
    vh, cv, wh, cw, n_docs, chunk, doc, times = [], [], [], [], [], [], [], []
    for k, p in enumerate(parts):
        n = _loose(p[2])
        vh.append(np.repeat(np.frombuffer(p[0], np.uint64), n))
        cv.append(np.repeat(_loose(p[1]), n))
        raw = np.zeros((len(p[3]) // 6, 8), dtype=np.uint8)
        raw[:, :6] = np.frombuffer(p[3], np.uint8).reshape(-1, 6)
        wh.append(raw.view(np.uint64).ravel())
        cw.append(_loose(p[4]))
        m = _loose(p[5])
        n_docs.append(m.astype(np.int32))
        steps = _loose(p[6])
        starts = np.cumsum(m) - m
        run = np.cumsum(steps)
        doc.append((run - np.repeat(run[starts] - steps[starts], m)).astype(np.int32))
        times.append(_loose(p[7]).astype(np.int32))
        chunk.append(np.full(len(steps), k, dtype=np.int32))
    columns = []
    for x in (vh, cv, wh, cw, n_docs, chunk, doc, times):
        columns.append(np.concatenate(x))
        x.clear()
    rows, sums, counts = [], [], np.zeros(K + 1)
    turn = (columns[0] >> np.uint64(11)) % np.uint64(TURNS)
    turn_of_event = np.repeat(turn, columns[4]).astype(np.uint8)
    for k in range(TURNS):
        some, events = turn == k, turn_of_event == k
        if some.any():
            pairs, own = [c[some] for c in columns[:5]], [c[events] for c in columns[5:]]
            hot = np.minimum(pairs[1], pairs[3]) > share
            if hot.any():
                at = np.repeat(hot, pairs[4])
                rows += _parts([c[hot] for c in pairs], [c[at] for c in own], chunks, uni)
                pairs, own = [c[~hot] for c in pairs], [c[~at] for c in own]
                if hot.all():
                    continue
            found = _histories(pairs, own, chunks, uni, share)
            rows += found[0]
            sums.append(found[1:4])
            counts += found[4]
    rows.append((3, 0, counts.tolist(), None))
    if not sums:
        return rows
    # sums by document
    docs, back = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate([x[1] for x in sums]), minlength=len(docs))
    hist = np.concatenate([x[2] for x in sums])
    hist = np.stack([np.bincount(back, weights=hist[:, k], minlength=len(docs)) for k in range(K)], axis=1).astype(np.int64)
    own = docs >> 40
    edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(docs))
    for a, b in zip(edges[:-1], edges[1:]):
        e = (docs[a:b] & ((1 << 40) - 1)) >> 1
        rows.append((0, int(chunks[own[a]]), None, [_squeezed(np.diff(e, prepend=0)), total[a:b].tobytes(), _squeezed(hist[a:b].ravel())]))
    return rows


def _parts(pairs, events, chunks, uni: Unigrams):
    """What a bucket has of pairs that others share: rows of kind 4 with c(v), P(w), this part's count, and the events."""
    vh, cv, wh, cw, n_docs = pairs
    chunk, doc, times = events
    keys, first, back = np.unique(np.column_stack([vh, wh]), axis=0, return_index=True, return_inverse=True)
    pair = np.repeat(back.ravel(), n_docs)
    order = np.argsort(pair, kind="stable")
    edges = np.searchsorted(pair[order], np.arange(len(keys) + 1))
    rows = []
    for k, (v, w) in enumerate(keys):
        at = order[edges[k] : edges[k + 1]]
        nums = [float(cv[first[k]]), float(uni.probability(cw[first[k] : first[k] + 1])[0]), float((times[at] * (1 - (doc[at] & 1))).sum())]
        rows.append((4, int(v.view(np.int64)), nums, [w.tobytes(), *_events(np.zeros(len(at), np.int64), chunks[chunk[at]], doc[at] >> 1, times[at])]))
    return rows


def merged_parts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, w, c, p, r): the pairs that are split by chunk with their counts; their parts with the same columns and events."""
    rows = found.where("kind = 4").select("key", F.get("data", F.lit(0)).alias("w"), "nums", "data")
    c, p, r = (F.get("nums", F.lit(k)) for k in range(3))
    whole = rows.groupBy("key", "w").agg(F.max(c).alias("c"), F.max(p).alias("p"), F.sum(r).alias("r"))
    return whole, rows.drop("nums").join(whole, ["key", "w"])


def split_pairs(parts: DataFrame) -> DataFrame:
    """(kind, key, data) like kind 0 from the parts of pairs, once their counts are whole."""

    def run(batches):
        for b in batches:
            out = []
            for c, p, r, data in zip(*(b.column(k).to_pylist() for k in range(4))):
                log = math.log10(p) if r == 0 else math.log10(r / c if r <= K else (r - TAIL) / c)
                chunk, doc, times = np.frombuffer(zlib.decompress(data[2]), np.int64), _loose(data[3]), _loose(data[4])
                edges = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    own, back = np.unique(doc[lo:hi], return_inverse=True)
                    n = np.bincount(back, weights=times[lo:hi], minlength=len(own))
                    hist = np.zeros((len(own) if 0 < r <= K else 0, K), np.int64)
                    if len(hist):
                        hist[:, int(r) - 1] = n
                    out.append((int(chunk[lo]), [_squeezed(np.diff(own, prepend=0)), (n * log).tobytes(), _squeezed(hist.ravel())]))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.binary()))], names=["kind", "key", "data"])

    return parts.select("c", "p", "r", "data").mapInArrow(run, "kind int, key long, data array<binary>")


def _histories(pairs, events, chunks, uni: Unigrams, share: float):
    """Some whole histories of a bucket: rows of kind 2; places of documents, their sums and counts; counts of counts."""
    vh, cv, wh, cw, n_docs = pairs
    chunk, doc, times = events
    order = np.lexsort((wh, vh))
    new_v = np.append(True, vh[order][1:] != vh[order][:-1])
    new = new_v | np.append(True, wh[order][1:] != wh[order][:-1])
    pair = np.empty(len(order), dtype=np.int64)
    pair[order] = np.cumsum(new) - 1
    head = order[new]  # one row of each pair
    event = np.repeat(pair, n_docs)
    held = doc & 1
    r = np.bincount(event, weights=times * (1 - held), minlength=len(head)).astype(np.int64)
    history = np.cumsum(new_v[new]) - 1  # by pair
    first = head[new_v[new]]  # one row of each history
    p_word = uni.probability(cw[head])
    c = cv[head]
    seen = r > 0
    known = c > 0
    log = np.zeros(len(head))
    low = seen & (r <= K)
    log[low] = np.log10(r[low] / c[low])
    high = r > K
    log[high] = np.log10((r[high] - TAIL) / c[high])
    log[~seen] = np.log10(p_word[~seen])
    docs, back = np.unique(chunk.astype(np.int64) << 40 | doc, return_inverse=True)
    total = np.bincount(back, weights=times * log[event], minlength=len(docs))
    hist = np.stack([np.bincount(back, weights=times * (r[event] == k), minlength=len(docs)) for k in range(1, K + 1)], axis=1).astype(np.int32)
    # histories that were backed off from, or that other buckets share
    rows = []
    lost = ~seen[event] & known[event]
    stats = np.stack([np.bincount(history, weights=x, minlength=len(first)) for x in (high * (r - TAIL), *[(r == k) for k in range(1, K + 1)], seen * p_word)], axis=1)
    many = np.ceil(cv[first] / share) > 1
    keep = np.zeros(len(first), dtype=bool)
    keep[history[event[lost]]] = True
    one = lost & ~many[history[event]]
    if one.any():
        used = np.flatnonzero(keep & ~many)
        rows.append((2, 0, None, [np.column_stack([cv[first[used]], stats[used]]).astype(np.float64).tobytes(), *_events(np.searchsorted(used, history[event[one]]), chunks[chunk[one]], doc[one] >> 1, times[one])]))
    for v in np.flatnonzero(many):
        at = lost & (history[event] == v)
        rows.append((2, int(vh[first[v]].view(np.int64)), [float(cv[first[v]]), *stats[v].tolist()], [b"", *_events(np.zeros(int(at.sum()), np.int64), chunks[chunk[at]], doc[at] >> 1, times[at])]))
    return rows, docs, total, hist, np.array([(r == k).sum() for k in range(1, K + 2)], dtype=np.float64)


def _events(history, chunk, doc, times):
    order = np.lexsort((history, doc, chunk))
    return [_squeezed(history[order]), zlib.compress(chunk[order].astype(np.int64).tobytes(), 1), _squeezed(doc[order]), _squeezed(times[order])]


def backed_off(found: DataFrame, d: np.ndarray) -> DataFrame:
    """(key, nums, data) like kind 0: by chunk and document the logs of the backoff weights."""
    rows = found.where("kind = 2").select("key", "nums", "data")
    shared = rows.where("nums IS NOT NULL")
    n = K + 3
    pairs, parts = merged_parts(found)
    zero = F.lit(0.0)
    own = [F.when(F.col("r") > K, F.col("r") - TAIL).otherwise(zero), *[F.when(F.col("r") == k, 1.0).otherwise(zero) for k in range(1, K + 1)], F.when(F.col("r") > 0, F.col("p")).otherwise(zero)]
    stats = shared.select("key", "nums").unionByName(pairs.select("key", F.array("c", *own).alias("nums")))
    unseen = parts.where("r = 0").select("key", "data")
    sums = stats.groupBy("key").agg(F.array(F.max(F.get("nums", F.lit(0))), *[F.sum(F.get("nums", F.lit(k))) for k in range(1, n)]).alias("all"))
    whole = shared.drop("nums").unionByName(unseen).join(sums, "key").select("key", F.col("all").alias("nums"), "data").unionByName(rows.where("nums IS NULL"))

    def run(batches):
        for b in batches:
            out = []
            for nums, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                stats = np.array([nums]) if nums is not None else np.frombuffer(data[0], np.float64).reshape(-1, n)
                mass = 1.0 - (stats[:, 1] + stats[:, 2 : 2 + K] @ (d * np.arange(1, K + 1))) / stats[:, 0]
                alpha = np.log10(np.maximum(mass, 1e-300) / np.maximum(1.0 - stats[:, -1], 1e-300))
                history, chunk, doc, times = _loose(data[1]), np.frombuffer(zlib.decompress(data[2]), np.int64), _loose(data[3]), _loose(data[4])
                if not len(doc):
                    continue
                edges = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    own, back = np.unique(doc[lo:hi], return_inverse=True)
                    out.append((int(chunk[lo]), [_squeezed(np.diff(own, prepend=0)), np.bincount(back, weights=times[lo:hi] * alpha[history[lo:hi]], minlength=len(own)).tobytes(), zlib.compress(b"", 1)]))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.binary()))], names=["kind", "key", "data"])

    return whole.mapInArrow(run, "kind int, key long, data array<binary>")


def score(docs: DataFrame, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    counts = word_counts(docs)
    sums = np.sum([np.zeros(K + 3), *[np.frombuffer(r.codes, np.float64) for r in counts.where("chunk < 0").select("codes").collect()]], axis=0)
    uni = Unigrams(float(sums[0]), float(sums[1]), sums[2:].tolist())
    buckets = max(1, math.ceil(1.25 * uni.total / bucket_tokens))
    found = counted_pairs(pair_rows(docs, counts, uni, buckets), uni, buckets)
    n = found.where("kind = 3").select(*[F.coalesce(F.sum(F.get("nums", F.lit(k))), F.lit(0.0)) for k in range(K + 1)]).first()
    pairs, parts = merged_parts(found)
    more = pairs.select(*[F.count(F.when(F.col("r") == k, 1)) for k in range(1, K + 2)]).first()
    d = discounts([a + b for a, b in zip(n, more)])
    train = int(uni.total)

    def run(group: pa.Table) -> pa.Table:
        docs, sums = None, []
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist()):
            if kind == 1:
                docs = data
            else:
                sums.append(data)
        ids, none = np.frombuffer(docs[0], np.int64), np.frombuffer(docs[1], np.uint8).astype(bool)
        logs, total = np.log10(d), np.zeros(len(ids))
        for places, part, hist in sums:
            at, h = np.cumsum(_loose(places)), _loose(hist)
            np.add.at(total, at, np.frombuffer(part, np.float64) + (h.reshape(-1, K) @ logs if len(h) else 0.0))
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=none),
                "held_out": pa.array(np.frombuffer(docs[2], np.uint8).astype(bool)),
                "n_tokens": pa.array(unpack(docs[3])),
                "n_known": pa.array(unpack(docs[4])),
                "train_tokens": pa.array(np.full(len(ids), train)),
                "base_score": pa.array(np.frombuffer(docs[5], np.float64)),
                "score": pa.array(total),
            }
        )

    rows = found.where("kind < 2").select("kind", "key", "data").unionByName(backed_off(found, d)).unionByName(split_pairs(parts))
    return rows.groupBy("key").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op5_katz_lm")
def op5_katz_lm(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
