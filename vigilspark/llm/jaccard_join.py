"""N-gram Jaccard join: MinHash bands give candidates, Bayes prunes them, the rest is verified exactly.

1. Every text becomes its set of five-word runs, a 128-bit fingerprint of that set and ``BANDS * ROWS`` MinHash values.
   Texts with equal sets form a class; all further work is on classes, so copies cost one aggregated row.
2. Classes that share a band meet in a bucket. A large bucket is cut into parts by hash, and each pair of parts is a work
   item of bounded size. A pair of classes is looked at only in the first band it shares.
3. In an item MinHash values are compared ``STEP`` at a time; a pair is dropped as soon as the posterior probability
   (uniform prior) that its similarity reaches the threshold falls below ``TOLERANCE``.
4. What is left is verified on the texts, item by item: exact sizes of intersections from bit sets. An item returns, per
   class, how many documents it is linked to, and a spanning star of its links, never all pairs as rows.
5. Classes connected by links share a ``class_id``, the smallest doc_id among them; smallest labels spread along the stars,
   with pointer jumping, each round cut by a table in the shared folder.

At a similarity of 0.8, ``BANDS = 20`` bands of 4 values miss a pair with probability 3e-5. Cases: NULL, empty and wordless
texts are linked to nothing and keep their own id; shorter texts than five words are one run of all their words; case and
white space do not matter, punctuation does. Repeated rows are copies of each other. NULL ids take part, and a class
whose ids are all NULL has a NULL class_id. Extra columns pass through ``keep_documents``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import packed, query, stored, table, text_or_empty
from .hashing import WordHashes, grams

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
STEP, TOLERANCE = 16, 1e-5
PART_CLASSES, PART_RUNS = 512, 1_000_000


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs of a text."""
    return np.unique(grams(known.of(text.lower().split()), GRAM)) if text else np.empty(0, np.uint64)


def multipliers() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(k), seed=7) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)


def minhash(own: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.full(len(by), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(own), 4096):
        out = np.minimum(out, ((own[k : k + 4096][None, :] * by[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values the fewest matches at which a pair stays."""

    def tail(m: int, n: int) -> float:
        # P(similarity >= threshold) under Beta(m + 1, n - m + 1): the chance of at most m successes in n + 1 draws
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, BANDS * ROWS + 1, STEP)}


def sketches(docs: DataFrame) -> DataFrame:
    """(id, th, cid, runs, sig) per row; cid (the class) is NULL for texts without words."""

    def run(batches):
        known, by = WordHashes(), multipliers()
        for b in batches:
            cid, n, sig = [], [], []
            for x in b.column(2).to_pylist():
                own = shingles(x, known)
                n.append(len(own))
                cid.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                sig.append(minhash(own, by).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cid, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["id", "th", "cid", "runs", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), "text")
    return rows.mapInArrow(run, "id long, th long, cid binary, runs long, sig binary")


def work_items(classes: DataFrame) -> DataFrame:
    """(item, side, cid, size, sig): the classes of every pair of parts of every bucket with two classes or more."""
    width = 4 * ROWS
    bands = classes.select("cid", "runs", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select("cid", "runs", "band", F.xxhash64(F.substring("sig", F.col("band") * width + 1, F.lit(width))).alias("key"))
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("runs").alias("all_runs")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / PART_CLASSES), F.ceil(F.col("all_runs") / PART_RUNS)).cast("int")
    members = bands.select("band", "key", "cid").join(buckets.select("band", "key", parts.alias("parts")), ["band", "key"])
    members = members.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    members = members.join(classes.select("cid", "size", "sig"), "cid")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    items = members.select("cid", "size", "sig", "band", "key", "part", other.alias("other"))
    return items.select(F.struct("band", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).alias("item"), "part", "cid", "size", "sig").select(F.to_json("item").alias("item"), F.col("item.band").alias("band"), "part", F.col("item.a").alias("a"), F.col("item.b").alias("b"), "cid", "size", "sig")


def pruned(items: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(item, cids, sizes, left, right): classes with candidates in an item, and the candidates as numbers into ``cids``."""
    least = least_matches(threshold, tolerance)

    def run(group: pa.Table) -> pa.Table:
        band, a, b = (group[c][0].as_py() for c in ("band", "a", "b"))
        cids = group["cid"].to_pylist()
        order = sorted(range(len(cids)), key=cids.__getitem__)
        part = group["part"].to_numpy()[order]
        sig = np.frombuffer(b"".join(group["sig"].take(pa.array(order)).to_pylist()), dtype=np.uint32).reshape(len(order), -1)
        whole = sig.reshape(len(order), BANDS, ROWS)
        pairs = []
        for k in range(len(order) - 1):
            near = np.arange(k + 1, len(order))
            if a != b:
                near = near[part[near] != part[k]]
            if band and len(near):
                near = near[~(whole[near, :band] == whole[k, :band]).all(axis=2).any(axis=1)]
            near = near[(whole[near, band] == whole[k, band]).all(axis=1)]
            matches, done = np.zeros(len(near), dtype=np.int64), 0
            for n, m in least.items():
                if not len(near):
                    break
                matches += (sig[near, done:n] == sig[k, done:n]).sum(axis=1)
                near, matches, done = near[matches >= m], matches[matches >= m], n
            if len(near):
                pairs.append((np.full(len(near), k, np.int32), near.astype(np.int32)))
        if not pairs:
            return pa.table({"item": pa.array([], pa.string()), "cids": pa.array([], pa.list_(pa.binary())), "sizes": pa.array([], pa.list_(pa.int64())), "pairs": pa.array([], pa.binary())})
        left, right = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        size = group["size"].to_numpy()[order]
        return pa.table({"item": [group["item"][0].as_py()], "cids": pa.array([[cids[order[k]] for k in used]], pa.list_(pa.binary())), "sizes": pa.array([size[used].tolist()], pa.list_(pa.int64())), "pairs": pa.array([place.astype("<i4").tobytes()], pa.binary())})

    return items.groupBy("item").applyInArrow(run, "item string, cids array<binary>, sizes array<long>, pairs binary")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 1 << 19) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right], from bit sets over blocks of values."""
    values = np.unique(np.concatenate(sets))
    out = np.zeros(len(left), dtype=np.int64)
    places = [np.searchsorted(values, s) for s in sets]
    first = np.searchsorted(left, np.arange(len(sets) + 1))  # left is sorted
    for lo in range(0, len(values), columns):
        hi = min(lo + columns, len(values))
        bits = np.zeros((len(sets), -(-(hi - lo) // 64) * 64), dtype=bool) if (hi - lo) * len(sets) <= 64_000_000 else None
        if bits is None:  # too many for one byte a place: pack set by set
            packed_bits = np.stack([_bits(p[(p >= lo) & (p < hi)] - lo, hi - lo) for p in places])
        else:
            for k, p in enumerate(places):
                bits[k, p[(p >= lo) & (p < hi)] - lo] = True
            packed_bits = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(len(sets)):
            if first[k] < first[k + 1]:
                for at in range(first[k], first[k + 1], 256):
                    to = min(at + 256, first[k + 1])
                    out[at:to] += np.bitwise_count(packed_bits[right[at:to]] & packed_bits[k]).sum(axis=1, dtype=np.int64)
    return out


def _bits(places: np.ndarray, width: int) -> np.ndarray:
    row = np.zeros(-(-width // 64) * 64, dtype=bool)
    row[places] = True
    return np.packbits(row).view(np.uint64)


def verified(candidates: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, hub, links): per item and class the documents it is linked to, and a class of the same star."""
    asked = candidates.select(F.col("item").alias("of"), F.explode("cids").alias("cid")).join(texts, "cid")

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"cid": pa.array([], pa.binary()), "hub": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
        if not pairs.num_rows:
            return empty
        cids, sizes = pairs["cids"][0].as_py(), np.array(pairs["sizes"][0].as_py(), dtype=np.int64)
        left, right = np.frombuffer(pairs["pairs"][0].as_py(), dtype="<i4").reshape(2, -1)
        known = WordHashes()
        found = {c: shingles(t, known) for c, t in zip(rows["cid"].to_pylist(), rows["text"].to_pylist())}
        sets = [found[c] for c in cids]
        n = np.array([len(s) for s in sets])
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        both = intersections(sets, left, right)
        good = both >= threshold * (n[left] + n[right] - both) - 1e-9
        left, right = left[good], right[good]
        if not len(left):
            return empty
        links = np.bincount(left, weights=sizes[right], minlength=len(cids)) + np.bincount(right, weights=sizes[left], minlength=len(cids))
        hub = np.arange(len(cids))
        while True:
            before = hub.copy()
            np.minimum.at(hub, left, hub[right])
            np.minimum.at(hub, right, hub[left])
            hub = hub[hub]
            if (hub == before).all():
                break
        own = np.flatnonzero(links)
        return pa.table({"cid": pa.array([cids[k] for k in own], pa.binary()), "hub": pa.array([cids[hub[k]] for k in own], pa.binary()), "links": pa.array(links[own].astype(np.int64))})

    return candidates.groupBy("item").cogroup(asked.groupBy("of")).applyInArrow(run, "cid binary, hub binary, links long")


def components(links: DataFrame) -> DataFrame:
    """(cid, label): the smallest class that each linked class is connected to."""
    pairs = links.where("cid <> hub").select("cid", "hub").distinct()
    edges = stored(pairs.union(pairs.select(F.col("hub").alias("cid"), F.col("cid").alias("hub"))))
    labels = stored(edges.groupBy("cid").agg(F.least(F.col("cid"), F.min("hub")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("cid").alias("hub"), F.col("label").alias("theirs")), "hub").groupBy("cid").agg(F.min("theirs").alias("theirs"))
        jump = labels.select(F.col("cid").alias("label"), F.col("label").alias("further"))
        new = labels.join(near, "cid").join(jump, "label", "left").select("cid", F.least("label", "theirs", "further").alias("label"), (F.least("theirs", "further") < F.col("label")).alias("moved"))
        new = stored(new)
        labels = new.select("cid", "label")
        if new.where("moved").isEmpty():
            return labels


def similar(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, th, class_id, first, n_copies, n_links) for every row.

    class_id: smallest id in the group of connected documents; first: whether (id, th) is the group's smallest row;
    n_copies: rows with the same set of runs; n_links: other rows at or above the threshold, copies included.
    """
    rows = stored(sketches(docs))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("size"), F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("least_id"), F.max("runs").alias("runs"), F.max("sig").alias("sig"))
    classes = stored(classes)
    candidates = stored(pruned(work_items(classes), threshold, tolerance))
    wanted = candidates.select(F.explode("cids").alias("cid")).distinct()
    reps = classes.join(wanted, "cid", "left_semi").select("cid", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), "text")
    texts = own.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("cid", "text").dropDuplicates(["cid"])
    links = stored(verified(candidates, texts, threshold))
    total = links.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "size", "rep", "least_id").join(total, "cid", "left").join(components(links), "cid", "left")
    known = known.withColumn("label", F.coalesce("label", "cid"))
    groups = known.groupBy("label").agg(F.min("least_id").alias("class_id"), F.min("rep").alias("first_row"))
    known = known.join(groups, "label").select("cid", "size", F.coalesce("links", F.lit(0)).alias("links"), "class_id", "first_row")
    out = rows.select("id", "th", "cid").join(known, "cid", "left")
    return out.select(
        "id",
        "th",
        F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("cid").isNull() | F.struct("id", "th").eqNullSafe(F.col("first_row"))).alias("first"),
        F.coalesce("size", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
    )


def keep_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest (id, text hash), in the columns of ``docs``."""
    gone = similar(docs, threshold).where("NOT first").select(F.col("id").alias("gid"), F.col("th").alias("gth")).distinct()
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("th"))
    left = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left_anti")
    # rows with the same id and text are copies of each other; those without words stay
    has_words = F.rlike(F.coalesce("row.text", F.lit("")), F.lit(r"\S"))
    left = left.where(has_words).dropDuplicates(["id", "th"]).select("row").unionByName(left.where(~has_words).select("row"))
    return left.select("row.*")


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    out = similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")
