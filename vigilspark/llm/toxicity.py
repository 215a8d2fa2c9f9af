"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, lower-cased and hashed into ``2**BITS``
places. Learning uses a sample of at most about ``SAMPLE`` labelled rows (a documented bound: rows whose id hash lies
below the share that gives that many), hashed where they lie and learned in one bounded group in a fixed order, with
per-coordinate rates; the L1 term leaves few weights, at most ``2**BITS``, which are broadcast. Scores are over whole
texts. Cases: NULL and empty texts have no features and get the bias alone; a document with several labels counts as
toxic if any says so; NULL labels and NULL ids teach nothing; without any labels every score is 0.5's left side (0).
Repeated rows get equal scores. Extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import query, table
from .hashing import WordHashes, pair

WORD = re.compile(r"\w+")
BITS = 20
SAMPLE = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.0, 3


def features(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted places of a text's words, pairs and skip pairs."""
    w = known.of(WORD.findall(text.lower())) if text else np.empty(0, np.uint64)
    kinds = [w, pair(w[:-1], w[1:]), pair(w[:-2] ^ np.uint64(0x5B), w[2:])]
    return np.unique((np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int32))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes in the given order."""
    size = 2**BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    # the bias is one more coordinate, without L1
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(at):
        d = z[at]
        return np.where(np.abs(d) <= l1[at], 0.0, -(d - np.sign(d) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for x, y in zip(rows, labels):
            at = np.append(x, size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            n0 = n[at]
            sigma = (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA
            z[at] += g - sigma * w
            n[at] = n0 + g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(places, weights, bias) from a bounded sample of the labelled rows outside the held-out fold."""
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    total = known.count()
    order = F.xxhash64("doc_id", F.lit("order"))
    if total > sample:
        share = sample / total
        known = known.where(F.shiftrightunsigned(order, 1).cast("double") < share * 2.0**63)
    picked = known.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"), order.alias("ord"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("ord", "toxic", "text")

    def hashed(batches):
        seen = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(x, seen) for x in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["ord", "toxic", "x"])

    def train(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.lexsort((np.fromiter(map(len, group["x"]), np.int64, len(group)), group["ord"].to_numpy()))
        flat = group["x"].chunk(0) if group.num_rows else pa.array([], pa.list_(pa.int32()))
        edges, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        w, bias = fit([values[edges[k] : edges[k + 1]] for k in order], group["toxic"].to_numpy()[order].astype(float))
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(at, -1), pa.int32()), "w": pa.array(np.append(w[at], bias), pa.float64())})

    found = rows.mapInArrow(hashed, "ord long, toxic int, x array<int>").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "at int, w double").toArrow()
    at, w = found["at"].to_numpy(), found["w"].to_numpy()
    bias = float(w[at < 0][0]) if (at < 0).any() else -35.0
    return at[at >= 0], w[at >= 0], bias


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        at, weight, bias = shared.value
        w = np.zeros(2**BITS)
        w[at] = weight
        seen = WordHashes()
        for b in batches:
            s = np.array([w[features(x, seen)].sum() + bias for x in b.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
