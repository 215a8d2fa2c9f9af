"""The toxicity learner against a plain FTRL-proximal over dictionaries, one coordinate at a time."""

import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vigilspark.llm import hashing, toxicity

SF = "/root/testdata/sf0.001"


def places(text):
    """Hashed words, pairs of neighbours and pairs with one word between, as places of the weight table."""
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    two = lambda a, b: int(hashing.pair(np.array([a], np.uint64), np.array([b], np.uint64))[0])
    found = [*h, *(two(a, b) for a, b in zip(h, h[1:])), *(two(a ^ 0x5B, b) for a, b in zip(h, h[2:]))]
    return sorted({x >> (64 - toxicity.BITS) for x in found})


def learned(rows):
    z, n = {}, {}

    def weight(k):
        d, l1 = z.get(k, 0.0), 0.0 if k == "bias" else toxicity.L1
        if abs(d) <= l1:
            return 0.0
        return -(d - math.copysign(l1, d)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {k: weight(k) for k in [*x, "bias"]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for k, v in w.items():
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * v
                n[k] = old + g * g
    return {k: weight(k) for k in z}


def test_scores_equal_a_plain_learner(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    order = {r.doc_id: r.o for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("order")).alias("o")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in texts}
    rows = [(places(texts[k]), float(known[k])) for k in sorted(known, key=order.get)]
    w = learned(rows)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in toxicity.op6_toxicity(spark, SF).collect()}
    assert len(got) == len(texts) and len(rows) > 30 and sum(1 for k, v in w.items() if v) > 1
    for k, text in texts.items():
        s = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.get(x, 0.0) for x in places(text)) + w["bias"]))))
        assert got[k][0] == (zlib.crc32(str(k).encode()) % 5 == 0) and abs(got[k][1] - s) < 1e-9 and got[k][2] == int(got[k][1] >= 0.5)
