"""Benchmark decontamination: BM25 index of test items with block maxima, candidates verified by word overlap.

* Index: inverted lists of the items, weighted by BM25 and divided by the item's score against itself, so that a
  passage that holds all words of an item scores 1. Items are numbered and cut into blocks; per word the largest
  weight (WAND's upper bound) and the largest weight in each block (block-max) are kept.
* Query: every text is cut into windows of as many words as the longest item has; two neighbours form a passage, so
  an item inside the text lies inside a passage. The sum of upper bounds skips a passage, the sums of block maxima skip
  blocks, and in what is left items are scored one by one, best bound first. All above ``threshold`` are candidates.
* Verification: the question and the answer must each occur in the passage, by the share of their five-word runs or word
  by word in order with few edits: a fifth of the words, and two in a short part, but never more than half of it
  (``allowed``). So a part of one word must stand as it is. The answer is the item's last sentence (the second half if
  it has one sentence), the question the rest. The overlap given is the larger of the two shares.

Memory: the index is collected in parts of at most ``PART_WORDS`` postings, each broadcast and used for one pass, so its
size is bounded whatever the benchmark's size. Cases: NULL or empty texts and items give nothing; items with equal
texts are all reported; repeated documents give their rows each; extra columns pass through ``keep_documents``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import query, table

TOKEN = re.compile(r"[^\W_]+")
PART_WORDS = 200_000
BLOCKS = 64
K1, B = 1.2, 0.75
GRAM = 5
THRESHOLD = 0.5
OVERLAP = 0.8
CHARS = 4_000_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def halves(text: str) -> tuple[list[str], list[str]]:
    """(question, answer) words of an item."""
    sentences = [w for w in map(tokens, re.split(r"[.!?\n]+", text)) if w]
    if len(sentences) > 1:
        return [x for s in sentences[:-1] for x in s], sentences[-1]
    w = tokens(text)
    return w[: len(w) // 2], w[len(w) // 2 :]


def runs(w: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's runs of five words (fewer, if it is shorter) found in the passage; 1 for an empty part."""
    n = min(GRAM, len(part))
    if n == 0:
        return 1.0
    own = runs(part, n)
    return len(own & runs(passage, n)) / len(own)


def allowed(n: int, least: float) -> int:
    """Edits that a part of ``n`` words may have; none if everything is asked for."""
    return 0 if least >= 1 else max(int((1 - least) * n + 1e-9), min(2, n // 2))


def edits(part: list[str], passage: list[str]) -> int:
    """Fewest words to change, drop or insert so that the part stands somewhere in the passage."""
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(part, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(passage, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
    return min(row)


def verified(part: list[str], passage: list[str], least: float) -> tuple[bool, float]:
    """Whether the part occurs in the passage, and the overlap."""
    share = overlap(part, passage)
    if share >= least:
        return True, share
    most = allowed(len(part), least)
    common = (Counter(part) & Counter(passage)).total()  # no fewer edits than words that are missing
    if len(part) - common > most:
        return False, share
    n = edits(part, passage)
    return n <= most, max(share, 1 - n / len(part))


class Index:
    """One part of the inverted index."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float):
        self.items = [(i, *halves(t)) for i, t in items]
        counts = [Counter(tokens(t)) for _, t in items]
        self.width = max([1, *(sum(c.values()) for c in counts)])
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for k, c in enumerate(counts):
            length = sum(c.values())
            w = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean_words)) for t, f in c.items()}
            total = sum(w.values()) or 1.0
            for t, x in w.items():
                at = self.terms.setdefault(t, len(postings))
                if at == len(postings):
                    postings.append([])
                postings[at].append((k, x / total))
        self.size = -(-max(1, len(items)) // BLOCKS)
        self.block_max = np.zeros((max(1, len(postings)), -(-max(1, len(items)) // self.size)), dtype=np.float32)
        for at, p in enumerate(postings):
            for k, x in p:
                self.block_max[at, k // self.size] = max(self.block_max[at, k // self.size], x)
        self.block_max = np.nextafter(self.block_max, np.float32(2))  # never below the exact weight
        self.bound = self.block_max.max(axis=1)
        self.postings = postings

    @classmethod
    def of(cls, parts: dict) -> Index:
        """An index from its plain parts, as they are broadcast."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def candidates(self, texts: list[list[str]], threshold: float):
        """(text, passage words, item, score) of every passage and item at or above the threshold."""
        width, get = self.width, self.terms.get
        window, ids, first = [], [], [0]
        for w in texts:
            found = np.fromiter((get(x, -1) for x in w), dtype=np.int64, count=len(w))
            at = np.flatnonzero(found >= 0)
            window.append(at // width + first[-1])
            ids.append(found[at])
            first.append(first[-1] + max(1, -(-len(w) // width)))
        if not texts or not sum(map(len, ids)):
            return
        size = np.int64(len(self.bound))
        keys = np.unique(np.concatenate(window) * size + np.concatenate(ids))
        win, ids = keys // size, keys % size
        n = first[-1]
        edge = np.searchsorted(win, np.arange(n + 1))
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        alone = np.bincount(win, weights=self.bound[ids], minlength=n)
        last = np.append(owner[1:] != owner[:-1], True)
        both = alone + np.where(last, 0, np.append(alone[1:], 0))
        for v in np.flatnonzero(both >= threshold):
            t = owner[v]
            own = np.unique(ids[edge[v] : edge[v + 1 if last[v] else v + 2]])
            blocks = np.flatnonzero(self.block_max[own].sum(axis=0) >= threshold)
            if not len(blocks):
                continue
            wanted = set(blocks.tolist())
            score: dict[int, float] = defaultdict(float)
            left = float(self.bound[own].sum())
            for x in own[np.argsort(-self.bound[own], kind="stable")].tolist():
                for k, weight in self.postings[x]:
                    # a new item is worth starting only while what is left can still carry it over the threshold
                    if k // self.size in wanted and (k in score or left >= threshold):
                        score[k] += weight
                left -= float(self.bound[x])
            start = (v - first[t]) * width
            for k, s in score.items():
                if s >= threshold - 1e-9:
                    yield int(t), texts[t][start : start + 2 * width], self.items[k], s

    def matches(self, texts: list[str | None], threshold: float = THRESHOLD, least: float = OVERLAP) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item) -> (score, question overlap, answer overlap) of the best verified passage."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        for t, passage, (item, question, answer), score in self.candidates([tokens(x) for x in texts], threshold):
            found, q = verified(question, passage, least)
            if not found:
                continue
            found, a = verified(answer, passage, least)
            if found:
                out[t, item] = max(out.get((t, item), (0.0, 0.0, 0.0)), (score, q, a))
        return out


def indexes(benchmark: DataFrame):
    """The index in parts of bounded size; document frequencies and mean length are over all items."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    n, total = items.select(F.count("*"), F.coalesce(F.sum(F.size(w)), F.lit(0))).first()
    parts = max(1, -(-total // PART_WORDS))
    for part in range(parts):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()]
        rows = [r for r in rows if tokens(r[1])]
        if not rows:
            continue
        own = {t for _, x in rows for t in tokens(x)}
        if parts == 1:
            df = Counter(t for _, x in rows for t in set(tokens(x)))
        else:  # words of this part only; counted over all items where they lie
            seen = items.select(F.explode(F.array_distinct(w)).alias("w")).groupBy("w").count()
            wanted = items.sparkSession.createDataFrame([(t,) for t in own], "w string")
            df = {t: 1 for t in own} | {r.w: r["count"] for r in seen.join(wanted, "w", "left_semi").collect()}
        yield Index(rows, df, n, max(1.0, total / max(1, n)))


def _groups(column: pa.ChunkedArray | pa.Array):
    """Runs of rows with about CHARS characters."""
    texts, at, size = [], 0, 0
    for k, x in enumerate(column.to_pylist()):
        texts.append(x)
        size += len(x or "")
        if size >= CHARS:
            yield at, texts
            texts, at, size = [], k + 1, 0
    if texts:
        yield at, texts


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """One row per document and test item whose question and answer it holds."""
    spark, out = docs.sparkSession, None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(vars(index))

        def search(batches, shared=shared):
            index = Index.of(shared.value)
            for batch in batches:
                rows = []
                for at, texts in _groups(batch.column(1)):
                    rows += [(at + t, item, *m) for (t, item), m in index.matches(texts, threshold, least).items()]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *[pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, OUT)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], OUT) if out is None else out


def keep_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """Documents without a leak, in the columns of ``docs``."""
    out, at = docs, [c.lower() for c in docs.columns].index("text")
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(vars(index))

        def clean(batches, shared=shared):
            index = Index.of(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for start, texts in _groups(batch.column(at)):
                    for t, _ in index.matches(texts, threshold, least):
                        keep[start + t] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
