"""Near-duplicate documents from an LSH forest of MinHash signatures, confirmed on whole shingle sets.

1. A text becomes its set of two-word shingles, a fingerprint of the set and ``TREES * LEAST_DEPTH`` MinHash values. Texts with
   equal sets form a class; all further work is on classes.
2. Tree t orders the classes by values from place ``t * LEAST_DEPTH`` on, ``DEPTH`` of them. Classes that agree on the first
   ``LEAST_DEPTH`` are a region; neighbours by longest common prefix stand together in it.
3. A region of little weight is one work item. A heavy one is descended in the first ``LINK_TREES`` trees: each class goes
   down its prefix until few enough share it, and an item is what has the longest prefix in common. Classes that agree on
   all ``DEPTH`` values are dealt by hash.
4. In an item, pairs whose signatures agree too rarely are dropped, and the rest are confirmed one pair for each two groups
   at a time, until all candidates are linked, in one group, or refused. The item returns a star per group.
5. What is left of a heavy region is exact: once its classes carry the component found so far, the classes outside the
   region's largest component meet each other and that component, in blocks. Pairs within a component need no look.

A pair of similarity 0.8 shares no region with probability (1 - 0.8^4)^20 = 3e-5. No cap on members, partners or items.

Cases: NULL, empty and wordless texts have no shingles, are linked to nothing and keep their own id; a text of one word is
one shingle; A-Z are lower-cased, all else counts as written. Repeated rows are copies of each other. NULL ids take part,
and a component whose ids are all NULL has a NULL component_id; ``kept`` is then false for all but texts without words.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import query, stored, table, text_or_empty
from .hashing import grams
from .jaccard_join import components

PERCENT, SHINGLE = 80, 2
TREES, LEAST_DEPTH, DEPTH, LINK_TREES = 20, 4, 8, 4
VALUES = TREES * LEAST_DEPTH
#: Of 80 values a pair of similarity 0.8 agrees on 46 or fewer with probability 5e-6.
LEAST_AGREE = 46
ITEM, WEIGHT_RUNS = 512, 2000


class Hashes(dict):
    """word -> hash, emptied when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, known: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles; bytes.split() knows just the white space of the rule."""
    found = text.lower().split() if text else []
    return np.unique(grams(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)), SHINGLE))


def salts() -> tuple[np.ndarray, np.ndarray]:
    h = np.array([xxhash.xxh64_intdigest(str(k), seed=23) for k in range(VALUES)], dtype=np.uint64)
    return (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32) | np.uint32(1)


def minhash(own: np.ndarray, add: np.ndarray, by: np.ndarray) -> np.ndarray:
    """One value per salt: both halves of a shingle's hash take part, so equal low halves do not tie two shingles."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(own), 1024):
        some = own[k : k + 1024]
        low, high = some.astype(np.uint32), (some >> np.uint64(32)).astype(np.uint32)
        v = (low[None, :] ^ add[:, None]) * by[:, None]
        v ^= v >> np.uint32(15)
        v += high[None, :]
        v *= np.uint32(0x9E3779B1)
        out = np.minimum(out, v.min(axis=1))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """(id, th, cid, n, sig) per row; cid names the set, NULL without words; th names the text."""

    def run(batches):
        known, (add, by) = Hashes(), salts()
        for b in batches:
            cid, n, sig = [], [], []
            for x in b.column(2).to_pylist():
                own = shingles(x, known)
                n.append(len(own))
                cid.append(xxhash.xxh128_digest(own.tobytes()) if len(own) else None)
                sig.append(minhash(own, add, by).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cid, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["id", "th", "cid", "n", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, th long, cid binary, n long, sig binary")


def prefix(depth: Column | int) -> Column:
    """Name of a class's first ``depth`` values in tree ``tree``; the order of a tree goes around the end of the signature."""
    start = F.col("tree") * (4 * LEAST_DEPTH)
    return F.xxhash64("tree", F.lit(depth), F.substring(F.concat("sig", F.substring("sig", 1, 4 * DEPTH)), start + 1, F.lit(4) * F.lit(depth)))


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, heavy): members (tree, region, cid, weight, large) of regions of two classes or more.

    Only keys travel here; ``large`` says that the region weighs more than an item may.
    """
    trees = classes.select("cid", "weight", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    keyed = trees.select("tree", prefix(LEAST_DEPTH).alias("region"), "cid", "weight")
    regions = keyed.groupBy("tree", "region").agg(F.count("*").alias("n"), F.sum("weight").alias("all_weight")).where("n > 1")
    members = stored(keyed.join(regions.select("tree", "region", (F.col("all_weight") > ITEM).alias("large")), ["tree", "region"]))
    return members, stored(members.where("large"))


def descended(heavy: DataFrame, classes: DataFrame) -> DataFrame:
    """(item, cid): the classes of heavy regions of the first trees, each at the depth where few enough share its prefix."""
    own = heavy.where(F.col("tree") < LINK_TREES).select("tree", "cid", "weight").join(classes.select("cid", "sig"), "cid")
    steps = own.select("tree", "cid", "weight", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("key")) for d in range(LEAST_DEPTH + 1, DEPTH + 1)])).alias("step")).select("tree", "cid", "weight", "step.*")
    shared = steps.groupBy("tree", "depth", "key").agg(F.sum("weight").alias("all_weight"))
    fit = steps.join(shared, ["tree", "depth", "key"]).groupBy("tree", "cid").agg(
        F.min(F.when((F.col("all_weight") <= ITEM) | (F.col("depth") == DEPTH), F.struct("depth", "key", "all_weight"))).alias("at")
    )
    deal = F.pmod(F.xxhash64("tree", "cid"), F.ceil(F.col("at.all_weight") / F.lit(float(ITEM))).cast("long"))
    return fit.select(F.xxhash64("at.key", F.when(F.col("at.all_weight") > ITEM, deal).otherwise(F.lit(0).cast("long"))).alias("item"), "tree", "cid")


def candidates_in(sig: np.ndarray, tree: int, light: np.ndarray, label: np.ndarray | None, region_of: np.ndarray):
    """(k, near) for each class k of an item: later classes of the same region that agree often enough.

    Pairs of one component are left out, and pairs that met in the light region of an earlier tree.
    """
    whole = sig.reshape(len(sig), TREES, LEAST_DEPTH)
    for k in range(len(sig) - 1):
        near = k + 1 + np.flatnonzero(region_of[k + 1 :] == region_of[k])
        if label is not None:
            near = near[label[near] != label[k]]
        if len(near):
            near = near[(sig[near] == sig[k]).sum(axis=1) >= LEAST_AGREE]
        if tree and len(near):
            met = (whole[near, :tree] == whole[k, :tree]).all(axis=2) & ((light[k] >> np.arange(tree)) & 1).astype(bool)
            near = near[~met.any(axis=1)]
        if len(near):
            yield k, near


def _item(group: pa.Table):
    """An item's rows in order of class, as arrays; ``side`` tells the two blocks of an item apart."""
    order = np.argsort(np.array(group["cid"].to_pylist(), dtype=object), kind="stable")
    take = lambda c: group[c].take(pa.array(order)).to_pylist()
    sig = np.frombuffer(b"".join(take("sig")), np.uint32).reshape(len(order), -1)
    tree = int(group["tree"][0].as_py())
    region = np.ascontiguousarray(sig[:, tree * LEAST_DEPTH : (tree + 1) * LEAST_DEPTH]).view("V16").ravel()
    region_of = np.unique(region, return_inverse=True)[1]
    label = None
    if group["label"].null_count < group.num_rows:
        label = np.unique(np.array(take("label"), dtype=object), return_inverse=True)[1]
    return take("cid"), sig, tree, np.array(take("light"), np.int64), label, region_of


ITEM_ROWS = ["item", "tree", "cid", "light", "label", "sig"]


def wanted(items: DataFrame) -> DataFrame:
    """(item, cid): the classes of an item that have a candidate there; only their texts travel."""

    def run(group: pa.Table) -> pa.Table:
        cids, *rest = _item(group)
        used: set[int] = set()
        for k, near in candidates_in(*rest):
            used.add(k)
            used.update(near.tolist())
        own = sorted(used)
        return pa.table({"item": pa.array([group["item"][0].as_py()] * len(own), pa.int64()), "cid": pa.array([cids[k] for k in own], pa.binary())})

    return items.groupBy("item").applyInArrow(run, "item long, cid binary")


def linked(n: int, found, same) -> np.ndarray:
    """Groups of 0..n-1 by candidates (k, near): ``same(left, right)`` confirms, a pair for each two groups at a time."""
    pairs = [(np.full(len(near), k), near) for k, near in found]
    hub = np.arange(n)
    if not pairs:
        return hub
    left, right = (np.concatenate(x) for x in zip(*pairs))
    while len(left):
        a, b = np.minimum(hub[left], hub[right]), np.maximum(hub[left], hub[right])
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        # the first pair of every two groups, and of those one for each group: no pair is looked at that others make needless
        _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
        first = first[np.unique(b[first], return_index=True)[1]]
        for k in first:
            if hub[left[k]] != hub[right[k]] and same(left[k], right[k]):
                low, high = sorted((hub[left[k]], hub[right[k]]))
                hub[hub == high] = low
        left, right = np.delete(left, first), np.delete(right, first)
    return hub


def confirmed(items: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, hub): a star for each group of an item whose links whole sets confirm."""
    rows = items.join(asked, ["item", "cid"]).join(texts, "cid")

    def run(group: pa.Table) -> pa.Table:
        cids, *rest = _item(group)
        known = Hashes()
        text = dict(zip(group["cid"].to_pylist(), group["text"]))
        sets: dict[int, np.ndarray] = {}

        def own(k):
            if k not in sets:
                sets[k] = shingles(text[cids[k]].as_py(), known)
            return sets[k]

        def same(a, b):
            x, y = own(a), own(b)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= PERCENT * (len(x) + len(y) - both)

        hub = linked(len(cids), candidates_in(*rest), same)
        moved = np.flatnonzero(hub != np.arange(len(cids)))
        return pa.table({"cid": pa.array([cids[k] for k in moved], pa.binary()), "hub": pa.array([cids[hub[k]] for k in moved], pa.binary())})

    return rows.select(*ITEM_ROWS, "text").groupBy("item").applyInArrow(run, "cid binary, hub binary")


def rest_of(heavy: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, tree, cid, label): blocks of every heavy region in which classes of different components still have to meet."""
    own = heavy.select("tree", "region", "cid", "weight").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    parts = own.groupBy("tree", "region", "label").agg(F.sum("weight").alias("w")).groupBy("tree", "region").agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("all_weight"))
    parts = parts.where("most.w < all_weight").select("tree", "region", F.col("most.label").alias("most"), F.ceil(F.col("most.w") / F.lit(ITEM / 2)).cast("int").alias("n_most"), F.ceil((F.col("all_weight") - F.col("most.w")) / F.lit(ITEM / 2)).cast("int").alias("n_rest"))
    own = own.join(parts, ["tree", "region"])
    major = F.col("label") == F.col("most")
    part = F.pmod(F.xxhash64("cid"), F.when(major, F.col("n_most")).otherwise(F.col("n_rest"))).cast("int")
    own = own.withColumns({"major": major, "part": part})
    # (m, r): block m of the largest component with block r of the rest; (-1 - a, b): blocks a <= b of the rest
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_most = F.when(F.col("major"), F.transform(upto(F.col("n_rest")), lambda r: F.struct(F.col("part").alias("x"), r.alias("y")))).otherwise(F.transform(upto(F.col("n_most")), lambda m: F.struct(m.alias("x"), F.col("part").alias("y"))))
    among = F.when(F.col("major"), F.filter(with_most, lambda _: F.lit(False))).otherwise(F.transform(upto(F.col("n_rest")), lambda o: F.struct((-1 - F.least("part", o)).alias("x"), F.greatest("part", o).alias("y"))))
    dealt = own.withColumn("block", F.explode(F.concat(with_most, among)))
    return dealt.select(F.xxhash64("region", "tree", "block.x", "block.y").alias("item"), "tree", "cid", "label")


def similar(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    rows = stored(sketches(docs))
    weight = F.greatest(F.lit(1.0), F.max("n") / F.lit(float(WEIGHT_RUNS)))
    classes = stored(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("least_id"), weight.alias("weight"), F.max("sig").alias("sig")))
    members, heavy = forest(classes)
    # bit t of ``light``: the class's region in tree t is settled in one item
    light = members.groupBy("cid").agg(F.sum(F.when(~F.col("large"), F.expr("shiftleft(1, tree)")).otherwise(0)).alias("light"))
    sketch = stored(classes.join(light, "cid").select("cid", "light", "sig"))
    no_label = F.lit(None).cast("binary").alias("label")

    def items_of(places: DataFrame) -> tuple[DataFrame, DataFrame]:
        items = places.join(sketch, "cid").select(*ITEM_ROWS)
        return items, stored(wanted(items))

    small = members.where("NOT large").select(F.xxhash64("region", "tree").alias("item"), "tree", "cid", no_label)
    items, asked = items_of(small.unionByName(descended(heavy, classes).select("item", "tree", "cid", no_label)))
    # all documents meet the wanted ones once, so the classes that may be asked for later are taken along
    reps = classes.join(asked.select("cid").unionByName(heavy.select("cid")).distinct(), "cid", "left_semi").select("cid", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("th"), F.col("text").cast("binary").alias("text"))
    texts = stored(own.join(reps, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("cid", "text").dropDuplicates(["cid"]))
    links = stored(confirmed(items, asked, texts))
    found = components(links)
    if not heavy.isEmpty():
        items, asked = items_of(stored(rest_of(heavy, found)))
        links = links.unionByName(stored(confirmed(items, asked, texts)))
        found = components(links)
    known = classes.select("cid", "least_id").join(found, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = known.groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = known.join(groups, "label").select("cid", "component_id")
    out = rows.select("id", "n", "cid").join(known, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("cid").isNull() | F.coalesce(F.col("id") == own, F.lit(False))).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 1 THEN ws
         ELSE list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS s
  FROM docs),
classes AS (SELECT s, md5(array_to_string(s, chr(10))) AS c, len(s) AS n, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT c, n, hash(g) AS g FROM (SELECT c, n, unnest(s) AS g FROM classes)),
common AS (
  SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS k
  FROM members a JOIN members b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * k >= 80 * (nx + ny - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT x AS c, x AS r FROM edges
  UNION
  SELECT reach.c, edges.y FROM reach JOIN edges ON edges.x = reach.r),
lowest AS (SELECT reach.c, min(k.low) AS low FROM reach JOIN classes k ON k.c = reach.r GROUP BY reach.c)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE coalesce(l.low, k.low) END AS component_id,
       len(d.s) = 0 OR d.doc_id = coalesce(l.low, k.low) AS kept
FROM sets d LEFT JOIN classes k ON k.s = d.s AND len(d.s) > 0 LEFT JOIN lowest l ON l.c = k.c
"""


@query("op11_lsh_forest", ORACLE_SQL)
def op11_lsh_forest(spark, sf_dir):
    out = similar(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
