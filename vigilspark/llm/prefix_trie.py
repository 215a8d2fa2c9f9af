"""Conversation prefix trie by truncation peeling.

1. Turns get their place in their conversation from one range partitioning that may cut through a conversation; every
   conversation is rebuilt from the head of its donor and its own turns after it.
2. A prefix is named by 128 bits: the exclusive or of a hash of (place, role, text) over its turns. Running values are taken
   per (conversation, partition) and then shifted by what earlier partitions hold, so no conversation needs one task.
3. What no other conversation shares, the end of a conversation below its deepest shared prefix, is a chain of nodes of one
   member each and is written as such. All else is peeled: from the deepest level up, conversations that end at a depth
   meet the nodes that survive from below, stripped of their last turn, under the same prefix; one aggregation merges
   them and reports the node. ``SEGMENT`` levels share one job, then the survivors are stored.
4. Members that end in a node are hashed as a stream: blocks of sorted ids, one running hash per node, no list of them.

Cases: NULL roles and texts are empty; turns are ordered by (turn, NULL first, role, text), so ties and repeated rows have a
place of their own; rows without a conv_id belong to no conversation and are left out; ``%`` is SQL's, with the sign of
conv_id; a conversation that is left without turns is a member of the root alone; an empty table has no nodes; extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE, query, stored, table, words

DONORS, HEAD, SEGMENT, BLOCK_IDS = 20, 4, 8, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
UPTO = (Window.unboundedPreceding, Window.currentRow)


def placed(conversations: DataFrame) -> DataFrame:
    """(conv, bucket, place, role, text): places from 1; a bucket is the part of a conversation that one partition holds."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), text("role"), text("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # the bounds come from sampling, so the layout is stored before it is read again
    laid = stored(turns.repartitionByRange("conv", *order).withColumn("bucket", F.spark_partition_id()))
    local = laid.withColumn("place", F.row_number().over(Window.partitionBy("conv", "bucket").orderBy(*order)).cast("long"))
    return shifted(local, laid.groupBy("conv", "bucket").agg(F.count("*").alias("size")), F.sum("size"), "place", lambda a, b: a + b)


def shifted(rows: DataFrame, totals: DataFrame, total: Column, name: str, add) -> DataFrame:
    """Add to ``name`` the total of a conversation's earlier buckets. Only cut conversations have one, fewer than partitions."""
    w = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", total.over(w)).where("before IS NOT NULL").select("conv", "bucket", "before")
    return rows.join(F.broadcast(before), ["conv", "bucket"], "left").withColumn(name, F.when(F.col("before").isNull(), F.col(name)).otherwise(add(F.col(name), F.col("before")))).drop("before")


def _turn(depth: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), depth, "role", "text") for k in (11, 23)]


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, words, len): every rebuilt turn with the name of the prefix that ends in it; len: of the whole.

    A conversation without a turn has one row of depth 0.
    """
    turns = stored(placed(conversations))
    ids = turns.groupBy("conv").agg(F.max("place").alias("own"))
    ids = ids.withColumns({"h": F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEAD)), "donor": F.col("conv") - F.col("conv") % DONORS})
    heads = turns.where(F.col("place") < HEAD).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("head"))
    ids = ids.join(heads.select(F.col("conv").alias("donor"), "head"), "donor", "left")
    ids = stored(ids.select("conv", "own", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,role:string,text:string>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    length = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))

    given = ids.select("conv", length.alias("len"), F.posexplode("head").alias("at", "turn")).select("conv", "len", (F.col("at") + 1).cast("long").alias("depth"), "turn.role", "turn.text")
    w = Window.partitionBy("conv").orderBy("depth").rowsBetween(*UPTO)  # at most three rows of a conversation
    given = given.select("conv", "len", "depth", n_words(F.col("text")).alias("words"), *[h.alias(n) for h, n in zip(_turn(F.col("depth")), ("h1", "h2"))])
    given = given.withColumns({c: F.bit_xor(c).over(w) for c in ("h1", "h2")})
    given = stored(given)
    base = given.groupBy("conv").agg(F.max_by("h1", "depth").alias("b1"), F.max_by("h2", "depth").alias("b2"))

    after = turns.join(ids.select("conv", "h", F.size("head").alias("given"), length.alias("len")), "conv").where("place > h")
    after = after.withColumn("depth", F.col("given") + F.col("place") - F.col("h"))
    after = stored(after.select("conv", "bucket", "len", "depth", n_words(F.col("text")).alias("words"), *[h.alias(n) for h, n in zip(_turn(F.col("depth")), ("h1", "h2"))]))
    own = Window.partitionBy("conv", "bucket").orderBy("depth").rowsBetween(*UPTO)
    sums = after.groupBy("conv", "bucket").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    after = after.withColumns({c: F.bit_xor(c).over(own) for c in ("h1", "h2")})
    for c, s in (("h1", "s1"), ("h2", "s2")):
        after = shifted(after, sums, F.bit_xor(s), c, lambda a, b: a.bitwiseXOR(b))
    after = after.join(base, "conv", "left").withColumns({c: F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0))) for c, b in (("h1", "b1"), ("h2", "b2"))})
    columns = ["conv", F.col("depth").cast("int").alias("depth"), "h1", "h2", "words", F.col("len").cast("int").alias("len")]
    zero = F.lit(0).cast("long")
    bare = ids.where(length == 0).select("conv", F.lit(0).alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("words"), F.lit(0).alias("len"))
    return given.select(*columns).unionByName(after.select(*columns)).unionByName(bare)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(h1, h2, depth, ends_sha256) of the nodes in which at least one of ``ends`` (h1, h2, depth, conv) ends."""
    keys = ["h1", "h2", "depth"]

    def blocks(batches):
        held, ids = None, []
        out = {"h1": [], "h2": [], "depth": [], "first": [], "ids": []}

        def put():
            for name, v in zip(out, (*held, ids[0], ",".join(map(str, ids)))):
                out[name].append(v)

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=list(out))
            for v in out.values():
                v.clear()
            return made

        for b in batches:
            for *key, conv in zip(*(b.column(k).to_pylist() for k in range(4))):
                if ids and (key != held or len(ids) >= BLOCK_IDS):
                    put()
                    ids = []
                    if len(out["h1"]) >= 10_000 or sum(map(len, out["ids"][-100:])) > 1_000_000:
                        yield batch()
                held = key
                ids.append(conv)
        if ids:
            put()
        if out["h1"]:
            yield batch()

    def digests(batches):
        held, running = None, None
        for b in batches:
            done = []
            for *key, _, ids in zip(*(b.column(k).to_pylist() for k in range(5))):
                if key != held:
                    if held is not None:
                        done.append((*held, running.hexdigest()))
                    held, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield _batch(done)
        if held is not None:
            yield _batch([(*held, running.hexdigest())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=[*keys, "ends_sha256"])

    cut = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(blocks, "h1 long, h2 long, depth int, first long, ids string")
    return cut.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "h1 long, h2 long, depth int, ends_sha256 string")


def peeled(rows: DataFrame, stops: DataFrame, deepest: int) -> DataFrame:
    """Shared nodes: (h1, h2, depth, p1, p2, conv, n_convs, n_children, n_leaves, saved_tokens).

    ``rows``: the prefixes of every conversation; ``stops`` (conv, stop, more): the depth at which a conversation enters the
    peeling, and whether a chain of its own goes on from there.
    """
    out = None
    segment = F.floor((F.col("depth") - 1) / SEGMENT).cast("int")
    # the prefixes of a segment's levels travel with the conversation: at most SEGMENT of them
    paths = rows.join(stops.select("conv", "stop"), "conv").where("depth BETWEEN 1 AND stop").groupBy("conv", segment.alias("segment"))
    paths = stored(paths.agg(F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "words"))).alias("path")))
    stops = stored(stops)
    fresh = stops.select("conv", "stop", F.lit(1).cast("long").alias("n_convs"), F.col("more").cast("long").alias("n_children"), F.col("more").cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    alive = None  # survivors: one row per node of the depth above which the next segment begins, named by its smallest member
    for number in range((deepest - 1) // SEGMENT if deepest else -1, -1, -1):
        top, bottom = number * SEGMENT, min(deepest, (number + 1) * SEGMENT)
        own = paths.where(F.col("segment") == number)
        level = own.join(alive, "conv") if alive is not None else None
        for depth in range(bottom, top, -1):
            entering = own.join(fresh.where(F.col("stop") == depth).drop("stop"), "conv")
            entering = entering.drop("segment")
            both = entering if level is None else level.select(*entering.columns).unionByName(entering)
            last, above = F.element_at("path", -1), F.element_at("path", -2)
            merged = both.withColumns({"h1": last["h1"], "h2": last["h2"], "words": last["words"]}).groupBy("h1", "h2").agg(
                F.min("conv").alias("conv"), F.first("path").alias("path"), F.max("words").alias("words"), F.sum("n_convs").alias("n_convs"),
                F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            )
            merged = merged.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"), "depth": F.lit(depth)})
            merged = merged.withColumns({"p1": above["h1"], "p2": above["h2"]}) if depth > top + 1 else merged.withColumns({c: F.lit(None).cast("long") for c in ("p1", "p2")})
            found = merged.select("h1", "h2", "depth", "p1", "p2", "conv", "path", "n_convs", "n_children", "n_leaves", "saved_tokens")
            # stripped of its last turn, a node is one child of the node above
            level = found.select("conv", F.slice("path", 1, depth - top - 1).alias("path"), "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens") if depth > top + 1 else None
            nodes = found.drop("path") if depth == bottom else nodes.unionByName(found.drop("path"))
        nodes = stored(nodes)
        alive = nodes.where(F.col("depth") == top + 1).select("conv", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")
        out = nodes if out is None else out.unionByName(nodes)
    ended = fresh.where("stop = 0").drop("stop")
    both = ended if alive is None else alive.select(*ended.columns).unionByName(ended)
    zero = F.lit(0).cast("long")
    root = both.agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).where("conv IS NOT NULL")
    root = root.select(zero.alias("h1"), zero.alias("h2"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "conv", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), "saved_tokens")
    return root if out is None else root.unionByName(out)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(rebuilt(conversations))
    shared = stored(rows.where("depth > 0").groupBy("h1", "h2", "depth").agg(F.count("*").alias("n"), F.max("conv").alias("one")).where("n > 1"))
    # a conversation is in the shared prefixes of depth 1 to its stop: the deepest one tells all
    stops = rows.join(shared.select("h1", "h2", "depth", F.lit(1).alias("hit")), ["h1", "h2", "depth"], "left").groupBy("conv", "len").agg(F.coalesce(F.max(F.when(F.col("hit") == 1, F.col("depth"))), F.lit(0)).alias("stop"))
    stops = stored(stops.select("conv", "stop", (F.col("len") > F.col("stop")).alias("more")))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    nodes = stored(peeled(rows, stops, deepest))

    ends = rows.where("depth = len").select("h1", "h2", "depth", "conv")
    # the prefix above a segment's first level is looked up in the rows of the node's smallest member
    up = rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("h1").alias("u1"), F.col("h2").alias("u2"))
    lost = nodes.where("p1 IS NULL AND depth > 1").join(up, ["conv", "depth"]).withColumns({"p1": F.col("u1"), "p2": F.col("u2")}).select(*nodes.columns)
    nodes = nodes.where("p1 IS NOT NULL OR depth <= 1").withColumns({c: F.when(F.col("depth") == 1, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("p1", "p2")}).unionByName(lost)
    top = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent_conv_id"))
    inside = nodes.join(top, ["p1", "p2", "depth"], "left").join(ends_digest(ends.join(stops.where("NOT more").select("conv"), "conv", "left_semi")), ["h1", "h2", "depth"], "left")
    inside = inside.select("conv", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tail = rows.join(stops.where("more").select("conv", "stop"), "conv").where("depth > stop")
    over = top.select(F.col("p1").alias("h1"), F.col("p2").alias("h2"), (F.col("depth") - 1).alias("depth"), "parent_conv_id")
    hung = rows.join(stops.where("more AND stop > 0").select("conv", F.col("stop").alias("depth")), ["conv", "depth"]).join(over, ["h1", "h2", "depth"]).select("conv", F.col("parent_conv_id").alias("hung"))
    root = nodes.where("depth = 0").select(F.col("conv").alias("root"))
    tail = tail.join(hung, "conv", "left").crossJoin(F.broadcast(root))  # the root is one row
    ends_here = F.col("depth") == F.col("len")
    tail = tail.select("conv", "depth", F.when(F.col("depth") > F.col("stop") + 1, F.col("conv")).otherwise(F.coalesce("hung", "root")).alias("parent_conv_id"), one.alias("n_convs"), F.when(ends_here, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(ends_here, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    return inside.unionByName(tail).select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
             lambda crc, ch: list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))),
           4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT i.conv_id, 0 AS own, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.donor AND t.place <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.place, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h),
lists AS (
  SELECT i.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY own, place) FILTER (text IS NOT NULL), []) AS ks,
         coalesce(list(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ORDER BY own, place) FILTER (text IS NOT NULL), []) AS ws
  FROM ids i LEFT JOIN parts p ON p.conv_id = i.conv_id GROUP BY i.conv_id),
prefixes AS (
  SELECT conv_id, d, ks[1:d] AS k, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ks) AS ends
  FROM lists, unnest(range(0, len(ks) + 1)) t(d)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids c ON c.k = n.k),
subtree AS (
  SELECT w.k[1:up] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n - 1) * w.w)::BIGINT AS saved
  FROM whole w, unnest(range(0, w.d + 1)) t(up) GROUP BY 1)
SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves, s.saved AS saved_tokens, w.ends_sha256
FROM whole w JOIN subtree s ON s.k = w.k LEFT JOIN whole p ON w.d > 0 AND p.k = w.k[1:w.d - 1]
"""


@query("op12_prefix_trie", ORACLE_SQL)
def op12_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
