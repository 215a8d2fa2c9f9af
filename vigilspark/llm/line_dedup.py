"""Line dedup: overlapping three-line windows are hashed, repeated ones found globally, later occurrences removed.

Windows run over the lines that hold a word, compared without surrounding white space. A document with fewer than
three such lines is one window of all of them. The first place of a window is the smallest (doc_id, text hash, line);
NULL ids come first. A line goes if a later occurrence covers it, unless the first occurrence of a repeated window
covers it too: every repeated window stays whole at exactly its first place. Cases:

* NULL or empty text: no windows, returned as it is. Blank lines stay while the document keeps a line.
* Repeated rows (same id, same text) are one document: each is returned, treated alike.
* A document whose every line is a later copy gets an empty text; ``keep_documents`` leaves it out.
* Further columns pass through.

A very frequent window meets in one group only as partial aggregates (smallest place and a count); the join that
tells occurrences from first places is a plain equi-join against one row per repeated window, which adaptive
execution splits when a window holds a large share of all rows. Document texts cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, packed, query, table, text_or_empty

SIZE = 3


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _place(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("th")]


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, th, pos, h1, h2): one row per window; two chained 64-bit hashes identify its lines."""
    lines = F.filter(F.transform(F.split(text_or_empty(), "\n"), _trimmed), lambda x: x != "")
    rows = docs.select(*_place(docs), lines.alias("lines"))
    ids = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0))))

    def hashed(i: Column) -> Column:
        parts = F.slice("lines", i + 1, size)
        return F.struct(i.alias("pos"), F.xxhash64(parts).alias("h1"), F.xxhash64(F.lit("second"), F.size(parts), F.array_join(parts, "\n")).alias("h2"))

    return rows.select("id", "th", F.inline(F.transform(ids, hashed)))


def repeated(win: DataFrame) -> DataFrame:
    """(h1, h2, first, n): windows found at two places or more, with the first place."""
    out = win.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.max(F.struct("id", "th", "pos")).alias("last"), F.count("*").alias("n"))
    return out.where("first <> last").drop("last")


def removals(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, th, gone): for each document with later occurrences, the indices of the lines to remove."""
    win = windows(docs, size)
    found = win.join(repeated(win).withColumnsRenamed({"h1": "r1", "h2": "r2"}), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    later = ~F.struct("id", "th", "pos").eqNullSafe(F.col("first"))
    spans = found.select("id", "th", "pos", later.alias("later")).groupBy("id", "th").agg(
        F.collect_set(F.when(F.col("later"), F.col("pos"))).alias("later"), F.collect_set(F.when(~F.col("later"), F.col("pos"))).alias("first")
    )
    merged = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + size - 1))))
    return spans.where(F.size("later") > 0).select("id", "th", F.array_except(merged("later"), merged("first")).alias("gone"))


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``row`` (the document), ``n_lines``, ``n_removed`` and the text without the removed lines."""
    rows = docs.select(packed(docs), *_place(docs), text_or_empty().alias("t"))
    gone = removals(docs, size).withColumnsRenamed({"id": "gid", "th": "gth"})
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    out = out.select("row", "t", F.split("t", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    filled = F.filter(F.transform("lines", lambda x, i: F.when(F.rlike(x, F.lit(f"[^{SPACE}]")), i)), lambda i: i.isNotNull())
    out = out.select("row", "t", "lines", filled.alias("filled"), "gone")
    # positions count lines with a word; map them back to lines, and drop those numbers from all line numbers
    out = out.withColumn("cut", F.when(F.size("gone") > 0, F.filter(F.transform("gone", lambda g: F.get("filled", g)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    text = F.when(F.size("cut") == 0, F.col("t")).when(F.size("cut") == F.size("filled"), F.lit("")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select("row", F.size("filled").cast("long").alias("n_lines"), F.size("cut").cast("long").alias("n_removed"), text.alias("clean_text"))


def keep_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Documents without the removed lines, in the columns of ``docs``; a document that lost every line goes."""
    out = dedup_lines(docs, size).where("n_removed = 0 OR n_removed < n_lines")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("clean_text"))
    return out.select(*[(text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, t, i, x, regexp_matches(x, '[^\x20\x09-\x0D]') AS has FROM (
    SELECT r, doc_id, t, unnest(range(0, len(string_split(t, chr(10))))) AS i, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT r, doc_id, i, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x,
    row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY r) AS n FROM l WHERE has),
w AS (SELECT a.r, a.doc_id, a.p, a.x || chr(10) || coalesce(b.x, chr(1)) || chr(10) || coalesce(c.x, chr(1)) AS win
    FROM f a LEFT JOIN f b ON b.r = a.r AND b.p = a.p + 1 LEFT JOIN f c ON c.r = a.r AND c.p = a.p + 2
    WHERE a.p <= greatest(a.n - 3, 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, p) AS nth, count(*) OVER (PARTITION BY win) AS c FROM w),
cov AS (SELECT r, p + o AS p, bool_and(nth > 1) AS cut FROM k, range(0, 3) AS u(o) WHERE c > 1 GROUP BY ALL),
m AS (SELECT l.r, l.i, l.x, l.has, coalesce(cov.cut, FALSE) AS cut FROM l LEFT JOIN f USING (r, i) LEFT JOIN cov ON cov.r = f.r AND cov.p = f.p)
SELECT d.doc_id, count(*) FILTER (has)::BIGINT AS n_lines, count(*) FILTER (cut)::BIGINT AS n_removed,
    CASE WHEN count(*) FILTER (cut) > 0 AND count(*) FILTER (cut) = count(*) FILTER (has) THEN '' ELSE coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT cut), '') END AS clean_text
FROM d JOIN m USING (r) GROUP BY d.r, d.doc_id
"""


@query("op1_line_dedup", ORACLE_SQL)
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", "clean_text")
