"""URL filters: a dated list becomes validity intervals, and every capture is held against the entries active then.

List entries: (pattern, changed_on, action, category); a pattern is a host, a parent domain, or host/first-path-part;
actions are ``block``, ``allow`` and ``remove``. An entry holds from its date until the pattern's next date. Of several
changes of one pattern on one date ``remove`` wins over ``block``, and ``block`` over ``allow``. Of all entries active at
fetch time the longest pattern decides. Cases:

* NULL or unparseable URL, or NULL fetch date: no host or no active entry, hence not blocked.
* NULL patterns and NULL dates in the list are left out; repeated list rows count once.
* Repeated captures are judged alike, one row each; further columns pass through.

Captures are reduced to distinct (host, first path part, date) before anything is shuffled, so a host with a third of
all captures costs one row per date. A pattern's intervals come from one small row per date. Everything is joins on
equal keys; adaptive execution may broadcast the list only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import packed, query, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PART = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
ADDRESS = r"^[0-9.]+$"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.+$", "")), F.lit(""))


def part_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PART, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, category, valid_from, valid_to): what each pattern says, and from when until when."""
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    day = entries.where("pattern IS NOT NULL AND changed_on IS NOT NULL").groupBy("pattern", "changed_on").agg(F.max(F.struct(rank.alias("rank"), "action", "category")).alias("m"))
    out = day.select("pattern", F.col("m.action").alias("action"), F.col("m.category").alias("category"), F.col("changed_on").alias("valid_from"), F.lead("changed_on").over(W.partitionBy("pattern").orderBy("changed_on")).alias("valid_to"))
    return out.where("action <> 'remove'")


def patterns_of(host: Column, part: Column) -> Column:
    """Everything a list may hold for a capture: the host, its parent domains of two labels or more, host/part."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.when(F.rlike(host, F.lit(ADDRESS)) | (F.size(labels) < 2), F.array(host)).otherwise(parents)
    return F.when(part == "", hosts).otherwise(F.array_append(hosts, F.concat_ws("/", host, part)))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_on, ...) with ``host``, ``blocked``, ``category``, ``pattern`` and ``listed_on``."""
    rows = captures.select(packed(captures), host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part"), F.col("fetched_on").alias("day"))
    asked = rows.where("host IS NOT NULL AND day IS NOT NULL").select("host", "part", "day").distinct()
    asked = asked.select("host", "part", "day", F.explode(patterns_of(F.col("host"), F.col("part"))).alias("pattern"))
    active = asked.join(intervals(entries), "pattern").where((F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = active.groupBy("host", "part", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "category", "valid_from")).alias("b"))
    best = best.select(F.col("host").alias("h"), F.col("part").alias("p"), F.col("day").alias("d"), "b")
    out = rows.join(best, (F.col("host") == F.col("h")) & (F.col("part") == F.col("p")) & (F.col("day") == F.col("d")), "left")
    return out.select("row", "host", F.coalesce(F.col("b.action") == "block", F.lit(False)).alias("blocked"), F.col("b.category").alias("category"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("listed_on"))


def _hex(text: Column, at: int, n: int = 2) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures of 2024: the table has no fetch date, so it follows from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)) * 37, F.lit(366)).cast("int")).alias("fetched_on"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of the pages: each hashed host has up to three changes, paths and domains fewer."""
    start = F.lit("2024-01-01").cast("date")
    seen = pages.select(host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part")).where("host IS NOT NULL").distinct()
    category = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("adult", "malware", "spam", "piracy")]), _hex(c, 5, 1) % 4 + 1)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    change = lambda c, day, action, when: F.when(when, F.struct(c.alias("pattern"), F.date_add(start, day).alias("changed_on"), F.lit(action).alias("action"), category(c).alias("category")))
    h, p = F.col("host"), F.concat_ws("/", "host", "part")
    first = _hex(h, 1) % 180
    changes = F.array(
        change(h, first, "block", _hex(h, 4, 1) < 8),
        change(h, first + 20 + _hex(h, 6) % 90, "remove", _hex(h, 4, 1) < 6),
        change(h, first + 120 + _hex(h, 8) % 90, "block", _hex(h, 4, 1) < 3),
        change(domain, _hex(domain, 1) % 300, "block", (domain != "") & (_hex(domain, 4, 1) < 2)),
        change(p, _hex(p, 1) % 300, "allow", (F.col("part") != "") & (_hex(p, 4, 1) < 3)),
    )
    return seen.select(F.inline(F.filter(changes, lambda x: x.isNotNull()))).distinct()


_H = lambda c, at, n=2: f"('0x' || substr(md5({c}), {at}, {n}))::INT"
_CAT = lambda c: f"['adult', 'malware', 'spam', 'piracy'][{_H(c, 5, 1)} % 4 + 1]"


def _change(c: str, day: str, action: str, when: str) -> str:
    return f"SELECT {c} AS pattern, DATE '2024-01-01' + {day} AS changed_on, '{action}' AS action, {_CAT(c)} AS category FROM seen WHERE {when}"


_DOMAIN = r"regexp_extract(host, '([^.]+\.[^.]+)$', 1)"
_PATH = "host || '/' || part"
_FIRST = f"{_H('host', 1)} % 180"
ORACLE_SQL = rf"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched_on,
    nullif(lower(regexp_replace(regexp_extract(url, '{HOST}', 1), '\.+$', '')), '') AS host, regexp_extract(coalesce(url, ''), '{PART}', 1) AS part FROM pages),
seen AS (SELECT DISTINCT host, part FROM c WHERE host IS NOT NULL),
list AS ({" UNION ".join([_change("host", _FIRST, "block", f"{_H('host', 4, 1)} < 8"), _change("host", f"{_FIRST} + 20 + {_H('host', 6)} % 90", "remove", f"{_H('host', 4, 1)} < 6"), _change("host", f"{_FIRST} + 120 + {_H('host', 8)} % 90", "block", f"{_H('host', 4, 1)} < 3"), _change(_DOMAIN, f"{_H(_DOMAIN, 1)} % 300", "block", f"{_DOMAIN} <> '' AND {_H(_DOMAIN, 4, 1)} < 2"), _change(_PATH, f"{_H(_PATH, 1)} % 300", "allow", f"part <> '' AND {_H(_PATH, 4, 1)} < 3")])}),
day AS (SELECT pattern, changed_on, arg_max(action, CASE action WHEN 'remove' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS action, max(category) AS category FROM list GROUP BY ALL),
iv AS (SELECT *, lead(changed_on) OVER (PARTITION BY pattern ORDER BY changed_on) AS until FROM day),
hit AS (SELECT c.*, iv.pattern, iv.action, iv.category, iv.changed_on AS listed_on, row_number() OVER (PARTITION BY page_id, url, c.fetched_on ORDER BY length(pattern) DESC, pattern DESC) AS nth
    FROM c JOIN iv ON (iv.pattern = c.host OR (c.part <> '' AND iv.pattern = c.host || '/' || c.part) OR (ends_with(c.host, '.' || iv.pattern) AND contains(iv.pattern, '.') AND NOT regexp_matches(c.host, '{ADDRESS}')))
    AND iv.action <> 'remove' AND iv.changed_on <= c.fetched_on AND (iv.until IS NULL OR c.fetched_on < iv.until))
SELECT c.page_id, c.url, c.fetched_on::DATE::VARCHAR AS fetched_on, c.host, coalesce(hit.action = 'block', FALSE) AS blocked, hit.category, hit.pattern, hit.listed_on::DATE::VARCHAR AS listed_on
FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.url = c.url AND hit.nth = 1
"""


@query("op8_url_filters", ORACLE_SQL)
def op8_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(captures_of(pages), list_of(pages))
    return out.select("row.page_id", "row.url", F.col("row.fetched_on").cast("string").alias("fetched_on"), "host", "blocked", "category", "pattern", F.col("listed_on").cast("string").alias("listed_on"))
