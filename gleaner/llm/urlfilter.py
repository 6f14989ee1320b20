"""URL filters as a temporal list join.

Dated list entries (a pattern is added to a category, or removed) become validity intervals; every capture is evaluated
against the intervals that were open when it was fetched. Patterns are a host, a domain with all below it, or a path
prefix of a host. Category `allow` overrides: the most specific open entry decides, an allowing one wins ties.

Built-in functions only. A capture has one join key for each suffix of its host, so no list is scanned against all captures.

Scale: intervals are broadcast only if there are at most `broadcast_rows`; beyond that the join shuffles both sides, and
a hot host is split by adaptive skew handling, since nothing above the join needs its rows together. Matches meet by
capture, which spreads evenly.

Defined results: a null url, or one without a host, matches nothing; a null fetch time matches nothing; repeated entries of one
moment count once, a removal wins over an addition of the same moment; repeated captures are each judged; of equally specific entries
an allowing one wins; a very long url is one url like any other; an empty table of captures gives an empty result, an
empty list blocks nothing; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BROADCAST_ROWS = 200_000
ALLOW = "allow"
HOST, DOMAIN, PREFIX = "host", "domain", "prefix"


def host_of(url: Column) -> Column:
    """The lower-cased host, without user, port and a final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    found = F.regexp_replace(found, r"\.$", "")
    return F.when(found != "", found)


def path_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def intervals(entries: DataFrame) -> DataFrame:
    """entries (category, kind, host, path, action add/remove, at) -> the same pattern with valid_from and valid_to (null: open).

    Between two events of a pattern its state is the earlier one's; only added states are intervals.
    """
    pattern = ["category", "kind", "host", "path"]
    known = entries.filter(F.col("host").isNotNull() & F.col("at").isNotNull()).withColumn("path", F.coalesce("path", F.lit("")))
    moment = known.groupBy(*pattern, "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    order = Window.partitionBy(*pattern).orderBy("at")
    return moment.withColumn("valid_to", F.lead("at").over(order)).filter("gone = 0").select(*pattern, F.col("at").alias("valid_from"), "valid_to")


def specificity(kind: Column, host: Column, path: Column) -> Column:
    """More labels before fewer, a host before its domain, a longer path before a shorter one."""
    labels = F.size(F.split(host, r"\."))
    return labels * 100_000 + F.when(kind == DOMAIN, 0).when(kind == HOST, 1).otherwise(F.length(path) + 1)


def evaluate(
    captures: DataFrame, entries: DataFrame, *, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched", broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Per capture row: id, url, fetched, n_active (open entries that match), categories (theirs, sorted), blocked."""
    rows = captures.select(captures[capture_id].alias("gl_id"), captures[url].alias("gl_url"), captures[fetched].alias("gl_at"))
    listed = intervals(entries)
    side = F.broadcast(listed) if listed.limit(broadcast_rows + 1).count() <= broadcast_rows else listed
    host, path = host_of(F.col("gl_url")), path_of(F.col("gl_url"))
    named = rows.filter(host.isNotNull() & F.col("gl_at").isNotNull()).withColumns({"gl_host": host, "gl_path": path})
    labels = F.split("gl_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    keyed = named.withColumn("host", F.explode(F.array_distinct(suffixes)))
    whole = F.col("host") == F.col("gl_host")
    fits = (F.col("kind") == DOMAIN) | (whole & ((F.col("kind") == HOST) | F.col("gl_path").startswith(F.col("path"))))
    open_ = (F.col("valid_from") <= F.col("gl_at")) & (F.col("valid_to").isNull() | (F.col("gl_at") < F.col("valid_to")))
    found = keyed.join(side, "host").filter(open_ & fits)
    rank = specificity(F.col("kind"), F.col("host"), F.col("path"))
    allowed = F.col("category") == ALLOW
    judged = found.groupBy("gl_id", "gl_url", "gl_at").agg(
        F.size(F.collect_set(F.struct("category", "kind", "host", "path"))).alias("n_active"),  # a repeated capture's matches once
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max(F.when(~allowed, rank)).alias("worst"),
        F.max(F.when(allowed, rank)).alias("best"),
    )
    judged = judged.toDF("k_id", "k_url", "k_at", "n_active", "categories", "worst", "best")
    same = (F.col("gl_url") == F.col("k_url")) & (F.col("gl_at") == F.col("k_at")) & F.col("gl_id").eqNullSafe(F.col("k_id"))
    out = rows.join(judged, same, "left")
    blocked = F.col("worst").isNotNull() & (F.col("best").isNull() | (F.col("worst") > F.col("best")))
    return out.select(
        F.col("gl_id").alias(capture_id), F.col("gl_url").alias(url), F.col("gl_at").alias(fetched),
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"), blocked.alias("blocked"),
    )


def _hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: host entries that come, go and come back, domains and path prefixes."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).dropna().distinct()
    day = lambda salt, span: F.timestamp_seconds(F.lit(1704067200) + (_hash(F.concat("h", F.lit(salt))) % span) * 86400)
    category = F.element_at(F.array(*map(F.lit, ("ads", "adult", "malware", ALLOW))), (_hash(F.col("h")) % 4).cast("int") + 1)
    domain = F.substring_index("h", ".", -2)
    add, gone = F.lit("add"), F.lit("remove")
    made = [
        hosts.select(category.alias("category"), F.lit(HOST).alias("kind"), F.col("h").alias("host"), F.lit("").alias("path"), add.alias("action"), day("a", 120).alias("at")),
        hosts.filter(_hash(F.concat("h", F.lit("x"))) % 3 != 0).select(category, F.lit(HOST), "h", F.lit(""), gone, day("b", 180)),
        hosts.filter(_hash(F.concat("h", F.lit("y"))) % 2 == 0).select(category, F.lit(HOST), "h", F.lit(""), add, day("c", 300)),
        hosts.filter(_hash(F.concat("h", F.lit("z"))) % 7 == 0).select(F.lit("tracker"), F.lit(DOMAIN), domain, F.lit(""), add, day("d", 365)),
        hosts.filter(_hash(F.concat("h", F.lit("p"))) % 2 == 0).select(F.lit(ALLOW), F.lit(PREFIX), "h", F.lit("/de/"), add, day("e", 365)),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures of pages, fetched at moments derived from their ids, against the dated list of their hosts."""
    pages = C.read(spark, sf_dir, "pages")
    fetched = F.timestamp_seconds(F.lit(1704067200) + (F.col("page_id") * 7919 % 525600) * 60)
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    out = evaluate(captures, sample_entries(pages))
    return out.select("page_id", F.unix_seconds("fetched").alias("fetched"), "n_active", "categories", "blocked")


_H = "CAST(('0x' || substr(md5({0}), 1, 6)) AS BIGINT)"
_HOST = "nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\\.$', ''), '')"


def _day(salt: str, span: int) -> str:
    return f"1704067200 + ({_H.format(f'h || {salt!r}')} % {span}) * 86400"


_CAT = f"list_extract(['ads', 'adult', 'malware', 'allow'], {_H.format('h')} % 4 + 1)"
OP2_SQL = f"""WITH hosts AS (SELECT DISTINCT {_HOST} AS h FROM pages WHERE {_HOST} IS NOT NULL),
e AS (SELECT {_CAT} AS category, 'host' AS kind, h AS host, '' AS path, 0 AS gone, {_day('a', 120)} AS moment FROM hosts
UNION ALL SELECT {_CAT}, 'host', h, '', 1, {_day('b', 180)} FROM hosts WHERE {_H.format("h || 'x'")} % 3 <> 0
UNION ALL SELECT {_CAT}, 'host', h, '', 0, {_day('c', 300)} FROM hosts WHERE {_H.format("h || 'y'")} % 2 = 0
UNION ALL SELECT 'tracker', 'domain', array_to_string(list_slice(string_split(h, '.'), -2, -1), '.'), '', 0, {_day('d', 365)} FROM hosts WHERE {_H.format("h || 'z'")} % 7 = 0
UNION ALL SELECT 'allow', 'prefix', h, '/de/', 0, {_day('e', 365)} FROM hosts WHERE {_H.format("h || 'p'")} % 2 = 0),
m AS (SELECT category, kind, host, path, moment, max(gone) AS gone FROM e GROUP BY ALL),
iv AS (SELECT * FROM (SELECT *, lead(moment) OVER (PARTITION BY category, kind, host, path ORDER BY moment) AS until FROM m) WHERE gone = 0),
c AS (SELECT page_id, url, 1704067200 + (page_id * 7919 % 525600) * 60 AS fetched, {_HOST} AS h,
 CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END AS p, row_number() OVER () AS rid FROM pages),
f AS (SELECT rid, category, len(string_split(host, '.')) * 100000 + CASE kind WHEN 'domain' THEN 0 WHEN 'host' THEN 1 ELSE length(path) + 1 END AS rank
 FROM c JOIN iv ON moment <= fetched AND (until IS NULL OR fetched < until) AND
 ((kind = 'domain' AND (h = host OR h LIKE '%.' || host)) OR (kind = 'host' AND h = host) OR (kind = 'prefix' AND h = host AND starts_with(p, path)))),
j AS (SELECT rid, count(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
 max(rank) FILTER (WHERE category <> 'allow') AS worst, max(rank) FILTER (WHERE category = 'allow') AS best FROM f GROUP BY rid)
SELECT page_id, fetched, coalesce(n_active, 0) AS n_active, coalesce(categories, '') AS categories, worst IS NOT NULL AND (best IS NULL OR worst > best) AS blocked
FROM c LEFT JOIN j USING (rid)"""
