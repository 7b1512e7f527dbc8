"""URL filters against dated lists.

The dated entries of a list become validity intervals: an entry holds until the pattern's next one in its list. Each
capture is judged against the entries in force when it was fetched by an as-of join: entries and captures of a (list,
pattern) are sorted by time together, and every capture takes the last entry before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import stored, table

#: A pattern with over one in so many of all (capture, pattern) pairs is hot; there are fewer hot patterns than this number.
HOT_SHARE = 10_000
#: Parts that the captures of a hot pattern are dealt over; its entries are repeated for each.
SALTS = 64


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and closing dots; an IPv6 address keeps its brackets. Empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def patterns_of(url: Column) -> Column:
    """The list patterns that cover a URL, with their rank: host/first-path-part (above all), host, then each parent domain
    of two labels or more. An address in numbers has no parent domains."""
    host = host_of(url)
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)
    labels = F.when(host.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((100 - i).alias("rank"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    prefix = F.when(part != "", F.array(F.struct(F.lit(100).alias("rank"), F.concat_ws("/", host, part).alias("pattern")))).otherwise(F.array().cast("array<struct<rank:int,pattern:string>>"))
    return F.when(host == "", F.array().cast("array<struct<rank:int,pattern:string>>")).otherwise(F.concat(prefix, domains))


def dated_entries(entries: DataFrame) -> DataFrame:
    """Entries (list_name, pattern, action, listed_at), one for each list, pattern and time: of several the last by action.

    Entries without pattern or date are void; a null list is a list of its own.
    """
    dated = entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
    return dated.groupBy("list_name", "pattern", "listed_at").agg(F.max("action").alias("action"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries with ``valid_to``: the date of the pattern's next entry in its list, null for the last one."""
    return dated_entries(entries).withColumn("valid_to", F.lead("listed_at").over(Window.partitionBy("list_name", "pattern").orderBy("listed_at")))


def judge_urls(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with verdict ('block' or 'allow'), list_name and pattern of the entry that decided, null if none did.

    An entry holds from its date (included) to the pattern's next entry in its list (excluded). Of the entries in
    force the most specific pattern decides, then a block before an allow, then the first list by name. A URL without
    host, a null URL or a null time is allowed; URLs of any length are read whole. Rows alike in URL and time are judged
    once and get the same result. Empty captures give an empty result, empty lists allow all. Columns named like the new
    ones are replaced, others are kept.
    """
    asked = captures.select(F.col(url).alias("__url"), F.col(at).cast("timestamp").alias("__at")).distinct()
    wanted = asked.where(F.col("__at").isNotNull()).select("__url", "__at", F.inline(patterns_of(F.col("__url"))))
    held = dated_entries(entries).withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    lists = held.groupBy("pattern").agg(F.collect_set(F.struct("list_name")).alias("lists"))
    met = wanted.join(held.select("pattern").distinct(), "pattern", "left_semi")
    # The hot patterns are under HOT_SHARE by their definition, so that they can be sent to all tasks.
    sizes = stored(met.groupBy("pattern").agg(F.count("*").alias("n")), "url_patterns")
    hot = F.broadcast(sizes.where(F.col("n") * HOT_SHARE > F.lit(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])).select("pattern", F.lit(SALTS).alias("salts")))
    salted = met.join(hot, "pattern", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("__url", "__at"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    listed = salted.join(lists.join(hot, "pattern", "left").select("pattern", "lists", F.explode(every).alias("salt")), ["pattern", "salt"]).withColumn("list", F.explode("lists")).drop("lists")
    marks = held.join(hot, "pattern", "left").select(
        "pattern", F.explode(every).alias("salt"), F.struct("list_name").alias("list"), F.col("listed_at").alias("__at"), F.struct("action", "listed_at").alias("entry")
    )
    so_far = Window.partitionBy("pattern", "salt", "list").orderBy("__at", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = listed.unionByName(marks, allowMissingColumns=True).withColumn("last", F.last("entry", ignorenulls=True).over(so_far))
    hit = both.where(F.col("entry").isNull() & F.col("last").isNotNull())
    order = F.struct(-F.col("rank"), F.when(F.col("last.action") == "block", 0).otherwise(1), F.coalesce("list.list_name", F.lit("")))
    verdicts = hit.groupBy("__url", "__at").agg(F.min_by(F.struct("last.action", "list.list_name", "pattern"), order).alias("__entry"))
    return (
        captures.drop("verdict", "list_name", "pattern")
        .withColumns({"__url": F.col(url), "__at": F.col(at).cast("timestamp")})
        .join(verdicts, ["__url", "__at"], "left")
        .withColumns({"verdict": F.coalesce(F.col("__entry.action"), F.lit("allow")), "list_name": F.col("__entry.list_name"), "pattern": F.col("__entry.pattern")})
        .drop("__url", "__at", "__entry")
    )


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, first path parts and parent domains of a crawl; the tables hold none of their own."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), F.inline(patterns_of(F.col("url")))).where(F.col("host") != "")
    seen = hosts.groupBy("pattern", "rank").agg(F.min("page_id").alias("first"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    size = F.length("pattern")
    steps = F.when(
        F.col("rank") == 100, F.array(F.struct(F.lit("pages").alias("list_name"), F.lit("allow").alias("action"), day(F.pmod("first", F.lit(300))).alias("listed_at")))
    ).when(
        F.col("rank") == 99,
        F.array(*[F.struct(F.lit("hosts").alias("list_name"), F.lit(a).alias("action"), day(F.pmod(F.col("first") * 7, F.lit(180)) + n * size).alias("listed_at")) for a, n in (("block", 0), ("allow", 2), ("block", 5))]),
    ).otherwise(F.array(F.struct(F.lit("domains").alias("list_name"), F.lit("block").alias("action"), day(200 + size).alias("listed_at"))))
    return seen.select("pattern", F.inline(steps))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).cast("timestamp")
    judged = judge_urls(pages.withColumn("fetched_at", fetched), dated_lists(pages))
    return judged.select("page_id", "url", F.col("fetched_at").cast("date").cast("string").alias("fetched_on"), "verdict", "list_name", "pattern")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)', 1)), '\.+$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS part, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched
  FROM pages),
c AS (
  SELECT page_id, url, fetched, 100 AS rank, host || '/' || part AS pattern FROM p WHERE host <> '' AND part <> ''
  UNION ALL
  SELECT page_id, url, fetched, 100 - i, array_to_string(list_slice(labels, i, 99), '.')
  FROM (SELECT *, unnest(range(1, greatest(len(labels), 2))) AS i
        FROM (SELECT *, CASE WHEN regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') THEN [host] ELSE string_split(host, '.') END AS labels FROM p WHERE host <> ''))),
s AS (SELECT pattern, rank, min(page_id) AS first, len(pattern) AS n FROM c GROUP BY pattern, rank),
e0 AS (
  SELECT pattern, 'pages' AS list_name, 'allow' AS action, DATE '2024-01-01' + CAST(first % 300 AS INTEGER) AS listed FROM s WHERE rank = 100
  UNION ALL SELECT pattern, 'hosts', 'block', DATE '2024-01-01' + CAST((first * 7) % 180 AS INTEGER) FROM s WHERE rank = 99
  UNION ALL SELECT pattern, 'hosts', 'allow', DATE '2024-01-01' + CAST((first * 7) % 180 + 2 * n AS INTEGER) FROM s WHERE rank = 99
  UNION ALL SELECT pattern, 'hosts', 'block', DATE '2024-01-01' + CAST((first * 7) % 180 + 5 * n AS INTEGER) FROM s WHERE rank = 99
  UNION ALL SELECT pattern, 'domains', 'block', DATE '2024-01-01' + CAST(200 + n AS INTEGER) FROM s WHERE rank < 99),
e1 AS (SELECT list_name, pattern, listed, max(action) AS action FROM e0 GROUP BY ALL),
e AS (SELECT *, lead(listed) OVER (PARTITION BY list_name, pattern ORDER BY listed) AS until FROM e1),
h AS (
  SELECT c.page_id, c.url, e.action, e.list_name, e.pattern,
         row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY c.rank DESC, CASE WHEN action = 'block' THEN 0 ELSE 1 END, list_name) AS n
  FROM c JOIN e ON c.pattern = e.pattern AND listed <= fetched AND (until IS NULL OR fetched < until))
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched_on, coalesce(h.action, 'allow') AS verdict, h.list_name, h.pattern
FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url = h.url AND h.n = 1
"""
