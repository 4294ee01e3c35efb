"""URL filters as a temporal list join.

Dated list entries (add or remove a key at a time) become validity intervals, kept
as one row per key.  Every capture is looked up by its host, the host's parent
domains and the prefixes of its path, no deeper than the host's deepest listed key, and each lookup is judged as of the capture's
fetch time.  Captures and intervals are stored first and joined on the key alone: adaptive execution may
split a key with very many captures, such as a top-level domain, and broadcasts the list only if it
measures small.  Only hits are gathered by capture and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import save

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
LONGEST_HOST = 253  # of a domain name
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, spans): the times each key is active, from rows (key, category, action, effective).

    ``action`` is ``add`` or ``remove``; of entries of a key and category at one time a
    removal comes last.  Null keys or times are left out.  A removal without an
    earlier addition has no effect; an addition without a removal stays active.
    """
    usable = entries.where("key IS NOT NULL AND effective IS NOT NULL AND action IN ('add', 'remove')")
    order = Window.partitionBy("key", "category").orderBy("effective", "action")
    spans = usable.withColumn("until", F.lead("effective").over(order)).where("action = 'add' AND (until IS NULL OR until > effective)")
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("effective", "until", "category"))).alias("spans"))


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def listed_depths(spans: DataFrame) -> DataFrame:
    """(host, depth): how many slashes the deepest listed key of each host has, for hosts with any."""
    paths = spans.where("instr(key, '/') > 0")
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    return paths.groupBy(F.substring_index("key", "/", 1).alias("host")).agg(F.max(slashes).alias("depth"))


def lookup_keys(url: Column, depth: Column | None = None) -> Column:
    """Keys of a URL: ``host`` and each parent domain, and ``host/path/`` up to each of the first ``depth`` slashes of its path (all, if not given)."""
    host = host_of(url)
    depth = F.lit(2**31 - 1) if depth is None else depth
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(F.regexp_extract(url, PATH, 1), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(steps) - 1, depth)),
        lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")),
    )
    keys = F.concat(domains, F.when((F.size(steps) > 1) & (depth > 0), prefixes).otherwise(F.array().cast("array<string>")))
    usable = (host != "") & (F.length(host) <= LONGEST_HOST)
    return F.when(usable, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per capture: page_id, url, fetched, blocked, matched_keys and categories (sorted, comma-joined).

    A URL that is null, has no host or one of more letters than names may have, and a capture without a fetch time, match
    nothing; repeated captures give a row each; an empty list blocks nothing; an empty
    table gives no rows; other columns are not read.
    """
    rows = captures.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched")
    )
    rows = save(rows, "captures")
    spans = save(validity_intervals(entries), "validity")
    usable = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("row", "fetched", "url", host_of(F.col("url")).alias("host"))
    usable = usable.join(listed_depths(spans), "host", "left")
    asked = usable.select("row", "fetched", F.explode(lookup_keys(F.col("url"), F.coalesce("depth", F.lit(0)))).alias("key"))
    active = F.filter("spans", lambda s: (s["effective"] <= F.col("fetched")) & (s["until"].isNull() | (s["until"] > F.col("fetched"))))
    hits = asked.join(spans, "key").select("row", "key", active["category"].alias("found"))
    per_row = hits.where(F.size("found") > 0).groupBy("row").agg(F.collect_set("key").alias("keys"), F.collect_list("found").alias("found"))
    none = F.array().cast("array<string>")
    return rows.join(per_row, "row", "left").select(
        "page_id", "url", "fetched", F.col("keys").isNotNull().alias("blocked"),
        F.array_join(F.sort_array(F.coalesce("keys", none)), ",").alias("matched_keys"),
        F.array_join(F.sort_array(F.array_distinct(F.coalesce(F.flatten("found"), none))), ",").alias("categories"),
    )


# The registered query's list and fetch times: the page table has neither, so both follow from its own columns.

# Dated list entries.
LISTED = (
    ("cheap-pills.example.com", "spam", "add", "2024-02-01"),
    ("cheap-pills.example.com", "spam", "remove", "2024-06-01"),
    ("cheap-pills.example.com", "spam", "add", "2024-09-15"),
    ("example.org", "mirror", "add", "2024-03-10"),
    ("example.org", "mirror", "remove", "2024-03-20"),
)


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time: day ``page_id * 37 mod 366`` of 2024, at noon."""
    day = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", (F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("fetched")
    )


def page_list(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The fixed entries, and for each host whose MD5 begins with 0-3 an addition and, but for 3, a removal 60 days later."""
    hosts = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("key")).where("key <> ''").distinct().withColumn("h", F.md5("key"))
    day = F.conv(F.substring("h", 2, 2), 16, 10).cast("int")
    added = hosts.where("substring(h, 1, 1) <= '3'").select("key", "h", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("day"))
    fixed = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, LISTED)) + " AS t(key, category, action, day)")
    return (
        fixed.select("key", "category", "action", F.col("day").cast("date").alias("day"))
        .unionByName(added.select("key", F.lit("host").alias("category"), F.lit("add").alias("action"), "day"))
        .unionByName(added.where("substring(h, 1, 1) <> '3'").select("key", F.lit("host").alias("category"), F.lit("remove").alias("action"), F.date_add("day", 60).alias("day")))
        .select("key", "category", "action", F.col("day").cast("timestamp_ntz").alias("effective"))
    )


def oracle() -> str:
    """The registered query in DuckDB SQL."""
    fixed = ", ".join(map(str, LISTED))
    return rf"""
        WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST((page_id * 37) % 366 AS INTEGER)) AS fetched,
                   rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.') AS host,
                   string_split(regexp_extract(coalesce(url, ''), '{PATH}', 1), '/') AS steps FROM pages),
        h AS (SELECT DISTINCT host AS key, md5(host) AS h FROM p WHERE host <> ''),
        a AS (SELECT key, h, TIMESTAMP '2024-01-01' + to_days(CAST(('0x' || substr(h, 2, 2)) AS INTEGER)) AS effective FROM h WHERE substr(h, 1, 1) <= '3'),
        e AS (SELECT key, category, action, CAST(day AS TIMESTAMP) AS effective FROM (VALUES {fixed}) t(key, category, action, day)
              UNION ALL SELECT key, 'host', 'add', effective FROM a
              UNION ALL SELECT key, 'host', 'remove', effective + to_days(60) FROM a WHERE substr(h, 1, 1) <> '3'),
        v AS (SELECT *, lead(effective) OVER (PARTITION BY key, category ORDER BY effective, action) AS until FROM e),
        k AS (SELECT page_id, fetched, array_to_string((string_split(host, '.'))[i:], '.') AS key
              FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) u(i) WHERE host <> ''
              UNION SELECT page_id, fetched, host || array_to_string(steps[1:i], '/') || '/'
              FROM p, unnest(range(1, len(steps))) u(i) WHERE host <> ''),
        m AS (SELECT k.page_id, k.key, v.category FROM k JOIN v ON k.key = v.key AND v.action = 'add' AND v.effective <= k.fetched AND (v.until IS NULL OR v.until > k.fetched)),
        g AS (SELECT page_id, string_agg(DISTINCT key, ',' ORDER BY key) AS matched_keys, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM m GROUP BY page_id)
        SELECT p.page_id, p.url, p.fetched, g.page_id IS NOT NULL AS blocked, coalesce(g.matched_keys, '') AS matched_keys, coalesce(g.categories, '') AS categories
        FROM p LEFT JOIN g ON p.page_id = g.page_id"""
