from datetime import datetime

from docgraph.llm.url_filter import filter_urls, lookup_keys
from pyspark.sql import functions as F

DAY = lambda m, d: datetime(2024, m, d)
ENTRIES = [
    ("example.com", "spam", "add", DAY(2, 1)), ("example.com", "spam", "remove", DAY(3, 1)), ("example.com", "spam", "add", DAY(5, 1)),
    ("www.example.com", "adult", "add", DAY(1, 1)), ("site.org/bad/", "path", "add", DAY(1, 1)), ("other.net", "x", "remove", DAY(1, 1)),
    ("same.net", "x", "add", DAY(1, 1)), ("same.net", "x", "remove", DAY(1, 1)), (None, "x", "add", DAY(1, 1)), ("late.net", "x", "add", None),
]


def test_as_of_lookups(spark):
    rows = [
        (1, "http://example.com/a", DAY(1, 31)), (2, "http://example.com/a", DAY(2, 1)), (3, "https://sub.EXAMPLE.com:80/x?y", DAY(2, 29)), (4, "http://example.com", DAY(3, 1)),
        (5, "http://example.com", DAY(9, 1)), (6, "http://u@www.example.com./", DAY(2, 2)), (7, "http://site.org/bad/page", DAY(2, 2)), (8, "http://site.org/badly", DAY(2, 2)),
        (9, "http://other.net/", DAY(2, 2)), (10, "http://same.net/", DAY(2, 2)), (11, None, DAY(2, 2)), (12, "not a url", DAY(2, 2)), (13, "http://example.com/", None),
        (14, "http://late.net", DAY(2, 2)), (1, "http://example.com/a", DAY(2, 1)), (None, "http://notexample.com", DAY(2, 2)),
    ]
    captures = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, fetched timestamp_ntz, key string").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "key string, category string, action string, effective timestamp_ntz")
    got = filter_urls(captures, entries).collect()
    assert len(got) == len(rows)
    hits = sorted(((r.page_id, r.matched_keys, r.categories) for r in got if r.blocked), key=repr)
    assert hits == sorted([
        (2, "example.com", "spam"), (3, "example.com", "spam"), (5, "example.com", "spam"), (6, "example.com,www.example.com", "adult,spam"),
        (7, "site.org/bad/", "path"), (1, "example.com", "spam"),
    ], key=repr)
    assert all(r.matched_keys == r.categories == "" for r in got if not r.blocked)
    assert not any(r.blocked for r in filter_urls(captures, entries.limit(0)).collect())
    assert filter_urls(captures.limit(0), entries).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("https://a.b.co/x/y?z=/q/",), ("ftp://host",), ("/x",)], "u string").select(lookup_keys(F.col("u")).alias("k"))
    got = [r.k for r in df.collect()]
    assert got[0] == ["a.b.co", "b.co", "co", "a.b.co/", "a.b.co/x/"] and got[1] == ["host"] and got[2] == []


def test_a_url_of_a_megabyte_and_a_list_of_paths(spark):
    import time

    deep = "http://a.org" + "/step" * 200_000
    urls = [(1, deep), (2, "http://a.org/step/step/x"), (3, "http://a.org/step"), (4, "http://b.org/step/step/"), (5, "http://" + "x." * 5000 + "org/"), (6, "http://sub.a.org/step/")]
    captures = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "TIMESTAMP_NTZ '2024-05-01 00:00:00' AS fetched")
    listed = [("a.org/step/step/", "deep", "add", "2024-01-01"), ("a.org/step/step/step/", "deeper", "add", "2024-06-01"), ("org", "tld", "add", "2024-04-30"), ("org", "tld", "remove", "2024-05-01")]
    entries = spark.createDataFrame(listed, "key string, category string, action string, day string").selectExpr("key", "category", "action", "CAST(day AS timestamp_ntz) AS effective")
    began = time.time()
    got = {r.page_id: (r.blocked, r.matched_keys) for r in filter_urls(captures, entries).collect()}
    assert got == {1: (True, "a.org/step/step/"), 2: (True, "a.org/step/step/"), 3: (False, ""), 4: (False, ""), 5: (False, ""), 6: (False, "")}
    assert time.time() - began < 30
