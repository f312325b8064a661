"""URL keys, intervals and verdicts against a plain replay of the list's log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.llm import url_filter as U


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_keys(spark):
    urls = [
        ("HTTPS://user:pw@WWW.Site.Example.com:8080/a//b/c?x=/d#e", {"host:www.site.example.com", "domain:www.site.example.com", "domain:site.example.com", "domain:example.com", "domain:com", "prefix:www.site.example.com/a", "prefix:www.site.example.com/a/b", "prefix:www.site.example.com/a/b/c"}),
        ("http://h.", {"host:h", "domain:h"}),
        ("http://[::1]:80/x", {"host:[::1]", "domain:[::1]", "prefix:[::1]/x"}),
        ("no url", set()), ("", set()), (None, set()), ("http:///p", set()),
    ]
    df = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    got = [set(r.k) for r in df.select(U.keys_of(F.col("url")).alias("k")).collect()]
    assert got == [k for _, k in urls]


def test_replay(spark):
    rng = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "a.com.b.org"]
    log = [(rng.choice(U.KINDS), None, rng.choice(["p", "q", None]), rng.choice(["add", "add", "remove"]), rng.randint(0, 30)) for _ in range(120)]
    log = [(k, rng.choice(hosts) + (rng.choice(["/s", "/s/t", "/u/"]) if k == "prefix" else ""), c, a, d) for k, _, c, a, d in log]
    caps = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/s', '/s/t/z', '/st', '/u'])}", rng.randint(-2, 32)) for i in range(250)]

    def matches(kind, pattern, url):
        rest = url.removeprefix("http://").rstrip("/")
        host = rest.split("/")[0]
        pattern = pattern.rstrip("/")
        return {"host": host == pattern, "domain": host == pattern or host.endswith("." + pattern), "prefix": rest == pattern or rest.startswith(pattern + "/")}[kind]

    entries = spark.createDataFrame([(k, p, c, a, day(d)) for k, p, c, a, d in log], "kind string, pattern string, category string, action string, at date")
    df = spark.createDataFrame([(i, u, day(d)) for i, u, d in caps], "page_id long, url string, fetched_at date")
    got = {r.page_id: (r.blocked, r.n_entries, list(r.categories)) for r in U.filter_urls(df, entries).collect()}
    for i, u, d in caps:
        state = {}
        for k, p, c, a, at in sorted(log, key=lambda e: (e[4], e[3])):
            if at <= d and matches(k, p, u):
                state[k, p.rstrip("/"), c or ""] = a == "add"
        on = [key for key, listed in state.items() if listed]
        assert got[i] == (bool(on), len(on), sorted({c for _, _, c in on})), (u, d)


def test_odd_rows(spark):
    entries = spark.createDataFrame([("host", "h.com", "x", "add", day(0)), (None, "h.com", "x", "add", day(0)), ("host", None, "x", "add", day(0))], "kind string, pattern string, category string, action string, at date")
    rows = [(1, "http://h.com/", day(1), "k"), (1, "http://h.com/", day(1), "k"), (None, None, day(1), None), (2, "http://h.com", None, "k"), (3, "http://" + "a." * 3000 + "com/" + "p/" * 3000, day(1), "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at date, key string")
    got = U.filter_urls(df, entries)
    assert got.columns == [*df.columns, "blocked", "n_entries", "categories"]
    assert sorted((str(r.page_id), r.blocked) for r in got.collect()) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", False)]
    assert U.filter_urls(df.limit(0), entries).count() == 0
    assert not any(r.blocked for r in U.filter_urls(df, entries.limit(0)).collect())
    with pytest.raises(ValueError):
        U.filter_urls(df.withColumn("blocked", F.lit(1)), entries)
