"""Pattern sets of sites: expressions that are none, age, gates and what a discovery does."""

from datetime import datetime

from pyspark.sql import functions as F

from cairn.operators import site_patterns as S

PATTERNS = [
    ("a", "product", r"/p/\d+", 0.8, 0), ("a", "product", r"/P/", 0.9, 1), ("a", "product", "([", 0.99, 2), ("a", "category", r"^/c/", 0.7, 3), ("a", "skip", r"cart|\?", 0.5, 4), ("a", "skip", "*", 1.0, 5),
    ("a", "category", r"^/c/", 0.7, 6), ("b", "product", "/x", 0.65, 0), ("c", "category", "/", 1.0, 0), ("d", "product", "/y", 0.75, 0), ("a", "product", None, 0.95, 7), ("e", "product", "/[0-9]$", 0.7, 0),
]
PATHS = [("a", p) for p in ("/p/12", "/p/x", "/c/tents", "/c/p/1?q", "/cart", "/", "/P/7")] + [("a", None), ("b", "/x"), ("z", "/p/1")] + [("e", f"/item/{i}") for i in range(7)] + [("c", f"/{i}") for i in range(6)]


def patterns(spark):
    return spark.createDataFrame(PATTERNS, S.PATTERN)


def test_an_expression_that_is_none_matches_nothing(spark):
    flags = {(r.kind, r.regex): r.valid for r in S.checked(patterns(spark)).collect()}
    assert flags["product", "(["] is False and flags["skip", "*"] is False and flags["product", None] is False and flags["skip", r"cart|\?"] and len(flags) == len({p[1:3] for p in PATTERNS})
    hits = S.matched(spark.createDataFrame(PATHS, "host string, path string"), patterns(spark))
    assert not {r.regex for r in hits.collect()} & {"([", "*", None}


def test_classes(spark):
    got = {(r.host, r.path): (r.kind, r.regex, r.confidence) for r in S.classified(spark.createDataFrame(PATHS + PATHS[:2], "host string, path string"), patterns(spark)).collect()}
    assert got["a", "/p/12"] == ("product", "/P/", 0.9) and got["a", "/c/tents"] == ("category", "^/c/", 0.7) and got["a", "/c/p/1?q"] == ("skip", r"cart|\?", 0.5)
    assert got["a", "/cart"][0] == "skip" and got["a", "/"] == ("other", None, None) and got["z", "/p/1"][0] == "other" and got["b", "/x"][0] == "product" and len(got) == len(set(PATHS))


def test_gates_and_age(spark):
    at = lambda h: datetime(2026, 1, 2, h)
    sites = spark.createDataFrame([("a", 0.6, at(0)), ("b", 0.9, at(1)), ("c", 0.9, at(1)), ("d", 0.59, at(1)), ("e", 1.0, datetime(2026, 1, 1, 23, 59)), ("f", 1.0, at(2))], "host string, overall double, created_at timestamp")
    now = F.lit(datetime(2026, 1, 3, 0))
    got = {r.host: tuple(r)[1:] for r in S.site_gates(sites, patterns(spark), now).collect()}
    assert got["a"] == (True, False, "([", "^/c/")  # the surest pattern is named even if it is no expression
    assert got["b"][:2] == (False, False) and got["c"] == (False, False, None, "/") and got["d"][0] is False and got["e"][:2] == (True, True) and got["f"][:2] == (False, False)
    urls = spark.createDataFrame(PATHS + [("d", "/y"), ("f", "/"), ("g", "/1"), ("h", "/1"), ("h", "/2"), ("h", "/3"), ("h", "/4"), ("h", "/5")], "host string, path string")
    plans = {r.host: tuple(r)[1:] for r in S.discovery(urls, sites, patterns(spark), now, most=2).collect()}
    assert plans["a"] == ("cached", 8, 3, 1, 2) and plans["b"][0] == "low_confidence" and plans["e"] == ("analyse", 7, 0, 0, 0) and plans["g"][0] == "crawl" and plans["h"][0] == "analyse" and plans["z"][0] == "crawl"
    later = {r.host: tuple(r)[1:] for r in S.discovery(urls, sites, patterns(spark), now + F.expr("INTERVAL 1 HOUR"), most=0).collect()}
    assert later["a"][0] == "analyse"
