"""Path entries of any depth."""

from datetime import date

from pyspark.sql import functions as F

from priorframe.llm import urlfilter


def test_deeper_paths(spark):
    entries = spark.createDataFrame([("path", v, "add", date(2024, 1, 1)) for v in ("ok.com/x/y", "ok.com/a", "ok.com/a/b/c")], "kind string, value string, action string, at date")
    want = {"http://ok.com/x": None, "http://ok.com/x/y": "ok.com/x/y", "http://ok.com/x/y/z?q": "ok.com/x/y", "http://ok.com/x/yy": None, "http://OK.com/x/y/": "ok.com/x/y", "http://ok.com/z/x/y": None,
            "http://ok.com/a/b": "ok.com/a", "http://ok.com/a/b/c#d": "ok.com/a/b/c", "http://ok.com/?a=/x/y": None, "http://ok.com": None, "http://www.ok.com/x/y": None}
    caps = spark.createDataFrame([(i, u, date(2024, 2, 1)) for i, u in enumerate(want)], "page_id long, url string, fetched_at date")
    got = {r.url: r.rule for r in urlfilter.evaluate(spark, caps, entries).collect()}
    assert got == want


def test_hosts(spark):
    urls = {"http://[::1]/a": ("[::1]", "a"), "//Host.com/p/q": ("host.com", "p"), "https://u:p@Host.com.:80/x": ("host.com", "x"), "http://host": ("host", ""), "host/p": ("", ""), "http:///p": ("", ""), "http://[::1]:8080": ("[::1]", "")}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", urlfilter.host(F.col("u")), urlfilter.segment(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2] if r[1] else "") for r in rows} == urls
