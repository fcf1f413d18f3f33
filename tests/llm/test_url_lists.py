from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from residua.llm import url_lists as u
from residua.llm import common
from residua.llm.queries import op10_url_temporal_lists, url_events


def slow(captures, events):
    def active(name, kind, entry, at):
        past = sorted((t, a) for n, k, e, a, t in events if (n, k, e) == (name, kind, entry) and t <= at)
        return bool(past) and past[-1][1] == "add"

    known, out = {(n, k, e) for n, k, e, _, _ in events}, []
    for page, url, at in captures:
        found = set()
        host = None
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
            host = rest[:cut].rsplit("@", 1)[-1].split(":")[0].lower().removesuffix(".") or None
            path = rest[cut:].split("?")[0].split("#")[0]
            if host and at:
                labels = host.split(".")
                keys = {("domain", ".".join(labels[k:])) for k in range(len(labels))} | {("host", host), ("url", host + path)}
                found = {(n, k, e) for n, k, e in known if (k, e) in keys and active(n, k, e, at)}
        out.append((page, host, len(found), ",".join(sorted({f[0] for f in found})), bool(found)))
    return sorted(out, key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    events = [tuple(r) for r in url_events(pages).collect()]
    assert len(events) > 20 and {e[1] for e in events} == {"host", "domain", "url"}
    captures = [(r.page_id, r.url, datetime(2024, 1, 1) + timedelta(days=r.page_id % 366)) for r in pages.collect()]
    rows = op10_url_temporal_lists(spark, sf).collect()
    assert sorted(map(tuple, rows), key=repr) == slow(captures, events)
    assert any(r.blocked for r in rows)


def test_case_of_paths(spark):
    """Hosts meet in any case, paths as they are."""
    day = datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "url", " X.com/Path", "add", day), ("b", "host", "X.Com", "add", day), ("c", "url", "X.com", "add", day)], "list_name string, kind string, entry string, action string, listed_at timestamp")
    caps = spark.createDataFrame(list(enumerate(["http://x.COM/Path?Q", "http://x.com/path", "http://X.com"])), "page_id bigint, url string").withColumn("fetched_at", F.lit(day))
    assert {r.page_id: r.lists for r in u.filter_urls(caps, events).collect()} == {0: "a,b", 1: "b", 2: "b,c"}


@pytest.mark.parametrize("hot", [1000, 4])
def test_odd_rows(spark, monkeypatch, hot):
    """With every key hot, and with few; one address has most captures and is very long."""
    monkeypatch.setattr(common, "HOT_SHARE", hot)
    day = lambda d: datetime(2024, 1, d)
    events = [("a", "domain", "x.com", "add", day(2)), ("a", "domain", "x.com", "remove", day(4)), ("a", "domain", "x.com", "add", day(4)), ("a", "domain", "x.com", "add", day(6)), ("a", "domain", "x.com", "add", day(6)), ("b", "host", "w.x.com", "add", day(1)), ("b", "url", "x.com/p", "add", day(3)), ("c", "domain", "com", "remove", day(1))]
    urls = ["http://x.com/p?q", "http://x.com/" + "long/" * 20_000, "https://u:1@W.X.com.:80/p#f", "ftp://notx.com/", None, "no address", "http:///p", "http://x.com"]
    caps = [(k * 10 + d, url, day(d)) for k, url in enumerate(urls) for d in range(1, 9)] + [(None, urls[0], day(3)), (1, urls[0], None), *[(1, urls[0], day(7))] * 50]
    frame = spark.createDataFrame([(*c, "clash", 1) for c in caps], "page_id bigint, url string, fetched_at timestamp, host string, n int")
    listed = spark.createDataFrame([*events, ("d", None, "x.com", "add", day(1))], "list_name string, kind string, entry string, action string, listed_at timestamp")
    rows = u.filter_urls(frame, listed).collect()
    assert sorted(map(tuple, rows), key=repr) == slow(caps, events)
    assert u.filter_urls(frame.limit(0), listed).count() == 0
    assert not u.filter_urls(frame, listed.limit(0)).filter("blocked").count()
