import random

import pytest
from pyspark.sql import functions as F

from flowlens.llm import revisits
from flowlens.llm.revisits import KEPT_FIELDS, canonical_url, resolve_revisits, time_slices, with_bodies

SCHEMA = "record_id long, kind string, url string, at long, status int, headers map<string,string>, body string"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumn("at", F.timestamp_seconds("at")).withColumn("outcome", F.lit("an extra column"))


@pytest.mark.parametrize(
    "url,expected",
    [
        ("http://www.Example.com:80/a/?b=2&a=1&utm_source=x#top", "example.com/a?a=1&b=2"),
        ("HTTPS://user:pw@example.com:443/a", "example.com/a"),
        ("//example.com", "example.com"),
        ("https://example.com:8080/", "example.com:8080"),
        ("http://example.com/?gclid=1", "example.com"),
        ("http://example.com/Path?X=y", "example.com/Path?X=y"),
        ("", None), (None, None), ("#x", None),
    ],
)
def test_canonical_url(spark, url, expected):
    row = spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("c")).first()
    assert row["c"] == expected


def brute(rows):
    out = []
    tag = lambda h: (h.get("etag") or "").strip().removeprefix("W/") or None
    for rid, kind, url, at, status, headers, _ in rows:
        if kind != "revisit":
            continue
        own = {k.lower(): v for k, v in (headers or {}).items()}
        earlier = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url and r[3] < at]
        if not earlier:
            out.append((rid, None, "missing", own, None))
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        theirs = {k.lower(): v for k, v in (best[5] or {}).items()}
        if tag(own) and tag(theirs):
            outcome = "resolved" if tag(own) == tag(theirs) else "changed"
        elif "last-modified" in own and "last-modified" in theirs:
            outcome = "resolved" if own["last-modified"] == theirs["last-modified"] else "changed"
        else:
            outcome = "unconfirmed"
        if outcome == "changed":
            out.append((rid, best[0], outcome, own, None))
        else:
            merged = theirs | {k: v for k, v in own.items() if k not in KEPT_FIELDS}
            out.append((rid, best[0], outcome, merged, best[6]))
    return sorted(out, key=lambda x: x[0])


@pytest.mark.parametrize("slices", [1, 4, 256])
def test_equals_brute_force(spark, slices):
    rng = random.Random(slices)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        headers = {}
        if rng.random() < 0.6:
            headers["ETag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice(["mon", "tue"])
        headers |= {"Content-Length": str(i)} | ({"Expires": f"e{i}"} if i % 2 else {})
        # One URL has half of all records; times repeat.
        url = rng.choice(["a.com/hot", "a.com/hot", f"a.com/{rng.randrange(20)}", "b.com"])
        rows.append((i, kind, url, rng.randrange(60), 200 if kind == "response" and rng.random() < 0.8 else 304, headers, f"body {i}"))
    spelled = [(r, k, f"http://{u}", *rest) for r, k, u, *rest in rows]
    got = resolve_revisits(table(spark, spelled), slices).collect()
    assert sorted(((r["record_id"], r["response_id"], r["outcome"], r["headers"], r["body"]) for r in got), key=lambda x: x[0]) == brute(rows)


def test_hard_rows(spark):
    rows = [
        (1, "response", "http://a.com/x", 10, 200, None, None),
        (2, "revisit", "http://A.com/x/", 20, 304, None, None),
        (3, "revisit", None, 20, 304, {"ETag": "1", "etag": "2"}, None),
        (4, "revisit", "http://a.com/x", None, 304, {}, None),
        (5, "response", "http://a.com/x", 5, 404, {}, "no"),
        (6, "revisit", "http://a.com/x", 10, 304, {}, None),
        (2, "revisit", "http://A.com/x/", 20, 304, None, None),
        (None, "response", "", 1, 200, {}, "lost"),
    ]
    got = resolve_revisits(table(spark, rows)).collect()
    seen = sorted((r["record_id"], r["response_id"], r["outcome"], tuple(r["headers"].items())) for r in got)
    assert seen == [
        (2, 1, "unconfirmed", ()), (2, 1, "unconfirmed", ()), (3, None, "missing", (("etag", "2"),)),
        (4, None, "missing", ()), (6, None, "missing", ()),
    ]
    assert resolve_revisits(table(spark, [])).collect() == []


def test_one_stray_time_and_a_hot_url(spark, monkeypatch):
    """A third of all records on one URL, one time far off: slices stay small, hot bodies are dealt out."""
    monkeypatch.setattr(revisits, "BODY_REVISITS", 20)
    rng, rows = random.Random(7), []
    for i in range(1500):
        kind = "response" if rng.random() < 0.02 else "revisit"
        url = "a.com/hot" if i % 3 == 0 else f"a.com/{rng.randrange(300)}"
        at = -2_000_000_000 if i == 0 else 1_700_000_000 + rng.randrange(5000)
        headers = {"ETag": rng.choice(['"1"', '"2"'])}
        rows.append((i, kind, url, at, 200 if kind == "response" else 304, headers, f"body {i}"))
    spelled = [(r, k, f"http://{u}", *rest) for r, k, u, *rest in rows]
    records = table(spark, spelled)
    got = resolve_revisits(records).collect()
    assert sorted(((r["record_id"], r["response_id"], r["outcome"], r["headers"], r["body"]) for r in got), key=lambda x: x[0]) == brute(rows)
    timed = records.select(F.unix_micros("at").alias("micros"))
    sizes = [r["count"] for r in time_slices(timed, 50).transform(timed).groupBy("slice").count().collect()]
    assert max(sizes) <= 2 * 1500 / 50


def test_a_hot_body_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(revisits, "BODY_REVISITS", 10)
    judged = spark.range(1000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("taken"))
    bodies = spark.createDataFrame([(1, "x"), (950, "y")], "body_of long, body string")
    got = with_bodies(judged, bodies)
    assert got.count() == 1000 and got.where("body = 'x'").count() == 900 and got.where("body = 'y'").count() == 1
    # 900 takers in 90 parts.
    assert got.where("body = 'x'").groupBy("part").count().agg(F.max("count")).first()[0] <= 20


def test_all_at_one_time(spark):
    rows = [(i, "response" if i < 5 else "revisit", "http://a.com/", 10, 200, {}, "b") for i in range(50)]
    got = resolve_revisits(table(spark, rows)).collect()
    assert len(got) == 45 and {r["outcome"] for r in got} == {"missing"}
