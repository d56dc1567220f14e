import datetime as dt

from pyspark.sql import functions as F

from wavelens.llm import op05_urls as op
from wavelens.llm import queries as q

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def _brute(captures, entries, keys):
    out = []
    for url, t in captures:
        m = []
        for k in keys.get(url, []):
            past = [(a, x) for kk, a, x in entries if kk == k and a is not None and x in ("add", "remove")
                    and t is not None and a <= t]
            if past:
                last = max(a for a, _ in past)
                if all(x == "add" for a, x in past if a == last):
                    m.append((k, last))
        out.append((url, t, len(m), min(m) if m else (None, None)))
    return sorted(out, key=repr)


def _check(spark, captures, entries):
    cap = spark.createDataFrame(captures, "url string, fetched_at timestamp")
    ent = spark.createDataFrame(entries, "key string, at timestamp, action string")
    keys = {r.url: r.k for r in cap.select("url", op.keys(F.col("url")).alias("k")).collect()}
    got = sorted(((r.row.url, r.row.fetched_at, r.n_matches, (r.key, r.since))
                  for r in op.judge(cap, ent).collect()), key=repr)
    assert got == _brute(captures, entries, keys)


def test_as_of(spark):
    urls = ["http://a.b.example.com/x/y?z", "https://u:p@EXAMPLE.com:80/", "ftp://other.org", "nonsense", "", None,
            "http://a.b.example.com/x"]
    captures = [(u, at(h)) for u in urls for h in (-5, 0, 3, 24, 25, 60, 99)] + [(urls[0], None)] + [(urls[0], at(3))] * 3
    entries = [("example.com", at(0), "add"), ("example.com", at(24), "remove"), ("a.b.example.com", at(10), "add"),
               ("a.b.example.com/x", at(3), "add"), ("a.b.example.com/x", at(3), "remove"), ("example.com", at(60), "add"),
               ("example.com", at(60), "add"), (None, at(0), "add"), ("other.org", None, "add"), ("other.org", at(1), "odd")]
    _check(spark, captures, entries)
    _check(spark, captures, [])
    _check(spark, [], entries)


def test_captures_between_entries_of_one_day(spark):
    """Several entries within a day, an hour and a minute; each capture is judged by its own time."""
    key, minutes = "http://x.org/a", [0, 5, 59, 60, 61, 119, 600, 660, 720, 1439, 1440, 2000]
    entries = [("x.org", at(m / 60), "remove" if i % 2 else "add") for i, m in enumerate(minutes)]
    captures = [(key, at((m + d) / 60)) for m in minutes for d in (-1, 0, 1, 30)]
    _check(spark, captures, entries)
    _check(spark, captures, entries + [("x.org/a", at(h), "add" if h % 3 else "remove") for h in range(48)] * 2)


def test_every_event_is_an_entry(spark):
    _, entries = q._url_list(spark, "/root/testdata/sf0.001")
    assert entries.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert entries.select("at").distinct().count() > 100


def test_filter_keeps_columns(spark):
    cap = spark.createDataFrame([("http://x.org/a", at(1), "k", 1), ("http://y.org/a", at(1), None, 2)],
                                "url string, fetched_at timestamp, key string, start long")
    ent = spark.createDataFrame([("x.org", at(0), "add")], "key string, at timestamp, action string")
    out = op.filter_captures(cap, ent)
    assert out.columns == cap.columns and [r.start for r in out.collect()] == [2]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    captures, entries = q._url_list(spark, sf)
    cap = [(r.page_id, r.url, r.fetched_at) for r in captures.collect()]
    keys = {r.url: r.k for r in captures.select("url", op.keys(F.col("url")).alias("k")).collect()}
    want = _brute([(u, t) for _, u, t in cap], [tuple(r) for r in entries.collect()], keys)
    got = q.op5_url_filter(spark, sf).collect()
    seconds = lambda t: -1 if t is None else int(t.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sorted(((r.url, r.fetched_at, r.n_matches, (r.key, r.since)) for r in got), key=repr) == sorted(
        ((u, seconds(t), n, (k, seconds(s))) for u, t, n, (k, s) in want), key=repr)
    assert 0 < sum(r.listed for r in got) < len(got)
