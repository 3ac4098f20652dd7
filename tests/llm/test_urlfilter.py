import datetime as dt
import random

from glossweave.llm import common
from glossweave.llm.urlfilter import host_of, intervals, judged

D = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def brute(url_host, fetched, log):
    if url_host is None or fetched is None:
        return []
    names = [".".join(url_host.split(".")[i:]) for i in range(url_host.count(".") + 1)]
    out = []
    for rule in sorted(set(names)):
        state = "remove"
        for _, action, at in sorted((x for x in log if x[0] and x[2] is not None and x[0].lower() == rule and x[1] in ("add", "remove")), key=lambda x: (x[2], x[1])):
            if at <= fetched:
                state = action
        if state == "add":
            out.append(rule)
    return out


def test_equals_brute_force(spark):
    r = random.Random(1)
    hosts = ["[::1]", "a.example.com", "b.a.example.com", "example.com", "com", "x.org", "10.0.0.1"]
    log = [(r.choice(hosts), r.choice(["add", "remove"]), day(r.randint(0, 40))) for _ in range(60)] + [(None, "add", D), ("x.org", None, D), ("x.org", "add", None), ("X.ORG", "add", day(3)), ("x.org", "odd", D)]
    urls = [("http://A.example.com:80/x", "a.example.com"), ("https://u:p@b.a.example.com./?q", "b.a.example.com"), ("example.com/x", None), ("", None), (None, None), ("ftp://x.org", "x.org"), ("http://10.0.0.1/", "10.0.0.1"), ("http:///x", None), ("http://" + "a." * 500 + "x.org", "a." * 500 + "x.org"), ("http://[::1]:80/x", "[::1]"), ("http://u@v@example.com/", "example.com")]
    rows = [(i, *r.choice(urls), r.choice([*range(45), None])) for i in range(200)]
    rows += [rows[0]]
    c = spark.createDataFrame([(i, u, day(n), "x", 7) for i, u, _, n in rows], "page_id long, url string, fetched date, rules string, rule long")
    e = spark.createDataFrame([(*x, "x") for x in log], "rule string, action string, at date, host string")
    got = sorted((x.page_id, x.host or "", x.n_active, x.rules, x.blocked) for x in judged(c, e).collect())
    assert got == sorted((i, h or "", len(f), ",".join(f), bool(f)) for i, _, h, n in rows for f in [brute(h, day(n), log)])
    assert judged(c, e.where("false")).where("blocked").count() == 0
    assert judged(c.where("false"), e).count() == 0


def test_intervals_touch_and_do_not_overlap(spark):
    log = [("a", "add", day(1)), ("a", "add", day(2)), ("a", "remove", day(5)), ("a", "remove", day(6)), ("a", "add", day(9)), ("a", "add", day(7)), ("a", "remove", day(7))]
    got = sorted(map(tuple, intervals(spark.createDataFrame(log, "rule string, action string, at date")).collect()))
    assert got == [("a", day(1), day(5)), ("a", day(9), None)]


def test_hosts(spark):
    df = spark.createDataFrame([("HTTP://Ex.Com",), ("x",), (" https://a.b?x",)], "url string")
    assert [r[0] for r in df.select(host_of(df.url)).collect()] == ["ex.com", None, "a.b"]


def test_hot_hosts_and_rules(spark, monkeypatch):
    monkeypatch.setattr(common, "WARM", 20)
    c = spark.createDataFrame([(i, f"http://h{i % 200}.example.com/" if i % 3 else ("http://hot.com/" if i % 2 else None), day(i % 50), "own") for i in range(900)], "page_id long, url string, fetched date, found string")
    e = spark.createDataFrame([("com", "add", day(10)), ("com", "remove", day(20)), ("hot.com", "add", day(15)), ("h7.example.com", "add", day(0))], "rule string, action string, at date")
    log = [tuple(r) for r in e.collect()]
    got = judged(c, e)
    assert got.columns == ["page_id", "url", "fetched", "found", "host", "n_active", "rules", "blocked"]
    assert {r.page_id: r.rules for r in got.collect()} == {r.page_id: ",".join(brute(r.url and r.url[7:-1], r.fetched, log)) for r in c.collect()}
