import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidewater.llm.list_join import domains_of, host_of, judge


def test_as_brute_force(spark):
    rng = random.Random(13)
    start = date(2024, 1, 1)
    hosts = ["a.x.org", "x.org", "b.y.net", "y.net", "org", "hot.z.com"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice(hosts), start + timedelta(rng.randint(0, 40)), rng.random() < 0.6) for _ in range(60)]
    entries += [(None, "x.org", start, True), ("l1", None, start, True), ("l1", "x.org", None, True)]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts + ['m.a.x.org', 'HOT.z.com'])}{rng.choice(['', '/p', ':80/', '?q'])}" for _ in range(200)] + [None, "", "no url"]
    captures = [(i, u, start + timedelta(rng.randint(-2, 50)), "x") for i, u in enumerate(urls)] + [(999, "http://x.org", None, "x"), (1, urls[1], start, "x"), (1, urls[1], start, "x")]
    got = judge(spark.createDataFrame(captures, "page_id long, url string, fetched date, lists string"), spark.createDataFrame(entries, "list string, domain string, day date, active boolean")).collect()

    def active(list_, domain, day):
        mine = sorted({(d, on) for x, y, d, on in entries if x == list_ and y == domain and d is not None and d <= day})
        last = [on for d, on in mine if d == mine[-1][0]] if mine else [False]
        return all(last)

    def brute(url, day):
        host = url.split("://")[1].split("/")[0].split(":")[0].split("?")[0].lower() if url and "://" in url else None
        if host is None or day is None:
            return host, "", 0
        names = [".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)]
        hits = [x for x in ("l1", "l2") for n in names if active(x, n, day)]
        return host, ",".join(sorted(set(hits))), len(hits)

    want = sorted((i, *map(str, brute(u, d))) for i, u, d, _ in captures)
    assert sorted((r.page_id, str(r.host), r.lists, str(r.n_entries)) for r in got) == want
    assert all(r.blocked == (r.n_entries > 0) for r in got)
    none = spark.createDataFrame([], "page_id long, url string, fetched date")
    assert judge(none, spark.createDataFrame(entries, "list string, domain string, day date, active boolean")).count() == 0


HOSTS = {
    "http://user:pw@evil.com/x": "evil.com",
    "http://a@b@evil.com": "evil.com",
    "https://EVIL.com./x": "evil.com",
    "https://evil.com..:443?q=@good.org": "evil.com",
    "http://evil.com\\@good.org/": "evil.com",
    "http://good.org/@evil.com": "good.org",
    "http://good.org?@evil.com": "good.org",
    "http://good.org#@evil.com": "good.org",
    "http://[2001:DB8::1]:80/": "[2001:db8::1]",
    "http://1.2.3.4:8080": "1.2.3.4",
    "ftp+x://m.evil.com:21": "m.evil.com",
    "http:///path": None,
    "http://:80/": None,
    "http://user@/": None,
    "evil.com/x": None,
    "": None,
    None: None,
}


def test_hosts(spark):
    urls = [(u,) for u in HOSTS]
    got = spark.createDataFrame(urls, "url string").select("url", host_of(F.col("url")).alias("host"), domains_of(host_of(F.col("url"))).alias("above")).collect()
    assert {r.url: r.host for r in got} == HOSTS
    above = {r.host: r.above for r in got}
    assert above["1.2.3.4"] == ["1.2.3.4"] and above["m.evil.com"] == ["m.evil.com", "evil.com", "com"] and above["[2001:db8::1]"] == ["[2001:db8::1]"]


def test_none_slips_by_its_spelling(spark):
    day = date(2024, 1, 1)
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(HOSTS)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("l", "Evil.com.", day, True), ("l", ".", day, True), ("l", "3.4", day, True)], "list string, domain string, day date, active boolean")
    got = {r.page_id: r.blocked for r in judge(captures, entries).collect()}
    assert got == {i: bool(h and h.endswith("evil.com")) for i, h in enumerate(HOSTS.values())}
