import datetime as dt
import random
from collections import Counter

from strataloom.llm import url_filters

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_as_of_join(spark):
    entries = [("bad.example", "spam", D(10), "add"), ("bad.example", "spam", D(20), "remove"), ("bad.example", "spam", D(30), "add"), ("bad.example", "spam", D(30), "add"), ("sub.ok.example", "adult", D(0), "add"), (None, "spam", D(0), "add"), ("x.example", None, D(5), "add"), ("never.example", "spam", D(5), "remove"), ("day.example", "spam", D(7), "add"), ("day.example", "spam", D(7), "remove")]
    captures = [(1, "http://bad.example/a", D(9)), (2, "https://www.BAD.example/a", D(10)), (3, "http://u@bad.example:80/", D(20)), (4, "http://bad.example", D(400)), (5, "http://ok.example/", D(1)), (6, "http://a.sub.ok.example/?q", D(1)), (7, None, D(1)), (8, "not a url", D(1)), (9, "http://bad.example/", None), (10, "http://notbad.example/", D(15)), (11, "http://x.example/", D(6)), (12, "http://never.example/", D(6)), (13, "http://day.example/", D(8)), (2, "https://www.BAD.example/a", D(10)), (None, "http://bad.example/1", D(11)), (None, "http://bad.example/2", D(11)), (14, f"http://{'a.' * 5000}sub.ok.example/", D(1)), (15, f"http://{'a' * 5000}/{'b' * 100_000}", D(1))]
    got = url_filters.temporal_list_join(spark.createDataFrame([(*c, "v", 3) for c in captures], "page_id long, url string, fetch_day date, verdict string, n_active int"), spark.createDataFrame(entries, "domain string, category string, day date, action string")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {2, 4, 6, 11, 14, None}
    assert sorted(str(r.page_id) for r in got) == sorted(str(c[0]) for c in captures)  # a row for each capture
    assert sum(r.page_id is None and r.verdict == "block" for r in got) == 2 and {r.page_id: r.matched for r in got}[6] == "sub.ok.example"
    assert {r.page_id: r.categories for r in got}[2] == "spam"


def test_nothing_listed_and_no_rows(spark):
    none = spark.createDataFrame([], "domain string, category string, day date, action string")
    captures = spark.createDataFrame([(1, "http://a.b/", D(1))], "page_id long, url string, fetch_day date")
    assert [r.verdict for r in url_filters.temporal_list_join(captures, none).collect()] == ["allow"]
    assert url_filters.temporal_list_join(captures.limit(0), none).count() == 0


def test_captures_against_brute_force(spark):
    """One host holds most captures; equal ids, equal rows and equal days abound."""
    rnd = random.Random(3)
    domains = [f"{a}.{b}" for a in "abcde" for b in ("com", "org")] + ["com", "x.a.com", "y.x.a.com"]
    entries = [(rnd.choice(domains), rnd.choice(["spam", "adult", None]), D(rnd.randrange(40)), rnd.choice(["add", "add", "remove"])) for _ in range(120)]
    captures = [(rnd.randrange(30), "http://" + (("y.x.a.com" if rnd.random() < 0.7 else rnd.choice(domains)) + "/"), D(rnd.randrange(45))) for _ in range(400)]

    def verdict(url, day):
        host, on = url[7:-1], set()
        for domain in set(d for d, *_ in entries):
            for category in set(c or "" for _, c, *_ in entries):
                states = {}
                for d, c, at, action in entries:
                    if d == domain and (c or "") == category and at <= day:
                        states[at] = max(states.get(at, ""), action)
                if states and states[max(states)] == "add" and (host == domain or host.endswith("." + domain)):
                    on.add((domain, category))
        return len(on), ",".join(sorted({c for _, c in on})), max((d for d, _ in on), key=lambda d: (len(d), d), default=None)

    rows = url_filters.temporal_list_join(spark.createDataFrame(captures, "page_id long, url string, fetch_day date"), spark.createDataFrame(entries, "domain string, category string, day date, action string"))
    got = Counter((r.page_id, r.host, r.fetch_day, r.n_active, r.categories, r.matched) for r in rows.collect())
    assert got == Counter((i, url[7:-1], str(day), *verdict(url, day)) for i, url, day in captures)
