import datetime as dt

import pytest

from gatewatch.llm import url_filter as U

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("spam", "bad.example.org", True, day(10), "add"), ("spam", "bad.example.org", True, day(20), "drop"),
            ("spam", "Bad.Example.org.", True, day(30), "add"), ("spam", "bad.example.org", True, day(30), "add"),
            ("good", "bad.example.org/docs", False, day(0), "add"), ("spam", "org", True, day(100), "add"),
            ("spam", "org", True, day(100), "drop"), ("other", "bad.example.org", True, day(15), "add"),
            (None, "x.com", True, day(0), "add"), ("spam", None, True, day(0), "add"), ("spam", "x.com", True, None, "add")]
    return spark.createDataFrame(rows, "list string, pattern string, blocks boolean, day date, action string")


@pytest.mark.parametrize("url,n,want", [
    ("http://bad.example.org/", 5, (False, None, 0)), ("http://bad.example.org/", 10, (True, "spam", 1)),
    ("http://a.bad.example.org", 15, (True, "other", 2)), ("http://bad.example.org/x", 20, (True, "other", 1)),
    ("HTTP://user@BAD.example.org:80/docs/a?b#c", 12, (False, "good", 2)), ("http://bad.example.org/docsx", 12, (True, "spam", 1)),
    ("http://notbad.example.org/", 12, (False, None, 0)), ("http://bad.example.org./", 30, (True, "other", 2)),
    ("http://x.org/", 101, (False, None, 0)), ("not a url", 12, (False, None, 0)), (None, 12, (False, None, 0)),
    ("http://bad.example.org/", None, (False, None, 0)), ("http://x.com/", 5, (False, None, 0))])
def test_as_of(spark, events, url, n, want):
    df = spark.createDataFrame([(1, url, None if n is None else day(n), "own")] * 2, "page_id long, url string, fetched_on date, pattern string")
    got = U.judge(df, events).collect()
    assert len(got) == 2 and all((r.blocked, r.list, r.n_active) == want for r in got)


def test_empty(spark, events):
    df = spark.createDataFrame([(1, "http://bad.example.org/", day(12))], "page_id long, url string, fetched_on date")
    assert U.judge(df.limit(0), events).count() == 0
    assert [r.blocked for r in U.judge(df, events.limit(0)).collect()] == [False]


def test_intervals_do_not_overlap(events):
    rows = U.intervals(events).where("pattern = 'bad.example.org' and list = 'spam'").orderBy("since").collect()
    assert [(r.since, r.until) for r in rows] == [(day(10), day(20)), (day(30), None)]
