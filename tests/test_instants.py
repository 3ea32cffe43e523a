from datetime import datetime, timezone

from grainmill.operators import instants

FEEDS = [("cn", "Asia/Shanghai", "ymd"), ("hk", "Asia/Hong_Kong", "dmy"), ("us", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("au", "Australia/Sydney", "dmy"), ("in", "Asia/Kolkata", "dmy")]
CREATED = datetime(2024, 5, 10, 18, 30, 15, 250000)
U = lambda *a: datetime(*a, tzinfo=timezone.utc)

CASES = [
    ("2024-03-08 11:26:27", "cn", U(2024, 3, 8, 3, 26, 27)), ("2024-03-08", "cn", U(2024, 3, 7, 16)), ("2024年11月14日下午5:12", "cn", U(2024, 11, 14, 9, 12)), ("2022年9月27日上午12:09", "cn", U(2022, 9, 26, 16, 9)), ("2023年2月3日 23时20分", "cn", U(2023, 2, 3, 15, 20)),
    ("23-11-09", "cn", U(2023, 11, 8, 16)), ("20230531083125", "cn", U(2023, 5, 31, 0, 31, 25)), ("20231119", "cn", U(2023, 11, 18, 16)), ("1715278173", "us", U(2024, 5, 9, 18, 9, 33)), ("1763534042405", "cn", U(2025, 11, 19, 6, 34, 2, 405000)), ("1727238070.0", "cn", U(2024, 9, 25, 4, 21, 10)),
    ("May 9, 2022 10:49:28 PM", "us", U(2022, 5, 10, 2, 49, 28)), ("15 Aug 2023", "hk", U(2023, 8, 14, 16)), ("1 Aug 2022, 9:55 PM", "de", U(2022, 8, 1, 19, 55)), ("Mon, 24 Jan 2022 20:30:28 +0800", "cn", U(2022, 1, 24, 12, 30, 28)),
    ("2-22-2023", "us", U(2023, 2, 22, 5)), ("9/3/22", "us", U(2022, 9, 3, 4)), ("09/04/2022", "de", U(2022, 4, 8, 22)), ("30.04.2023 02:15:11", "in", U(2023, 4, 29, 20, 45, 11)), ("01/04/2024 6:36 AM", "us", U(2024, 1, 4, 11, 36)),
    ("2022-11-20 15:13:00 GMT+5:30", "cn", U(2022, 11, 20, 9, 43)), ("2025-02-01T00:58:39-0500", "us", U(2025, 2, 1, 5, 58, 39)), ("2023-10-28T19:42:05.500333000Z", "cn", U(2023, 10, 28, 19, 42, 5, 500333)), ("2024-02-18 20:20 CST", "cn", U(2024, 2, 18, 12, 20)), ("2024-02-18 20:20 CST", "us", None),
    ("2022-11-06 01:37:00 America/New_York", "us", U(2022, 11, 6, 5, 37)), ("2022-11-06 01:37 EST", "us", U(2022, 11, 6, 6, 37)), ("2024-03-10 02:30", "us", None), ("2024-03-10 02:30 America/New_York", "cn", None), ("2025-10-26 02:50", "de", U(2025, 10, 26, 0, 50)), ("2024-10-06 02:33 Australia/Sydney", "au", None),
    ("3小时前", "cn", U(2024, 5, 10, 15, 30, 15, 250000)), ("2 days ago", "us", U(2024, 5, 8, 4)), ("昨日发布", "cn", U(2024, 5, 9, 16)), ("today", "us", U(2024, 5, 10, 4)), ("09-28发布", "cn", U(2023, 9, 27, 16)), ("5月11日", "cn", U(2024, 5, 10, 16)), ("10 Aug", "in", U(2023, 8, 9, 18, 30)), ("29 Feb", "de", U(2024, 2, 28, 23)),
    ("２０２３－０８－０７Ｔ００：０４：１８", "cn", U(2023, 8, 6, 16, 4, 18)), ("2024-02-30", "cn", None), ("31/04/2023", "de", None), ("01/02/2023", "cn", None), ("0000-00-00", "cn", None), ("asap", "us", None), ("长期有效", "cn", None), ("", "cn", None), (None, "cn", None), ("nan", "cn", None), ("2024-01-01 25:00", "cn", None), ("2024-01-01 10:00", "nowhere", None), ("2024-01-01T10:00:00Z", "nowhere", U(2024, 1, 1, 10)),
]


def frames(spark, rows):
    return spark.createDataFrame(rows, "recruitment_record_id string, source_table string, publish_date string, created_at timestamp_ntz, y int, offset_s string"), spark.createDataFrame(FEEDS, "source_table string, zone_id string, date_order string")


def test_notations(spark):
    rows = [(f"r{i}", feed, s, CREATED, 1, "x") for i, (s, feed, _) in enumerate(CASES)] * 2
    got = {r[0]: r[1] for r in instants.found(*frames(spark, rows)).collect()}
    us = lambda t: int(t.timestamp()) * 1_000_000 + t.microsecond
    want = {f"r{i}": us(t) for i, (*_, t) in enumerate(CASES) if t}
    assert {CASES[int(k[1:])][:2]: v for k, v in got.items()} == {CASES[int(k[1:])][:2]: v for k, v in want.items()}


def test_status_and_empty(spark):
    assert instants.found(*frames(spark, [])).count() == 0
    rows = [("a", "us", "2022-11-06 01:37", CREATED, 1, "x"), ("b", "us", "2024-03-10 02:30", CREATED, 1, "x"), ("c", "us", "never", CREATED, 1, "x"), ("d", "us", "3 days ago", None, 1, "x")]
    assert {r[0]: r[2] for r in instants.instants(*frames(spark, rows)).collect() if r[0] != "d"} == {"a": "ambiguous", "b": "skipped", "c": "none"}


def test_intervals_agree_with_zoneinfo():
    from datetime import timedelta
    from zoneinfo import ZoneInfo

    rows, _ = instants.zone_intervals(["Europe/Berlin", "Australia/Sydney"], (2022, 2026))
    for z in ("Europe/Berlin", "Australia/Sydney"):
        t = datetime(2022, 2, 1, 0, 30)
        while t < datetime(2025, 12, 1):
            us = int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
            hit = sorted(o for n, y, a, b, o in rows if n == z and y == t.year and a <= us < b)
            both = sorted({int(t.replace(tzinfo=ZoneInfo(z), fold=f).utcoffset().total_seconds()) for f in (0, 1)})
            real = [o for o in both if (t - timedelta(seconds=o)).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(z)).replace(tzinfo=None) == t]
            assert hit == real, (z, t)
            t += timedelta(hours=13)


def test_years_and_zones_without_bounds(spark):
    rows = [("old", "cn", "1985-05-01", CREATED, 1, "x"), ("new", "de", "2065-07-01 12:00", CREATED, 1, "x"), ("far", "us", "9998-01-02", CREATED, 1, "x"), ("lost", "nowhere", "2 days ago", CREATED, 1, "x"), ("own", "nowhere", "2024-01-01 10:00 Asia/Tokyo", CREATED, 1, "x")]
    rows += [(f"junk{i}", "cn", f"2024-01-01 10:00 ab/c{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", CREATED, 1, "x") for i in range(100)]
    got = {r[0]: (r[1], r[2]) for r in instants.instants(*frames(spark, rows)).collect()}
    us = lambda t: int(t.timestamp()) * 1_000_000
    assert got["old"] == (us(U(1985, 4, 30, 16)), "exact")
    assert got["new"] == (us(U(2065, 7, 1, 10)), "exact") and got["far"] == (us(U(9998, 1, 2, 5)), "exact")
    assert got["lost"] == (None, "none") and got["own"] == (us(U(2024, 1, 1, 1)), "exact") and len(got) == len(rows)
