"""Mixed timestamp notations and zones: every publish date as one instant in UTC.

Texts are read into local date and time fields by built-in expressions.  Local times meet their zone
by an as-of join to offset intervals exploded by year: the interval that starts last at or before
the local time gives the offset directly; a second matching interval means an ambiguous time (the first instant counts); no match means a time that was skipped.

Defined results: NULL, blank and wordy texts, impossible dates and skipped times give no row; relative texts
without created_at give no row; a feed that source_feeds lacks gives a row only where the text names
its own zone; years from 1 to 9999 are read, with each zone's last rule beyond its table; equal rows give one row; extra columns are ignored.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.chars import narrow, trim_all
from grainmill.sources.shared import cut

# The words of the notations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TODAY = r"^(?:今天|今日|today)$"
YESTERDAY = r"^(?:昨天|昨日|yesterday)$"
BEFORE_YESTERDAY = r"^(?:前天|前日)$"
NOW = r"^(?:刚刚|刚才|just now)$"
AGO = r"^(\d+) ?(天|日|小时|个小时|分钟|周|星期|days?|hours?|hrs?|minutes?|mins?|weeks?) ?(?:前|以前|之前|ago)$"
UNIT_US = {"天": 86400, "日": 86400, "小时": 3600, "个小时": 3600, "分钟": 60, "周": 604800, "星期": 604800, "day": 86400, "hour": 3600, "hr": 3600, "minute": 60, "min": 60, "week": 604800}

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST, _LAST = datetime(1, 1, 3, tzinfo=timezone.utc), datetime(9999, 12, 29, tzinfo=timezone.utc)


def year_intervals(zones: list[str], years: list[int]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Offset intervals (zone, local year, local_from, local_to, offset_s), the same by UTC (zone, year, from, to, offset_s), and abbreviations (zone, abbr, offset_s).

    Times are microseconds.  Some 3 rows a zone and year asked for, and some 5 abbreviations a zone, whatever the data.
    """
    local, utc, names = set(), set(), set()
    us = lambda t: int((t - _EPOCH).total_seconds()) * 1_000_000
    for name in sorted(set(zones) & available_timezones()):
        z = ZoneInfo(name)
        state = lambda u: (u.astimezone(z).utcoffset(), u.astimezone(z).tzname())  # noqa: B023, E731
        for y in sorted({y for y in years if 1 <= y <= 9999}):
            a0 = max(_FIRST, datetime(y, 1, 1, tzinfo=timezone.utc) - timedelta(days=2)) if y > 1 else _FIRST
            z0 = datetime(y + 1, 1, 3, tzinfo=timezone.utc) if y < 9999 else _LAST
            cuts, u = [(a0, *state(a0))], a0
            while u < z0:
                v = min(u + timedelta(days=14), z0)
                if state(v) != state(u):
                    lo, hi = u, v
                    while hi - lo > timedelta(seconds=1):
                        mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                        lo, hi = (mid, hi) if state(mid) == state(u) else (lo, mid)
                    cuts.append((hi, *state(hi)))
                u = v
            cuts.append((z0, None, None))
            for (start, off, abbr), (end, _, _) in zip(cuts, cuts[1:]):
                sec = int(off.total_seconds())
                if abbr and abbr.isalpha():
                    names.add((name, abbr.upper(), sec))
                if (start + off).year <= y <= (end + off - timedelta(microseconds=1)).year:
                    local.add((name, y, us(start + off), us(end + off), sec))
                if start.year <= y <= (end - timedelta(microseconds=1)).year:
                    utc.add((name, y, us(start), us(end), sec))
    return sorted(local), sorted(utc), sorted(names)


def zone_intervals(zones: list[str], years: tuple[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Offset intervals by local year and abbreviations, of the years from the first to the one before the last."""
    local, _, names = year_intervals(zones, list(range(*years)))
    return local, names


def parse_fields(df: DataFrame, text: str = "publish_date", order: str = "date_order") -> DataFrame:
    """Add y, mo, d, h, mi, s (INT), us (BIGINT, of the second), epoch_us, ago_s, ago_days, zone_text and no_year; NULL where the notation is none of those known."""
    t = F.regexp_replace(trim_all(narrow(F.coalesce(F.col(text), F.lit("")))), r"(?U)\s+", " ")
    t = trim_all(F.regexp_replace(F.lower(t), r"(?:发布于|发布时间[:：]?|posted(?: on)?|发布|更新)", ""))
    df = df.withColumn("_t", t)
    t = F.col("_t")
    mon = "|".join(MONTHS)
    clock = r"(?:,? ?t?(上午|下午|凌晨|早上|中午|晚上)? ?(\d{1,2})(?:[:时点]|(?<=时) ?)(\d{1,2})分?(?:[:]?(\d{1,2})秒?(?:[.,](\d{1,9}))?)? ?(am|pm|a\.m\.|p\.m\.)?(?![a-z/]{3}))?"
    zone = r" ?(z|utc|gmt|(?:gmt|utc)? ?[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z_+-]+)+|[a-z]{2,5})?$"
    lead = rf"^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?{clock}{zone}"
    trail = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{2}}|\d{{4}}){clock}{zone}"
    wordy = rf"^(?:[a-z]{{3}}[a-z]*,? )?(?:(\d{{1,2}})\.? )?({mon})[a-z]*\.?(?: (\d{{1,2}})(?!\d))?(?:,? (\d{{4}}))?{clock}{zone}"
    compact = r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?$"
    short = r"^(\d{1,2})[-/月](\d{1,2})日?$"
    g = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    none = F.lit(None).cast("string")

    def fields(y, mo, d, ampm, h, mi, s, frac, ap, zone_text):
        return F.struct(*[x.alias(n) for x, n in zip((y, mo, d, ampm, h, mi, s, frac, ap, zone_text), ("y", "mo", "d", "day_part", "h", "mi", "s", "frac", "ap", "z"))])

    a, b, c = g(trail, 1), g(trail, 3), g(trail, 4)
    order_c = F.when(F.length(c) == 4, F.when(F.col(order) == "mdy", "mdy").when(F.col(order) == "dmy", "dmy")).otherwise(F.col(order))
    century = lambda x: F.when(F.length(x) == 2, F.concat(F.lit("20"), x)).otherwise(x)
    parts = (
        F.when(t.rlike(lead), fields(g(lead, 1), g(lead, 2), g(lead, 3), *[g(lead, k) for k in range(4, 11)]))
        .when(t.rlike(trail), fields(
            century(F.when(order_c == "ymd", a).when(order_c.isNotNull(), c)),
            F.when(order_c == "ymd", b).when(order_c == "mdy", a).when(order_c == "dmy", b),
            F.when(order_c == "ymd", c).when(order_c == "mdy", b).when(order_c == "dmy", a), *[g(trail, k) for k in range(5, 12)]))
        .when(t.rlike(wordy) & (g(wordy, 1).isNull() != g(wordy, 3).isNull()), fields(g(wordy, 4), F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), g(wordy, 2)).cast("string"), 2, "0"), F.coalesce(g(wordy, 1), g(wordy, 3)), *[g(wordy, k) for k in range(5, 12)]))
        .when(t.rlike(compact), fields(g(compact, 1), g(compact, 2), g(compact, 3), none, g(compact, 4), g(compact, 5), g(compact, 6), none, none, none))
        .when(t.rlike(short), fields(none, g(short, 1), g(short, 2), none, none, none, none, none, none, none))
    )
    epoch = F.when(t.rlike(r"^\d{10}(?:\.\d{1,9})?$"), F.substring_index(t, ".", 1).cast("bigint") * 1_000_000 + F.when(t.contains("."), F.substring(F.rpad(F.substring_index(t, ".", -1), 9, "0"), 1, 6).cast("bigint")).otherwise(F.lit(0)))
    epoch = epoch.when(t.rlike(r"^\d{13}$"), t.try_cast("bigint") * 1000).when(t.rlike(r"^\d{16}$"), t.try_cast("bigint"))
    unit = F.regexp_replace(F.regexp_extract(t, AGO, 2), "s$", "")
    per = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_US.items() for x in kv]), unit)
    n = F.regexp_extract(t, AGO, 1).try_cast("bigint")
    df = df.withColumns({
        "_p": parts, "epoch_us": epoch,
        "ago_days": F.when(t.rlike(TODAY), 0).when(t.rlike(YESTERDAY), 1).when(t.rlike(BEFORE_YESTERDAY), 2).when(t.rlike(AGO) & (per % 86400 == 0), n * per / 86400).cast("int"),
        "ago_s": F.when(t.rlike(NOW), F.lit(0)).when(t.rlike(AGO) & (per % 86400 != 0), n * per).cast("bigint"),
    })
    i = lambda k: F.col(f"_p.{k}").cast("int")
    pm = F.coalesce(F.col("_p.day_part").isin("下午", "晚上") | F.col("_p.ap").startswith("p"), F.lit(False))
    am = F.coalesce(F.col("_p.day_part").isin("上午", "凌晨", "早上") | F.col("_p.ap").startswith("a"), F.lit(False))
    h = F.when(pm & (i("h") < 12), i("h") + 12).when(am & (i("h") == 12), F.lit(0)).otherwise(F.coalesce(i("h"), F.lit(0)))
    return df.withColumns({
        "y": i("y"), "mo": i("mo"), "d": i("d"), "h": h, "mi": F.coalesce(i("mi"), F.lit(0)), "s": F.coalesce(i("s"), F.lit(0)),
        "us": F.coalesce(F.substring(F.rpad(F.col("_p.frac"), 9, "0"), 1, 6).cast("bigint"), F.lit(0).cast("bigint")),
        "zone_text": F.col("_p.z"), "no_year": F.col("_p.mo").isNotNull() & F.col("_p.y").isNull() & F.col("_p.z").isNull(),
    }).drop("_t", "_p")


def _day_us(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * 86_400_000_000


def asof_offset(df: DataFrame, intervals: DataFrame, zone: str, local: str) -> DataFrame:
    """Add offset_s and n_offsets to ``df``: the offset of the first interval of ``zone`` that holds the local time, and how many do (0: skipped; 2: it occurs twice).

    ``intervals``: iz, iy, local_from, local_to, off; an equality on zone and year leaves 1 to 4 intervals to compare.  The
    table's size is fixed by the number of zones and years; adaptive execution broadcasts it where it is small.
    """
    year = F.year(F.timestamp_micros(F.col(local)))
    right = intervals.groupBy("iz", "iy").agg(F.sort_array(F.collect_list(F.struct("local_from", "local_to", "off"))).alias("_iv"))
    joined = df.join(right, (F.col(zone) == F.col("iz")) & (year == F.col("iy")), "left")
    hit = F.filter("_iv", lambda x: (x["local_from"] <= F.col(local)) & (F.col(local) < x["local_to"]))
    # of two offsets the larger one gives the earlier instant
    return joined.withColumn("_hit", hit).withColumns({"n_offsets": F.when(F.col("_iv").isNotNull(), F.size("_hit")), "offset_s": F.array_max(F.transform("_hit", lambda x: x["off"]))}).drop("_iv", "_hit", "iz", "iy")


def instants(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """recruitment_record_id, utc_us (NULL: no real time), status (exact, ambiguous, skipped, none).

    ``df``: recruitment_record_id, source_table, publish_date, created_at (UTC).
    """
    spark: SparkSession = df.sparkSession
    f = feeds.groupBy(F.col("source_table").alias("_feed")).agg(F.min("zone_id").alias("zone_id"), F.min("date_order").alias("date_order"))
    base = df.select("recruitment_record_id", "source_table", "publish_date", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us")).filter(F.col("publish_date").isNotNull())
    rows = parse_fields(base.join(F.broadcast(f), F.col("source_table") == F.col("_feed"), "left"))
    rows = cut(rows.drop("publish_date", "_feed", "source_table", "date_order"))
    # the zones in use, among those there are, and the years in use: 9,999 at most
    zname = F.col("zone_text")
    by_lower = {z.lower(): z for z in available_timezones()}
    there = spark.createDataFrame([(z,) for z in sorted(by_lower)], "z string")
    used = rows.select(F.explode(F.array(F.lower("zone_id"), F.when(zname.contains("/"), F.lower(zname)))).alias("z")).join(F.broadcast(there), "z").distinct().collect()
    zones = sorted({by_lower[r["z"]] for r in used})
    made = F.year(F.timestamp_micros("created_us"))
    relative = F.col("ago_days").isNotNull() | F.col("no_year")
    spans = F.when(relative, F.sequence(made - 9, made + 1)).otherwise(F.array("y"))
    years = [r["y"] for r in rows.select(F.explode(spans).alias("y")).filter("y BETWEEN 1 AND 9999").distinct().collect()]
    iv, by_utc, abbr = year_intervals(zones, years)
    intervals = spark.createDataFrame(iv, "iz string, iy int, local_from bigint, local_to bigint, off int")
    names = F.create_map(*[x for z, a, o in abbr for x in (F.lit(f"{z} {a}"), F.lit(o))]) if abbr else F.create_map(F.lit(""), F.lit(0))
    lower = F.create_map(*[F.lit(x) for z in zones for x in (z.lower(), z)]) if zones else F.create_map(F.lit(""), F.lit(""))

    sign = F.when(F.regexp_extract(zname, r"([+-])", 1) == "-", -1).otherwise(1)
    hours = F.regexp_extract(zname, r"[+-](\d{1,2})", 1).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(zname, r"[+-]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    fixed = F.when(zname.isin("z", "utc", "gmt"), F.lit(0)).when(zname.rlike(r"[+-]\d") & ~zname.contains("/"), sign * (hours * 3600 + minutes * 60)).when(~zname.contains("/"), F.try_element_at(names, F.concat_ws(" ", "zone_id", F.upper(zname))))
    zone = F.when(zname.contains("/"), F.try_element_at(lower, zname)).otherwise(F.try_element_at(lower, F.lower("zone_id")))
    # the local date of created_at, for relative and yearless dates
    rows = rows.withColumns({"_fixed": fixed, "_zone": zone})
    clock = F.try_make_timestamp  # ANSI-safe: NULL for impossible fields
    utc_iv = spark.createDataFrame(by_utc, "cz string, cy int, u_from bigint, u_to bigint, c_off int").groupBy("cz", "cy").agg(F.collect_list(F.struct("u_from", "u_to", "c_off")).alias("_uiv"))
    home = F.try_element_at(lower, F.lower("zone_id"))
    dated = rows.filter(~relative)
    rel = rows.filter(relative).withColumn("_home", home).join(utc_iv, (F.col("_home") == F.col("cz")) & (made == F.col("cy")), "left")
    c_off = F.array_max(F.transform(F.filter("_uiv", lambda x: (x["u_from"] <= F.col("created_us")) & (F.col("created_us") < x["u_to"])), lambda x: x["c_off"]))
    today = F.to_date(F.timestamp_micros(F.col("created_us") + c_off * F.lit(1_000_000).cast("bigint")))
    rel = rel.withColumn("_today", today).drop("_uiv", "cz", "cy", "_home")
    at = lambda back: F.try_to_timestamp(F.concat_ws("-", F.lpad((F.year("_today") - back).cast("string"), 4, "0"), F.lpad(F.col("mo").cast("string"), 2, "0"), F.lpad(F.col("d").cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    latest = F.coalesce(*[F.when(at(k) <= F.col("_today"), at(k)) for k in range(0, 9)])
    rel = rel.withColumn("local_us", F.when(F.col("ago_days").isNotNull(), _day_us(F.date_sub("_today", F.col("ago_days")))).otherwise(_day_us(latest) + ((F.col("h") * 60 + F.col("mi")) * 60 + F.col("s")) * F.lit(1_000_000).cast("bigint") + F.col("us"))).drop("_today")
    real = (F.col("h") < 24) & (F.col("mi") < 60) & (F.col("s") < 60) & (F.col("y") > 0)
    day = F.to_date(clock(F.col("y"), F.col("mo"), F.col("d"), F.lit(0), F.lit(0), F.lit(0)))
    dated = dated.withColumn("local_us", F.when(real, _day_us(day) + ((F.col("h") * 60 + F.col("mi")) * F.lit(60) + F.col("s")) * F.lit(1_000_000).cast("bigint") + F.col("us")))
    both = dated.unionByName(rel)
    out = asof_offset(both, intervals, "_zone", "local_us")
    # a zone text that is none known (neither offset, name nor abbreviation of the feed's zone) gives no instant
    own = F.col("zone_text").isNotNull() & ~F.col("zone_text").contains("/")
    utc = (
        F.when(F.col("epoch_us").isNotNull(), F.col("epoch_us"))
        .when(F.col("ago_s").isNotNull(), F.col("created_us") - F.col("ago_s") * F.lit(1_000_000).cast("bigint"))
        .when(own, F.col("local_us") - F.col("_fixed") * F.lit(1_000_000).cast("bigint"))
        .otherwise(F.col("local_us") - F.col("offset_s") * F.lit(1_000_000).cast("bigint"))
    )
    status = F.when(utc.isNotNull(), F.when(~own & (F.col("n_offsets") > 1) & F.col("epoch_us").isNull(), "ambiguous").otherwise("exact")).when(F.col("n_offsets") == 0, "skipped").otherwise("none")
    return out.select("recruitment_record_id", utc.alias("utc_us"), status.alias("status"))


def found(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """recruitment_record_id, publish_utc_us, distinct."""
    return instants(df, feeds).filter(F.col("utc_us").isNotNull() & F.col("recruitment_record_id").isNotNull()).select("recruitment_record_id", F.col("utc_us").alias("publish_utc_us")).distinct()
