import numpy as np
import pytest

from grainmill.operators import units

FEEDS = [("cn", "cny", "month", "one"), ("th", "cny", "month", "thousand"), ("us", "usd", "year", "one"), ("de", "eur", "year", "one"), ("hk", "hkd", "month", "one"), ("in", "inr", "month", "one")]
FACTORS = [("hour", "period", 174.0, 1.0), ("day", "period", 87.0, 4.0), ("week", "period", 87.0, 20.0), ("month", "period", 1.0, 1.0), ("year", "period", 1.0, 12.0), ("cny", "currency", 1.0, 1.0), ("hkd", "currency", 23.0, 25.0), ("usd", "currency", 36.0, 5.0), ("eur", "currency", 39.0, 5.0), ("inr", "currency", 17.0, 200.0), ("one", "scale", 1.0, 1.0), ("thousand", "scale", 1000.0, 1.0), ("ten_thousand", "scale", 10000.0, 1.0), ("lakh", "scale", 100000.0, 1.0)]

CASES = [
    ("8000-12000元/月", "cn", "", (8000, 12000)), ("1-1.5万", "cn", "", (10000, 15000)), ("8千-1.5万/月", "cn", "", (8000, 15000)), ("一万五到两万五", "cn", "", (15000, 25000)),
    ("月薪八千至两万二元", "cn", "", (8000, 22000)), ("7K~11K·16薪", "cn", "", (7000, 11000)), ("4-7k×13", "cn", "", (4000, 7000)), ("10-21", "th", "", (10000, 21000)),
    ("10-21", "cn", "薪酬单位：万元/年。", (8333, 17500)), ("260-300", "cn", "注：薪资数字为日薪，单位元。", (5655, 6525)), ("260", "cn", "薪酬按元/天结算。", (5655, 5655)), ("21-28", "cn", "（上述薪资以万元每年计）", (17500, 23333)),
    ("US$1200-2200 每月", "cn", "", (8640, 15840)), ("$90,000-$121,000 per year", "us", "", (54000, 72600)), ("57.000 bis 82.000 EUR brutto/Jahr", "de", "", (37050, 53300)), ("4.000,00 EUR monatlich", "de", "", (31200, 31200)),
    ("14,5 €/Std.", "de", "", (19679, 19679)), ("47-68 TEUR", "de", "", (30550, 44200)), ("港幣11500-16000元", "hk", "", (10580, 14720)), ("₹18.5-27.5 LPA", "in", "", (13104, 19479)), ("６５００－７５００元／月", "cn", "", (6500, 7500)),
    ("8500元以上/月", "cn", "", (8500, 8500)), ("13.5K+", "cn", "", (13500, 13500)), ("年薪18万-32万", "cn", "", (15000, 26667)), ("面议", "cn", "", None), (None, "cn", "", None), ("", "cn", None, None), ("nan", "cn", "", None), ("待遇从优", "cn", "", None),
]


def frames(spark, rows):
    df = spark.createDataFrame(rows, "recruitment_record_id string, source_table string, salary_raw string, job_description_raw string, p string, period int")
    return df, spark.createDataFrame(FEEDS, "source_table string, pay_currency string, pay_period string, pay_scale string"), spark.createDataFrame(FACTORS, "unit_code string, quantity string, multiply_by double, divide_by double")


def test_stated_and_declared_units(spark):
    rows = [(f"r{i}", feed, s, d, "x", 1) for i, (s, feed, d, _) in enumerate(CASES)] * 2  # every row twice, with clashing extra columns
    got = {r[0]: (r[1], r[2]) for r in units.found(*frames(spark, rows)).collect()}
    want = {f"r{i}": w for i, (*_, w) in enumerate(CASES) if w}
    assert {k: (CASES[int(k[1:])][0], v) for k, v in got.items()} == {k: (CASES[int(k[1:])][0], v) for k, v in want.items()}


def test_empty_and_unknown_feed(spark):
    assert units.found(*frames(spark, [])).count() == 0
    rows = [(f"s{i}", "cn", f"{6000 + 10 * i}-{9000 + 20 * i}元/月", "", "x", 1) for i in range(200)] + [("u", "no such feed", "9000", "", "x", 1), ("v", "no such feed", "11", "", "x", 1)]
    got = {r["recruitment_record_id"]: r for r in units.common_units(*frames(spark, rows)).filter("unit_from = 'mixture'").collect()}
    assert got["u"]["scale"] == "one" and got["u"]["period"] == "month" and 8000 < got["u"]["high"] < 10000
    assert got["v"]["high"] > 2000 and got["v"]["posterior"] is not None


def test_mixture_separates_scales():
    rng = np.random.default_rng(1)
    true = rng.normal(4.0, 0.1, 4000)
    offsets = np.array([0.0, 3.0, -np.log10(12)])  # months, thousands a month, years: a year in ten thousands would lie within a deviation of the second
    kind = rng.integers(0, 3, 4000)
    bins = np.floor((true - offsets[kind]) / units.BIN).astype(int)
    b, n = np.unique(bins, return_counts=True)
    post, w, mu, _ = units.fit_mixture(n.astype(float), (b + 0.5) * units.BIN, offsets, 4.1, 0.3)
    pick = dict(zip(b.tolist(), post.argmax(axis=1).tolist()))
    assert np.mean([pick[x] == k for x, k in zip(bins.tolist(), kind.tolist())]) > 0.97
    assert mu == pytest.approx(4.0, abs=0.05) and w == pytest.approx([1 / 3] * 3, abs=0.05)


def test_units_that_no_feed_declares(spark):
    """Planted: half of the rows say their units, the others come from feeds that declare nothing or only the currency."""
    rng = np.random.default_rng(7)
    feeds = [("cn", "cny", "month", "one"), ("none", None, None, None), ("usd", "usd", None, None), ("odd", "cny", "month", "one")]
    rows, truth = [], {}
    for i, v in enumerate(10 ** rng.normal(4.1, 0.08, 1200)):
        kind = i % 6
        if kind < 3:
            rows.append((f"r{i}", "cn", f"{v:.0f}元/月", ""))
        else:
            feed, amount = [("none", v), ("none", v / 1000), ("usd", v / 7.2 / 174)][kind - 3]
            rows.append((f"r{i}", feed, f"{amount:.2f}", ""))
            truth[f"r{i}"] = v
    rows += [("us15", "usd", "15", ""), ("implausible", "odd", "0.001", ""), ("odd", "odd", "15000", "")]
    df, _, factors = frames(spark, [(*r, "x", 1) for r in rows])
    got = {r["recruitment_record_id"]: r for r in units.common_units(df, spark.createDataFrame(feeds, "source_table string, pay_currency string, pay_period string, pay_scale string"), factors).collect()}
    right = [abs(got[k]["high"] / v - 1) < 0.02 for k, v in truth.items()]
    assert np.mean(right) > 0.9 and all(got[k]["unit_from"] == "mixture" for k in truth)
    assert (got["us15"]["period"], got["us15"]["currency"], round(got["us15"]["high"])) == ("hour", "usd", 18792)
    assert got["odd"]["unit_from"] == "feed" and not got["odd"]["uncertain"] and got["implausible"]["unit_from"] == "mixture"
