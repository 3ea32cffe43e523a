"""Quantities recorded in different units: every stated pay as yuan per month.

The text is read into numbers, scales, a currency and a period by built-in expressions.
Every unit that the text leaves out (scale, period, currency, each by itself) is assigned by the posterior of a mixture over log amounts whose components
are offset by the known conversion factors (:func:`fit_units`); what the text does say is taken off the logarithm.  The unit that the
description or the feed declares has a prior of ``DECLARED``; where neither declares anything, the priors are estimated.

Defined results: NULL, empty and white-space texts, and texts without an amount give no row; equal
rows give one row; a record whose feed is unknown is assigned by the mixture alone; a unit that
``unit_factors`` lacks gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.chars import narrow, trim_all
from grainmill.sources.shared import cut

# How units are written.  (regular expressions over lower-case, narrow text)
PERIOD_WORDS = [
    ("hour", r"时|時|hour|/ ?hr|/ ?h$|stunde|/ ?std"),
    ("day", r"日薪|每日|每天|按天|/ ?[天日]|元每[天日]|per day|daily|/ ?day|pro tag|/ ?tag"),
    ("week", r"周|週|week|/ ?wk|woche"),
    ("year", r"年|per year|p\.? ?a\.?(?![a-z])|per annum|annual|yearly|/ ?y(?:ea)?r|jahr|lpa"),
    ("month", r"月|month|monat|p\.? ?m\.?(?![a-z])"),
]
CURRENCY_WORDS = [
    ("hkd", r"hk ?\$|hkd|港币|港幣|港元"),
    ("usd", r"us ?\$|usd|美元|美金"),
    ("aud", r"a(?:u)? ?\$|aud|澳元|澳币"),
    ("eur", r"€|eur|欧元"),
    ("inr", r"₹|inr|rs\.?|卢比|lakh|lpa"),
    ("cny", r"[¥￥]|cny|rmb|人民币|元"),
]
SCALE_WORDS = [("lakh", r"^(?:lakhs?|lpa|l)$"), ("ten_thousand", r"^[万萬w]$"), ("thousand", r"^(?:千|k|t)$")]
CN_DIGITS = ("一二两兩三四五六七八九", "12223456789")

_NUMBER = r"\d[\d.,]*"
_AMOUNT = rf"({_NUMBER})\s*((?:万|萬|千|lakhs?|lpa|k|w|t)(?![a-df-z]))?"


def _first(words: list[tuple[str, str]], text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(words):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def plain_numerals(c: Column) -> Column:
    """Chinese numerals before 万, 千 or 百 as decimal amounts: 一万五 -> 1.5万, 八千 -> 8千."""
    n = F.translate(c, "兩两", "二二")
    digits = F.translate(n, CN_DIGITS[0], CN_DIGITS[1])
    digits = F.regexp_replace(digits, r"(?<!\d)十(?=\d)", "1")
    digits = F.regexp_replace(digits, r"(?<=\d)十(?=\d)", "")
    digits = F.regexp_replace(digits, r"(?<=\d)十", "0")
    digits = F.regexp_replace(digits, r"十(?=[万千])", "10")
    digits = F.regexp_replace(digits, r"(\d)[万萬](\d)千(\d)百?", "$1.$2$3万")
    digits = F.regexp_replace(digits, r"(\d)[万萬](\d)(?:千|(?=\D|$))", "$1.$2万")
    digits = F.regexp_replace(digits, r"(\d)千(\d)(?:百|(?=\D|$))", "$1.$2千")
    return F.when(n.rlike("[一二三四五六七八九十][万萬千百]"), digits).otherwise(c)


def parse_number(token: Column, continental: Column) -> Column:
    """A number token as a double; ``continental``: a point groups thousands, a comma marks decimals."""
    t = F.regexp_replace(token, r"[.,]+$", "")
    grouped = t.rlike(r"^\d{1,3}(?:\.\d{3})+(?:,\d+)?$")
    comma_decimal = t.rlike(r"^\d+,\d{1,2}$")
    eu = F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")
    us = F.regexp_replace(t, ",", "")
    return F.when(continental & (grouped | comma_decimal), eu).otherwise(us).try_cast("double")


def parse_pay(df: DataFrame, text: str = "salary_raw", feed_currency: str = "pay_currency") -> DataFrame:
    """Add low, high (DOUBLE, in the text's own unit), scale_low, scale_high, period, currency, figures_only.

    Extra months (``·16薪``, ``×13``) are dropped; a single amount or a bound fills both ends.  Text
    without an amount gives NULLs.
    """
    s = F.lower(trim_all(narrow(F.coalesce(F.col(text), F.lit("")))))
    s = F.regexp_replace(F.translate(s, "～〜—–－", "~~---"), r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"[·*×x]\s*\d+(?:\.\d+)?\s*薪?|(?<=[^\d])\d{2}薪", " ")
    s = trim_all(plain_numerals(s))
    df = df.withColumn("_s", s)
    t = F.col("_s")
    dollar = F.when(F.col(feed_currency).isin("usd", "hkd", "aud"), F.col(feed_currency)).otherwise(F.lit("usd"))
    currency = F.coalesce(_first(CURRENCY_WORDS[:-1], t), F.when(t.contains("$"), dollar), _first(CURRENCY_WORDS[-1:], t))
    continental = F.coalesce(currency, F.col(feed_currency), F.lit("")) == "eur"
    df = df.withColumns({"_n": F.regexp_extract_all(t, F.lit(_AMOUNT), F.lit(1)), "_u": F.regexp_extract_all(t, F.lit(_AMOUNT), F.lit(2)), "currency": currency, "period": _first(PERIOD_WORDS, t), "figures_only": t.rlike(r"^[\d.,\s~+-]*\d[\d.,\s~+至到-]*$"), "_eu": continental})
    at = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    two = F.size("_n") >= 2
    unit1 = F.nullif(at("_u", 1), F.lit(""))
    unit2 = F.when(two, F.nullif(at("_u", 2), F.lit("")))
    return df.withColumns({
        "low": parse_number(at("_n", 1), F.col("_eu")),
        "high": F.coalesce(F.when(two, parse_number(at("_n", 2), F.col("_eu"))), parse_number(at("_n", 1), F.col("_eu"))),
        "scale_low": _first(SCALE_WORDS, F.coalesce(unit1, unit2, F.lit(""))),
        "scale_high": _first(SCALE_WORDS, F.coalesce(unit2, unit1, F.lit(""))),
    }).drop("_s", "_n", "_u", "_eu")


def described_units(df: DataFrame, text: str) -> DataFrame:
    """Add said_scale, said_period, said_currency from a sentence of ``text`` that states the pay's unit."""
    s = F.lower(narrow(F.coalesce(F.col(text), F.lit(""))))
    say = F.regexp_extract(s, r"((?:薪酬|薪资|薪水|工资|年薪|月薪)[^，。；！？,;!?\n\r<|(（]{0,12}?(?:单位|结算|计|日薪|时薪|周薪|年薪|月薪|为)[^。；！？;!?\n\r<|]{0,16})", 1)
    df = df.withColumn("_say", say)
    c = F.col("_say")
    unit = F.regexp_extract(c, r"(万|千|百)?元", 1)
    stated = c.rlike(r"元|薪数字|单位")
    return df.withColumns({
        "said_scale": F.when(stated & c.contains("元"), F.when(unit == "万", "ten_thousand").when(unit == "千", "thousand").otherwise("one")),
        "said_period": F.when(stated, _first([("hour", "时薪|[/每按](?:小)?时"), ("day", "日薪|[/每按][天日]"), ("week", "周薪|[/每按]周"), ("year", "年薪|[/每按]年"), ("month", "月薪|[/每按]月")], c)),
        "said_currency": F.when(stated & c.contains("元"), F.coalesce(_first(CURRENCY_WORDS[:-1], c), F.lit("cny"))),
    }).drop("_say")


BIN = 0.01  #: Width of a bin of log10 amounts.
DECLARED = 1 - 1e-6  #: Prior of the unit that the description or the feed declares; the rest falls to the others by their weights.
KNOWN = 50  #: Rows that the units said or declared anywhere count for, where nothing declares them.
START = (4.0, 0.3, 10.0)  #: Mean and deviation of log10 yuan a month where no row says its units, and the rows that they count for.


def fit_units(groups: list[tuple[np.ndarray, np.ndarray, dict]], dims: dict[str, np.ndarray], mu: float, sigma: float, rounds: int = 50, smooth: float | dict[str, np.ndarray] = 1.0, held: float = START[2]) -> tuple[list[np.ndarray], dict[str, np.ndarray], float, float]:
    """Expectation-maximisation of unit weights, one mean and one deviation, over weighted histograms.

    ``groups``: (counts, logs, open) of rows that leave the same units open; ``open`` gives for each open dimension the index of the
    declared unit, or None.  ``dims``: the logarithms of each dimension's factors.  A component is one unit for each open dimension: a normal
    at ``mu`` less the sum of their logarithms.  Returns posteriors (a group: bins x components, the last open dimension
    varying fastest), weights, mean, deviation.
    """
    plus = {d: np.broadcast_to(smooth[d] if isinstance(smooth, dict) else smooth, len(o)).astype(float) for d, o in dims.items()}
    weights = {d: p / p.sum() for d, p in plus.items()}
    start, posts = mu, []
    for _ in range(rounds):
        mass = {d: np.zeros(len(o)) for d, o in dims.items()}
        n, s1, s2, posts = held, held * start, held * (sigma**2 + (start - mu) ** 2), []
        for counts, logs, open_ in groups:
            off, prior = np.zeros(1), np.ones(1)
            for d, said in open_.items():
                w = weights[d]
                if said is not None:
                    w = w * (1 - DECLARED) / max(1e-12, 1 - w[said])
                    w[said] = DECLARED
                off = (off[:, None] + dims[d][None, :]).ravel()
                prior = (prior[:, None] * w[None, :]).ravel()
            x = logs[:, None] + off[None, :]
            p = np.log(prior)[None, :] - 0.5 * ((x - mu) / sigma) ** 2
            p = np.exp(p - p.max(axis=1, keepdims=True))
            post = p / p.sum(axis=1, keepdims=True)
            posts.append(post)
            m = post * counts[:, None]
            n, s1, s2 = n + m.sum(), s1 + float((m * x).sum()), s2 + float((m * (x - mu) ** 2).sum())
            by = m.sum(axis=0).reshape([len(dims[d]) for d in open_] or [1])
            for i, (d, said) in enumerate(open_.items()):
                if said is None:
                    mass[d] += by.sum(axis=tuple(j for j in range(by.ndim) if j != i))
        weights = {d: (m + plus[d]) / (m + plus[d]).sum() for d, m in mass.items()}
        mu, sigma = s1 / n, max(0.05, math.sqrt(s2 / n))
    return posts, weights, mu, sigma


def fit_mixture(counts: np.ndarray, logs: np.ndarray, offsets: np.ndarray, mu: float, sigma: float, rounds: int = 50, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """:func:`fit_units` of one open dimension that nothing declares: posteriors (bins x components), weights, mean, deviation."""
    posts, weights, mu, sigma = fit_units([(counts, logs, {"unit": None})], {"unit": offsets}, mu, sigma, rounds, smooth)
    return posts[0], weights["unit"], mu, sigma


def common_units(df: DataFrame, feeds: DataFrame, factors: DataFrame, certain: float = 0.8) -> DataFrame:
    """Pay of each row in yuan per month.

    ``df``: recruitment_record_id, source_table, salary_raw, job_description_raw.  Returns recruitment_record_id, low, high (DOUBLE, yuan
    per month), period, currency, scale, unit_from (text: all said; description, feed: what these declare was assigned; mixture: nothing declared it, or
    it is too implausible), posterior of the units assigned and uncertain (posterior under ``certain``).
    """
    spark = df.sparkSession
    fac = {(r["quantity"], r["unit_code"]): r["multiply_by"] / r["divide_by"] for r in factors.filter("multiply_by > 0 AND divide_by > 0").collect()}  # the list of units
    rate = {(r["quantity"], r["unit_code"]): (r["multiply_by"], r["divide_by"]) for r in factors.collect()}
    dims = {q: sorted(u for k, u in fac if k == q) for q in ("scale", "period", "currency")}
    if not all(dims.values()):
        raise ValueError("unit_factors must hold scales, periods and currencies")
    f = feeds.groupBy(F.col("source_table").alias("_feed")).agg(*[F.min(c).alias(c) for c in ("pay_currency", "pay_period", "pay_scale")])
    base = df.select("recruitment_record_id", "source_table", "salary_raw", "job_description_raw").filter(F.col("salary_raw").isNotNull() & narrow(F.col("salary_raw")).rlike(r"\d|[一二两三四五六七八九十][万千百]"))
    rows = described_units(parse_pay(base.join(F.broadcast(f), F.col("source_table") == F.col("_feed"), "left")), "job_description_raw")

    def factor(quantity: str, c: Column) -> Column:
        """Units of ``quantity`` to common units, as (multiply, divide) structs; NULL for a unit unknown."""
        known = [x for (q, u), (m, d) in sorted(rate.items()) if q == quantity for x in (F.lit(u), F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")))]
        return F.try_element_at(F.create_map(*known), c)

    def log(quantity: str, c: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[x for u in dims[quantity] for x in (F.lit(u), F.lit(math.log10(fac[quantity, u])))]), c), F.lit(0.0))

    # read once, used twice (for the histogram and for the result); the texts themselves go no further
    rows = cut(rows.drop("salary_raw", "job_description_raw", "source_table", "_feed")).filter("low IS NOT NULL")
    # what the text says of each unit; else what is declared ('' where nothing is), by the order of precedence
    open_scale = F.col("scale_high").isNull() & F.col("figures_only")
    declared = lambda quantity, *cs: F.coalesce(*[F.when(F.col(c).isin(*dims[quantity]), F.col(c)) for c in cs], F.lit(""))
    rows = rows.withColumns({
        "d_scale": F.when(open_scale, declared("scale", "said_scale", "pay_scale")),
        "d_period": F.when(F.col("period").isNull(), declared("period", "said_period", "pay_period")),
        "d_currency": F.when(F.col("currency").isNull(), declared("currency", "said_currency", "pay_currency")),
        "described": (open_scale & F.col("said_scale").isNotNull()) | (F.col("period").isNull() & F.col("said_period").isNotNull()) | (F.col("currency").isNull() & F.col("said_currency").isNotNull()),
        "scale_low": F.when(~open_scale, F.coalesce("scale_low", F.lit("one"))), "scale_high": F.when(~open_scale, F.coalesce("scale_high", F.lit("one"))),
    })
    said = log("scale", F.col("scale_high")) + log("period", F.col("period")) + log("currency", F.col("currency"))
    rows = rows.withColumn("bin", F.floor((F.log10(F.greatest("high", F.lit(1e-6))) + said) / BIN).cast("int"))
    keys = ["d_scale", "d_period", "d_currency"]
    # how often each unit is said or declared: the start of the weights where nothing declares it
    known = {q: dict.fromkeys(us, 0) for q, us in dims.items()}
    for q, c in (("scale", "scale_high"), ("period", "period"), ("currency", "currency")):
        for r in rows.groupBy(F.coalesce(F.col(c), f"d_{q}").alias("u")).count().collect():  # at most one row a unit
            if r["u"] in known[q]:
                known[q][r["u"]] = r["count"]
    smooth = {q: np.array([1 + KNOWN * n / max(1, sum(ns.values())) for n in ns.values()]) for q, ns in known.items()}
    # histograms of fixed resolution, one for each combination of units open and declared: bounded by the list of units
    got = rows.groupBy(*keys, "bin").count().toPandas()
    groups, which = [], []
    for combo, g in got.groupby(keys, dropna=False, sort=True):
        g = g.sort_values("bin")
        said_ = {q: (dims[q].index(v) if v else None) for q, v in zip(("scale", "period", "currency"), combo) if isinstance(v, str)}
        groups.append((g["count"].to_numpy(float), (g["bin"].to_numpy(float) + 0.5) * BIN, said_))
        which.append((combo, g["bin"].tolist()))
    logs = {q: np.array([math.log10(fac[q, u]) for u in us]) for q, us in dims.items()}
    # the start: rows that leave nothing open, with the declared ones
    sure = [(c, x + sum(logs[q][k] for q, k in o.items())) for c, x, o in groups if None not in o.values()]
    n = sum(c.sum() for c, _ in sure)
    mu = sum((c * x).sum() for c, x in sure) / n if n else START[0]
    sigma = max(0.05, math.sqrt(sum((c * (x - mu) ** 2).sum() for c, x in sure) / n)) if n else START[1]
    posts, _, _, _ = fit_units(groups, logs, mu, sigma, smooth=smooth)
    best = []
    for (combo, bins), (_, _, said_), post in zip(which, groups, posts):
        shape = [len(dims[q]) for q in said_] or [1]
        for b, k, p in zip(bins, post.argmax(axis=1), post.max(axis=1)):
            units = dict(zip(said_, (dims[q][i] for q, i in zip(said_, np.unravel_index(int(k), shape)))))
            best.append((*[v if isinstance(v, str) else None for v in combo], int(b), *[units.get(q) for q in ("scale", "period", "currency")], float(p)))
    table = spark.createDataFrame(best, "k_scale string, k_period string, k_currency string, k_bin int, g_scale string, g_period string, g_currency string, posterior double")
    same = F.col("bin") == F.col("k_bin")
    for q in ("scale", "period", "currency"):
        same &= F.col(f"d_{q}").eqNullSafe(F.col(f"k_{q}"))
    rows = rows.join(table, same)
    as_declared = F.lit(True)
    for q in ("scale", "period", "currency"):
        as_declared &= F.col(f"d_{q}").isNull() | (F.col(f"d_{q}") == F.col(f"g_{q}"))
    by = F.when(F.coalesce("g_scale", "g_period", "g_currency").isNull(), "text").when(~as_declared, "mixture").when(F.col("described"), "description").otherwise("feed")
    rows = rows.withColumns({"p": F.coalesce("period", "g_period"), "c": F.coalesce("currency", "g_currency"), "sl": F.coalesce("scale_low", "g_scale"), "sh": F.coalesce("scale_high", "g_scale")})
    rows = rows.withColumns({"fp": factor("period", F.col("p")), "fc": factor("currency", F.col("c")), "fl": factor("scale", F.col("sl")), "fh": factor("scale", F.col("sh"))})
    value = lambda v, s: F.col(v) * F.col(s)["m"] / F.col(s)["d"] * F.col("fp")["m"] * F.col("fc")["m"] / (F.col("fp")["d"] * F.col("fc")["d"])
    return rows.select("recruitment_record_id", value("low", "fl").alias("low"), value("high", "fh").alias("high"), F.col("p").alias("period"), F.col("c").alias("currency"), F.col("sh").alias("scale"), by.alias("unit_from"), "posterior", (F.col("posterior") < certain).alias("uncertain"))


def found(df: DataFrame, feeds: DataFrame, factors: DataFrame) -> DataFrame:
    """recruitment_record_id, low_cny_month, high_cny_month: whole yuan per month, distinct."""
    r = common_units(df, feeds, factors)
    whole = lambda c: F.floor(F.round(F.col(c), 6) + F.lit(0.5)).cast("bigint")
    return r.filter(F.col("low").isNotNull() & F.col("recruitment_record_id").isNotNull()).select("recruitment_record_id", whole("low").alias("low_cny_month"), whole("high").alias("high_cny_month")).distinct()
