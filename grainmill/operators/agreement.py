"""Votes, agreement and evaluation measures.

Votes are rows (item, voter, choice); NULL choices are left out; an item without votes gives no row; shares over nothing are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def majority(votes: DataFrame, item: str, choice: str) -> DataFrame:
    """item, choice (the most frequent, ties by value), n_choice, n_votes, strict (over half), unanimous, pair_agreement."""
    c = votes.filter(F.col(choice).isNotNull()).groupBy(item, choice).agg(F.count("*").alias("n_choice"))
    w = W.partitionBy(item)
    c = c.withColumns({"n_votes": F.sum("n_choice").over(w), "_same": F.sum(F.col("n_choice") * (F.col("n_choice") - 1)).over(w), "_r": F.row_number().over(w.orderBy(F.desc("n_choice"), choice))})
    n = F.col("n_votes")
    return c.filter("_r = 1").select(item, choice, "n_choice", "n_votes", (F.col("n_choice") * 2 > n).alias("strict"), (F.col("n_choice") == n).alias("unanimous"), F.round(F.try_divide("_same", n * (n - 1)), 6).alias("pair_agreement"))


def voter_quality(votes: DataFrame, item: str, voter: str, choice: str) -> DataFrame:
    """voter, n_items, agreement: how often a voter chose as the majority of items with two votes or more."""
    m = majority(votes, item, choice).filter("n_votes >= 2").select(item, F.col(choice).alias("_m"))
    x = votes.filter(F.col(choice).isNotNull()).join(m, item)
    return x.groupBy(voter).agg(F.count("*").alias("n_items"), F.round(F.avg((F.col(choice) == F.col("_m")).cast("double")), 6).alias("agreement"))


def vote_aggregate(votes: DataFrame, item: str, voter: str, choice: str, least: int) -> DataFrame:
    """item, choice, support: choices that at least ``least`` different voters named."""
    return votes.filter(F.col(choice).isNotNull()).groupBy(item, choice).agg(F.countDistinct(voter).alias("support")).filter(F.col("support") >= least)


def threshold_sweep(scored: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """threshold, n_kept, kept_rate, n_labelled, precision: for each threshold the rows at or above it.  ``correct`` may be NULL (no label)."""
    x = scored.select(F.col(score).alias("_s"), F.col(correct).cast("int").alias("_c"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = F.col("_s") >= F.col("threshold")
    g = x.groupBy("threshold").agg(F.count(F.when(kept, 1)).alias("n_kept"), F.count("*").alias("_n"), F.count(F.when(kept, F.col("_c"))).alias("n_labelled"), F.sum(F.when(kept, F.col("_c"))).alias("_ok"))
    return g.select("threshold", "n_kept", F.round(F.try_divide("n_kept", "_n"), 6).alias("kept_rate"), "n_labelled", F.round(F.try_divide("_ok", "n_labelled"), 6).alias("precision"))


def set_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and exact_rate of array columns compared as sets; NULL arrays count as empty."""
    empty = F.array().cast("array<string>")
    p, g = F.array_distinct(F.coalesce(predicted, empty)), F.array_distinct(F.coalesce(gold, empty))
    x = df.select(F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))
    a = x.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")).alias("e"))
    pr, rc = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return a.select("tp", "fp", "fn", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"), F.round("e", 6).alias("exact_rate"))


def fuzzy_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row: coverage and precision of array columns where an entry matches another that contains it or that it contains."""
    meets = lambda x, ys: F.exists(ys, lambda y: x.contains(y) | y.contains(x))
    empty = F.array().cast("array<string>")
    p, g = F.coalesce(predicted, empty), F.coalesce(gold, empty)
    x = df.select(F.size(F.filter(g, lambda y: meets(y, p))).alias("hit_g"), F.size(g).alias("n_g"), F.size(F.filter(p, lambda y: meets(y, g))).alias("hit_p"), F.size(p).alias("n_p"))
    return x.agg(F.round(F.try_divide(F.sum("hit_g"), F.sum("n_g")), 6).alias("coverage"), F.round(F.try_divide(F.sum("hit_p"), F.sum("n_p")), 6).alias("precision"))


def macro_f1(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: accuracy and macro-F1 over the classes that occur on either side."""
    x = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).select(F.col(predicted).alias("p"), F.col(actual).alias("a")).groupBy("p", "a").agg(F.count("*").alias("n"))
    sides = x.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.col("n").alias("np"), F.lit(0).cast("bigint").alias("na"), F.when(F.col("p") == F.col("a"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("a").alias("c"), F.lit(0).cast("bigint").alias("np"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("np").alias("np"), F.sum("na").alias("na"), F.sum("tp").alias("tp"))
    return per.agg(F.round(F.try_divide(F.sum("tp"), F.sum("na")), 6).alias("accuracy"), F.round(F.avg(2 * F.col("tp") / (F.col("np") + F.col("na"))), 6).alias("macro_f1"))


def quality_tier(full: Column, majority_: Column, n: Column) -> Column:
    """S to D by agreement signals: all agree of three or more, all agree, strict majority, plurality, single."""
    return F.when(full & (n >= 3), "S").when(full & (n >= 2), "A").when(majority_ & (n >= 2), "B").when(n >= 2, "C").otherwise("D")


def oversample(df: DataFrame, tier: str, times: dict[str, int]) -> DataFrame:
    """Each row as many times as its tier says (0: left out), with copy 1, 2, ..."""
    m = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col(tier)), F.lit(0))
    return df.withColumn("_m", m).filter("_m > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_m")))).drop("_m")


def match_evaluation(ranked: DataFrame, item: str, place: str, correct: str, matched: str) -> DataFrame:
    """One row: items, share of them with a correct candidate at place 1, 3, 5 or better, and share without any match."""
    hit = lambda k: F.max((F.col(correct) & (F.col(place) <= k)).cast("double"))
    per = ranked.groupBy(item).agg(hit(1).alias("t1"), hit(3).alias("t3"), hit(5).alias("t5"), (1 - F.max(F.col(matched).cast("double"))).alias("none"))
    return per.agg(F.count("*").alias("n_items"), *[F.round(F.avg(a), 6).alias(b) for a, b in (("t1", "top1"), ("t3", "top3"), ("t5", "top5"), ("none", "unmatched"))])


def threshold_decision(scored: DataFrame, score: str, correct: str, error: str, thresholds: list[float], least: float) -> DataFrame:
    """:func:`threshold_sweep` with the three most frequent errors at each threshold, whether its precision passes, and the one recommended: of those that pass the one that keeps most."""
    g = threshold_sweep(scored, score, correct, thresholds)
    x = scored.filter(~F.col(correct)).select(F.col(score).alias("_s"), F.col(error).alias("_e"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).filter("_s >= threshold")
    e = x.groupBy("threshold", "_e").agg(F.count("*").alias("_n")).withColumn("_r", F.row_number().over(W.partitionBy("threshold").orderBy(F.desc("_n"), "_e"))).filter("_r <= 3")
    top = e.groupBy("threshold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_e"))), lambda z: z["_e"]), ",").alias("errors"))
    ok = F.coalesce(F.col("precision") >= least, F.lit(False))
    order = W.orderBy(F.desc("passes"), F.desc("kept_rate"), "threshold")  # a row a threshold
    return g.join(top, "threshold", "left").withColumns({"errors": F.coalesce("errors", F.lit("")), "passes": ok}).withColumn("recommended", F.col("passes") & (F.row_number().over(order) == 1))


def model_agreement(df: DataFrame, same: str, kind: str, confidence: str, buckets: list[tuple[str, float]]) -> DataFrame:
    """grp (overall and each kind), bucket, n, agreement: how often model and people agree, by confidence; a value below all bounds is low."""
    b = F.lit("low")
    for name, least in reversed(buckets):
        b = F.when(F.col(confidence) >= least, F.lit(name)).otherwise(b)
    x = df.select(F.explode(F.array(F.lit("overall"), F.col(kind))).alias("grp"), b.alias("bucket"), F.col(same).cast("double").alias("_s"))
    return x.groupBy("grp", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("_s"), 6).alias("agreement"))


def batch_summary(df: DataFrame, score: str, value: str, k: int = 5) -> DataFrame:
    """One row: rows, share and mean of positive scores, and the ``k`` most frequent values with their counts."""
    top = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_v").limit(k)
    text = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_v"))), lambda z: F.concat(z["_v"], F.lit(":"), (-z["m"]).cast("string"))), ",").alias("t"))
    pos = F.col(score) > 0
    return df.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.coalesce(pos, F.lit(False)).cast("double")), 6).alias("positive_rate"), F.round(F.avg(F.when(pos, F.col(score))), 6).alias("mean_positive")).withColumn("top5", text.scalar())


def consistent_labels(df: DataFrame, correct: str, gold: str, predicted: Column, error: str, kinds: list[str]) -> DataFrame:
    """Labels without contradiction: ``correct`` is 0 or 1; correct rows have no error; others one of ``kinds`` or other, and no gold title that equals the prediction."""
    ok = F.lower(F.trim(F.col(correct).cast("string"))).isin("1", "true")
    clash = ~ok & (F.trim(gold) == F.trim(predicted)) & (F.coalesce(gold, F.lit("")) != "")
    return df.withColumns({correct: ok.cast("int"), gold: F.when(clash, F.lit("")).otherwise(F.col(gold)), error: F.when(ok, F.lit("")).when(F.col(error).isin(kinds), F.col(error)).otherwise(F.lit("other"))})


def weak_labels(candidates: DataFrame, gold: DataFrame, keys: list[str], name: str, golds: str, share: float) -> DataFrame:
    """keys, name, label: valid where the gold list of the keys holds the candidate, else not_skill, of which a share chosen by hash is kept."""
    x = candidates.join(gold, keys).withColumn("label", F.when(F.array_contains(golds, F.col(name)), "valid").otherwise("not_skill"))
    first = F.conv(F.substring(F.md5(F.concat_ws("|", *keys, name)), 1, 8), 16, 10).cast("bigint")
    return x.filter((F.col("label") == "valid") | (first < int(share * (1 << 32)))).select(*keys, name, "label")


def modal_votes(votes: DataFrame, item: str, voter: str, choice: str, value: str) -> DataFrame:
    """item, choice, support (votes, each once), modal_<value>: the most frequent value given with a choice, ties by value."""
    once = votes.select(item, choice, voter, value).distinct()
    w = W.partitionBy(item, choice)
    per = once.groupBy(item, choice, value).agg(F.count("*").alias("_n"))
    per = per.withColumns({"support": F.sum("_n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("_n"), value))})
    return per.filter("_r = 1").select(item, choice, "support", F.col(value).alias(f"modal_{value}"))


def until_stable(step, state, measure, rounds: int, least_gain: float = 0.0):
    """Drive ``step`` (state -> state) while ``measure`` (state -> number) gains more than ``least_gain``, at most ``rounds`` times.

    Returns (best state, its measure, history of measures).  The measures are single numbers; states are frames or whatever the step takes.
    """
    best, score = state, measure(state)
    history = [score]
    for _ in range(rounds):
        state = step(state)
        now = measure(state)
        history.append(now)
        if now - score <= least_gain:
            break
        best, score = state, now
    return best, score, history
