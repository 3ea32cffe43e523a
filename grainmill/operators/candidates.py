"""Candidate lists: merging sources of candidates, judging them, and merging a second judge's opinion.

Candidates are rows (query, code, score, ...).  A query without candidates gives no row unless said otherwise; scores that are NULL count as 0;
ties are ordered by code.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators.relational import first_per_key, top_k_per_group


def best_of_queries(scores: DataFrame, record: str, code: str, query: str, score: str, priority: dict[str, int], near: float = 0.005, k: int = 5) -> DataFrame:
    """The ``k`` best codes of each record under its best query: scores of chunks are taken at their largest per query and code, and a query
    within ``near`` of the best one wins by ``priority`` (smaller first).
    """
    best = scores.groupBy(record, query, code).agg(F.max(F.coalesce(score, F.lit(0.0))).alias("score"))
    top = best.groupBy(record, query).agg(F.max("score").alias("_top"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col(query)), F.lit(99))
    top = top.withColumn("_max", F.max("_top").over(W.partitionBy(record))).filter(F.col("_top") >= F.col("_max") - near)
    chosen = first_per_key(top.withColumn("_rank", rank), [record], [F.col("_rank"), F.desc("_top"), F.col(query)]).select(record, query)
    return top_k_per_group(best.join(chosen, [record, query]), [record], [F.desc("score"), F.col(code)], k)


def supplement(sources: list[DataFrame], record: str, code: str, score: str, k: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """Exactly up to ``k`` distinct codes of each record: earlier sources first, then score; add slot 1..k and source number.  Codes in ``exclude`` are left out."""
    every = None
    for i, s in enumerate(sources):
        x = s.select(record, code, F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(i).alias("source"))
        every = x if every is None else every.unionByName(x)
    every = every.filter(F.col(code).isNotNull() & (F.col(code).cast("string") != ""))
    if exclude is not None:
        every = every.join(exclude.select(code), code, "left_anti")
    once = first_per_key(every, [record, code], [F.col("source"), F.desc("score")])
    w = W.partitionBy(record).orderBy("source", F.desc("score"), code)
    return once.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= k)


def fused_max(parts: DataFrame, record: str, code: str, kind: str, score: str, weights: dict[str, float], bonus: Column | None = None) -> DataFrame:
    """record, code, score: the largest score of each kind of chunk, weighed, plus a bonus; a kind without chunk counts as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.max(F.when(F.col(kind) == name, F.col(score))), F.lit(0.0)) * w
    extra = F.lit(0.0) if bonus is None else F.max(bonus)
    return parts.groupBy(record, code).agg((total + extra).alias("score"))


def escalate(confidence: Column, margin: Column, is_new: Column, noisy: Column, conflict: Column, least: float = 0.82, least_margin: float = 0.08) -> Column:
    """Whether a cheap decision needs a second look; a missing confidence or margin raises no doubt by itself."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return flag(is_new) | flag(noisy) | flag(conflict) | flag(confidence < least) | flag(margin < least_margin)


def accept(score: Column, margin: Column, least: float = 0.97, least_margin: float = 0.12) -> Column:
    """Whether the first candidate is accepted without a second look."""
    return F.coalesce((score >= least) & (margin >= least_margin), F.lit(False))


def rerank_merge(base: DataFrame, judged: DataFrame, query: str, code: str, low: float = 0.50, high: float = 0.85) -> DataFrame:
    """query, code, place, fell_back: the judge's order, then base candidates that it left out.

    Where the judge changes the first candidate with a score under ``low`` or of ``high`` or more, the base's first one leads.
    ``base``: query, code, score; ``judged``: query, code, score (codes that the base lacks are dropped).
    """
    b = base.withColumn("_b", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), code))).select(query, code, "_b")
    j = judged.join(b.select(query, code), [query, code], "left_semi").withColumn("_j", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), code))).select(query, code, "_j", F.col("score").alias("_s"))
    x = b.join(j, [query, code], "left")
    w = W.partitionBy(query)
    changed = F.max(F.when((F.col("_j") == 1) & (F.col("_b") != 1), 1)).over(w)
    doubt = F.max(F.when((F.col("_j") == 1) & ((F.col("_s") < low) | (F.col("_s") >= high)), 1)).over(w)
    x = x.withColumn("fell_back", F.coalesce((changed == 1) & (doubt == 1), F.lit(False)))
    lead = F.when(F.col("fell_back") & (F.col("_b") == 1), 0).otherwise(1)
    place = F.row_number().over(w.orderBy(lead, F.col("_j").asc_nulls_last(), "_b"))
    return x.withColumn("place", place).select(query, code, "place", "fell_back")


def validated(found: DataFrame, verdicts: DataFrame | None, key: str, name: str) -> DataFrame:
    """Found terms after a second judge: rejected ones dropped, confirmed ones raised to 0.9, others at 0.5; without verdicts all at 0.5.

    ``found``: key, name, dimension, confidence; ``verdicts``: key, name, is_valid, dimension.
    """
    if verdicts is None:
        return found.withColumns({"confidence": F.lit(0.5), "source": F.lit("fallback")})
    v = verdicts.groupBy(key, name).agg(F.max("is_valid").alias("_ok"), F.min("dimension").alias("_dim"))
    x = found.join(v, [key, name], "left").filter(F.col("_ok").isNull() | F.col("_ok"))
    yes = F.col("_ok").isNotNull()
    return x.withColumns({"dimension": F.when(yes, F.coalesce("_dim", "dimension")).otherwise(F.col("dimension")), "confidence": F.when(yes, F.greatest("confidence", F.lit(0.9))).otherwise(F.lit(0.5)), "source": F.when(yes, "confirmed").otherwise("unconfirmed")}).drop("_ok", "_dim")


def hard_over_soft(hard: DataFrame, soft: DataFrame, key: str, name: str) -> DataFrame:
    """Both kinds of terms with kind; a soft term of a hard one's name (case left out) gives way."""
    h, s = hard.select(key, name).distinct(), soft.select(key, name).distinct()
    taken = h.select(key, F.lower(name).alias("_n"))
    s = s.withColumn("_n", F.lower(name)).join(taken, [key, "_n"], "left_anti").drop("_n")
    return h.withColumn("kind", F.lit("hard")).unionByName(s.withColumn("kind", F.lit("soft")))


# Knots (raw, calibrated) of the confidence scale, steps at the second coordinates' jumps, and its top.
KNOTS = [(0.0, 0.0, 0.5), (0.70, 0.35, 1.25), (0.90, 0.60, 1.5)]
CEILING = 0.85


def calibrated(raw: Column, choice: Column, knots: list[tuple[float, float, float]] = KNOTS, ceiling: float = CEILING) -> Column:
    """A raw confidence on the scale of agreement: linear from each knot (from, value, slope) on, at most ``ceiling``; 0 for NONE, NULL and what isn't positive."""
    out = F.lit(0.0)
    for start, value, slope in knots:
        out = F.when(raw >= start, value + (raw - start) * slope).otherwise(out)
    none = raw.isNull() | (raw <= 0) | (F.coalesce(choice, F.lit("NONE")) == "NONE")
    return F.when(none, 0.0).otherwise(F.round(F.least(out, F.lit(ceiling)), 4))


def _lenient(t: str | None) -> str | None:
    """The outermost JSON value of a model's answer, as compact JSON; None where there is none."""
    if not isinstance(t, str):
        return None
    t = re.sub(r"(?s)<think>.*?</think>", " ", t)
    t = re.sub(r"```(?:json)?", " ", t)
    starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
    if not starts:
        return None
    body = t[min(starts) :]
    end = max(body.rfind("}"), body.rfind("]"))
    upto = body[: end + 1] if end >= 0 else body
    # as it is; with what is open at the end closed; cut back to the last bracket, or to the last whole field, and closed
    commas = [m.start() for m in re.finditer(",", body)][::-1][:50]
    for form in (upto, _closed(body), *(_closed(body[:i]) for i in commas), _closed(upto)):
        plain = re.sub(r",\s*([}\]])", r"\1", form)
        python = re.sub(r"\bNone\b", "null", re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", plain.replace("'", '"'))))
        for x in (plain, python):
            try:
                return json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def _closed(text: str) -> str:
    """``text`` with its open string and brackets closed."""
    open_, in_str, esc = [], False, False
    for ch in text:
        if in_str:
            if ch == '"' and not esc:
                in_str = False
            esc = ch == "\\" and not esc
        elif ch == '"':
            in_str = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]" and open_:
            open_.pop()
    return text + ('"' if in_str else "") + "".join(reversed(open_))


def lenient_json(c: Column) -> Column:
    """Compact JSON out of text with thoughts, fences, trailing commas, single quotes or a cut end; NULL where nothing parses."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(_lenient)

    return F.pandas_udf(run, "string")(c)
