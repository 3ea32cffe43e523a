"""Problem 2: one consensus choice from several people who disagree.

Expectation-maximisation over per-annotator confusion matrices with smoothing: the posterior of a task's
true choice weighs each answer by what its author's answers mean over all tasks.  Chance-corrected
agreement (Krippendorff's alpha for nominal data, and Fleiss-style observed agreement) is reported separately.

A round is one pass over the votes (one array row a task) that sums expected counts per annotator; the driver holds only the
confusion matrices: 288 bytes a person, whatever the number of tasks and answers.

Defined results: NULL, blank and cut-off JSON, cancelled answers and answers without a choice or created_at count as absent; a task's
latest sync with readable JSON and a person's latest answer count (ties: the larger id); tasks with fewer than two answers get no
consensus; equally likely choices go to the first by letter, NONE last; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions.chars import narrow, trim_all
from grainmill.sources.shared import cut

CODES = ["A", "B", "C", "D", "E", "NONE"]
SMOOTH = 1.0  #: Pseudo-answers in each row of a confusion matrix, most of them on the diagonal.
ROUNDS = 60
_ANNOTATION = "array<struct<id:bigint,completed_by:string,result:string,was_cancelled:boolean,created_at:string>>"
_RESULT = "array<struct<from_name:string,value:struct<choices:array<string>>>>"


def choice_code(c: Column) -> Column:
    """A to E or NONE of a choice as it is spelled; NULL where it is neither."""
    t = F.upper(F.regexp_replace(narrow(c), r"(?U)\s", ""))
    return F.when(t.rlike(r"不|NONE|以上.*否"), "NONE").when(t.rlike(r"^(?:候选|选项|CANDIDATE|OPTION|CAND)?[:：_-]?[A-E]$"), F.regexp_extract(t, r"([A-E])$", 1))


def votes(tasks: DataFrame, payload: str = "annotations_completed") -> DataFrame:
    """task_id, person, code: each person's latest choice in each task's latest readable sync."""
    t = tasks.select("task_id", "updated_at", trim_all(F.col(payload)).alias("j")).filter("task_id IS NOT NULL AND j IS NOT NULL")
    ok = F.col("j").startswith("[") & F.col("j").endswith("]") & F.try_parse_json(F.col("j")).isNotNull()
    t = t.filter(ok).groupBy("task_id").agg(F.max(F.struct("updated_at", "j")).alias("m")).select("task_id", F.explode(F.from_json("m.j", _ANNOTATION)).alias("a"))
    best = F.filter(F.from_json("a.result", _RESULT), lambda r: (r["from_name"] == "best_candidate_choice") & (F.size(r["value"]["choices"]) > 0))
    person = F.coalesce(F.get_json_object("a.completed_by", "$.id"), F.col("a.completed_by"))
    t = t.select("task_id", F.trim(person).alias("person"), choice_code(F.element_at(F.try_element_at(best, F.lit(-1))["value"]["choices"], 1)).alias("code"), F.col("a.created_at").alias("at"), F.coalesce("a.id", F.lit(0)).alias("id"), F.coalesce("a.was_cancelled", F.lit(False)).alias("off"))
    t = t.filter("NOT off AND at IS NOT NULL AND at <> '' AND code IS NOT NULL AND person IS NOT NULL AND person <> ''")
    return t.groupBy("task_id", "person").agg(F.max(F.struct("at", "id", "code")).alias("m")).select("task_id", "person", "m.code")


@dataclass
class Fit:
    people: list[str]
    prior: np.ndarray  #: weight of each choice
    confusion: np.ndarray  #: people x true choice x answer
    rounds: int
    log_likelihood: float


def _posterior(people: list[np.ndarray], codes: list[np.ndarray], log_prior: np.ndarray, log_conf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(log_prior)
    lens = np.array([len(p) for p in people])
    p, c = np.concatenate(people).astype(np.int64), np.concatenate(codes).astype(np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    ll = np.tile(log_prior, (len(lens), 1))
    np.add.at(ll, row, log_conf[p, :, c])
    top = ll.max(axis=1, keepdims=True)
    e = np.exp(ll - top)
    z = e.sum(axis=1, keepdims=True)
    return e / z, (np.log(z) + top).ravel().reshape(-1) + 0 * k


def fit(v: DataFrame, smooth: float = SMOOTH, rounds: int = ROUNDS, tol: float = 1e-5) -> tuple[Fit, DataFrame]:
    """(the fit, tasks with their answers as arrays task_id, p ARRAY<INT>, c ARRAY<INT>).  An empty table gives a fit without people."""
    k = len(CODES)
    numbered = cut(v.select("person").distinct().select("person", (F.row_number().over(W.orderBy("person")) - 1).alias("p")))
    people = numbered.orderBy("p").toArrow().column(0).to_pylist()  # one row a person
    m = len(people)
    code = F.create_map(*[x for i, p in enumerate(CODES) for x in (F.lit(p), F.lit(i))])
    rows = v.join(numbered, "person").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("p", code[F.col("code")].alias("c")))).alias("v")).select("task_id", F.transform("v", lambda x: x["p"]).alias("p"), F.transform("v", lambda x: x["c"]).alias("c"))
    tasks = cut(rows)
    base = (np.full((k, k), 0.3 / (k - 1)) + np.eye(k) * (0.7 - 0.3 / (k - 1))) * smooth
    conf = np.tile(base / base.sum(axis=1, keepdims=True), (m, 1, 1))
    prior = np.full(k, 1.0 / k)
    if not m:
        return Fit([], prior, conf, 0, 0.0), tasks
    shape = "pos bigint, x double"
    ll_old, ll, r = -np.inf, -np.inf, 0
    for r in range(1, rounds + 1):
        lp, lc = np.log(prior), np.log(conf)

        def sums(frames, lp=lp, lc=lc):
            total, like = np.zeros((m, k, k)), 0.0
            mass = np.zeros(k)
            for f in frames:
                if not len(f):
                    continue
                post, l1 = _posterior(list(f["p"]), list(f["c"]), lp, lc)
                lens = f["p"].map(len).to_numpy()
                row = np.repeat(np.arange(len(f)), lens)
                np.add.at(total, (np.concatenate(list(f["p"])), slice(None), np.concatenate(list(f["c"]))), post[row])
                mass += post.sum(axis=0)
                like += float(l1.sum())
            flat = np.concatenate([total.ravel(), mass, [like]])
            some = np.flatnonzero(flat)
            yield pd.DataFrame({"pos": some, "x": flat[some]})

        got = tasks.select("p", "c").mapInPandas(sums, shape)
        # sums of what is not zero
        sums_at = got.groupBy("pos").agg(F.sum("x").alias("x")).toArrow()
        summed = np.zeros(m * k * k + k + 1)
        summed[sums_at.column("pos").to_numpy()] = sums_at.column("x").to_numpy()
        total, mass, ll = summed[: m * k * k].reshape(m, k, k), summed[m * k * k : -1], float(summed[-1])
        conf = (total + base) / (total + base).sum(axis=2, keepdims=True)
        prior = (mass + 1.0) / (mass + 1.0).sum()
        if abs(ll - ll_old) <= tol * abs(ll):
            break
        ll_old = ll
    return Fit(people, prior, conf, r, ll), tasks


def consensus(tasks: DataFrame, f: Fit) -> DataFrame:
    """task_id, choice_code, confidence, n_answers: for tasks of at least two answers; only choices that somebody gave compete."""
    lp, lc = np.log(f.prior), np.log(np.maximum(f.confusion, 1e-300))

    def run(frames):
        for x in frames:
            if not len(x):
                continue
            post, _ = _posterior(list(x["p"]), list(x["c"]), lp, lc)
            given = np.zeros_like(post, dtype=bool)
            lens = x["p"].map(len).to_numpy()
            given[np.repeat(np.arange(len(x)), lens), np.concatenate(list(x["c"]))] = True
            post = np.where(given, post, 0.0)
            best = np.round(post, 12).argmax(axis=1)
            yield pd.DataFrame({"task_id": x["task_id"], "choice_code": [CODES[b] for b in best], "confidence": post[np.arange(len(x)), best] / np.maximum(post.sum(axis=1), 1e-300), "n_answers": lens})

    return tasks.filter(F.size("p") >= 2).mapInPandas(run, "task_id bigint, choice_code string, confidence double, n_answers bigint")


def reliability(v: DataFrame, f: Fit) -> DataFrame:
    """person, n_answers, reliability (probability of naming the true choice, weighed by the choices' shares)."""
    acc = {p: float((f.prior * np.diagonal(f.confusion[i])).sum()) for i, p in enumerate(f.people)}
    spark = v.sparkSession
    acc_df = spark.createDataFrame(list(acc.items()), "person string, reliability double")
    return v.groupBy("person").agg(F.count("*").alias("n_answers")).join(acc_df, "person").withColumn("reliability", F.round("reliability", 6))


def agreement(v: DataFrame) -> DataFrame:
    """n_tasks, n_answers, observed, expected, alpha: nominal agreement over tasks of at least two answers, corrected for chance.

    One row; without such tasks the shares are NULL.
    """
    per = v.groupBy("task_id", "code").agg(F.count("*").alias("c")).groupBy("task_id").agg(F.collect_list(F.struct("code", "c")).alias("cs"), F.sum("c").alias("n")).filter("n >= 2")
    x = per.select("task_id", "n", F.explode("cs").alias("e")).select("task_id", "n", "e.code", "e.c")
    tot = x.groupBy("code").agg(F.sum("c").alias("nc"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("n") - 1)).alias("same"))
    a = tot.agg(F.sum("nc").alias("n_answers"), F.sum("same").alias("same"), F.sum(F.col("nc") * (F.col("nc") - 1)).alias("sq"))
    n = F.col("n_answers")
    out = a.withColumns({"observed": F.try_divide("same", n), "expected": F.try_divide(F.col("sq"), n * (n - 1))})
    tasks = per.agg(F.count("*").alias("n_tasks"))
    return out.select(tasks.scalar().alias("n_tasks"), F.coalesce(n, F.lit(0)).alias("n_answers"), F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")), 6).alias("alpha"))


def found(tasks: DataFrame) -> DataFrame:
    """task_id BIGINT, choice_code."""
    f, rows = fit(cut(votes(tasks)))
    return consensus(rows, f).select("task_id", "choice_code")
