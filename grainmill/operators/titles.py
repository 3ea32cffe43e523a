"""Job titles against a catalogue of occupations: cleaning, features, string ratios, dictionary scores and the whole match pipeline.

Candidates come from joins on tokens and n-grams; no title meets every entry.  Only string ratios leave the JVM, in Arrow batches and on candidate pairs alone.

Defined results: NULL and blank titles have no candidates and match nothing; a catalogue entry without title is left out; ties are ordered by code; equal
titles are computed once and joined back.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from grainmill.functions.chars import narrow, trim_all
from grainmill.functions.text import compact
from grainmill.operators.relational import min_max, top_k_per_group
from grainmill.operators.retrieval import bm25, ngrams, tokens
from grainmill.sources.shared import cut

# Weights, bonuses and penalties of the match score, and its limits.
WEIGHTS = {"title_score": 0.45, "task_score": 0.30, "desc_score": 0.15, "class_score": 0.10}
BONUS = {"alias": 0.10, "direct": 0.18, "task_overlap": 0.08}
NORMAL_SHARE, FUZZY_SHARE = 0.85, 0.35
GENERIC, GENERIC_EACH, CONFLICT = 0.08, 0.04, 0.12
FUZZY_LEAST, MARGIN_LEAST, SCORE_LEAST = 0.82, 0.08, 0.35
POOL, TOP = 30, 5
# Scores of the dictionary route.
EXACT, HOLDS, HELD = 1.0, 0.93, 0.88
ACTION_VERBS = "负责 参与 开展 执行 制定 完成 跟进 处理 管理 维护 开发 设计 协助 推进 搭建 优化 跟踪".split()


def light_title(c: Column) -> Column:
    """A title without brackets, numbers of pay and years, urgencies and separators; '' for NULL."""
    t = trim_all(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"[（(][^）)]*[）)]|[【\[][^】\]]*[】\]]", " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])\d+[kKwW]?(?:-\d+[kKwW]?)?(?![\p{L}\p{N}_])", " ")
    t = F.regexp_replace(t, r"急聘|直聘|高薪|诚聘|双休|五险一金|包吃住|[-|_/]+", " ")
    return trim_all(F.regexp_replace(t, r"(?U)\s+", " "))


def noisy_title(c: Column) -> Column:
    """Whether a title is noise: blank, letters run into digits, doubled separators, or a long bracket."""
    return F.coalesce(trim_all(c) == "", F.lit(True)) | c.rlike(r"[A-Za-z]{2,}\d{2,}|[/|_]{2,}|\([^)]{8,}\)|（[^）]{8,}）")


def query_text(c: Column, noise: str = r"五险一金|双休|包食宿|面议|急聘", limit: int = 512) -> Column:
    """A query for an encoder of bounded input: mark-up, noise words and repeated blanks dropped, cut to what the encoder takes."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    return F.substring(trim_all(F.regexp_replace(F.regexp_replace(t, noise, " "), r"(?U)\s+", " ")), 1, limit)


def title_label(c: Column) -> Column:
    """STRUCT<title, label>: a catalogue title without its level mark (L or S at the end, or in brackets), and that mark ('' where there is none)."""
    t = trim_all(narrow(F.coalesce(c, F.lit(""))))
    mark = r"\s*(?:\(([LS](?:/[LS])?)\)|(?<=\p{IsHan})([LS](?:/[LS])?))$"
    return F.struct(F.regexp_replace(F.regexp_replace(t, mark, ""), r"\s*\([^)]*\)$", "").alias("title"), F.concat(F.regexp_extract(t, mark, 1), F.regexp_extract(t, mark, 2)).alias("label"))


def sentences(c: Column) -> Column:
    """The sentences of a description, list numbers dropped; [] for NULL."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[。！？!?;；\n]+"), lambda x: trim_all(F.regexp_replace(x, r"^\s*\d+[.、]\s*", "")))
    return F.filter(parts, lambda x: x != "")


def terms_in(c: Column, terms: list[str]) -> Column:
    """Those of ``terms`` that a text holds, in their order, each once."""
    known = F.array(*map(F.lit, dict.fromkeys(terms))) if terms else F.array().cast("array<string>")
    return F.filter(known, lambda t: F.contains(F.coalesce(c, F.lit("")), t))


def described(c: Column, verbs: list[str] = ACTION_VERBS, domains: list[str] | None = None) -> Column:
    """STRUCT<sentences, core, keywords> of a description: its sentences, those with an action verb, and the domain words it holds."""
    s = sentences(c)
    pattern = "|".join(verbs) or r"(?!)"
    return F.struct(s.alias("sentences"), F.filter(s, lambda x: x.rlike(pattern)).alias("core"), terms_in(c, domains or []).alias("keywords"))


def term_features(title: Column, description: Column, lists: dict[str, list[str]]) -> Column:
    """STRUCT with one array a list: the terms that title or description hold."""
    both = F.concat_ws(" ", title, description)
    return F.struct(*[terms_in(both, v).alias(k) for k, v in lists.items()])


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=len(b) >= 200).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in common blocks over both lengths; NULL where a side is NULL."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: the largest ratio among the common tokens and these with either side's others; 0 where a side has none."""
    out = []
    for x, y in zip(a, b):
        s, t = set((x or "").split()), set((y or "").split())
        both = " ".join(sorted(s & t))
        one, two = (" ".join(filter(None, [both, " ".join(sorted(v))])) for v in (s - t, t - s))
        pairs = [(p, q) for p, q in ((both, one), (both, two), (one, two)) if p and q]
        out.append(100 * max((_ratio(p, q) for p, q in pairs), default=0.0))
    return pd.Series(out)


@F.pandas_udf(T.StructType([T.StructField("level", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType())]))
def match_level(title: pd.Series, names: pd.Series) -> pd.DataFrame:
    """How a clean title meets an entry's names: exact, normalized_exact, fuzzy (best ratio, also against a name's beginning, of FUZZY_LEAST or more), none."""
    rows = []
    for t, ns in zip(title, names):
        known = [n.strip() for n in (ns if ns is not None else []) if n and n.strip()]
        flat = _flat(t or "")
        if not t or not known:
            rows.append(("none", 0.0, ""))
        elif t in known:
            rows.append(("exact", 1.0, t))
        elif same := next((n for n in known if flat and _flat(n) == flat), None):
            rows.append(("normalized_exact", 0.95, same))
        else:
            score, name = max(((max(_ratio(t, n), _ratio(t, n[: len(t)])), n) for n in known), key=lambda x: x[0])
            rows.append(("fuzzy" if score >= FUZZY_LEAST else "none", round(score, 6), name if score > 0 else ""))
    return pd.DataFrame(rows, columns=["level", "score", "name"])


@F.pandas_udf(T.DoubleType())
def best_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """The largest Jaccard of a set of ``a`` and one of ``b``, both arrays of arrays; 0 where a side has none."""
    made: dict[tuple, frozenset] = {}

    def sets(xs) -> list[frozenset]:
        out = []
        for x in xs if xs is not None else []:
            k = tuple(x)
            if k not in made:
                made[k] = frozenset(k)
            out.append(made[k])
        return out

    rows = []
    for x, y in zip(a, b):
        best = 0.0
        for s in sets(x):
            for t in sets(y):
                i = len(s & t)
                if i:
                    best = max(best, i / (len(s) + len(t) - i))
        rows.append(best)
    return pd.Series(rows, dtype="float64")


def _flat(t: str) -> str:
    return "".join(ch for ch in t.lower() if ch.isalnum())


def dictionary_scores(titles: DataFrame, title: str, entries: DataFrame, code: str, names: str, k: int = 8) -> DataFrame:
    """title, code, name, score: the ``k`` best entries of each distinct title by the largest of five signals over its names.

    Equal compact forms 1, a name held by the title 0.93, a title held by a name 0.88, the share of words in common, the Jaccard of character
    pairs.  Pairs meet on a character pair or a one-character word, without which every signal is 0.
    """
    grams = lambda c: F.array_distinct(F.concat(ngrams(c), F.split(c, "")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|[一-龥]+)")))
    q = titles.select(F.col(title).alias("t")).distinct().withColumn("tn", compact(F.col("t"))).filter("tn <> ''")
    e = entries.select(F.col(code).alias("code"), F.explode(names).alias("name")).withColumn("nn", compact(F.col("name"))).filter("nn <> ''").distinct()
    q, e = q.withColumns({"tg": ngrams(F.col("tn")), "tw": words(F.col("t"))}), e.withColumns({"ng": ngrams(F.col("nn")), "nw": words(F.col("name"))})
    # a name of one character is met by that character; all else by a pair of characters
    key = lambda n, g: F.when(F.length(n) == 1, grams(n)).otherwise(g)
    single = F.array_distinct(F.filter(F.split("tn", ""), lambda x: x != ""))
    met = q.select("t", F.explode(F.array_distinct(F.concat("tg", single))).alias("_g")).join(e.select("code", "name", F.explode(key(F.col("nn"), F.col("ng"))).alias("_g")).filter("_g <> ''"), "_g").select("t", "code", "name").distinct()
    short = q.filter("length(tn) = 1").select("t", F.col("tn").alias("_g")).join(e.select("code", "name", F.explode(F.array_distinct(F.split("nn", ""))).alias("_g")), "_g").select("t", "code", "name")
    x = met.unionByName(short).distinct().join(q, "t").join(e, ["code", "name"])
    whole = F.when(F.col("nn") == F.col("tn"), EXACT).when(F.contains("tn", "nn"), HOLDS).when(F.contains("nn", "tn"), HELD).otherwise(0.0)
    share = F.coalesce(F.size(F.array_intersect("tw", "nw")) / F.nullif(F.greatest(F.size("tw"), F.size("nw")), F.lit(0)), F.lit(0.0))
    pairs = F.size(F.array_intersect("tg", "ng")) / F.size(F.array_union("tg", "ng"))
    x = x.withColumn("score", F.round(F.greatest(whole, share, pairs), 4)).filter("score > 0")
    best = top_k_per_group(x, ["t", "code"], [F.desc("score"), F.col("name")], 1)
    return top_k_per_group(best, ["t"], [F.desc("score"), F.col("code")], k).select(F.col("t").alias(title), "code", "name", "score")


def similar_names(df: DataFrame, key: str, name: str, least: float = 0.70) -> DataFrame:
    """x < y, ratio: pairs of names whose ratio is at least ``least`` (0.5 or more), all of them.

    Such names share a share of their characters, counted with repeats: each name is met under its rarest ones only, as many as could all be
    missing from the other but one (a prefix filter); lengths and shared characters rule out most pairs before any ratio.
    """
    n = df.select(F.col(key).alias("id"), F.lower(F.trim(name)).alias("s")).filter("s <> ''").distinct()
    c = n.select("id", F.length("s").alias("n"), F.posexplode(F.array_sort(F.filter(F.split("s", ""), lambda x: x != ""))).alias("p", "c"))
    c = c.withColumn("tok", F.concat("c", F.row_number().over(W.partitionBy("id", "c").orderBy("p")).cast("string")))
    often = c.groupBy("tok").agg(F.count("*").alias("f"))
    c = c.join(often, "tok").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("f", "tok")))
    # 2m / (a + b) >= least, and so b >= a * least / (2 - least): at least m characters of a are shared
    need = F.ceil(F.col("n") * least / (2 - least) - 1e-9)
    pre = c.filter(F.col("r") <= F.col("n") - need + 1).select("id", "n", "tok")
    a, b = pre.select(F.col("id").alias("x"), F.col("n").alias("nx"), "tok"), pre.select(F.col("id").alias("y"), F.col("n").alias("ny"), "tok")
    met = a.join(b, "tok").filter((F.col("x") < F.col("y")) & (2 * F.least("nx", "ny") >= least * (F.col("nx") + F.col("ny")) - 1e-9)).select("x", "y").distinct()
    toks = c.groupBy("id").agg(F.collect_list("tok").alias("ts"))
    side = lambda i, s: n.join(toks, "id").select(F.col("id").alias(i), F.col("s").alias(f"s{s}"), F.col("ts").alias(f"t{s}"))
    p = met.join(side("x", 1), "x").join(side("y", 2), "y").filter(2 * F.size(F.array_intersect("t1", "t2")) >= least * (F.length("s1") + F.length("s2")) - 1e-9)
    return p.withColumn("ratio", F.round(F.greatest(ratio("s1", "s2"), ratio("s2", "s1")), 6)).filter(F.col("ratio") >= least).select("x", "y", "ratio")


def union_recall(titles: DataFrame, title: str, catalogue: DataFrame, code: str, text: str, floor: float = 0.3, k: int = 20) -> DataFrame:
    """title, code, score: candidates by BM25 (over the best one's score) and, at ``floor``, those that only hold a character pair of the title; the best ``k``."""
    q = titles.select(F.col(title).alias("q")).filter("q IS NOT NULL").distinct().withColumn("w", tokens(F.regexp_replace("q", r"[（(][^）)]*[）)]", "")))
    d = catalogue.select(F.col(code).alias("code"), F.col(text).alias("x"))
    b = bm25(d.withColumn("w", tokens(F.col("x"))), "code", "w", q, "q", "w")
    b = b.withColumn("score", F.try_divide("score", F.max("score").over(W.partitionBy("q")))).select("q", "code", "score")
    like = q.select("q", F.explode(F.array_distinct("w")).alias("w")).filter(F.col("w").rlike(r"^[一-鿿]{2}$")).join(d.select("code", F.explode(ngrams(F.col("x"))).alias("w")), "w").select("q", "code", F.lit(floor).alias("score"))
    x = b.unionByName(like).groupBy("q", "code").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k_per_group(x, ["q"], [F.desc("score"), F.col("code")], k).withColumnRenamed("q", title)


def major_class(text: Column, keywords: dict[str, str]) -> Column:
    """The class of the first keyword, in the order given, that a text holds; '' where it holds none."""
    out = F.when(F.lit(False), F.lit(""))
    for word, major in keywords.items():
        out = out.when(F.contains(text, F.lit(word)), F.lit(major))
    return out.otherwise(F.lit(""))


def match_titles(jobs: DataFrame, key: str, title: str, description: str, catalogue: DataFrame, lists: dict[str, list[str]], keywords: dict[str, str], aliases: dict[str, str] | None = None, conflicts: list[tuple[str, list[str]]] | None = None, k: int = TOP) -> DataFrame:
    """key, place, code, score, level, margin, confidence, flags: the ``k`` best entries of each job, with how sure the first one is.

    ``catalogue``: code, title, aliases, tasks ARRAY<STRING>, description, major.  ``lists``: terms by kind (function, object, conflict, generic);
    ``keywords``: word -> major class; ``aliases``: title -> title; ``conflicts``: (pattern of an entry's text, terms that speak against it).
    Two BM25 routes (title; core sentences against tasks) propose POOL entries each, inside the inferred class where that leaves any; four signals scaled per
    job are weighed, bonuses added and penalties taken off.  A job without candidates comes out once, with place 0 and no code.
    """
    cat = catalogue.filter(F.coalesce(F.trim("title"), F.lit("")) != "").select("code", F.trim("title").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("tasks", F.array().cast("array<string>")).alias("tasks"), F.coalesce("description", F.lit("")).alias("about"), F.coalesce("major", F.lit("")).alias("major"))
    cat = cat.withColumns({"names": F.array_distinct(F.concat(F.array("name"), "aliases")), "about_g": ngrams(compact(F.col("about"))), "task_w": F.transform("tasks", lambda x: F.array_distinct(tokens(x)))})
    j = jobs.select(F.col(key).alias("id"), F.coalesce(title, F.lit("")).alias("raw"), F.coalesce(description, F.lit("")).alias("jd")).distinct()
    clean = light_title(F.col("raw"))
    for a, b in (aliases or {}).items():
        clean = F.when(clean == a, F.lit(b)).otherwise(clean)
    j = j.withColumn("clean", clean).withColumns({"d": described(F.col("jd"), domains=lists.get("domain", [])), "f": term_features(F.col("clean"), F.col("jd"), lists), "class": major_class(F.concat_ws(" ", "clean", "jd"), keywords)})
    core = F.when(F.size("d.core") > 0, F.col("d.core")).when(F.size("d.sentences") > 0, F.slice("d.sentences", 1, 3)).otherwise(F.array("jd"))
    j = j.withColumns({"asked": ngrams(compact(F.concat_ws(" ", "clean", "jd", F.array_join("d.keywords", " ")))), "core_w": F.transform("d.core", lambda s: F.array_distinct(tokens(s)))})
    j = j.withColumns({"tw": tokens(F.when(F.col("clean") == "", F.col("raw")).otherwise(F.col("clean"))), "sw": tokens(F.array_join(core, " "))})
    # the class filter holds only where it leaves an entry
    there = cat.select("major").distinct()
    j = j.join(there.select(F.col("major").alias("_m")), (F.col("class") != "") & F.contains("_m", "class"), "left_semi").withColumn("inside", F.lit(True)).unionByName(j.join(there.select(F.col("major").alias("_m")), (F.col("class") != "") & F.contains("_m", "class"), "left_anti").withColumn("inside", F.lit(False)))

    j, cat = cut(j), cut(cat)

    def route(words: str, text: Column, name: str) -> DataFrame:
        q = j.select(words).distinct().withColumn("h", F.xxhash64(words))
        r = bm25(cat.select("code", tokens(text).alias("w")), "code", "w", q, "h", words)
        return top_k_per_group(r, ["h"], [F.desc("score"), F.col("code")], POOL).withColumnRenamed("score", name)

    ids = j.select("id", "class", "inside", F.xxhash64("tw").alias("h1"), F.xxhash64("sw").alias("h2"))
    t1 = ids.join(route("tw", F.array_join("names", " "), "title_raw").withColumnRenamed("h", "h1"), "h1").select("id", "code", "title_raw", F.lit(None).cast("double").alias("task_raw"))
    t2 = ids.join(route("sw", F.array_join("tasks", " "), "task_raw").withColumnRenamed("h", "h2"), "h2").select("id", "code", F.lit(None).cast("double").alias("title_raw"), "task_raw")
    c = t1.unionByName(t2).groupBy("id", "code").agg(F.coalesce(F.max("title_raw"), F.lit(0.0)).alias("title_score"), F.coalesce(F.max("task_raw"), F.lit(0.0)).alias("task_score"))
    x = cut(c).join(j, "id").join(cat, "code")
    fits = (F.col("class") != "") & F.contains("major", "class")
    x = x.filter(~F.col("inside") | fits)
    # signals of candidates only
    overlap = best_jaccard("core_w", "task_w")
    common = F.size(F.array_intersect("asked", "about_g"))
    desc = F.coalesce(common / F.nullif(F.size("asked") + F.size("about_g") - common, F.lit(0)), F.lit(0.0))
    level = match_level("clean", "names")
    x = x.withColumns({"desc_score": desc, "class_score": fits.cast("double"), "task_overlap": overlap, "m": level})
    alias = F.when(F.col("m.level") == "exact", BONUS["alias"]).when(F.col("m.level") == "normalized_exact", round(BONUS["alias"] * NORMAL_SHARE, 6)).otherwise(0.0)
    direct = F.when(F.col("m.level") == "exact", BONUS["direct"]).when(F.col("m.level") == "normalized_exact", round(BONUS["direct"] * NORMAL_SHARE, 6)).when(F.col("m.level") == "fuzzy", round(BONUS["direct"] * FUZZY_SHARE, 6)).otherwise(0.0)
    hits = F.size(terms_in(F.col("clean"), lists.get("generic", [])))
    has = lambda kind: F.size(f"f.{kind}") > 0 if kind in lists else F.lit(False)
    generic = F.when(hits == 0, 0.0).when(has("object"), GENERIC * 0.5).when(has("function") & (F.length("clean") <= 8), GENERIC).otherwise(F.least(F.lit(GENERIC), hits * GENERIC_EACH))
    against = F.lit(0.0)
    whole = F.concat_ws(" ", "name", "about", "major")
    for pattern, terms in conflicts or []:
        against = against + F.when(whole.rlike(pattern) & (F.size(terms_in(F.concat_ws(" ", "clean", "jd"), terms)) > 0), CONFLICT).otherwise(0.0)
    x = x.withColumns({"generic": generic, "against": F.least(against, F.lit(CONFLICT * 1.5)), "bonus": alias + direct + BONUS["task_overlap"] * F.col("task_overlap")})
    total = F.col("bonus") - F.col("generic") - F.col("against")
    x = cut(x.select("id", "code", *WEIGHTS, "m", "generic", "against", total.alias("rest")))
    for s in WEIGHTS:
        x = min_max(x, s, ["id"], f"n_{s}")
    score = F.col("rest")
    for s, w in WEIGHTS.items():
        score = score + F.col(f"n_{s}") * w
    w = W.partitionBy("id").orderBy(F.desc("score"), "code")
    x = x.withColumn("score", F.round(score, 6)).withColumns({"place": F.row_number().over(w), "next": F.lead("score").over(w)}).filter(F.col("place") <= k)
    first = x.filter("place = 1").select("id", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"), (F.col("score") < SCORE_LEAST).alias("low"), (F.col("generic") > 0).alias("g"), (F.col("against") > 0).alias("a"), (F.col("n_task_score") == 0).alias("nt"), ((F.col("n_title_score") == 0) & (F.col("m.score") == 0)).alias("nn"))
    small = F.col("margin") < MARGIN_LEAST
    flags = F.array_compact(F.array(F.when(small, F.lit("small_top1_top2_margin")), F.when(F.col("low"), F.lit("low_top1_score")), F.when(F.col("g"), F.lit("generic_title_penalty")), F.when(F.col("a"), F.lit("domain_conflict_penalty")), F.when(F.col("nt"), F.lit("task_signal_missing")), F.when(F.col("nn"), F.lit("title_signal_missing"))))
    sure = first.select("id", "margin", flags.alias("flags"), F.when(small | F.col("a") | F.col("nn"), "low").when(F.size(flags) > 0, "medium").otherwise("high").alias("confidence"))
    out = x.select("id", "place", "code", "score", F.col("m.level").alias("level")).join(sure, "id")
    none = j.select("id").join(x.select("id"), "id", "left_anti").select("id", F.lit(0).alias("place"), F.lit("").alias("code"), F.lit(0.0).alias("score"), F.lit("none").alias("level"), F.lit(0.0).alias("margin"), F.array(F.lit("no_candidates")).alias("flags"), F.lit("low").alias("confidence"))
    return out.unionByName(none).withColumnRenamed("id", key)
