"""Lexical and dense retrieval as joins: BM25 over postings, n-gram overlap, exact cosine, fusion and flags.

Texts that are NULL or empty have no tokens and meet nothing; ties are ordered by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators.relational import min_max, top_k_per_group


def tokens(c: Column) -> Column:
    """Latin and digit words in lower case, and two-character pieces of runs of Han characters."""
    t = F.coalesce(c, F.lit(""))
    runs = F.regexp_extract_all(t, F.lit(r"([一-鿿]+)"))
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(word_tokens(t), grams)


def word_tokens(c: Column) -> Column:
    """Latin and digit words in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z0-9]+)")), F.lower)


def bm25(docs: DataFrame, key: str, words: str, queries: DataFrame, query_key: str, query_words: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_key, key, score: of every pair that shares a word.  ``words`` and ``query_words`` are arrays.

    Query words meet postings by an equality join; a word of very many documents is split by AQE's skew join.  Query frequency weighs.
    """
    d = docs.select(F.col(key).alias("_d"), F.col(words).alias("_w"))
    stats = d.agg(F.count("*").alias("_n"), F.avg(F.size("_w")).alias("_avg"))
    post = d.select("_d", F.size("_w").alias("_len"), F.explode("_w").alias("_t")).groupBy("_d", "_len", "_t").agg(F.count("*").alias("_tf"))
    df = post.groupBy("_t").agg(F.count("*").alias("_df"))
    q = queries.select(F.col(query_key).alias("_q"), F.explode(query_words).alias("_t")).groupBy("_q", "_t").agg(F.count("*").alias("_qtf"))
    x = q.join(df, "_t").join(post, "_t").withColumns({"_n": stats.select("_n").scalar(), "_avg": stats.select("_avg").scalar()})
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    tf = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.greatest("_avg", F.lit(1e-9))))
    return x.groupBy("_q", "_d").agg(F.sum(F.col("_qtf") * idf * tf).alias("score")).select(F.col("_q").alias(query_key), F.col("_d").alias(key), "score")


def ngrams(c: Column, n: int = 2) -> Column:
    """The distinct character n-grams of a text; a shorter text is its own."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))))


def ngram_jaccard(left: DataFrame, lkey: str, right: DataFrame, rkey: str, grams: str, least: float) -> DataFrame:
    """lkey, rkey, score of pairs with Jaccard of at least ``least``; sets meet on one of their rarer grams.

    Sets of n grams and such a Jaccard share at least ``least`` * n of them, so each set is met under its rarest n - ceil(least * n) + 1 grams alone (a
    prefix filter in the order of their frequency on the right): common grams never meet by themselves, and no pair is lost.
    """
    side = lambda df, k, i: df.select(F.col(k).alias(i), F.array_distinct(grams).alias(f"g{i}")).filter(F.size(f"g{i}") > 0)
    a, b = side(left, lkey, "_a"), side(right, rkey, "_b")
    often = b.select(F.explode("g_b").alias("_g")).groupBy("_g").agg(F.count("*").alias("_f"))

    def prefix(df: DataFrame, i: str) -> DataFrame:
        x = df.select(i, F.size(f"g{i}").alias(f"_n{i}"), F.explode(f"g{i}").alias("_g")).join(often, "_g", "left")
        x = x.withColumn("_r", F.row_number().over(W.partitionBy(i).orderBy(F.coalesce("_f", F.lit(0)), "_g")))
        return x.filter(F.col("_r") <= F.col(f"_n{i}") - F.ceil(least * F.col(f"_n{i}") - 1e-9) + 1).select(i, f"_n{i}", "_g")

    met = prefix(a, "_a").join(prefix(b, "_b"), "_g").filter(F.least("_n_a", "_n_b") >= least * F.greatest("_n_a", "_n_b") - 1e-9).select("_a", "_b").distinct()
    x = met.join(a, "_a").join(b, "_b").withColumn("_i", F.size(F.array_intersect("g_a", "g_b")))
    s = F.col("_i") / (F.size("g_a") + F.size("g_b") - F.col("_i"))
    return x.withColumn("score", s).filter(F.col("score") >= least).select(F.col("_a").alias(lkey), F.col("_b").alias(rkey), "score")


def cosine_top_k(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query_key, key, score, rank: the ``k`` items nearest to each query by cosine, exactly.

    Queries and items are cut into blocks of about ``block`` vectors; a task multiplies one block of either side, whatever the tables' sizes, and each query
    leaves it with its ``k`` best, so what is merged per query is k times the number of item blocks.  NULL and zero vectors are left out.
    """
    blocks, groups = max(1, -(-items.count() // block)), max(1, -(-queries.count() // block))
    v = items.select(F.col(key).alias("_i"), F.col(vector).cast("array<double>").alias("_v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_b")).filter("_v IS NOT NULL")
    v = v.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    q = queries.select(F.col(key).alias("_q"), F.col(vector).cast("array<double>").alias("_x")).filter("_x IS NOT NULL").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).withColumn("_c", F.pmod(F.xxhash64("_q"), F.lit(groups)))
    kind = dict(items.dtypes)[key]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        mat = lambda t, c: np.stack(t.column(c).to_pandas().to_list()) if t.num_rows else np.zeros((0, 1))
        x, y = mat(left, "_x"), mat(right, "_v")
        if not len(x) or not len(y):
            return pa.table({"_q": left.column("_q").slice(0, 0), "_i": left.column("_q").slice(0, 0).cast(right.schema.field("_i").type), "score": pa.array([], pa.float64())})
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        s = (x / np.where(nx == 0, 1, nx)[:, None]) @ (y / np.where(ny == 0, 1, ny)[:, None]).T
        s[nx == 0], s[:, ny == 0] = -np.inf, -np.inf
        m = min(k + 1, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        row = np.repeat(np.arange(len(x)), m)
        flat, col = s[row, top.ravel()], top.ravel()
        ok = np.isfinite(flat)
        return pa.table({"_q": left.column("_q").take(pa.array(row[ok])), "_i": right.column("_i").take(pa.array(col[ok])), "score": pa.array(flat[ok])})

    got = q.groupBy("_b", "_c").cogroup(v.groupBy("_b", "_c")).applyInArrow(best, f"_q {kind}, _i {kind}, score double").filter("_q <> _i")
    top = top_k_per_group(got, ["_q"], [F.round("score", 9).desc(), F.col("_i")], k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(F.round("score", 9).desc(), "_i"))).select(F.col("_q").alias("query_key"), F.col("_i").alias(key), "score", "rank")


def fuse(scores: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """Add score: the weighted sum of the columns, each scaled to 0..1 among a query's candidates (missing counts as 0)."""
    total = F.lit(0.0)
    for c, w in weights.items():
        scores = min_max(scores.withColumn(c, F.coalesce(c, F.lit(0.0))), c, [query], f"_{c}")
        total = total + F.col(f"_{c}") * w
    return scores.withColumn("score", total).drop(*[f"_{c}" for c in weights])


def confidence(ranked: DataFrame, query: str, key: str, score: str, margin: float, least: float) -> DataFrame:
    """query, best, score, margin, flags, level: low for a small margin, medium for another flag, high otherwise.

    ``ranked`` holds the candidates of each query; a query without second candidate has its own score as margin.
    """
    w = W.partitionBy(query).orderBy(F.desc(score), key)
    x = ranked.withColumns({"_r": F.row_number().over(w), "_next": F.lead(score).over(w)}).filter("_r = 1")
    x = x.withColumn("margin", F.round(F.col(score) - F.coalesce("_next", F.lit(0.0)), 6))
    flags = F.array_compact(F.array(F.when(F.col("margin") < margin, F.lit("small_margin")), F.when(F.col(score) < least, F.lit("low_score"))))
    level = F.when(F.col("margin") < margin, "low").when(F.col(score) < least, "medium").otherwise("high")
    return x.select(query, F.col(key).alias("best"), F.round(score, 6).alias("score"), "margin", F.array_join(flags, ",").alias("flags"), level.alias("level"))
