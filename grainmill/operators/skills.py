"""Dictionary matching: many terms against many texts, and what the matches mean.

Terms are few (their number is bounded by ``MAX_TERMS``) and compiled once a worker; texts come in Arrow batches.  NULL and empty texts
match nothing; a term given twice counts once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # the join does the same
    ahocorasick = None

MAX_TERMS = 200_000
FEW = 20_000  #: Terms up to which an automaton is sent to the tasks: some megabytes.


@lru_cache(maxsize=8)
def _compile(terms: tuple[str, ...]) -> re.Pattern:
    """One alternation, longest term first; ASCII terms only between non-word characters."""
    parts = [rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])" if t.isascii() else re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))]
    return re.compile("|".join(parts), re.IGNORECASE)


def matcher(terms: list[str]):
    """A function of a text column: the distinct terms found, longest first at each place, without overlap, in order of appearance."""
    known = tuple(sorted({t.strip().lower() for t in terms if t and t.strip()}))
    if len(known) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: match them by an n-gram join instead")

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        if not known:
            return pd.Series([[] for _ in texts])
        pat = _compile(known)
        return pd.Series([list(dict.fromkeys(m.group().lower() for m in pat.finditer(t))) if isinstance(t, str) else [] for t in texts])

    return find


def _contained(terms: list[str]):
    """A function of a text column: the distinct terms it contains, also inside one another."""

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        auto = ahocorasick.Automaton()
        for t in terms:
            auto.add_word(t, t)
        if terms:
            auto.make_automaton()
        return pd.Series([list(dict.fromkeys(v for _, v in auto.iter(t))) if terms else [] for t in texts])

    return find


def contained_terms(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, n: int = 2) -> DataFrame:
    """key, term of every term that a text contains, each pair once.

    Up to ``FEW`` terms (counted first) become an automaton that reads every text once, in Arrow batches; more are met by an equality join on
    the term's first ``n`` characters, then verified, with nothing broadcast.  Terms shorter than ``n`` are matched on what they have.
    """
    t = terms.select(F.lower(term).alias("term")).filter("term <> ''").distinct()
    few = [r["term"] for r in t.limit(FEW + 1).collect()] if ahocorasick else []
    if ahocorasick and len(few) <= FEW:
        d = texts.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("_t")).filter("_t <> ''")
        return d.select(key, F.explode(_contained(sorted(few))(F.col("_t"))).alias("term")).distinct()
    d = texts.select(F.col(key).alias("_k"), F.lower(F.coalesce(text, F.lit(""))).alias("_t")).filter("_t <> ''").distinct()
    d = d.withColumn("_k0", F.col("_k")).withColumn("_k", F.struct(F.col("_k0").alias("k")))
    chars = F.filter(F.split("_t", ""), lambda x: x != "")

    def heads(m: int) -> Column:
        return F.array_distinct(F.transform("_c", lambda _, i: F.array_join(F.slice("_c", i + 1, F.lit(m)), "")))

    h = d.withColumn("_c", chars)
    long = t.filter(F.length("term") >= n).withColumn("_h", F.substring("term", 1, n))
    # the texts themselves come in only for keys and terms whose heads met
    met = h.select("_k", F.explode(heads(n)).alias("_h")).join(long, "_h").select("_k", "term")
    out = met.join(d, "_k").filter(F.contains("_t", "term")).select(F.col("_k0").alias(key), "term")
    short = t.filter(F.length("term") < n).withColumn("_h", F.substring("term", 1, 1))
    one = h.select("_k", F.explode(heads(1)).alias("_h")).join(short, "_h").select("_k", "term").join(d, "_k").filter(F.contains("_t", "term")).select(F.col("_k0").alias(key), "term")
    return out.unionByName(one).distinct()


def drop_substrings(found: Column) -> Column:
    """The terms of an array that no other, longer term of it contains."""
    return F.filter(found, lambda x: ~F.exists(found, lambda y: y.contains(x) & (F.length(y) > F.length(x))))


def resolve(found: DataFrame, term: str, dictionary: DataFrame) -> DataFrame:
    """Name, category and confidence of found terms: 0.9 by name, 0.85 by alias.  ``dictionary``: name, category, alias (NULL for the name itself)."""
    names = dictionary.select(F.lower("name").alias("_t"), "name", "category", F.lit(0.9).alias("confidence"))
    alias = dictionary.filter("alias IS NOT NULL").select(F.lower("alias").alias("_t"), "name", "category", F.lit(0.85).alias("confidence"))
    best = names.unionByName(alias).groupBy("_t").agg(F.max_by(F.struct("name", "category", "confidence"), F.struct("confidence", F.col("name"))).alias("r"))
    return found.join(best, F.lower(F.col(term)) == F.col("_t")).select(*found.columns, "r.*")


def bio_tags(words: Column, spans: Column) -> Column:
    """B-, I- and O tags of an array of words for spans STRUCT<start, end, label> (end exclusive, later spans win nothing from earlier ones)."""
    at = lambda i: F.element_at(F.concat(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("label")))), 1)
    return F.transform(words, lambda w, i: F.when(at(i)["start"] < 0, "O").when(at(i)["start"] == i, F.concat(F.lit("B-"), at(i)["label"])).otherwise(F.concat(F.lit("I-"), at(i)["label"])))
