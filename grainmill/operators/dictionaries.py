"""Skill dictionaries: built, kept in order and matched with their rules.

A dictionary is rows (name, category, alias); matching compiles its terms once a worker.  NULL and blank names are left out; a term that stands for several
names goes to the first by name; equal rows count once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators.graph import components
from grainmill.operators.relational import first_per_key
from grainmill.operators.rules import ascii_term, skill_key
from grainmill.operators.skills import contained_terms, drop_substrings, matcher


def term_index(dictionary: DataFrame, blacklist: list[str], broad: list[str], least_han: int = 2, least_ascii: int = 2) -> DataFrame:
    """term, name, category, is_alias, size: what the dictionary is matched by, longest first.

    Blacklisted terms, broad aliases (not names), and terms shorter than their kind's least length are left out; of equal terms a name comes before an alias.
    """
    names = dictionary.select(F.col("name").alias("t"), "name", "category", F.lit(False).alias("is_alias"))
    alias = dictionary.filter("alias IS NOT NULL").select(F.col("alias").alias("t"), "name", "category", F.lit(True).alias("is_alias"))
    x = names.unionByName(alias).withColumn("term", F.lower(F.trim("t"))).filter("term <> ''")
    x = x.filter(~F.col("term").isin([b.lower() for b in blacklist]) & ~(F.col("is_alias") & F.col("term").isin([b.lower() for b in broad])))
    x = x.filter(F.length("term") >= F.when(ascii_term(F.col("term")), least_ascii).otherwise(least_han))
    x = first_per_key(x, ["term"], [F.col("is_alias"), F.col("name"), F.col("category")])
    return x.select("term", "name", "category", "is_alias", F.length("term").alias("size")).orderBy(F.desc("size"), "term")


def longest_at(terms: list[str]):
    """A function of a text column: the terms found by a trie, the longest at each start offset (overlaps stay), in order of appearance, each once."""
    known = sorted({t.strip().lower() for t in terms if t and t.strip()})

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        trie: dict = {}
        for t in known:
            node = trie
            for ch in t:
                node = node.setdefault(ch, {})
            node[""] = t
        word = re.compile(r"[a-z0-9]")
        out = []
        for text in texts:
            got: dict[str, None] = {}
            low = text.lower() if isinstance(text, str) else ""
            for i in range(len(low)):
                node, j, best = trie, i, None
                while j < len(low) and low[j] in node:
                    node = node[low[j]]
                    j += 1
                    t = node.get("")
                    if t and not (t.isascii() and ((i and word.match(low[i - 1])) or (j < len(low) and word.match(low[j])))):
                        best = t
                if best:
                    got[best] = None
            out.append(list(got))
        return pd.Series(out)

    return find


def context_kept(found: DataFrame, term: str, text: str, rules: DataFrame) -> DataFrame:
    """``found`` without terms whose context rules fail: a term with rules stays if one of them passes.

    ``rules``: term, require (pattern or NULL), reject (pattern or NULL).  A rule passes when the text matches what it requires and not what it rejects.
    """
    r = rules.groupBy(F.lower("term").alias("_t")).agg(F.collect_list(F.struct("require", "reject")).alias("_rules"))
    x = found.join(r, F.lower(term) == F.col("_t"), "left")
    passes = lambda q: F.coalesce(F.regexp_like(F.col(text), q["require"]), F.lit(True)) & ~F.coalesce(F.regexp_like(F.col(text), q["reject"]), F.lit(False))
    return x.filter(F.col("_rules").isNull() | F.exists("_rules", passes)).select(*found.columns)


def resolved_names(found: DataFrame, term: str, index: DataFrame, generic: list[str], overrides: dict[str, str]) -> DataFrame:
    """Add skill and category: the override of the term, else the alias itself where its name is generic (one of the patterns), else the name."""
    x = found.join(index.select(F.col("term").alias("_t"), "name", "category", "is_alias"), F.lower(term) == F.col("_t"))
    own = F.try_element_at(F.create_map(*[F.lit(v) for kv in overrides.items() for v in kv]), F.col("_t")) if overrides else F.lit(None).cast("string")
    broad = F.col("is_alias") & F.col("name").rlike("|".join(generic)) if generic else F.lit(False)
    return x.withColumn("skill", F.coalesce(own, F.when(broad, F.col("_t")).otherwise(F.col("name")))).drop("_t", "name", "is_alias")


def matched_rows(rows: DataFrame, key: str, fields: list[str], terms: list[str], keep: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """key, field, terms: the terms of each field's items (parted by ' | '), joined per row and field, without those inside longer ones.

    ``keep`` (key, term, label, score), a classifier's verdicts: terms it judged stay only as valid with a score of ``least`` or more.
    """
    find = matcher(terms)
    x = None
    for f in fields:
        one = rows.select(F.col(key), F.lit(f).alias("field"), F.explode(F.split(F.coalesce(f, F.lit("")), r" \| ")).alias("item"))
        x = one if x is None else x.unionByName(one)
    x = x.withColumn("found", find(F.col("item"))).select(key, "field", F.explode(drop_substrings(F.col("found"))).alias("term")).distinct()
    if keep is not None:
        v = keep.select(F.col(key), F.lower("term").alias("term"), "label", "score")
        x = x.join(v, [key, "term"], "left").filter(F.col("label").isNull() | ((F.col("label") == "valid") & (F.col("score") >= least))).select(key, "field", "term")
    return x.groupBy(key, "field").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def merged(dictionary: DataFrame, decisions: DataFrame) -> DataFrame:
    """The dictionary after merges: names joined by decisions (a, b) are one entry under their smallest name, whose aliases are all others' names and aliases."""
    names = dictionary.filter("name IS NOT NULL AND trim(name) <> ''").select("name").distinct()
    linked = components(decisions.select(F.col("a").alias("x"), F.col("b").alias("y")).join(names.withColumnRenamed("name", "x"), "x").join(names.withColumnRenamed("name", "y"), "y").select("x", "y"), names.withColumnRenamed("name", "id"))
    x = dictionary.join(linked.withColumnRenamed("id", "name"), "name")
    category = x.groupBy("component").agg(F.min_by("category", "name").alias("category"))
    terms = x.select("component", F.explode(F.array("name", "alias")).alias("alias")).filter("alias IS NOT NULL AND alias <> component").distinct()
    return category.join(terms, "component", "left").select(F.col("component").alias("name"), "category", "alias")


def corrected(dictionary: DataFrame, corrections: DataFrame) -> DataFrame:
    """The dictionary after corrections (op, name, value): drop a name, rename it, drop_alias or add_alias; each alias goes to one name only, and no alias is a name."""
    c = corrections.withColumn("k", skill_key(F.col("name")))
    of = lambda op: c.filter(F.col("op") == op)
    x = dictionary.withColumn("k", skill_key(F.col("name"))).join(of("drop").select("k"), "k", "left_anti")
    x = x.join(of("rename").groupBy("k").agg(F.min("value").alias("to")), "k", "left").withColumn("name", F.coalesce("to", "name")).drop("to")
    x = x.withColumn("ka", skill_key(F.col("alias"))).join(of("drop_alias").select("k", skill_key(F.col("value")).alias("ka"), F.lit(1).alias("off")).distinct(), ["k", "ka"], "left").withColumn("alias", F.when(F.col("off").isNull(), F.col("alias"))).drop("off", "ka")
    more = x.select("k", "name", "category").distinct().join(of("add_alias").select("k", F.col("value").alias("alias")), "k")
    every = x.select("name", "category", "alias").unionByName(more.select("name", "category", "alias")).distinct()
    heads = every.groupBy("name").agg(F.min("category").alias("category"))
    alias = every.filter("alias IS NOT NULL").withColumn("ka", skill_key(F.col("alias"))).join(heads.select(skill_key(F.col("name")).alias("ka")), "ka", "left_anti")
    alias = first_per_key(alias, ["ka"], [F.col("name"), F.col("alias")]).select("name", "alias")
    return heads.join(alias, "name", "left").select("name", "category", "alias")


_TECH = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z][A-Za-z]*[+#]{1,2}|[A-Z]{2,6}\d{0,3}|[A-Z][a-z]+[A-Z][A-Za-z]+)(?![A-Za-z0-9])")


def rule_entities(titles: list[str], skills: list[str]):
    """A function of a text column: ARRAY<STRUCT<start, end, label, text>> by rules.

    The longest title of the list (TITLE, one), skills longest first without overlap (SKILL), and words cased like technologies (TECH), none inside another.
    """
    kinds = [("TITLE", sorted({t for t in titles if t}, key=lambda t: (-len(t), t))), ("SKILL", sorted({t for t in skills if t}, key=lambda t: (-len(t), t)))]

    @F.pandas_udf("array<struct<start:int,end:int,label:string,text:string>>")
    def find(texts: pd.Series) -> pd.Series:
        pats = [(k, re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(t)}(?![A-Za-z0-9])" if t.isascii() else re.escape(t) for t in ts), re.I)) for k, ts in kinds if ts]
        out = []
        for text in texts:
            got: list[tuple[int, int, str, str]] = []
            free = lambda a, b: all(b <= x or a >= y for x, y, _, _ in got)  # noqa: B023, E731
            if isinstance(text, str):
                for k, p in pats:
                    hits = sorted(p.finditer(text), key=lambda m: (-len(m.group()), m.start()))
                    for m in hits[:1] if k == "TITLE" else hits:
                        if free(*m.span()):
                            got.append((*m.span(), k, m.group()))
                for m in _TECH.finditer(text):
                    if free(*m.span()):
                        got.append((*m.span(), "TECH", m.group()))
            out.append([{"start": a, "end": b, "label": k, "text": t} for a, b, k, t in sorted(got)])
        return pd.Series(out)

    return find


def valid_entities(entities: Column, text: Column) -> Column:
    """The entities whose place and text agree with ``text``, longest first and none inside another."""
    real = F.filter(entities, lambda e: (e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.length(text)) & (F.substring(text, e["start"] + 1, e["end"] - e["start"]) == e["text"]))
    return F.filter(real, lambda e: ~F.exists(real, lambda o: (o["start"] < e["end"]) & (e["start"] < o["end"]) & ((o["end"] - o["start"] > e["end"] - e["start"]) | ((o["end"] - o["start"] == e["end"] - e["start"]) & (o["start"] < e["start"])))))


def decoded(words: Column, tags: Column) -> Column:
    """ARRAY<STRUCT<start, end, label>> of BIO tags: a B- opens a span, I- of the same label goes on; an I- without opening opens one."""
    label = lambda i: F.substring(F.get(tags, i), 3, 64)
    open_ = lambda i: F.get(tags, i).startswith("B-") | (F.get(tags, i).startswith("I-") & F.coalesce((label(i) != label(i - 1)) | (F.get(tags, i - 1) == "O"), F.lit(True)))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, open_)
    ends = lambda s: F.coalesce(F.array_min(F.filter(places, lambda i: (i > s) & (open_(i) | ~F.get(tags, i).startswith("I-")))), F.size(words))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), ends(s).alias("end"), label(s).alias("label")))


def soft_skills(texts: DataFrame, key: str, text: str, entries: DataFrame, blacklist: list[str], hard: DataFrame | None = None) -> DataFrame:
    """key, name, dimension, confidence: soft skills a text contains, one hit a name, by its longest term: 0.9 by its name and 0.85 by an alias.

    ``entries``: name, dimension, alias (or NULL).  Blacklisted terms and names of ``hard`` skills (name), case left out, are no hits.
    """
    t = entries.select("name", "dimension", F.lower("name").alias("term"), F.lit(0.9).alias("confidence")).unionByName(entries.filter("alias IS NOT NULL").select("name", "dimension", F.lower("alias").alias("term"), F.lit(0.85).alias("confidence")))
    t = t.filter(~F.col("term").isin([b.lower() for b in blacklist])).distinct()
    if hard is not None:
        t = t.join(hard.select(F.lower("name").alias("_h")), F.lower("name") == F.col("_h"), "left_anti")
    f = contained_terms(texts, key, text, t, "term").join(t, "term")
    w = W.partitionBy(key, "name").orderBy(F.desc(F.length("term")), F.desc("confidence"), "dimension")
    return f.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, "name", "dimension", "confidence")
