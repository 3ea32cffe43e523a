"""Relational helpers that the reports, mergers and samplers share.  All are plain plans for Catalyst.

NULL keys form a group of their own; every ordering ends in a unique key, so results are the same on any cluster; empty input gives
empty output; columns not named pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.sources.shared import cut

_RN = "__rn"


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (the filter on the rank is pushed into the window)."""
    return df.withColumn(_RN, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(_RN) <= k).drop(_RN)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``."""
    return top_k_per_group(df, keys, order, 1)


def with_share(df: DataFrame, value: str, keys: list[str], name: str = "share", digits: int = 6) -> DataFrame:
    """``value`` over its group's sum, rounded; NULL where the sum is zero."""
    return df.withColumn(name, F.round(F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys))), digits))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-NULL values of ``column`` (ties: smaller value first), as a one-column frame."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), column).limit(n).select(column)


def non_empty(*columns: Column) -> Column:
    """The first of ``columns`` that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def alternative_key_join(left: DataFrame, right: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Left join on ``first`` where the left row has it (non-NULL), otherwise on ``second``: two equality joins, no OR.

    Rows of ``right`` whose key is NULL meet nothing on that key.
    """
    has = F.lit(True)
    for c in first:
        has = has & left[c].isNotNull()
    extra = [c for c in right.columns if c not in first and c not in second]
    one = left.filter(has).join(right.select(*first, *extra), first, "left")
    two = left.filter(~has).join(right.select(*second, *extra), second, "left")
    return one.unionByName(two.select(*one.columns))


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add previous, change and growth (rounded to 6) of ``value`` against the row before in ``order``; NULL in first rows."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("previous", prev)
    return df.withColumns({"change": F.col(value) - F.col("previous"), "growth": F.round(F.try_divide(F.col(value) - F.col("previous"), F.col("previous")), 6)})


def min_max(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """``column`` scaled to 0..1 in its group; in a group of equal values 1.0 where they are positive, else 0.0."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(name, F.when(hi == lo, F.when(F.col(column) > 0, 1.0).otherwise(0.0)).otherwise((F.col(column) - lo) / (hi - lo)))


def quota_fill(df: DataFrame, group: str, row: str, rank: str, order: list[Column], quota: int) -> DataFrame:
    """Up to ``quota`` rows of each ``group``: lower ``rank`` first, each ``row`` once a group."""
    once = first_per_key(df, [group, row], [F.col(rank), *order])
    return top_k_per_group(once, [group], [F.col(rank), *order], quota)


def round_robin(df: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn, in the order of md5: add turn; strata with fewer rows drop out of later turns."""
    h = F.md5(F.col(key).cast("string"))
    # a stratum gives at most n rows: its window keeps no more
    turned = df.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(h, key))).filter(F.col("turn") <= n)
    return turned.orderBy("turn", F.md5(F.coalesce(F.col(stratum).cast("string"), F.lit("")).cast("string")), stratum, key).limit(n)


def upsert_frozen(existing: DataFrame, incoming: DataFrame, id_col: str, ladders: list[list[str]], fresh: Column) -> DataFrame:
    """``incoming`` with an identity: that of the existing row met by the first ladder key that meets one, else ``fresh``.

    Each ladder rung joins what earlier rungs left open (NULL or empty key values meet nothing; of several existing rows the smallest id counts).
    """
    out = incoming.withColumn("__id", F.lit(None).cast(existing.schema[id_col].dataType))
    for i, rung in enumerate(ladders):
        keyed = existing.filter(" AND ".join(f"`{c}` IS NOT NULL AND cast(`{c}` AS string) <> ''" for c in rung)).groupBy(*rung).agg(F.min(id_col).alias(f"__id{i}"))
        out = out.join(keyed, rung, "left").withColumn("__id", F.coalesce("__id", f"__id{i}")).drop(f"__id{i}")
    return out.withColumn(id_col, F.coalesce("__id", fresh)).drop("__id")


def conditional_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The table after the upsert, with action: inserted, updated (some value IS DISTINCT FROM the old one) or kept."""
    new = incoming.select(*keys, *[F.col(v).alias(f"__new_{v}") for v in values], F.lit(True).alias("__in"))
    old = existing.select(*keys, *values, F.lit(True).alias("__old"))
    both = old.join(new, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.col(f"__new_{v}"))
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__in").isNotNull() & differs, "updated").otherwise("kept")
    take = lambda v: F.when(F.col("__in").isNotNull(), F.col(f"__new_{v}")).otherwise(F.col(v)).alias(v)
    return both.select(*keys, *[take(v) for v in values], action.alias("action"))


def enriching_merge(base: DataFrame, others: list[tuple[str, DataFrame]], key: str, values: list[str]) -> DataFrame:
    """Full outer merge of sources: later non-NULL values win, and from_<source> flags tell who knew the key."""
    out = base
    for name, o in others:
        n = o.select(key, *[F.col(v).alias(f"__{v}") if v in o.columns else F.lit(None).cast(base.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(True).alias(f"from_{name}"))
        out = out.join(n, key, "full_outer")
        out = out.withColumns({v: F.coalesce(f"__{v}", v) for v in values} | {f"from_{name}": F.coalesce(f"from_{name}", F.lit(False))}).drop(*[f"__{v}" for v in values])
    return out


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and the incoming ones whose key is not there yet (of equal new keys the first by all columns)."""
    cols = existing.columns
    new = first_per_key(incoming, keys, [F.col(c) for c in cols]).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*cols))


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Add a global number from 1 on in the order of ``order`` (a unique key, NULLs first), without one task for all rows.

    Rows are dealt to ranges of the order and written once; each range is numbered by itself and shifted by the rows before it.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shift = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))  # a row a partition
    own = dealt.withColumn(_RN, F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    return own.join(shift, "__part").withColumn(name, F.col(_RN) + F.col("__shift")).drop(_RN, "__part", "__shift")


def chunk_of(number: Column, size: int) -> Column:
    """The chunk, from 1 on, of a row number."""
    return F.floor((number - 1) / size).cast("bigint") + 1


def latest(df: DataFrame, keys: list[str], at: str, version: str) -> DataFrame:
    """The latest row of each key: by time (NULLs last), then by the version's digits as a number, then by its text, then by all columns."""
    number = F.regexp_replace(F.coalesce(version, F.lit("")), r"\D", "").try_cast("bigint")
    return first_per_key(df, keys, [F.col(at).desc_nulls_last(), number.desc_nulls_last(), F.col(version).desc_nulls_last(), *[F.col(c) for c in df.columns if c not in (*keys, at, version)]])


def split_at(df: DataFrame, score: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(matched, pending): rows whose score reaches the threshold, and all others, NULL scores among them."""
    ok = F.coalesce(F.col(score) >= threshold, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of ``columns`` is NULL."""
    return df.dropna("any", subset=columns)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join that keeps both sides' columns: a right one of a name taken gets ``suffix``."""
    taken = set(left.columns)
    return left.join(right.select(*keys, *[F.col(c).alias(f"{c}{suffix}" if c in taken else c) for c in right.columns if c not in keys]), keys, "left")


def filled(payload: Column, path: str, default: Column, kind: str = "string") -> Column:
    """A field of a JSON payload, or ``default`` where the payload lacks it, is NULL or no JSON."""
    return F.coalesce(F.get_json_object(payload, path).try_cast(kind), default)


def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, which fails with ``message`` when a row does not meet ``condition`` (NULL fails too)."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(condition, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message))))


def compared_prefixes(df: DataFrame, group: str, variants: dict[str, Column]) -> DataFrame:
    """group, chosen, passes: of several ways to decide (name -> passed), the one with most passes; of equals the first named."""
    counts = [F.struct(F.coalesce(F.count_if(c), F.lit(0)).alias("passes"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, c) in enumerate(variants.items())]
    return df.groupBy(group).agg(F.greatest(*counts).alias("b")).select(group, F.col("b.name").alias("chosen"), F.col("b.passes").alias("passes"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, bins: int = 1024) -> DataFrame:
    """keys, name: the interpolated quantile ``q`` of a numeric column in each group, exactly, without any task that holds a group.

    Two passes: a histogram of ``bins`` equal bins a group tells in which bins the two order statistics lie; only rows of these bins are ranked.
    NULLs are left out; a group without values gives no row.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    g = x.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    g = g.withColumns({"_at": F.lit(q) * (F.col("_n") - 1)}).withColumns({"_k": F.floor("_at") + 1, "_k2": F.ceil("_at") + 1})
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).cast("int")
    b = x.alias("x").join(g.alias("g"), _equal("x", "g", keys)).select(*[F.col(f"x.{k}").alias(k) for k in keys], "_v", "_k", "_k2", at.alias("_b"))
    h = b.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.min("_k").alias("_k"), F.min("_k2").alias("_k2"))
    h = h.withColumn("_before", F.sum("_c").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_c"))
    h = h.filter(((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_c"))) | ((F.col("_k2") > F.col("_before")) & (F.col("_k2") <= F.col("_before") + F.col("_c"))))
    r = b.alias("b").join(h.alias("h"), (F.col("b._b") == F.col("h._b")) & _equal("b", "h", keys)).select(*[F.col(f"b.{k}").alias(k) for k in keys], "b._b", "b._v", "b._k", "b._k2", "h._before")
    # equal values are one row with their number, so that a value of very many rows is no sort of them
    r = r.groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"), F.min("_k").alias("_k"), F.min("_k2").alias("_k2"), F.min("_before").alias("_before"))
    r = r.withColumn("_upto", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v")))
    pick = lambda k: F.min(F.when((F.col(k) > F.col("_upto") - F.col("_c")) & (F.col(k) <= F.col("_upto")), F.col("_v")))
    out = r.groupBy(*keys).agg(pick("_k").alias("_a"), pick("_k2").alias("_z"), F.min("_k").alias("_k"))
    out = out.alias("o").join(g.alias("g"), _equal("o", "g", keys)).select(*[F.col(f"o.{k}").alias(k) for k in keys], (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("g._at") - F.col("g._k") + 1)).alias(name))
    return out


def _equal(a: str, b: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same
