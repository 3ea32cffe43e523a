"""Problem 6: postings put up again with small changes.

A description becomes the set of its clauses (mark-up, width, case, punctuation, numbering and order left out), each weighed
by its length.  Candidates come from an exact prefix filter over pairs of clauses: with the clauses of every text in one
global order, rare ones first, two texts that share ``SHARED`` of the longer one have a first and a second shared clause,
and from either on each text must hold enough weight.  Each class is indexed under all pairs of its clauses that can be these
two, and under each clause that suffices alone, so no pair is lost, however common its clauses are; the order only decides
how many candidates there are.  A bucket of more than ``BUCKET`` classes is split by the third shared clause, by the
same argument, where that leaves fewer pairs, and is dealt in blocks of ``BUCKET`` otherwise; no row ever holds more.  Pairs that meet are verified exactly on the
clauses.

Records with the same clauses form one class; pairs are found between classes and expanded to records only
in :func:`found`, whose form is fixed.

Defined results: descriptions that are NULL or shorter than 40 characters are in no pair; equal rows count once; a
record with two different descriptions takes part with each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.operators.graph import components
from grainmill.sources.shared import cut, drop_cut

BUCKET = 200  #: Classes of a bucket beyond which it is split.
SHARED = 0.6  #: Least share of wording, by length of shared clauses against the longer text: between "less than about half" and "two thirds".
BINS = 1 << 20  #: Bins of the histogram of clauses that gives their order, whatever the number of clauses.
CHUNK = 16_000  #: Most characters of one number of :func:`tokens`.
LEVELS = (8, 13)  #: Lengths from which on clauses are of the next level of a sketch.
LEAST_CHARS = 40

_TAG = re.compile(r"<[^<>]{0,200}>")
_CUT = re.compile(r"[^\w ]+|(?<=[^\x00-\x7f]) +| +(?=[^\x00-\x7f])")


def clauses(text: str) -> list[str]:
    """The clauses of a text, normalised; those of one character and numbering are left out."""
    if "<" in text or "&" in text:
        text = html.unescape(_TAG.sub("\n", html.unescape(text)))
    text = unicodedata.normalize("NFKC", text).lower()
    out = []
    for x in _CUT.split(text):
        x = x.strip().lstrip("0123456789 ").replace(" ", "")
        if len(x) >= 2:
            out.append(x)
    return out


def tokens(cs: list[str], memo: dict[str, int]) -> list[int]:
    """The clauses as distinct ascending numbers: 50 bits of a hash and, in the last 14, the clause's characters.

    The second and later places of a clause are numbers of their own, so of a repeated clause as many places are shared as both texts have.  What
    is longer than ``CHUNK`` characters gives one number for each ``CHUNK`` of them: no length is clipped.
    """
    out, seen = [], {}
    for c in cs:
        h = memo.get(c)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[c] = int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), "little")
        n, part = len(c), seen.get(c, 0)
        while n > 0:
            x = (h + part * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 14 << 14 | min(n, CHUNK)
            out.append(x - (1 << 64) if x >> 63 else x)
            n, part = n - CHUNK, part + 1
        seen[c] = part
    return sorted(out)


def featured(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, cls (a 64-bit hash of the clauses as they are, sorted) and cl ARRAY<BIGINT> (:func:`tokens`) of each row long enough."""

    def run(batches):
        memo: dict[str, int] = {}
        for b in batches:
            keys, kept, cls, cl = b.column(0), [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is None or len(t) < LEAST_CHARS:
                    continue
                cs = sorted(clauses(t))
                if not cs:
                    continue
                kept.append(i)
                cls.append(int.from_bytes(hashlib.blake2b("\n".join(cs).encode(), digest_size=8).digest(), "little", signed=True))
                cl.append(tokens(cs, memo))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), pa.array(cls, pa.int64()), pa.array(cl, pa.list_(pa.int64()))], ["key", "cls", "cl"])

    return df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").mapInArrow(run, "key string, cls bigint, cl array<bigint>")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = (a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        k = ((k ^ (k >> np.uint64(29))) ^ b.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        return (k ^ (k >> np.uint64(32))).astype(np.int64)


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, characters and histogram bin of each clause of a batch."""
    size = np.asarray(b.column("cl").value_lengths())
    tok = b.column("cl").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), tok, tok & 0x3FFF, _mix(tok, tok) & (BINS - 1)


class _Ordered:
    """The clauses of a batch's classes, rare ones first, with the weight from each on."""

    def __init__(self, b: pa.RecordBatch, hist: np.ndarray, shared: float):
        row, tok, w, bins = _tokens(b)
        order = np.lexsort((tok, hist[bins], row))
        self.row, self.tok, self.w = row[order], tok[order], w[order]
        n = np.bincount(row, minlength=b.num_rows)
        self.total = np.bincount(row, w, minlength=b.num_rows).astype(np.int64)
        self.end = np.cumsum(n)[self.row]
        before = np.concatenate([[0], np.cumsum(self.w)])
        self.on = self.total[self.row] - (before[:-1] - before[self.end - n[self.row]])
        self.need = shared * self.total[self.row] - 1e-6

    def keys(self):
        """Arrays of key, first and second position and the most weight that can be shared; those of one clause have it twice."""
        p = np.flatnonzero(self.w >= self.need)
        yield _mix(self.tok[p], self.tok[p]), p, p, self.on[p]
        p, gap = np.flatnonzero(self.on >= self.need), 1
        while len(p):
            p = p[p + gap < self.end[p]]
            p = p[self.w[p] + self.on[p + gap] >= self.need[p]]
            yield _mix(self.tok[p], self.tok[p + gap]), p, p + gap, self.w[p] + self.on[p + gap]
            gap += 1

    def third(self, key: np.ndarray, p: np.ndarray, q: np.ndarray):
        """Arrays of index into ``key``, key with the third shared clause and the most weight that can be shared; the key itself again where its clauses suffice."""
        i = np.arange(len(key))
        both = np.where(p == q, 0, self.w[p]) + self.w[q]
        c = i[both >= self.need[p]]
        yield c, _mix(key[c], key[c]), (both - self.w[q] + self.on[q])[c]
        i, gap = i[p != q], 1
        while len(i):
            i = i[q[i] + gap < self.end[q[i]]]
            i = i[both[i] + self.on[q[i] + gap] >= self.need[q[i]]]
            yield i, _mix(key[i], self.tok[q[i] + gap]), both[i] + self.on[q[i] + gap]
            gap += 1


def _histogram(feat: DataFrame) -> np.ndarray:
    """How often the clauses of each bin occur: no more than an order of clauses, rare ones first."""

    def run(batches):
        n = np.zeros(BINS, np.int64)
        for b in batches:
            n += np.bincount(_tokens(b)[3], minlength=BINS)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(n[at[i : i + (1 << 16)]])], ["bin", "n"])

    t = feat.select("cl").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most ``BINS`` rows
    out = np.zeros(BINS, np.int64)
    out[t.column("bin").to_numpy()] = t.column("n").to_numpy()
    return out


def class_pairs(feat: DataFrame, shared: float = SHARED) -> DataFrame:
    """cls_a < cls_b of classes that share at least ``shared`` of their wording.  ``feat``: cls, cl, one row a class."""
    hist = feat.sparkSession.sparkContext.broadcast(_histogram(feat))

    def index(batches):
        for b in batches:
            if b.num_rows:
                o, ids = _Ordered(b, hist.value, shared), b.column("cls").to_numpy()
                for key, p, _, most in o.keys():
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[o.row[p]]), pa.array(o.total[o.row[p]], pa.int32()), pa.array(most, pa.int32())], ["k", "id", "total", "most"])

    def reindex(batches):
        for b in batches:
            if b.num_rows:
                o, ids, want = _Ordered(b, hist.value, shared), b.column("cls").to_numpy(), b.column("k").to_numpy()
                for key, p, q, _ in o.keys():
                    same = key == want[o.row[p]]
                    key, p, q = key[same], p[same], q[same]
                    for i, k, most in o.third(key, p, q):
                        yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(k), pa.array(ids[o.row[p[i]]]), pa.array(o.total[o.row[p[i]]], pa.int32()), pa.array(most, pa.int32())], ["k0", "k", "id", "total", "most"])

    def blocks(df: DataFrame, *keys: str) -> DataFrame:
        """``keys``, blk, g: the members of each key that has several, at most ``BUCKET`` in a row."""
        w = W.partitionBy(*keys)
        x = df.withColumns({"n": F.row_number().over(w.orderBy("id")), "more": F.lead("id").over(w.orderBy("id"))}).filter("n > 1 OR more IS NOT NULL")
        x = x.withColumn("blk", F.floor((F.col("n") - 1) / BUCKET).cast("int"))
        return x.groupBy(*keys, "blk").agg(F.collect_list(F.struct("id", "total", "most")).alias("g"))

    def cross(df: DataFrame) -> DataFrame:
        # a pair whose clauses from the key on cannot suffice has no place here
        p = df.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
        may = F.least("x.most", "y.most") >= shared * F.greatest("x.total", "y.total") - 1e-6
        return p.filter((F.col("x.id") < F.col("y.id")) & may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    def block_pairs(g: DataFrame, *keys: str) -> DataFrame:
        """Every block against itself and the later ones of its key, each pair of blocks a row of its own."""
        both = g.select(*keys, F.col("blk").alias("i"), F.col("g").alias("x")).join(g.select(*keys, F.col("blk").alias("j"), F.col("g").alias("y")), list(keys)).filter("i <= j")
        return cross(both.select("x", "y").repartition(F.xxhash64("x", "y")))

    buckets = cut(blocks(feat.mapInArrow(index, "k bigint, id bigint, total int, most int"), "k"))
    full = buckets.filter("blk > 0").select("k").distinct()
    if full.limit(1).count():
        single = buckets.join(full, "k", "left_anti")
        crowd = cut(buckets.join(full, "k"))
        each = crowd.select("k", F.explode("g.id").alias("cls")).distinct()
        again = each.join(feat, "cls").mapInArrow(reindex, "k0 bigint, k bigint, id bigint, total int, most int")
        again = cut(blocks(again, "k0", "k"))
        met = lambda c: c.cast("double") * (c - 1)
        cost = again.groupBy("k0", "k").agg(F.sum(F.size("g")).alias("n")).groupBy(F.col("k0").alias("k")).agg(F.sum(met(F.col("n"))).alias("met"))
        whole = crowd.groupBy("k").agg(F.sum(F.size("g")).alias("n")).join(cost, "k", "left").filter(F.col("met") >= met(F.col("n"))).select("k")
        once = cross(single.select(F.col("g").alias("x"), F.col("g").alias("y")))
        pairs = once.unionByName(block_pairs(crowd.join(whole, "k", "left_semi"), "k")).unionByName(block_pairs(again.join(whole.withColumnRenamed("k", "k0"), "k0", "left_anti"), "k0", "k"))
    else:
        pairs = cross(buckets.select(F.col("g").alias("x"), F.col("g").alias("y")))
    pairs = _sketched(pairs.distinct(), feat, shared)
    side = lambda s: feat.select(F.col("cls").alias(s), F.col("cl").alias(f"cl_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_share("cl_a", "cl_b") >= shared).select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"))


def _sketched(pairs: DataFrame, feat: DataFrame, shared: float) -> DataFrame:
    """``pairs`` without those whose sketches rule them out, before any clauses are sent.

    A sketch has, for clauses of each level of length, 64 bits that tell which clauses a text may hold, and the shortest clause of the level: a bit
    that the other text lacks is a clause apart of at least that length.  No pair that shares enough is dropped.
    """
    n = len(LEVELS) + 1

    def run(batches):
        for b in batches:
            row, tok, w, _ = _tokens(b)
            m = b.num_rows
            bit = np.uint64(1) << ((_mix(tok, tok) >> 40) & 63).astype(np.uint64)
            level = np.searchsorted(np.array(LEVELS), w, side="right")
            bits, least = np.zeros(m * n, np.uint64), np.full(m * n, CHUNK + 1, np.int64)
            np.bitwise_or.at(bits, row * n + level, bit)
            np.minimum.at(least, row * n + level, w)
            bits, least = bits.view(np.int64).reshape(m, n), least.reshape(m, n)
            room = ((1 - shared) * np.bincount(row, w, minlength=m) + 1e-6).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(room, pa.int32()), *[pa.array(bits[:, i]) for i in range(n)], *[pa.array(least[:, i], pa.int16()) for i in range(n)]], ["cls", "room", *[f"s{i}" for i in range(n)], *[f"m{i}" for i in range(n)]])

    cols = ["room", *[f"s{i}" for i in range(n)], *[f"m{i}" for i in range(n)]]
    sketch = cut(feat.mapInArrow(run, "cls bigint, room int, " + ", ".join(f"s{i} bigint" for i in range(n)) + ", " + ", ".join(f"m{i} smallint" for i in range(n))))
    side = lambda s: sketch.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    apart = lambda x, y: sum((F.bit_count(F.expr(f"s{i}_{x} & ~s{i}_{y}")) * F.col(f"m{i}_{x}").cast("int") for i in range(n)), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter((apart("a", "b") <= F.col("room_a")) & (apart("b", "a") <= F.col("room_b"))).select("a", "b")


def _share(a: str, b: str):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda x, y: x + y.bitwiseAND(F.lit(0x3FFF)))
    return total(F.array_intersect(a, b)) / F.greatest(total(F.col(a)), total(F.col(b)))


def near_copies(df: DataFrame, key: str = "recruitment_record_id", text: str = "job_description_raw") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): key and cls of each record; cls_a, cls_b of classes with nearly the same wording."""
    feat = cut(featured(df, key, text))
    members = cut(feat.select("key", "cls").distinct())
    one = cut(feat.groupBy("cls").agg(F.min("cl").alias("cl")))
    drop_cut(feat)
    return members, class_pairs(one)


def groups(df: DataFrame, key: str = "recruitment_record_id", text: str = "job_description_raw") -> DataFrame:
    """record_id, class_id, n_links, group_id of each record long enough, distinct.

    A class has equal clauses; n_links counts the other classes with nearly the same wording, and a group is what links connect
    (its smallest class), so near copies of near copies are together.
    """
    members, pairs = near_copies(df, key, text)
    pairs = cut(pairs)
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    linked = components(pairs.select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y")), ends.select(F.col("cls").alias("id")))
    x = ends.join(linked.withColumnRenamed("id", "cls"), "cls")
    return members.join(x, "cls", "left").select(F.col("key").alias("record_id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "cls").alias("group_id"))


def found(df: DataFrame) -> DataFrame:
    """record_id_a < record_id_b: every pair of records whose descriptions share at least two thirds of their wording."""
    members, pairs = near_copies(df)
    a = members.select(F.col("cls").alias("cls_a"), F.col("key").alias("x"))
    b = members.select(F.col("cls").alias("cls_b"), F.col("key").alias("y"))
    across = pairs.join(a, "cls_a").join(b, "cls_b").select("x", "y")
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).filter("x < y").select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b")).distinct()
