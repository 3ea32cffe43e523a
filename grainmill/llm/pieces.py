"""Problem 10: oversized texts cut at natural boundaries, with overlap.

A text is handled in ranges of ``RANGE`` bytes.  A worker sees a range with ``HALO`` bytes on either side, finds the
words that start in it, their sizes in tokens and how natural a cut before each would be, and keeps a boundary at least every
``GRAIN`` tokens.  The ranges' tokens and characters are summed to prefixes in their order; the boundary tables are stitched
in segments of about ``SEGMENT`` tokens, whose ends are cuts that both neighbours compute alike, so no task holds a whole text's table.
Pieces are emitted by byte offset: from the ranges of a table's texts, or read from files (:func:`split_files`), of which
no worker ever reads more than a range or a piece.  A text of one range takes the same steps in one worker.

A cut falls where the byte-pair pattern starts a word anyway, so a piece's size is exactly the difference of two prefixes.  Only inside
a word of more bytes than :func:`steps` allows (no place to cut) is a cut forced; pieces with part of such a word are counted again, their
overlap made good and, if need be, cut anew at single characters.

Defined results: NULL and empty texts give no piece; a text within the limit is one piece; consecutive pieces overlap by the
fewest tokens of at least ``overlap`` that boundaries allow; equal rows give their pieces once, different texts under one key (NULL too) each
their own; bytes of files that are no UTF-8 are read as question marks; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.llm.encode import WordSizes, _classes, default_ranks, unique_rows
from grainmill.llm.pretokens import SPACE, text_slices, word_starts
from grainmill.sources.shared import cut

LIMIT, OVERLAP = 1024, 64
RANGE, HALO = 49_152, 2_048
FILE_RANGE = 16_384  #: Of files: a reader's batch of 4,096 ranges' boundary tables stays at some 100 MB.
CHUNK = 96  #: Most bytes between forced cuts inside a word.
GRAIN = 16
SEGMENT = 1 << 18  #: Tokens of a segment, about; more than twice a range can hold a range over.

# What ends a sentence and a clause.
SENTENCE = "。！？!?；;…"
CLAUSE = "，,、：:)）】]|·—"
_LEVEL = np.zeros(0x110000, np.uint8)
_LEVEL[[ord(c) for c in SENTENCE]] = 2
_LEVEL[[ord(c) for c in CLAUSE]] = 1


def steps(limit: int, overlap: int) -> tuple[int, int]:
    """(grain, chunk): so fine that two steps between boundaries fit between the overlap and the limit, whatever the text."""
    room = limit - overlap
    grain = min(GRAIN, room // 8)
    chunk = min(CHUNK, (room // 2 - grain) // 2 - 4)
    if not 0 <= overlap < limit // 2 or chunk < 1:
        raise ValueError("the overlap must be less than half the limit and at least 32 tokens less than it")
    return grain, chunk


def boundaries(cp: np.ndarray, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, forced: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, level, tokens before, forced) of the places of a range where a cut keeps sizes exact.

    ``cp``: the code points; ``starts``: positions of words, with ``sizes`` their tokens.  Levels: 3 paragraph, 2 line or sentence, 1 clause or blank, 0 word, -1 inside a word.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    space = classes[cp] == SPACE
    prev = np.maximum(starts - 1, 0)
    prev_space = space[prev]
    # a run of white space that the pattern cuts in two is one word at a piece's end: no cut after it
    run_before = np.zeros(len(starts), bool)
    run_before[1:] = space[np.maximum(starts[:-1] - 1, 0)] & space[starts[:-1]] & (starts[:-1] > 0)
    ok = ~prev_space | (~run_before & prev_space & ~space[starts]) | forced
    if first and len(ok):
        ok[0] = True
    level = _LEVEL[cp[prev]].copy().astype(np.int64)
    newline = cp == 10
    lines = np.concatenate([[0], np.cumsum(newline)])
    # the white space at a cut, before or after it
    nxt = np.concatenate([starts[1:], [len(cp)]])
    own = lines[np.where(space[starts], nxt, starts)] - lines[starts]
    prior = np.zeros(len(starts), np.int64)
    prior[1:] = np.where(space[starts[:-1]], lines[starts[1:]] - lines[starts[:-1]], 0)
    n = own + prior
    level = np.where(n >= 2, 3, np.where(n == 1, np.maximum(level, 2), np.where(space[starts] | prev_space, np.maximum(np.where((cp[prev] == 46) & space[starts], 2, level), 1), level)))
    level = np.where(forced, -1, level)
    return starts[ok], level[ok].astype(np.int8), before[ok], forced[ok]


def thin(forced: np.ndarray, level: np.ndarray, before: np.ndarray, grain: int = GRAIN) -> np.ndarray:
    """Indices of the boundaries kept: those of level 1 or more, forced ones, and enough others that ``grain`` tokens hold one where possible."""
    keep = (level >= 1) | forced
    slot = before // grain
    keep[1:] |= slot[1:] != slot[:-1]
    if len(keep):
        keep[0] = True
    return np.flatnonzero(keep)


def chop(starts: np.ndarray, at: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts with forced ones added, which are forced): inside words of more than ``chunk`` bytes, at absolute multiples of it.

    ``starts``: characters at which words start; ``at``: the absolute byte of each character, and of the end.
    """
    ends = np.append(starts[1:], len(at) - 1)
    long = np.flatnonzero(at[ends] - at[starts] > chunk)
    if not len(long):
        return starts, np.zeros(len(starts), bool)
    extra = []
    for k in long.tolist():
        a, b = int(at[starts[k]]), int(at[ends[k]])
        f = np.unique(np.searchsorted(at, np.arange((a // chunk + 1) * chunk, b, chunk)))
        extra.append(f[(f > starts[k]) & (f < ends[k])])
    extra = np.concatenate(extra)
    out = np.concatenate([starts, extra])
    forced = np.concatenate([np.zeros(len(starts), bool), np.ones(len(extra), bool)])
    o = np.argsort(out, kind="stable")
    return out[o], forced[o]


def choose(level: np.ndarray, cum: np.ndarray, limit: int, overlap: int, i: int = 0) -> list[tuple[int, int]]:
    """(from, to) indices of boundaries of consecutive pieces from boundary ``i`` on; ``cum``: tokens before each boundary, and before the end."""
    m = len(cum) - 1
    out = []
    while True:
        j = int(np.searchsorted(cum, cum[i] + limit, side="right")) - 1
        if j >= m:
            out.append((i, m))
            return out
        j = max(j, i + 1)
        lo = int(np.searchsorted(cum, cum[i] + max(limit // 2, overlap + 1), side="left"))
        lo = min(max(lo, i + 1), j)
        w = level[lo : j + 1]
        best = lo + len(w) - 1 - int(np.argmax(w[::-1]))
        k = int(np.searchsorted(cum, cum[best] - overlap, side="right")) - 1
        if k <= i < best:  # a natural cut that leaves no room for the overlap: the last one that does, or the last at all
            best = j
            k = int(np.searchsorted(cum, cum[best] - overlap, side="right")) - 1
        out.append((i, best))
        i = k if k > i else best


def range_table(texts: list[bytes], sizes: WordSizes, classes: np.ndarray, seen: list[int], at: list[int], width: list[int], last: list[bool], grain: int, chunk: int, enough: int = -1):
    """For each range (whole characters with the halos): pos (absolute bytes), chars and tokens before within the range, level, forced, tokens and characters of the range.

    ``seen``: the absolute byte at which what is seen starts.  A whole text of at most ``enough`` tokens gets no table, only its size.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    for i, j in text_slices(lens):
        part = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        o = np.concatenate([[0], np.cumsum(lens[i:j])])
        starts = word_starts(part, np.unique(o[:-1][np.diff(o) > 0]), classes)
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        row = np.searchsorted(lead, o)  # characters before each row
        words = np.searchsorted(starts, o)
        at_char = np.searchsorted(lead, starts)
        cps = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        a_b = np.append(lead, len(part))
        metas, spans_a, spans_e = [], [], []
        for r in range(j - i):
            k = i + r
            st = at_char[words[r] : words[r + 1]] - row[r]
            place = np.append(lead[row[r] : row[r + 1]], o[r + 1]) - o[r] + seen[k]  # absolute byte of each character
            edge = np.append(st, len(place) - 1)
            forced = None
            if (np.diff(place[edge]) > chunk).any():
                st, forced = chop(st, place, chunk)
                edge = np.append(st, len(place) - 1)
            lo = int(np.searchsorted(place[st], at[k]))
            hi = len(st) if last[k] else int(np.searchsorted(place[st], at[k] + width[k]))
            spans_a.append(row[r] + edge[lo:hi])
            spans_e.append(row[r] + edge[lo + 1 : hi + 1])
            metas.append((st, forced, lo, hi, place))
        at_all, end_all = np.concatenate(spans_a), np.concatenate(spans_e)
        got = sizes.of(part, a_b[at_all].astype(np.int64), a_b[end_all].astype(np.int64))
        p = 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))
        for r, (st, forced, lo, hi, place) in enumerate(metas):
            k = i + r
            mine = got[p : p + hi - lo]
            p += hi - lo
            if forced is not None:
                mine = mine + forced[lo:hi]  # a forced cut may cost a token
            total = int(mine.sum())
            c0 = int(np.searchsorted(place[:-1], at[k]))
            chars = (len(place) - 1 if last[k] else int(np.searchsorted(place[:-1], at[k] + width[k]))) - c0
            whole = at[k] == 0 and last[k]
            if hi == lo or (whole and total <= enough):
                yield k, *none, np.ones(1, bool) if forced is not None and forced.any() else np.zeros(0, bool), total, chars
                continue
            sz = np.zeros(len(st), np.int64)
            sz[lo:hi] = mine
            pos, level, before, f = boundaries(cps[row[r] : row[r + 1]], classes, st, sz, np.zeros(len(st), bool) if forced is None else forced, seen[k] == 0)
            own = (place[pos] >= at[k]) & (last[k] | (place[pos] < at[k] + width[k]))
            pos, level, before, f = pos[own], level[own], before[own], f[own]
            keep = thin(f, level, before, grain)
            yield k, place[pos[keep]], pos[keep] - c0, before[keep], level[keep], f[keep], total, chars


def _spans(pos, chars, before, level, forced, limit, overlap, start=0):
    """(x, x_char, a, p, b, tokens, forced) of each piece: bytes from ``x`` on are needed, the piece starts ``a`` characters later, the piece before ends ``p`` characters later (-1: none).

    The last entries of the arrays are those of the end.
    """
    fc = np.concatenate([[0], np.cumsum(forced)])
    out, prev = [], -1 if start == 0 else len(pos) + 1  # of a segment's first piece the caller tells what lies before
    for a, b in choose(level, before, limit, overlap, start):
        f = bool(fc[min(b + 1, len(forced))] - fc[a] > 0) or (0 <= prev < len(pos) and before[prev] - before[a] < overlap)
        x = a
        if f and prev >= 0:
            x = max(0, int(np.searchsorted(before, before[a] - limit, side="right")) - 1)
        p = int(chars[prev] - chars[x]) if 0 <= prev < len(pos) else -1
        out.append((int(pos[x]), int(chars[x]), int(chars[a] - chars[x]), p, int(pos[b]), int(before[b] - before[a]), f))
        prev = b
    return out


def _count(text: str, sizes: WordSizes, classes: np.ndarray) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return 0
    at = word_starts(raw, np.zeros(1, np.int64), classes)
    return int(sizes.of(raw, at, np.append(at[1:], len(raw))).sum())


def _settle(text: str, a: int, p: int, tokens: int, forced: bool, sizes: WordSizes, classes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(from, to, tokens) within ``text``, which the piece from ``a`` on ends: with part of an unbroken word, counted exactly, its overlap with what ends at ``p`` made good, and cut anew if too long."""
    if not forced:
        return [(a, len(text), tokens)]
    count = lambda i, j: _count(text[i:j], sizes, classes)

    def back(i: int, end: int) -> int:
        """The last start at or before ``i`` from which ``end`` is ``overlap`` tokens away, or 0."""
        if count(i, end) >= overlap:
            return i
        good, bad = 0, i
        while bad - good > 1:
            mid = (good + bad) // 2
            good, bad = (mid, bad) if count(mid, end) >= overlap else (good, mid)
        return good

    if p >= 0 and overlap:
        a = back(a, p)
    out, end = [], len(text)
    while True:
        n = count(a, end)
        if n <= limit:
            return [*out, (a, end, n)]
        good, bad = max(a + 1, min(p, end) if not out else out[-1][1]), end
        while bad - good > 1:
            mid = (good + bad) // 2
            good, bad = (mid, bad) if count(a, mid) <= limit else (good, mid)
        good = max(good, out[-1][1] + 1 if out else a + 1)
        out.append((a, good, count(a, good)))
        a = max(a + 1, back(good, good)) if overlap else good


def _whole(src: DataFrame, kind: str, ranks: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of texts of one range.  ``src``: k, t."""
    grain, chunk = steps(limit, overlap)

    def run(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            raw = b.column(1).cast(pa.binary()).to_pylist()
            n = len(raw)
            idx, num, tot, a, e, tk, tx = [], [], [], [], [], [], []
            for k, pos, chars, before, level, forced, total, length in range_table(raw, sizes, classes, [0] * n, [0] * n, [0] * n, [True] * n, grain, chunk, limit):
                t = raw[k].decode()
                if total <= limit:
                    ss = _settle(t, 0, -1, total, bool(forced.any()), sizes, classes, limit, overlap)
                else:
                    ss = []
                    for x, xc, a1, p1, b1, n1, f1 in _spans(np.append(pos, len(raw[k])), np.append(chars, length), np.append(before, total), level, forced, limit, overlap):
                        part = raw[k][x:b1].decode()
                        ss += [(xc + i, xc + j, m) for i, j, m in _settle(part, a1, p1, n1, f1, sizes, classes, limit, overlap)]
                for q, (x, y, z) in enumerate(ss):
                    idx.append(k), num.append(q), tot.append(len(ss)), a.append(x), e.append(y), tk.append(z), tx.append(t[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(idx, pa.int64())), pa.array(num, pa.int32()), pa.array(tot, pa.int32()), pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array(tk, pa.int64()), pa.array(tx, pa.string())], ["k", "piece", "n_pieces", "from_char", "to_char", "tokens", "piece_text"])

    return src.mapInArrow(run, f"k {kind}, piece int, n_pieces int, from_char bigint, to_char bigint, tokens bigint, piece_text string")


def _aligned(raw: bytes, seen: int) -> tuple[bytes, int]:
    """Whole characters of ``raw``, which starts at byte ``seen``, and where they start."""
    a = 0
    while seen and a < min(4, len(raw)) and raw[a] & 0xC0 == 0x80:
        a += 1
    e, k = len(raw), len(raw)
    while k > max(a, len(raw) - 4):
        k -= 1
        if raw[k] & 0xC0 != 0x80:
            lead = raw[k]
            if lead >= 0xC0 and k + (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > len(raw):
                e = k
            break
    return raw[a:e], seen + a


_TABLE = "pos array<bigint>, chars array<bigint>, bef array<bigint>, lev array<int>, fo array<boolean>, tot bigint, len bigint"


def _table_batch(keep: list[pa.Array], names: list[str], texts: list[bytes], seen, at, n, width, sizes, classes, limit, overlap) -> pa.RecordBatch:
    both = [_aligned(t, s) for t, s in zip(texts, seen)]
    cols = [[] for _ in range(8)]
    for row in range_table([t for t, _ in both], sizes, classes, [s for _, s in both], at, [width] * len(at), [x + width >= m for x, m in zip(at, n)], *steps(limit, overlap)):
        for c, v in zip(cols, row):
            c.append(v)
    take = pa.array(cols[0], pa.int64())
    kinds = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.int64()]
    cols[4] = [x.astype(np.int32) for x in cols[4]]
    return pa.RecordBatch.from_arrays([*[c.take(take) for c in keep], *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], [*names, "pos", "chars", "bef", "lev", "fo", "tot", "len"])


def _stitched(table: DataFrame, ids: list[str], limit: int, overlap: int, segment: int = SEGMENT) -> DataFrame:
    """``ids``, x, xc, a, p, b, tok, f of each piece.  ``table``: ids, n, r and the columns of a range's table."""
    w = W.partitionBy(*ids)
    before = w.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    meta = table.select(*ids, "r", "tot", "len").withColumns({"t0": F.coalesce(F.sum("tot").over(before), F.lit(0)), "c0": F.coalesce(F.sum("len").over(before), F.lit(0))})
    meta = meta.withColumn("seg", F.dense_rank().over(w.orderBy(F.floor(F.col("t0") / segment))) - 1).withColumn("end", F.max(F.col("t0") + F.col("tot")).over(W.partitionBy(*ids, "seg")))
    # the next segment sees the tail of the one before it: its last cut, and what overlaps it
    tail = F.col("t0") + F.col("tot") >= F.col("end") - 3 * limit
    meta = meta.withColumn("top", F.max("seg").over(w)).select(*ids, "r", "t0", "c0", "top", F.explode(F.when(tail & (F.col("seg") < F.col("top")), F.array(F.struct(F.col("seg").alias("seg"), F.lit(True).alias("own")), F.struct((F.col("seg") + 1).alias("seg"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("seg").alias("seg"), F.lit(True).alias("own"))))).alias("s"))
    rows = table.join(meta.select(*ids, "r", "t0", "c0", "top", "s.seg", "s.own"), [*ids, "r"])
    kinds = dict(table.dtypes)

    def stitch(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        lens = pdf["pos"].map(len).to_numpy()
        flat = lambda c, t: np.concatenate([np.asarray(x, t) for x in pdf[c]]) if len(pdf) else np.zeros(0, t)
        pos, lev, fo = flat("pos", np.int64), flat("lev", np.int64), flat("fo", bool)
        cum, ch = flat("bef", np.int64) + np.repeat(pdf["t0"].to_numpy(), lens), flat("chars", np.int64) + np.repeat(pdf["c0"].to_numpy(), lens)
        own, tail_row = np.repeat(pdf["own"].to_numpy(bool), lens), pdf.iloc[-1]
        final = int(tail_row["top"]) == int(key[-1])

        def border(mask: np.ndarray) -> int:
            """The best cut in the last half limit of the boundaries of ``mask``."""
            i = np.flatnonzero(mask)
            i = i[cum[i] >= cum[i[-1]] - limit // 2]
            return int(i[len(i) - 1 - int(np.argmax(lev[i][::-1]))])

        start, ahead = 0, None
        if not own.all():
            ahead = border(~own)
            start = max(0, int(np.searchsorted(cum, cum[ahead] - overlap, side="right")) - 1)
        if final:
            pos, ch, cum = np.append(pos, int(pdf["n"].iloc[0])), np.append(ch, int(tail_row["c0"] + tail_row["len"])), np.append(cum, int(tail_row["t0"] + tail_row["tot"]))
        else:
            e = border(own)
            pos, ch, cum, lev, fo = pos[: e + 1], ch[: e + 1], cum[: e + 1], lev[:e], fo[:e]
        ss = _spans(pos, ch, cum, lev, fo, limit, overlap, start)
        if not final and len(ss) > 1 and ss[-1][1] + ss[-1][2] >= ch[max(0, int(np.searchsorted(cum, cum[-1] - overlap, side="right")) - 1)]:
            ss.pop()  # no more than the overlap: the next segment's first piece holds it
        if ahead is not None:
            x, xc, a, p, b, tok, f = ss[0]
            back = max(0, int(np.searchsorted(cum, cum[start] - limit, side="right")) - 1)
            f = f or bool(fo[start : ahead + 1].any()) or cum[ahead] - cum[start] < overlap
            ss[0] = (int(pos[back]), int(ch[back]), int(ch[start] - ch[back]), int(ch[ahead] - ch[back]), b, tok, f) if f else (int(pos[start]), int(ch[start]), 0, int(ch[ahead] - ch[start]), b, tok, f)
        x, xc, a, p, b, tok, f = (list(v) for v in zip(*ss))
        out = pd.DataFrame({"x": x, "xc": xc, "a": a, "p": p, "b": b, "tok": tok, "f": f})
        for i, c in enumerate(ids):
            out.insert(i, c, [key[i]] * len(ss))
        return out

    return rows.groupBy(*ids, "seg").applyInPandas(stitch, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", x bigint, xc bigint, a bigint, p bigint, b bigint, tok bigint, f boolean")


_EMITTED = "from_char bigint, to_char bigint, tokens bigint, piece_text string"


def _emit(keep: list[pa.Array], names: list[str], raws: list[bytes], xc, a, p, tok, f, sizes, classes, limit, overlap) -> pa.RecordBatch:
    idx, rows = [], []
    for i, raw in enumerate(raws):
        t = raw.decode(errors="replace")
        for x, y, z in _settle(t, a[i], p[i], tok[i], f[i], sizes, classes, limit, overlap):
            idx.append(i), rows.append((xc[i] + x, xc[i] + y, z, t[x:y]))
    cols = list(zip(*rows)) or [[]] * 4
    take = pa.array(idx, pa.int64())
    return pa.RecordBatch.from_arrays([*[c.take(take) for c in keep], *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], [*names, "from_char", "to_char", "tokens", "piece_text"])


def _numbered(df: DataFrame, ids: list[str]) -> DataFrame:
    """Add piece and n_pieces: counted on the offsets alone, the texts stay where they are."""
    df = cut(df)
    w = W.partitionBy(*ids)
    n = df.select(*ids, "from_char").withColumns({"piece": F.row_number().over(w.orderBy("from_char")) - 1, "n_pieces": F.count("*").over(w).cast("int")})
    return df.join(n, [*ids, "from_char"])


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, ranks: str | None = None, width: int = RANGE, segment: int = SEGMENT) -> DataFrame:
    """key, piece, n_pieces, from_char, to_char, tokens, piece_text of each text with tokens."""
    ranks = ranks or default_ranks()
    kind = dict(docs.dtypes)[key]
    steps(limit, overlap)
    src = unique_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t <> ''"))
    small = _whole(src.filter(F.octet_length("t") <= width), kind, ranks, limit, overlap)
    # longer texts, by 128 bits that stand for key and text: ranges with halos, boundary tables, stitching
    big = src.filter(F.octet_length("t") > width).select("k", F.xxhash64("k", "t").alias("h"), F.xxhash64(F.lit(7), "t", "k").alias("g"), F.col("t").cast("binary").alias("t"))
    r = big.select("k", "h", "g", F.length("t").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / width).cast("int"))).alias("r"), "t")
    at = F.col("r") * width
    left = F.least(F.lit(HALO), at)
    ranges = r.select("h", "g", "n", "r", at.cast("bigint").alias("at"), (at - left).cast("bigint").alias("seen"), F.substring("t", at - left + 1, F.lit(width) + left + HALO).alias("t"))

    def tables(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            n, at_, seen = (b.column(i).to_pylist() for i in (2, 4, 5))
            yield _table_batch([b.column(i) for i in range(4)], ["h", "g", "n", "r"], b.column(6).to_pylist(), seen, at_, n, width, sizes, classes, limit, overlap)

    table = cut(ranges.mapInArrow(tables, f"h bigint, g bigint, n bigint, r int, {_TABLE}"))
    spans = _stitched(table, ["h", "g"], limit, overlap, segment)
    # by offset: the parts of a piece from the one or two ranges that hold it
    parts = spans.withColumn("r", F.explode(F.sequence(F.floor(F.col("x") / width).cast("int"), F.floor((F.col("b") - 1) / width).cast("int"))))
    slices = r.select("k", "h", "g", "r", F.substring("t", at + 1, F.lit(width)).alias("t"))
    lo, hi = F.greatest("x", F.col("r") * width), F.least("b", (F.col("r") + 1) * width)
    got = parts.join(slices, ["h", "g", "r"]).select("k", "h", "g", "x", "xc", "a", "p", "b", "tok", "f", "r", F.substring("t", (lo - F.col("r") * width + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    got = got.groupBy("h", "g", "b").agg(F.first("k").alias("k"), *[F.first(c).alias(c) for c in ("xc", "a", "p", "tok", "f")], F.array_sort(F.collect_list(F.struct("r", "t"))).alias("ts"))
    got = got.select("k", "h", "g", "xc", "a", "p", "tok", "f", F.aggregate("ts", F.lit(b""), lambda x, y: F.concat(x, y["t"])).alias("t"))

    def settle(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            xc, a, p, tok, f = (b.column(i).to_pylist() for i in range(3, 8))
            yield _emit([b.column(i) for i in range(3)], ["k", "h", "g"], b.column(8).to_pylist(), xc, a, p, tok, f, sizes, classes, limit, overlap)

    large = _numbered(got.mapInArrow(settle, f"k {kind}, h bigint, g bigint, {_EMITTED}"), ["h", "g"])
    cols = ["k", "piece", "n_pieces", "from_char", "to_char", "tokens", "piece_text"]
    return small.unionByName(large.select(*cols)).withColumnRenamed("k", key)


def _read(path: str, at: int, n: int) -> bytes:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        f.seek(at)
        return f.read(n)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, ranks: str | None = None, width: int = FILE_RANGE, segment: int = SEGMENT) -> DataFrame:
    """path, piece, n_pieces, from_char, to_char, tokens, piece_text of UTF-8 files of any size.  ``paths``: URIs of files that every executor reaches.

    The driver asks for the files' lengths alone; workers read ranges and pieces by their offsets.
    """
    ranks = ranks or default_ranks()
    steps(limit, overlap)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    sized = [(p, hadoop(p).getFileSystem(conf).getFileStatus(hadoop(p)).getLen()) for p in sorted(set(paths))]
    files = spark.createDataFrame(sized, "path string, n bigint").filter("n > 0")
    ranges = files.select("path", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / width).cast("int"))).alias("r")).repartition(F.hash("path", "r"))

    def tables(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            for i in range(0, b.num_rows, 64):  # a few ranges at a time
                c = b.slice(i, 64)
                path, n, r = (c.column(x).to_pylist() for x in range(3))
                at = [x * width for x in r]
                seen = [max(0, x - HALO) for x in at]
                texts = [_clean(_read(p, s, x + width + HALO - s)) for p, s, x in zip(path, seen, at)]
                yield _table_batch([c.column(x) for x in range(3)], ["path", "n", "r"], texts, seen, at, n, width, sizes, classes, limit, overlap)

    table = cut(ranges.mapInArrow(tables, f"path string, n bigint, r int, {_TABLE}"))
    spans = _stitched(table, ["path"], limit, overlap, segment)

    def emit(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                path, x, xc, a, p, e, tok, f = (c.column(k).to_pylist() for k in range(8))
                yield _emit([c.column(0)], ["path"], [_clean(_read(q, s, t - s)) for q, s, t in zip(path, x, e)], xc, a, p, tok, f, sizes, classes, limit, overlap)

    out = _numbered(spans.mapInArrow(emit, f"path string, {_EMITTED}"), ["path"])
    return out.select("path", "piece", "n_pieces", "from_char", "to_char", "tokens", "piece_text")


def _clean(raw: bytes) -> bytes:
    """``raw`` with each byte that is no UTF-8 replaced by ``?``, whatever its neighbours: offsets stay; parts of characters at the ends stay too."""
    body, at = _aligned(raw, 1)
    try:
        body.decode()
        return raw
    except UnicodeDecodeError:
        head, tail = raw[: at - 1], raw[at - 1 + len(body) :]
        out, rest = bytearray(), body
        while rest:
            try:
                rest.decode()
                out += rest
                break
            except UnicodeDecodeError as x:
                out += rest[: x.start] + b"?" * (x.end - x.start)
                rest = rest[x.end :]
        return head + bytes(out) + tail
