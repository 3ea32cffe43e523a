"""Problem 8: the whole corpus as ids of a public byte-level BPE.

All texts are cut into words twice: once to count words (partial counts per batch, summed by a shuffle), once to encode.
The most frequent words go into a transducer (:mod:`grainmill.llm.lexicon`); words outside it are merged exactly, once a batch for equal ones.
The lexicon's size changes the speed alone, never the ids.

Defined results: NULL and empty texts have no ids (an empty list); white space and odd characters are encoded like any text; strings
of special tokens are ordinary text; equal rows give one row, different texts under one key a row each; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.lexicon import MAX_WORD, Lexicon, Merger, compile_lexicon
from grainmill.llm.pretokens import class_table, distinct_spans, span_hashes, text_slices, word_starts
from grainmill.sources.shared import cut, put_bytes

LEXICON_WORDS = 1 << 16  #: Most words in a lexicon: bounds the model's file (some 20 MB) and what the driver holds.


def default_ranks() -> str:
    """Where the box keeps the public vocabulary's ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), o


def batch_words(texts: pa.Array, classes: np.ndarray):
    """For slices of a batch: (row from, row to, bytes, word starts, word ends, words of each row)."""
    data, off = _buffers(texts)
    for i, j in text_slices(np.diff(off)):
        part = data[off[i] : off[j]]
        o = off[i : j + 1] - off[i]
        full = np.unique(o[:-1][np.diff(o) > 0])
        at = word_starts(part, full, classes)
        end = np.append(at[1:], len(part)) if len(at) else at
        yield i, j, part, at, end, np.diff(np.searchsorted(at, o))


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(class_table())
    return _CLASSES[0]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word BINARY, n BIGINT: how often each word of at most ``MAX_WORD`` bytes occurs in all texts."""

    def count(batches):
        classes = _classes()
        for b in batches:
            for _, _, data, at, end, _ in batch_words(b.column(0), classes):
                short = (end - at) <= MAX_WORD
                at, end = at[short], end[short]
                _, first, n = np.unique(span_hashes(data, at, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in zip(at[first].tolist(), end[first].tolist())], pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    part = docs.select(F.col(text).alias("t")).filter("t <> ''").mapInArrow(count, "word binary, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str = "text", ranks: str | None = None, words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of the corpus; returns the name of the model's file on every executor."""
    counts = cut(count_words(docs, text).filter("n > 1").select("word", F.floor(F.log2("n") * 32).cast("int").alias("bin")))
    room, least = words, None
    for r in counts.groupBy("bin").count().orderBy(F.desc("bin")).collect():  # at most 2,048 bins of counts
        if r["count"] > room:
            break
        room, least = room - r["count"], r["bin"]
    top = [] if least is None else counts.filter(F.col("bin") >= least).select("word").toArrow().column(0).to_pylist()  # at most ``words``
    merge = Merger.of(ranks or default_ranks())
    return put_bytes(docs.sparkSession, compile_lexicon(top, [merge.ids(w) for w in top], _classes()), ".lex")


@lru_cache(maxsize=4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Encodes batches of texts by a lexicon and, beyond it, by exact merging."""

    def __init__(self, name: str, ranks: str):
        self.lex, self.merge = _lexicon(name), Merger.of(ranks)

    def words(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, first id, number of ids) of each word; equal words are looked up and merged once."""
        one, inv = distinct_spans(data, at, end)
        a, e = at[one], end[one]
        index = self.lex.find(data, a, e)
        ids, off = self.lex.a["ids"], self.lex.a["at"]
        seen = index >= 0
        lo, n = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        lo[seen], n[seen] = off[index[seen]], off[index[seen] + 1] - off[index[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            raw, merge = data.tobytes(), self.merge.ids
            new = [merge(raw[i:j]) for i, j in zip(a[rest].tolist(), e[rest].tolist())]
            n[rest] = [len(x) for x in new]
            lo[rest] = len(ids) + np.cumsum(n[rest]) - n[rest]
            ids = np.concatenate([ids, np.array([t for x in new for t in x], np.int32)])
        return ids, lo[inv], n[inv]


class WordSizes:
    """Tokens of each word by exact merging alone, equal words once; ``kept`` words are remembered over batches."""

    def __init__(self, ranks: str, kept: int = 300_000):
        self.merge, self.kept, self.memo = Merger.of(ranks), kept, {}

    def of(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, inv = distinct_spans(data, at, end)
        raw, memo, merge = data.tobytes(), self.memo, self.merge.ids
        if len(memo) > self.kept:
            memo.clear()
        out = np.empty(len(one), np.int64)
        for k, (i, j) in enumerate(zip(at[one].tolist(), end[one].tolist())):
            w = raw[i:j]
            n = memo.get(w)
            if n is None:
                n = len(merge(w))
                if len(w) <= MAX_WORD:
                    memo[w] = n
            out[k] = n
        return out[inv]


def spread(flat: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[lo[i] : lo[i] + n[i]]``."""
    total = int(n.sum())
    before = np.cumsum(n) - n
    return flat[np.repeat(lo - before, n) + np.arange(total)]


def unique_rows(df: DataFrame) -> DataFrame:
    """``df`` (key, text) with equal rows once.  Only rows whose hashes meet are compared whole; all others pass without a shuffle of texts."""
    key, text = df.columns
    again = cut(df.groupBy(F.xxhash64(key, text).alias("_h")).count().filter("count > 1").select("_h"))
    if not again.limit(1).count():
        return df
    both = df.withColumn("_h", F.xxhash64(key, text))
    once = both.join(again, "_h", "left_anti").drop("_h")
    return once.unionByName(both.join(again, "_h", "left_semi").drop("_h").distinct())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, lexicon: str | None = None) -> DataFrame:
    """``key`` and ids ARRAY<INT> of each row of ``docs``."""
    ranks = ranks or default_ranks()
    name = lexicon or build_lexicon(docs, text, ranks)

    def run(batches):
        enc = Encoder(name, ranks)
        for b in batches:
            for i, j, data, at, end, per_row in batch_words(b.column(1), enc.lex.classes):
                flat, lo, n = enc.words(data, at, end)
                ids = spread(flat, lo, n)
                tokens = np.concatenate([[0], np.cumsum(n)])
                rows = np.concatenate([[0], np.cumsum(per_row)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(tokens[rows], pa.int32()), pa.array(ids, pa.int32()))], [key, "ids"])

    src = unique_rows(docs.select(F.col(key), F.col(text).alias("_t")))
    return src.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """``key``, copy (a hash of the text) and tokens BIGINT of each distinct row; NULL and empty texts have 0."""
    ranks = ranks or default_ranks()

    def run(batches):
        sizes, classes = WordSizes(ranks), _classes()
        for b in batches:
            for i, j, data, at, end, per_row in batch_words(b.column(1), classes):
                tokens = np.concatenate([[0], np.cumsum(sizes.of(data, at, end))])
                rows = np.concatenate([[0], np.cumsum(per_row)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(tokens[rows]), pa.int64())], [key, "copy", "tokens"])

    src = unique_rows(docs.select(F.col(key), F.col(text).alias("_t"))).withColumn("copy", F.xxhash64("_t"))
    return src.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, copy bigint, tokens bigint")
