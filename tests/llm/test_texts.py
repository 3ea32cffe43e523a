"""Encoding, packing and splitting: exact round trips and bounds."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("grainmill.llm")
from grainmill.llm import encode, pack, pieces  # noqa: E402
from grainmill.llm.lexicon import Lexicon, Merger, compile_lexicon  # noqa: E402
from grainmill.llm.pretokens import class_table, distinct_spans, word_starts  # noqa: E402

random.seed(3)
ODD = ["a's'll 'tis x'  \n\n b 's\n's", "'s", "''s", " 's", "\t's it'd've I'llx'", "  ", "a  ", "a \n", "\n\na", "　　あ", "éáx", "½x²", " 1'd", "<|endoftext|> ok", "😀😀 x", "x" * 3000, "​﻿ a", "中文，标点。\n\n第二段"]
TEXTS = ODD + ["".join(random.choice("a b'slvrtd\n\t1!　é中文。，") for _ in range(random.randint(0, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_words_as_the_pattern_cuts_them():
    import public_tokenizers
    import regex

    pat, table = regex.compile(public_tokenizers.PATTERN), class_table()
    for i, _, data, at, end, per in encode.batch_words(pa.array([*TEXTS, None, ""]), table):
        raw, k = data.tobytes(), 0
        for r, n in enumerate(per):
            t = ([*TEXTS, None, ""][i + r]) or ""
            assert [raw[a:b].decode() for a, b in zip(at[k : k + n], end[k : k + n])] == pat.findall(t)
            k += n


def test_distinct_words_are_exact():
    raw = np.frombuffer(" ".join(random.choice(["ab", "abc", "b", "longer-word", "longer-work"]) for _ in range(500)).encode(), np.uint8)
    at = word_starts(raw, np.zeros(1, np.int64), class_table())
    end = np.append(at[1:], len(raw))
    one, inv = distinct_spans(raw, at, end)
    words = [raw[a:b].tobytes() for a, b in zip(at, end)]
    assert [words[one[i]] for i in inv] == words and len(set(words)) == len(one)


def test_transducer(tmp_path):
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 7))).encode() for _ in range(400)} | {"中文".encode(), b" the"})
    p = tmp_path / "x.lex"
    p.write_bytes(compile_lexicon(words, [[i, i + 1] for i in range(len(words))], class_table()))
    lex = Lexicon(str(p))
    ask = words + [b"abcabcabcabc", b"zz", "中".encode(), b"a" * 100]
    data = np.frombuffer(b"".join(ask), np.uint8)
    end = np.cumsum([len(w) for w in ask])
    got = lex.find(data, end - [len(w) for w in ask], end)
    assert got.tolist() == [words.index(w) if w in set(words) else -1 for w in ask]
    assert len(lex.a["final"]) < sum(len(w) for w in words)  # suffixes are shared
    empty = tmp_path / "e.lex"
    empty.write_bytes(compile_lexicon([], [], class_table()))
    assert Lexicon(str(empty)).find(data, end[:1] - end[:1], end[:1]).tolist() == [-1]


def test_ids_equal_the_public_tokenizer(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None, ""])]
    got = {r["doc_id"]: r["ids"] for r in encode.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert got == {i: plain(t or "") for i, t, _ in rows}
    assert encode.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    n = {r["doc_id"]: r["tokens"] for r in encode.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert n == {k: len(v) for k, v in got.items()}


def test_packing(spark):
    sizes = [(f"i{k}", random.randint(1, 400)) for k in range(900)] + [("full", 1000), ("big", 999)]
    got = pack.pack(spark.createDataFrame(sizes, "item string, size bigint"), 1000, region=200).toPandas()
    assert sorted(got["item"]) == sorted(k for k, _ in sizes) and got.set_index("item")["size"].to_dict() == dict(sizes)
    fill = got.groupby("container")["size"].sum()
    assert fill.max() <= 1000 and (got["fill"] == got["container"].map(fill)).all()
    assert len(fill) <= -(-sum(s for _, s in sizes) // 1000) + 2
    assert pack.pack(spark.createDataFrame([], "item string, size bigint"), 10).count() == 0


def test_evolution_is_no_worse_than_best_fit():
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(120, 510, 240))[::-1].astype(np.int64)
    bins, room = [], []
    pack.best_fit(sizes, list(range(240)), bins, room, 1000)
    best = pack.evolve(sizes, [], 1000, 1, generations=20)
    assert np.bincount(best, weights=sizes).max() <= 1000 and len(np.unique(best)) <= len(bins)


def test_documents_in_parts(spark, plain):
    docs = spark.createDataFrame([(1, "word " * 300), (2, "kurz"), (3, None), (4, ""), (5, "kurz")], "doc_id bigint, text string")
    got = pack.pack_documents(docs, capacity=64).toPandas()
    n = {1: len(plain("word " * 300)), 2: len(plain("kurz")), 5: len(plain("kurz"))}
    assert got.groupby("doc_id")["size"].sum().to_dict() == n and got["size"].max() <= 64
    assert (got[got["doc_id"] == 1]["size"] == 64).sum() == n[1] // 64
    s = pack.summary(pack.pack_documents(docs, capacity=64), 64).head()
    assert s["containers"] == s["least"]


LONG = ["\n\n".join("这是第%d段的内容，说明流程与要求。后面还有一句话。" % i for i in range(40)), "x" * 2500, "字" * 1500, "Sentence one is here. Another one follows it! " * 60, "no cut " + "ab" * 700 + " end", " " * 900, None, "", "short"]


@pytest.mark.parametrize("width", [200, 100_000])
def test_pieces(spark, plain, width):
    docs = spark.createDataFrame(list(enumerate(LONG)), "doc_id bigint, text string")
    got = pieces.split(docs, limit=120, overlap=12, width=width).toPandas().sort_values(["doc_id", "piece"])
    assert set(got["doc_id"]) == {i for i, t in enumerate(LONG) if t}
    for k, g in got.groupby("doc_id"):
        t, a, b = LONG[k], g["from_char"].tolist(), g["to_char"].tolist()
        assert a[0] == 0 and b[-1] == len(t) and all(x < y for x, y in zip(a, b)) and (g["n_pieces"] == len(g)).all()
        assert [t[x:y] for x, y in zip(a, b)] == g["piece_text"].tolist() and g["tokens"].tolist() == [len(plain(p)) for p in g["piece_text"]] and g["tokens"].max() <= 120
        assert all(y1 >= x2 for y1, x2 in zip(b, a[1:]))
    first = got[got["doc_id"] == 0]
    assert all(p.rstrip()[-1] in "。" for p in first["piece_text"][:-1])  # the text pauses there
    over = [len(plain(LONG[0][x:y])) for y, x in zip(first["to_char"][:-1], first["from_char"][1:])]
    assert min(over) >= 12


def test_pieces_empty_and_bad(spark):
    assert pieces.split(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        pieces.split(spark.createDataFrame([], "doc_id bigint, text string"), limit=10, overlap=5)


def test_nothing_else_imports_this_subpackage():
    root = Path(encode.__file__).parents[1]
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "grainmill.llm" not in p.read_text(), p


def test_merger_is_shared():
    assert Merger.of(encode.default_ranks()) is Merger.of(encode.default_ranks())


RARE = [chr(0x20000 + i * 7 % 40000) for i in range(2000)]
HARD = ["".join(RARE), "é" * 3000, "a" * 5000 + " b " + "字" * 900, " " * 4000 + "x", "".join(random.choice("x é字𠀀") for _ in range(3000)), LONG[0] * 5]


@pytest.mark.parametrize("width,segment", [(512, 400), (1 << 20, 1 << 18)])
def test_overlap_is_kept_where_nothing_pauses(spark, plain, width, segment, monkeypatch):
    monkeypatch.setattr(pieces, "HALO", 256)
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string")
    got = pieces.split(docs, limit=200, overlap=90, width=width, segment=segment).toPandas().sort_values(["doc_id", "piece"])
    assert set(got["doc_id"]) == set(range(len(HARD)))
    for k, g in got.groupby("doc_id"):
        t, a, b = HARD[k], g["from_char"].tolist(), g["to_char"].tolist()
        assert a[0] == 0 and b[-1] == len(t) and g["piece"].tolist() == list(range(len(g)))
        assert g["tokens"].tolist() == [len(plain(t[x:y])) for x, y in zip(a, b)] and g["tokens"].max() <= 200
        assert min([len(plain(t[x:y])) for x, y in zip(a[1:], b)] or [99]) >= 90


def test_files_by_byte_ranges(spark, plain, tmp_path):
    text = "".join(random.choice([LONG[0], HARD[1][:50], "Ein Satz. ", "\n\n", "字" * 30]) for _ in range(60))
    for name, t in (("a.txt", text), ("b.txt", ""), ("c.txt", "kurz")):
        (tmp_path / name).write_text(t)
    (tmp_path / "d.txt").write_bytes("ab字".encode()[:-1] + b"\xff" + "字".encode())
    got = pieces.split_files(spark, [f"file://{tmp_path}/{x}.txt" for x in "abcd"], limit=120, overlap=12, width=1000, segment=700).toPandas().sort_values(["path", "piece"])
    by = {p[-5]: g for p, g in got.groupby("path")}
    assert set(by) == {"a", "c", "d"} and by["c"]["piece_text"].tolist() == ["kurz"] and by["d"]["piece_text"].tolist() == ["ab???字"]
    a, b = by["a"]["from_char"].tolist(), by["a"]["to_char"].tolist()
    assert a[0] == 0 and b[-1] == len(text) and by["a"]["piece_text"].tolist() == [text[x:y] for x, y in zip(a, b)]
    assert by["a"]["tokens"].tolist() == [len(plain(text[x:y])) for x, y in zip(a, b)] and by["a"]["tokens"].max() <= 120
    assert min(len(plain(text[x:y])) for x, y in zip(a[1:], b)) >= 12


def test_repeated_rows_and_keys(spark, plain):
    rows = [(1, "eins"), (1, "eins"), (1, "zwei drei"), (None, "vier"), (None, "vier"), (None, "fünf " * 40), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(str, encode.encode(docs).collect())) == sorted(map(str, {(k, t): r for k, t in rows for r in [encode.encode(spark.createDataFrame([(k, t)], docs.schema)).head()]}.values()))
    for width in (8, 1000):
        got = [(r["doc_id"], r["piece_text"]) for r in pieces.split(docs, width=width).collect()]
        assert sorted(got, key=str) == sorted({x for x in rows if x[1]}, key=str)
    got = pack.pack_documents(docs, capacity=32).collect()
    assert sum(r["size"] for r in got) == sum(len(plain(t)) for _, t in set(rows) if t) and {r["n_parts"] for r in got} == {1, -(-len(plain("fünf " * 40)) // 32)}


def test_packing_goes_on_until_one_region_is_left(spark):
    sizes = [(f"i{k}", 10 + k * 37 % 90) for k in range(4000)]
    got = pack.pack(spark.createDataFrame(sizes, "item string, size bigint"), 1000, region=40).toPandas()
    fill = got.groupby("container")["size"].sum()
    assert len(fill) <= -(-sum(s for _, s in sizes) // 1000) + 2
    wide = pack.pack(spark.createDataFrame([(f"w{k}", 600) for k in range(300)], "item string, size bigint"), 1000, region=40).toPandas()
    assert wide["container"].nunique() == 300
