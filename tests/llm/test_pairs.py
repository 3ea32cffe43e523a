"""Operators on pairs against brute force."""

import itertools
import random
from collections import Counter

import pytest

pytest.importorskip("grainmill.llm")
from pyspark.sql import functions as F  # noqa: E402

from grainmill.llm import automaton, names, nearcopies, overlap  # noqa: E402

random.seed(5)
OBJECTS = ["库存台账", "退货工单", "广告投放", "会员投诉", "设备巡检", "质检报告", "客户回访", "排产计划", "合同评审", "接口联调"]
VERBS = ["跟踪", "搭建", "优化", "复核", "牵头", "处理", "推进"]
ENDS = ["减少人工误差", "便于后续追溯", "保证信息同步", "控制综合成本", "缩短交付周期"]


def posting(n=12):
    return [f"{random.choice(VERBS)}{random.choice(OBJECTS)}{random.randint(100, 999)}号任务，{random.choice(ENDS)}" for _ in range(n)]


def variants(items):
    shuffled = random.sample(items, len(items))
    return ["\n".join(f"{i + 1}、{x}。" for i, x in enumerate(shuffled)), "<br>".join(f"({i}) {x}" for i, x in enumerate(items[:-1])), " - ".join(items).replace("，", ",").upper(), "；".join(items + ["另有弹性打卡与年度体检"])]


def corpus():
    rows = []
    for g in range(12):
        base = posting()
        rows += [(f"g{g}-{i}", v) for i, v in enumerate(variants(base) if g % 2 else ["\n".join(base)])]
    rows += [("null", None), ("empty", ""), ("short", "负责销售"), ("again", rows[1][1])]
    return rows


def test_near_copies_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows + rows[:3]], "recruitment_record_id string, job_description_raw string, cls string, k int")
    got = {tuple(r) for r in nearcopies.found(df).collect()}

    def share(a, b):
        ca, cb = Counter(nearcopies.clauses(a)), Counter(nearcopies.clauses(b))
        size = lambda c: sum(n * len(x) for x, n in c.items())
        return size(ca & cb) / max(size(ca), size(cb))

    long = [(k, t) for k, t in rows if t and len(t) >= nearcopies.LEAST_CHARS]
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(long, 2) if share(x, y) >= nearcopies.SHARED}
    assert got == want and len(want) > 30


def test_near_copies_split_full_buckets(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "recruitment_record_id string, job_description_raw string")
    want = {tuple(r) for r in nearcopies.found(df).collect()}
    monkeypatch.setattr(nearcopies, "BUCKET", 1)  # every bucket goes through the second index
    assert {tuple(r) for r in nearcopies.found(df).collect()} == want


def test_near_copies_in_one_large_group(spark):
    rnd = random.Random(8)
    base = [f"第{i}项职责为{rnd.choice(VERBS)}{rnd.choice(OBJECTS)}{i}" for i in range(20)]
    rows = []
    for r in range(690):  # a third are copies with four clauses changed each
        own = rnd.sample(range(20), 4) if r % 3 == 0 else range(20)
        rows.append((f"r{r}", "；".join(f"另行安排{r}号{i}批{rnd.choice(OBJECTS)}" if i in own else x for i, x in enumerate(base))))
    got = {tuple(r) for r in nearcopies.found(spark.createDataFrame(rows, "recruitment_record_id string, job_description_raw string")).collect()}
    sets = [(k, {x: len(x) for x in nearcopies.clauses(t)}) for k, t in rows]
    share = lambda a, b: sum(a[x] for x in a.keys() & b.keys()) / max(sum(a.values()), sum(b.values()))
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets, 2) if share(x, y) >= nearcopies.SHARED}
    assert got == want and len(want) > 15_000


def test_near_copies_form_groups(spark):
    base = posting(12)
    rows = [("a", "；".join(base)), ("b", "；".join(base[:10])), ("c", "；".join(base[:8])), ("d", "；".join(base[:6])), ("e", "。".join(base)), ("f", "；".join(posting(12))), ("g", None)]
    got = {r["record_id"]: r for r in nearcopies.groups(spark.createDataFrame(rows, "recruitment_record_id string, job_description_raw string")).collect()}
    assert set(got) == set("abcdef") and got["a"]["class_id"] == got["e"]["class_id"]
    assert len({got[k]["group_id"] for k in "abcde"}) == 1 != len({got[k]["group_id"] for k in "af"})
    assert got["f"]["n_links"] == 0 and got["a"]["n_links"] == 2 and got["d"]["n_links"] == 2


def test_near_copies_with_giant_clauses(spark):
    big = "".join(chr(0x4E00 + i % 5000) for i in range(50_000))
    rows = [("a", big + "；" + "短句在此" * 3), ("b", big + "；" + "别的句子" * 3), ("c", big[::-1])]
    assert [tuple(r) for r in nearcopies.found(spark.createDataFrame(rows, "recruitment_record_id string, job_description_raw string")).collect()] == [("a", "b")]
    assert sum(t & 0x3FFF for t in nearcopies.tokens(nearcopies.clauses(rows[0][1]), {})) == 50_012


def test_near_copies_empty(spark):
    df = spark.createDataFrame([], "recruitment_record_id string, job_description_raw string")
    assert nearcopies.found(df).count() == 0


def test_overlap_against_brute_force(spark):
    train, ev = [], []
    for i in range(40):
        items = posting(6)
        train.append((i, "[SEP]".join(["岗位", "；".join(items)]), "a"))
        if i % 4 == 0:
            ev.append((1000 + i, "；".join(random.sample(items, 6)).replace("，", ",").upper(), None if i == 8 else "s"))
    ev += [(2000 + i, "；".join(posting(6)), "s") for i in range(15)] + [(3000, None, "s"), (3001, "", "s"), (3002, "短", "s")]
    train += [train[0], (500, None, "a"), (501, "短", "a")]
    mk = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "row_id bigint, text string, source string, t int")
    tr, va, te = mk(train), mk(ev[:12]), mk(ev[12:] + ev[:1])
    got = {tuple(r) for r in overlap.found(tr, va, te).collect()}
    def by(t, other):
        """Characters of the clauses of ``t`` that passages of ``other`` cover."""
        n = 0
        for c in overlap.clauses(t):
            k = min(len(c), overlap.GRAM)
            hit = [False] * len(c)
            for i in range(len(c) - k + 1):
                if c[i : i + k] in other:
                    hit[i : i + k] = [True] * k
            n += sum(hit)
        return n

    def back(t, y):
        hit = [False] * len(t)
        for c in overlap.clauses(y):
            k = min(len(c), overlap.GRAM)
            for i in range(len(c) - k + 1):
                p = t.find(c[i : i + k])
                while p >= 0:
                    hit[p : p + k] = [True] * k
                    p = t.find(c[i : i + k], p + 1)
        return sum(hit)

    want = set()
    for a, x, _ in train:
        for b, y, _ in ev:
            if x and y and len(x) > 40 and len(y) > 40:
                n, m = overlap.normal(x), overlap.normal(y)
                if min(by(y, n), back(n, y)) >= overlap.WORDING * max(len(n), len(m)):
                    want.add((min(a, b), max(a, b)))
    assert got == want and len(want) >= 10
    rep = {(r["split"], r["source"]): (r["n_rows"], r["n_overlapping"]) for r in overlap.report(overlap.records(tr, va, te)).collect()}
    assert sum(n for n, _ in rep.values()) == len(ev) + 1 and sum(m for _, m in rep.values()) >= len(want)
    assert overlap.found(tr.limit(0), va, te).count() == 0 and overlap.found(tr, va.limit(0), te.limit(0)).count() == 0


def test_overlap_shards_lose_nothing(spark):
    items = [posting(6) for _ in range(9)]
    tr = spark.createDataFrame([(i, "；".join(x)) for i, x in enumerate(items)], "row_id bigint, text string")
    ev = spark.createDataFrame([(100 + i, "。".join(reversed(x))) for i, x in enumerate(items)], "row_id bigint, text string")
    got = {(r["train_id"], r["eval_id"]) for r in overlap.overlaps(tr, ev, shard=2).collect()}
    assert {(i, 100 + i) for i in range(9)} <= got


def test_overlap_of_punctuation_alone_and_of_many_copies(spark):
    text = "；".join(posting(6))
    train = [(i, text) for i in range(300)] + [(400, "-" * 50), (401, "!" * 60), (402, "。，" * 30)]
    ev = [(1000 + i, text + "。") for i in range(200)] + [(2000, "-" * 45), (2001, "!" * 70)]
    mk = lambda rows: spark.createDataFrame(rows, "row_id bigint, text string").withColumn("source", F.lit(None).cast("string"))
    got = {tuple(r) for r in overlap.found(mk(train), mk(ev[:50]), mk(ev[50:])).collect()}
    assert got == {(i, 1000 + j) for i in range(300) for j in range(200)}
    rows = {r["row_id"]: (r["n_train_texts"], r["coverage"]) for r in overlap.records(mk(train), mk(ev[:50]), mk(ev[50:])).collect()}
    assert rows[1000] == (1, 1.0) and rows[2000] == (0, 0.0) and len(rows) == len(ev)


def test_automaton_finds_all_passages():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("甲乙丙", k=rnd.randint(1, 9))) for _ in range(60)]
    m = automaton.build(words)
    texts = ["".join(rnd.choices("甲乙丙丁", k=n)) for n in (0, 1, 4, 5, 300, 700)] + ["丁"]
    passages = {w[i : i + 5] for w in words for i in range(max(1, len(w) - 4))}
    got = set()
    for x, e, s in zip(*automaton.scan(m, texts, lane=64)):
        p = int(m["place"][m["at"][s]])
        got.add((int(x), int(e), int(m["long_at"][p])))
    want = {(x, i + len(p) - 1, len(p)) for x, t in enumerate(texts) for p in passages for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p}
    assert got == want


def test_overlap_with_clauses_shuffled(spark):
    rnd = random.Random(3)
    own = lambda n: ["".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(rnd.randint(6, 10))) for _ in range(n)]
    train, ev = [], []
    for i in range(20):
        items = own(12)
        train.append((i, "，".join(items)))
        ev.append((100 + i, "；".join(items[::-1])))  # all of the wording
        ev.append((200 + i, " ".join(rnd.sample(items[:9] + own(3), 12))))  # three clauses of twelve replaced
        ev.append((300 + i, "".join(rnd.sample(items, 12))))  # without punctuation
        ev.append((400 + i, "。".join(items[:5] + own(7))))  # less than half
    train.append((50, "甲乙" * 30)), ev.append((150, "甲乙" * 30 + "，"))  # few distinct passages
    mk = lambda rows: spark.createDataFrame(rows, "row_id bigint, text string")
    got = {tuple(r) for r in overlap.found(mk(train), mk(ev[:40]), mk(ev[40:])).collect()}
    assert got == {(i, k + i) for i in range(20) for k in (100, 200, 300)} | {(50, 150)}


def test_overlap_scans_and_looks_up_repeated_pieces_once(monkeypatch, tmp_path):
    rnd = random.Random(4)
    pool = ["".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(rnd.randint(3, 12))) for _ in range(40)]
    texts = ["；".join(rnd.sample(pool, 9)) for _ in range(400)] + ["；".join(pool * 3), "ΟΔΟΣ'α, ﬁne_x\n" * 9, "甲乙" * 30, "，"]
    ev = ["。".join(rnd.sample(pool, 9)) for _ in range(150)] + ["甲乙" * 31, "；".join(pool[::-1] * 3), "—" * 50, "οδοσ α fine x " * 9]
    (tmp_path / "shard").write_bytes(overlap.compile_shard(list(range(len(ev))), ev))
    m = automaton.load(f"file://{tmp_path}/shard")
    assert all("".join(overlap.plain_clauses(t)) == overlap.normal(t) for t in texts + ev)
    plain = [overlap.normal(t) for t in texts]
    pieces, each = overlap._pieces(["\n".join(overlap.plain_clauses(t)) for t in texts])
    scanned, scan = [], automaton.scan
    monkeypatch.setattr(automaton, "scan", lambda m, t, *a: scanned.append(sum(map(len, t))) or scan(m, t, *a))
    got = overlap.covered(m, plain, pieces, each)
    assert scanned[0] < sum(map(len, plain)) / 2  # of texts that share pieces, these once
    for name, n in (("ENTRIES", 0), ("ENTRIES", 2000), ("WORK", 1)):  # long texts, few texts and few places at once
        with monkeypatch.context() as c:
            c.setattr(overlap, name, n)
            assert overlap.covered(m, plain, pieces, each) == got
    grams = lambda t: {c[i : i + 5] for c in overlap.clauses(t) for i in range(max(1, len(c) - 4))}

    def over(t, passages):
        hit = [False] * len(t)
        for p in passages:
            for i in range(len(t) - len(p) + 1):
                if t[i : i + len(p)] == p:
                    hit[i : i + len(p)] = [True] * len(p)
        return sum(hit)

    def of(y, x):
        n = 0
        for c in overlap.clauses(y):
            hit = [False] * len(c)
            for i in range(max(1, len(c) - 4)):
                if c[i : i + 5] in x:
                    hit[i : i + 5] = [True] * len(c[i : i + 5])
            n += sum(hit)
        return n

    want = set()
    for i, x in enumerate(plain):
        for j, y in enumerate(ev):
            limit = overlap.WORDING * max(len(x), len(overlap.normal(y)))
            if x and overlap.normal(y) and of(y, x) >= limit and over(x, grams(y)) >= limit:
                want.add((i, j))
    assert {(i, j) for i, j, _ in got} == want and len(want) > 20


NAMES = [
    "深圳市鲸澜数驿科技有限公司", "深圳鲸澜数驿科技有限公司 ", "鲸澜数驿科技", "鲸澜·数驿", "鲸澜数驿(深圳)科技有限公司", "科技鲸澜数驿（深圳）", "深圳鲸数科技公司", "深圳市鲸蓝数驿科技有限公司", "深圳市鲸数澜驿科技集团有限公司",
    "深圳市鲸澜数驿食品有限公司", "广州市丰新琥一贸易有限公司", "廣州市丰新琥一贸易有限公可", "杭州市丰新琥一贸易有限公司", "Kinarove Foods (Hong Kong) Co., Ltd.", "KINAROVE FOODS (HONG KONG) CO., LTD.", "Kinarove Food.", "KinaroveFoods", "Foods Kinarove Ltd", "Kin arove Foods Co., Ltd.", "Knarove Foods (Hong Kong) Co., Ltd.", "保密", "某知名公司", "-", "nan", "", None,
]


def test_names(spark):
    df = spark.createDataFrame([(n, "x", 1) for n in NAMES] * 2, "company_name string, firm string, id int")
    got = {tuple(r) for r in names.found(df).collect()}
    tech = {n for n in NAMES[:9] if n not in ("鲸澜·数驿",)}  # of two trades, the bare brand may mean either
    groups = [tech, {"广州市丰新琥一贸易有限公司", "廣州市丰新琥一贸易有限公可"}, set(NAMES[13:20])]
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert got == want
    assert names.found(df.limit(0)).count() == 0


def test_radius_join_against_brute_force(spark):
    pool = "甲乙丙丁戊己"
    pts = [(i, random.choice(["广州", "深圳"]), random.choice(["科技", "食品"]), "".join(random.choices(pool, k=random.randint(3, 5)))) for i in range(70)]
    df = spark.createDataFrame(pts, "id bigint, city string, trade string, brand string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    got = {(r["x"], r["y"]): r["d"] for r in names.radius_join(df, df).collect()}
    want = {(a[0], b[0]): d for a in pts for b in pts for d in [names.APART * ((a[1] != b[1]) + (a[2] != b[2])) + lev(a[3], b[3])] if d <= names.RADIUS}
    assert got == want


def test_names_learn_cities_and_link_partial_readings(spark):
    rows = ["哈尔滨星河科技有限公司", "哈尔滨市星河科技有限公司", "星河科技（哈尔滨）有限公司", "上海星河科技有限公司", "上海市星河科技有限公司", "晨曦远帆网络", "晨曦远凡网络", "晨曦近帆金融", "亮公司", "亮有限公司", "深圳科技有限公司", "深圳市科技有限公司", "齐齐哈尔市北风贸易有限公司", "齐齐哈尔北风贸易公司"]
    got = {tuple(r) for r in names.found(spark.createDataFrame([(n,) for n in rows], "company_name string")).collect()}
    groups = [rows[:3], rows[3:5], rows[5:7], rows[8:10], rows[10:12], rows[12:]]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_trades_are_learned_from_endings(spark):
    heads = ["".join(random.choices("甲乙丙丁戊己庚辛壬癸子丑寅卯", k=4)) for _ in range(40)]
    df = spark.createDataFrame([(h + ("水产养殖" if i % 2 else "达园艺"),) for i, h in enumerate(heads)], "rest string")
    assert {"水产养殖"} <= {r[0] for r in names.known_trades(df).collect()} - set(names.TRADES) <= {"水产养殖", "达园艺"}
