"""Consensus and canonical values."""

import json
import random

import pytest

pytest.importorskip("grainmill.llm")
from grainmill.llm import canonical, consensus  # noqa: E402


def answer(i, who, choice, at="2026-01-01T00:00:00Z", off=False, name="best_candidate_choice"):
    return {"id": i, "completed_by": who, "result": [{"from_name": name, "to_name": "job", "type": "choices", "value": {"choices": [choice]}}], "was_cancelled": off, "created_at": at}


def tasks(spark, rows):
    return spark.createDataFrame([(t, u, p if isinstance(p, str) or p is None else json.dumps(p, ensure_ascii=False), "x") for t, u, p in rows], "task_id bigint, updated_at string, annotations_completed string, p string")


def test_votes(spark):
    rows = [
        (1, "2026-01-01", [answer(1, 7, "候选A"), answer(2, {"id": 8}, "选项 B"), answer(3, 9, "都不符合"), answer(4, 9, "C", "2026-01-02T00:00:00Z"), answer(5, 10, "D", off=True), answer(6, 11, "E", at=None), answer(7, 12, "x", name="other")]),
        (2, "2026-01-01", [answer(1, 7, "A")]), (2, "2026-01-03", [answer(1, 7, " b")]), (2, "2026-01-05", '[{"id":1,"comp'), (3, "2026-01-01", None), (4, "2026-01-01", ""), (5, "2026-01-01", [answer(1, "7", "以上选项都不属于 ")]),
    ]
    got = {tuple(r) for r in consensus.votes(tasks(spark, rows)).collect()}
    assert got == {(1, "7", "A"), (1, "8", "B"), (1, "9", "C"), (2, "7", "B"), (5, "7", "NONE")}


def test_consensus_weighs_by_reliability(spark):
    rng = random.Random(4)
    codes = consensus.CODES
    names = {"NONE": "都不符合"}
    skill = {f"good{i}": 0.95 for i in range(3)} | {f"bad{i}": 0.25 for i in range(5)}
    rows, truth = [], {}
    for t in range(500):
        truth[t] = rng.choices(codes, [5, 3, 2, 2, 1, 2])[0]
        who = rng.sample(sorted(skill), 5)
        said = [truth[t] if rng.random() < skill[w] else rng.choice(codes) for w in who]
        rows.append((t, "2026-01-01", [answer(i, w, names.get(c, f"候选{c}")) for i, (w, c) in enumerate(zip(who, said))]))
    rows.append((900, "2026-01-01", [answer(1, "good0", "A")]))
    df = tasks(spark, rows)
    got = {r["task_id"]: r["choice_code"] for r in consensus.found(df).collect()}
    assert set(got) == set(range(500)) and sum(got[t] == truth[t] for t in truth) / 500 > 0.9
    v = consensus.votes(df).persist()
    f, _ = consensus.fit(v)
    r = {x["person"]: x["reliability"] for x in consensus.reliability(v, f).collect()}
    assert min(r[k] for k in r if k.startswith("good")) > max(r[k] for k in r if k.startswith("bad")) + 0.3
    a = consensus.agreement(v).head()
    assert a["n_tasks"] == 500 and 0 < a["alpha"] < 1


def test_alpha_against_pairs(spark):
    data = {1: "AAB", 2: "AB", 3: "CCC", 4: "AA", 5: "B"}
    v = spark.createDataFrame([(t, str(i), c) for t, s in data.items() for i, c in enumerate(s)], "task_id bigint, person string, code string")
    a = consensus.agreement(v).head()
    many = {t: s for t, s in data.items() if len(s) > 1}
    flat = "".join(many.values())
    n = len(flat)
    do = sum(sum(x != y for i, x in enumerate(s) for j, y in enumerate(s) if i != j) / (len(s) - 1) for s in many.values()) / n
    de = sum(x != y for i, x in enumerate(flat) for j, y in enumerate(flat) if i != j) / (n * (n - 1))
    assert a["alpha"] == pytest.approx(1 - do / de, abs=1e-5) and a["n_answers"] == n


def test_consensus_empty(spark):
    e = tasks(spark, [])
    assert consensus.found(e).count() == 0 and consensus.agreement(consensus.votes(e)).head()["alpha"] is None


OCC = [("R1-01", "幼儿教育测试员", "幼儿教育人员", ["早教测试", "Early Education Tester"]), ("R1-02", "幼儿教育采购员", "幼儿教育人员", ["早教采购", "Early Education Buyer"]), ("R2-01", "工业机器人采购员", "工业机器人人员", ["机械臂采购", "Industrial Robotics Buyer"]), ("R3-01", " 跨境电商文案编辑 ", "跨境电商人员", ["Cross-Border Commerce Copy Editor"])]
TITLES = {
    "幼儿教育测试员": "R1-01", " 【急聘】幼儿教育测试员2名": "R1-01", "<b>幼儿教育测试</b>员（包食宿）": "R1-01", "测试员（幼儿教育）": "R1-01", "幼儿教育岗-测试员": "R1-01", "幼儿教育方向测试员": "R1-01", "幼儿教育测是员": "R1-01", "幼儿育教测试员": "R1-01", "早教测试": "R1-01", "Tester, Early Education": "R1-01", "early education tster": "R1-01",
    "Buyer - Industrial Robotics": "R2-01", "采购员-工业机器人": "R2-01", "深圳工业机器人采购员 8-12K": "R2-01", "Sr. Industrial Robotics Buyer II": "R2-01", "跨境 电商 / 文案编辑": "R3-01", "工业机器人采购员 Industrial Robotics Buyer": "R2-01",
    "品茶师": "", "Beekeeper": "", "【急聘】--": "", "采购员": "", "幼儿教育": "",
}


def occ(spark, rows=OCC):
    return spark.createDataFrame([(c, t, t.strip(), m, a, True, "x") for c, t, m, a in rows] + [("C9", "幼儿教育人员", "幼儿教育人员", "幼儿教育人员", [], False, "x")], "code string, title string, title_clean string, occupation_middle_category string, aliases array<string>, is_terminal boolean, form string")


def test_canonical(spark):
    df = spark.createDataFrame([(f"r{i}", t, "x") for i, t in enumerate([*TITLES, None, " ", "nan"])] * 2, "recruitment_record_id string, job_title string, code string")
    got = {r[0]: r[1] for r in canonical.found(df, occ(spark)).collect()}
    assert {t: got[f"r{i}"] for i, t in enumerate(TITLES)} == TITLES and len(got) == len(TITLES)
    assert {r[1] for r in canonical.found(df, occ(spark, []).limit(0)).collect()} == {""}
    assert canonical.found(df.limit(0), occ(spark)).count() == 0


def test_pigeonhole_against_levenshtein(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("甲乙丙丁", k=rng.randint(4, 9))) for _ in range(60)})
    ref = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(words)], "code string, form string")

    def edit(w):
        w = list(w)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.pop(k), lambda: w.insert(k, "戊"), lambda: w.__setitem__(k, "己")])()
        return "".join(w)

    asked = sorted({edit(w) for w in words} - set(words))
    s = spark.sql(canonical._SEGMENTS, r=ref, long=7, short=4)
    w = spark.sql(canonical._WINDOWS, f=spark.createDataFrame([(a,) for a in asked], "form string"), long=7, short=4)
    got = {(r["form"], r["code"]) for r in spark.sql(canonical._NEAR, w=w, s=s).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = set()
    for a in asked:
        for i, b in enumerate(words):
            d, k = lev(a, b), 2 if len(b) >= 7 else 1
            if d <= k and (d <= 1 or sorted(a) == sorted(b) or len(b) >= 10):
                want.add((a, f"c{i}"))
    assert got == want and want


def test_values_of_any_length(spark):
    ref = spark.createDataFrame([("1-01", True, "甲" * 40 + "质量检验员" + "乙" * 45, None, [], "制造人员")], "code string, is_terminal boolean, title string, title_clean string, aliases array<string>, occupation_middle_category string")
    title = "甲" * 40 + "质量检验员" + "乙" * 45
    wrong = title[:60] + "丙" + title[61:]
    vals = spark.createDataFrame([(title,), (wrong,), ("长" * 20_000,), (f"【{'急' * 30}】{title}（{'注' * 50}）",)], "v string")
    assert {r["value"][:8]: r["code"] for r in canonical.match(vals, "v", ref).collect()} == {title[:8]: "1-01", wrong[:8]: "1-01", "长" * 8: "", "【急急急急急急急": "1-01"}
