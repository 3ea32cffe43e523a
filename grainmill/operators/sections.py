"""Posting descriptions as sections of items.

A line that starts with a known heading opens its section; text before any heading is placed by its words; items are cut by
numbers, bullets, lines or semicolons, and an item that speaks of another section goes there.  One Arrow-batched function
does the cutting; what is read from the sections is plain SQL.

Defined results: NULL and blank texts have no sections and empty fields.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import drop_noise, strip_html

DUTIES, DEMANDS, BENEFITS, OTHER = "岗位职责", "任职要求", "福利待遇", "其他信息"
# Headings as postings write them.
HEADINGS = {
    DUTIES: "岗位职责 职责描述 工作职责 工作内容 职位描述 主要职责 岗位描述 岗位内容 主要工作 工作描述 职位职责 工作范围 职责范围 职责 你将负责 responsibilities duties".split() + ["job description", "key responsibilities", "what you will do"],
    DEMANDS: "任职要求 岗位要求 任职资格 职位要求 任职条件 资格要求 招聘要求 技能要求 能力要求 基本要求 应聘条件 学历要求 专业要求 要求 我们希望你 我们希望你是 requirements qualifications".split() + ["job requirements", "candidate profile"],
    BENEFITS: "福利待遇 公司福利 薪酬福利 薪资待遇 薪资福利 员工福利 福利 待遇 我们提供 我们能提供 你能得到 benefits".split(),
    OTHER: "工作地点 上班地点 工作时间 上班时间 联系方式 公司简介 公司介绍 公司地址 备注 温馨提示 简历投递".split() + ["about the company", "who we are"],
}
WORDS = {
    DUTIES: "负责|参与|开展|执行|制定|完成|跟进|处理|管理|维护|开发|设计|协助|协同|推进|搭建|优化|跟踪|输出",
    DEMANDS: "学历|专业|经验|优先|熟练|能力|责任心|要求|资格|本科|大专|硕士|博士|年龄|证书|具备|了解",
    BENEFITS: "福利|待遇|薪资|补贴|奖金|住宿|五险一金|公积金|年假|体检|提成|双休",
    OTHER: "公司简介|工作地点|地址|联系|简历投递|成立于|创立于",
}
_BY_NAME = sorted(((h, k) for k, hs in HEADINGS.items() for h in hs), key=lambda x: -len(x[0]))
_HEAD = re.compile(r"^[\s\[【(（]*(?:[一二三四五六七八九十]+\s*[、.．]\s*)?[\[【(（]?\s*(" + "|".join(re.escape(h) for h, _ in _BY_NAME) + r")\s*[\]】)）]?\s*([:：]|$|(?=[\]】]))\s*[\]】]?[:：]?\s*(.*)$", re.I)
_GLUED = re.compile(r"^[\s\[【]*(?:[一二三四五六七八九十]+\s*[、.]\s*)?(" + "|".join(re.escape(h) for h, k in _BY_NAME if len(h) >= 4 or k == BENEFITS) + r")[\]】]?\s+(.*)$", re.I)
_KIND = {h.lower(): k for h, k in _BY_NAME}
_ITEM = re.compile(r"(?:(?<=^)|(?<=[\s;；。|]))(?:[(（]?\d{1,2}[)）.、．](?!\d)|[①-⑳]|[•●▪◆★])\s*")
_INLINE = re.compile(r"(?<=[。；;|!！\s])\s*(?=[\[【]?(?:" + "|".join(re.escape(h) for h, _ in _BY_NAME if len(h) >= 4) + r")[\]】]?\s*[:：])")


def _tidy(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip(" \t|,，;；-–·•●")


def split_items(text: str) -> list[str]:
    """Items by numbers or bullets, else lines, else semicolons and bars, else the whole."""
    text = text.strip()
    if not text:
        return []
    parts = [p for p in (_tidy(x) for x in _ITEM.split(text)) if p]
    if len(parts) < 2:
        parts = [p for p in (_tidy(x) for x in re.split(r"\n+|\s\|\s|(?:^|\s)-\s", text)) if p]
    if len(parts) < 2:
        parts = [p for p in (_tidy(x) for x in re.split(r"[;；]", text)) if p]
    return parts


def infer(text: str, fallback: str | None = None) -> str | None:
    """The section whose words occur most in ``text`` (the first of equals); ``fallback`` where none do."""
    best, score = fallback, 0
    for k, p in WORDS.items():
        n = len(re.findall(p, text))
        if n > score:
            best, score = k, n
    return best


def word_counts(c: Column) -> list[Column]:
    """How often the words of each section, in the order of WORDS, occur in a text; 0 for NULL."""
    return [F.regexp_count(F.coalesce(c, F.lit("")), F.lit(p)).cast("bigint") for p in WORDS.values()]


def inferred(c: Column) -> Column:
    """:func:`infer` as an expression: the section whose words occur most (the first of equals), NULL where none do."""
    n = word_counts(c)
    most = F.greatest(*n)
    out = F.when(most == 0, F.lit(None).cast("string"))
    for k, x in zip(WORDS, n):
        out = out.when(x == most, F.lit(k))
    return out


def parse(text: str) -> tuple[list[tuple[str, bool, list[str]]], list[str]]:
    """([(section, inferred, items)], unclassified items)."""
    text = unicodedata.normalize("NFKC", text)
    text = _INLINE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    blocks: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        if not line.strip():
            continue
        m = _HEAD.match(line)
        g = None if m else _GLUED.match(line)
        if m or g:
            blocks.append((_KIND[(m or g).group(1).lower()], []))
            rest = m.group(3) if m else g.group(2)
            if rest.strip():
                blocks[-1][1].append(rest)
        else:
            blocks[-1][1].append(line)
    got: dict[str, tuple[bool, list[str]]] = {}
    loose: list[str] = []
    for head, lines in blocks:
        items = split_items("\n".join(lines))
        kind = head or (infer(" ".join(items)) if items else None)
        for x in items:
            own = infer(x) if head is None or kind in (DUTIES, DEMANDS) else kind
            # an item moves only between duties and demands, and only when it says nothing of its own section
            to = kind
            if head is None:
                to = own
            elif own in (DUTIES, DEMANDS) and own != kind and not re.search(WORDS[kind], x):
                to = own
            if to is None:
                loose.append(x)
            else:
                got.setdefault(to, (head is None, []))[1].append(x)
        if head and head not in got:
            got[head] = (False, [])
    order = [DUTIES, DEMANDS, BENEFITS, OTHER]
    return [(k, got[k][0], list(dict.fromkeys(got[k][1]))) for k in order if k in got and got[k][1]], list(dict.fromkeys(loose))


_SHAPE = "struct<sections:array<struct<title:string,inferred:boolean,items:array<string>>>,unclassified:array<string>>"


def _parse_batch(texts: pd.Series) -> pd.DataFrame:
    memo: dict[str, tuple] = {}
    out = []
    for t in texts:
        if not isinstance(t, str) or not t.strip():
            out.append(([], []))
            continue
        if t not in memo:
            s, u = parse(t)
            memo[t] = ([{"title": a, "inferred": b, "items": c} for a, b, c in s], u)
        out.append(memo[t])
    return pd.DataFrame(out, columns=["sections", "unclassified"])


def sectioned(df: DataFrame, text: str) -> DataFrame:
    """Add parsed STRUCT<sections, unclassified>, requirements_text, duties_text, unclassified_text, sections_brief, query_text and query_source."""
    df = df.withColumn("parsed", F.pandas_udf(_parse_batch, _SHAPE)(drop_noise(strip_html(F.col(text)))))
    items = lambda k: F.flatten(F.transform(F.filter("parsed.sections", lambda s: s["title"] == k), lambda s: s["items"]))
    joined = lambda c: F.array_join(c, " | ")
    df = df.withColumns({"requirements_text": joined(items(DEMANDS)), "duties_text": joined(items(DUTIES)), "unclassified_text": joined(F.col("parsed.unclassified")), "sections_brief": F.array_join(F.transform("parsed.sections", lambda s: F.concat(s["title"], F.lit(":"), F.size(s["items"]).cast("string"))), ";")})
    src = F.when(F.col("duties_text") != "", "duties").when(F.col("requirements_text") != "", "requirements").when(F.col("unclassified_text") != "", "unclassified").otherwise("none")
    return df.withColumns({"query_source": src, "query_text": F.when(F.col("duties_text") != "", F.col("duties_text")).when(F.col("requirements_text") != "", F.col("requirements_text")).otherwise(F.col("unclassified_text"))})
