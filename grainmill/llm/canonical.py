"""Problem 5: freely typed values mapped to the closest entry of a reference list.  SQL only.

Both sides are normalised alike.  A partition-based pigeonhole join finds the rest: a reference form allowing k edits is cut into
k + 1 segments, one of which any string within k edits holds unchanged at most k places away; the segments meet
positional substrings of the typed value by an equality join, and built-in ``levenshtein`` decides.  Values that meet no form are reported by an
anti-join.

Defined results: NULL and blank values (also ``nan``) are no cases; values equally near to two entries, and values that are noise alone, are unmatched;
an empty reference list leaves all unmatched; equal rows give one row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.chars import blank, narrow

# What postings add to a title.
CITIES = "北京 上海 广州 深圳 杭州 南京 苏州 武汉 成都 重庆 西安 长沙 郑州 青岛 厦门 合肥 东莞 佛山 珠海 中山 惠州 江门 肇庆 汕头 湛江 天津 宁波 无锡 济南 福州 大连 沈阳 昆明 南宁 贵阳 南昌 哈尔滨 长春 石家庄 太原 香港".split()
PRAISE = "急聘 诚聘 急招 高薪 直聘 招聘 直招 诚招 热招 高级 资深 中级 初级 实习 见习 助理级 兼职 全职 双休 包食宿 可实习 月薪过万 应届 五险一金 若干名 若干".split()
LATIN_NOISE = r"\b(?:sr|jr|senior|junior|lead|intern|trainee|urgent|hiring|full[- ]?time|part[- ]?time|m/f/d|m/w/d|f/m/d|ii|iii|iv|i|v)\b\.?"
SHORT, LONG = 4, 7  #: From these lengths on one and two edits are allowed.


def compact(c: Column) -> Column:
    """Letters and digits alone, in lower case, roman numerals and mark-up left out."""
    t = F.lower(narrow(c))
    t = F.regexp_replace(t, r"<[^<>]*>|&[a-z]{2,6};", " ")
    t = F.regexp_replace(t, r"[Ⅰ-Ⅻⅰ-ⅻ]", " ")
    t = F.regexp_replace(t, r"\d+(?:\.\d+)?\s*[-~]\s*\d+(?:\.\d+)?\s*[kw万千]?(?:/月(?!薪))?|\d+薪|\d+届|\d+名|\d+人", " ")
    t = F.regexp_replace(t, LATIN_NOISE, " ")
    return F.regexp_replace(t, "|".join(PRAISE), "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w]|_", "")


def spellings(values: DataFrame, column: str) -> DataFrame:
    """value, form: the ways to read each distinct value: bracketed parts dropped or kept, city names and filler words dropped."""
    v = values.filter(~blank(F.col(column))).select(F.col(column).alias("value")).distinct()
    base = compact(F.regexp_replace(narrow(F.col("value")), r"【[^】]*】", " "))
    v = v.withColumn("_b", base)
    bare = F.regexp_replace("_b", r"[(\[（][^()\[\]（）]*[)\]）]", " ")
    filler = lambda c: F.regexp_replace(c, r"(?:岗位|岗|方向|类)(?=[^\p{IsHan}\w]|$)|(?<=\p{IsHan})(?:岗|方向)(?=[-–—/· (（]?\p{IsHan})", " ")
    cities = "|".join(CITIES)
    town = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), rf"^(?:(?:{cities})市?[^\p{{L}}\p{{N}}]*)+(?=\p{{IsHan}})", ""), rf"(?:[^\p{{L}}\p{{N}}]*(?:{cities})市?)+[^\p{{L}}\p{{N}}]*$", "")
    han = F.regexp_replace(squeeze(F.col("_b")), r"[a-z]+", "")
    latin = squeeze(F.regexp_replace("_b", r"\p{IsHan}+", " "))
    forms = F.array(squeeze(F.col("_b")), squeeze(town(bare)), squeeze(town(filler(bare))), squeeze(town(filler(F.col("_b")))), squeeze(town(F.col("_b"))), F.when(latin.rlike("^[a-z]{6,}$") & (F.length(han) >= 3), han), F.when(F.length(han) >= 3, F.when(F.length(latin) >= 8, latin)))
    return v.select("value", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (F.length(x) >= 2)))).alias("form"))


def reference_forms(ref: DataFrame) -> DataFrame:
    """code, form of each terminal entry: its title, its aliases, and both with their parts in another order."""
    leaf = ref.filter(F.col("is_terminal") & F.col("code").isNotNull())
    field = F.regexp_replace(F.trim("occupation_middle_category"), "人员$", "")
    title = F.trim(F.coalesce("title_clean", "title"))
    names = F.array_compact(F.concat(F.array(title, F.trim("title")), F.coalesce("aliases", F.array().cast("array<string>"))))
    x = leaf.select("code", field.alias("f"), F.explode(names).alias("n")).select("code", "f", F.lower(narrow(F.trim("n"))).alias("n"))
    turned = F.when(F.col("n").startswith(F.col("f")) & (F.length("n") > F.length("f")) & (F.length("f") > 0), F.concat(F.expr("substring(n, length(f) + 1)"), "f"))
    words = F.split(F.col("n"), r"[^\p{L}\p{N}]+")
    turns = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.concat(F.slice(words, i + 1, F.size(words)), F.slice(words, F.lit(1), i)), "")))
    forms = F.array_compact(F.concat(F.array(F.col("n"), turned), F.coalesce(turns, F.array().cast("array<string>"))))
    out = x.select("code", F.explode(forms).alias("form")).select("code", squeeze(F.col("form")).alias("form")).filter("length(form) >= 2").distinct()
    # a form of two entries names neither
    return out.groupBy("form").agg(F.min("code").alias("code"), F.countDistinct("code").alias("n")).filter("n = 1").select("code", "form")


_EXACT = "SELECT t.value, t.form, r.code, 0 AS d FROM {t} t JOIN {r} r ON t.form = r.form"
_SEGMENTS = """
SELECT code, form, len, k, i, substring(form, 1 + i * len div (k + 1), (i + 1) * len div (k + 1) - i * len div (k + 1)) AS piece
FROM (SELECT code, form, len, k, explode(sequence(0, k)) AS i FROM (SELECT code, form, length(form) AS len, CASE WHEN length(form) >= {long} THEN 2 WHEN length(form) >= {short} THEN 1 ELSE 0 END AS k FROM {r}) WHERE k > 0)
"""
_WINDOWS = """
SELECT form, l AS len, k, i, substring(form, 1 + i * l div (k + 1) + s, (i + 1) * l div (k + 1) - i * l div (k + 1)) AS piece
FROM (SELECT form, l, k, i, explode(sequence(-k, k)) AS s
      FROM (SELECT form, l, k, explode(sequence(0, k)) AS i
            FROM (SELECT form, l, CASE WHEN l >= {long} THEN 2 ELSE 1 END AS k
                  FROM (SELECT form, explode(sequence(greatest({short}, length(form) - 2), length(form) + 2)) AS l FROM {f} WHERE length(form) >= {short} - 1))
            WHERE abs(l - length(form)) <= k))
WHERE 1 + i * l div (k + 1) + s >= 1 AND 1 + i * l div (k + 1) + s <= length(form)
"""
_NEAR = """
SELECT form, code, d, swapped FROM (
  SELECT DISTINCT w.form, s.code, levenshtein(w.form, s.form, s.k) AS d, s.k, length(s.form) AS l,
         array_sort(split(w.form, '')) = array_sort(split(s.form, '')) AS swapped
  FROM {w} w JOIN {s} s ON w.len = s.len AND w.i = s.i AND w.piece = s.piece)
WHERE d >= 0 AND (d <= 1 OR swapped OR l >= 10)
"""
_BEST = """
SELECT value, min_by(code, o) AS code, min(o).d AS d FROM (
  SELECT value, code, struct(d, NOT swapped AS s) AS o, min(struct(d, NOT swapped AS s)) OVER (PARTITION BY value) AS b FROM {m})
WHERE o = b GROUP BY value HAVING count(DISTINCT code) = 1
"""


def match(values: DataFrame, column: str, ref: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """value, code ('' if none), edits of each distinct value that isn't blank."""
    spark = values.sparkSession
    t, r = spellings(values, column), reference_forms(ref)
    exact = spark.sql(_EXACT, t=t, r=r)
    rest = t.join(exact.select("value"), "value", "left_anti")
    s = spark.sql(_SEGMENTS, r=r, long=long, short=short)
    # what is longer than the longest entry and its edits is near none
    f = rest.select("form").distinct().filter(F.length("form") <= s.agg(F.max("len") + 2).scalar())
    w = spark.sql(_WINDOWS, f=f, long=long, short=short)
    near = rest.join(spark.sql(_NEAR, w=w, s=s), "form").select("value", "code", "d", "swapped")
    hits = exact.select("value", "code", "d", F.lit(True).alias("swapped")).unionByName(near)
    best = spark.sql(_BEST, m=hits)
    every = values.filter(~blank(F.col(column))).select(F.col(column).alias("value")).distinct()
    unmatched = every.join(best.select("value"), "value", "left_anti")
    return best.unionByName(unmatched.select("value", F.lit("").alias("code"), F.lit(None).cast("int").alias("d")))


def found(df: DataFrame, ref: DataFrame) -> DataFrame:
    """recruitment_record_id, code."""
    x = df.select("recruitment_record_id", "job_title").filter(F.col("recruitment_record_id").isNotNull() & ~blank(F.col("job_title"))).distinct()
    m = match(x, "job_title", ref)
    return x.join(m, x["job_title"] == m["value"]).select("recruitment_record_id", "code").distinct()
