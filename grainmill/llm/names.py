"""Problem 7: variant spellings of firms' names.

A name is read into city, trade and brand; whatever its order, brackets, width, script variant and legal form, equal readings are
one node.  Cities and trades are looked up in tables that start from short lists and are learned from all names: what
stands in brackets or before 市 and what the city column holds are cities; an ending is a trade where its first character is nearly always
followed by the rest and what stands before it varies.  Nodes lie in a metric space: the distance is the edit distance of brands plus ``APART`` for another city and
``APART`` for another trade (a sum of metrics, so the triangle inequality holds).  Pivots, in proportion to the root of the nodes around them, cut the space
into cells; a node is replicated to every cell whose members the triangle inequality leaves within reach, and exact radius joins run inside
the cells.  Edits that people make (one edit, two neighbours swapped, an abbreviation) link two full
readings; a reading without city or trade joins a firm if exactly one firm lies within reach of what it does say; those that reach none are
linked with one another.

Defined results: NULL and blank names and placeholders for a withheld name are in no pair; a name without brand is its own brand; brands of one
character link only where they are equal; a reading that fits
several firms joins none; equal rows count once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grainmill.functions.chars import blank, narrow
from grainmill.operators.graph import components
from grainmill.sources.shared import cut

# Cities, trades and legal forms to start from, script variants.
CITIES = "北京 上海 广州 深圳 杭州 南京 苏州 武汉 成都 重庆 西安 长沙 郑州 青岛 厦门 合肥 东莞 佛山 珠海 中山 惠州 江门 肇庆 汕头 湛江 天津 宁波 无锡 济南 福州 大连 沈阳 昆明 南宁 贵阳 南昌 香港".split()
CITIES_EN = ["hong kong", "shanghai", "shenzhen", "guangzhou", "beijing", "hangzhou", "nanjing", "suzhou", "chengdu", "wuhan", "singapore"]
TRADES = "教育咨询 餐饮管理 医疗器械 建筑工程 文化传媒 汽车服务 新能源 科技 食品 服饰 贸易 物流 网络 信息 制造 医药 金融 地产 旅游".split()
TRADES_EN = ["foods", "logistics", "biotech", "consulting", "dynamics", "interactive", "technology", "trading", "education", "media", "energy", "software", "robotics"]
LEGAL = r"(?:集团)?(?:股份有限公司|有限责任公司|有限公司|公司|集团)$"
LEGAL_EN = r"\b(?:co|ltd|limited|company|inc|corp|corporation|llc|gmbh|group|the)\b"
WITHHELD = r"保密|匿名|^某|不便透露|不公开|未公开|暂不|^confidential|^undisclosed|^n/?a$|^未知$|^none$|^null$"
NO_CITY = r"中国|集团|公司|控股|筹|原名|分店|总部"
TRADITIONAL = ("東廣圖聯興澤業達華飛萬寧門慶長漢蘇車務貿醫療設築傳電龍鳳馬鵬鷹麥雲霧夢書學樂實寶時國園銅鐵鋼銀錦鴻鯤愛歲濟灣灘陽陳隊際雙雜難頭題願飲館", "东广图联兴泽业达华飞万宁门庆长汉苏车务贸医疗设筑传电龙凤马鹏鹰麦云雾梦书学乐实宝时国园铜铁钢银锦鸿鲲爱岁济湾滩阳陈队际双杂难头题愿饮馆")

APART = 5  #: Distance between two cities, and between two trades: more than twice the radius.
RADIUS = 2
HEADS = 5  #: Different beginnings that an ending needs to be learned as a trade.


def _rows(df: DataFrame, values: list[str], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def _plain(c: Column) -> Column:
    return F.translate(F.lower(narrow(c)), *TRADITIONAL)


def _right(c: Column, k: int) -> Column:
    return F.when(F.length(c) >= k, F.right(c, F.lit(k)))


def _body(t: Column) -> Column:
    """A Chinese name without blanks, brackets and legal form, one wrong character in the form allowed."""
    s = F.regexp_replace(F.regexp_replace(t, r"(?U)\s", ""), r"[（(][^）)]*[)）]$", "")
    cut_ = lambda k: F.regexp_replace(F.left(s, F.length(s) - k), r"(?:股份|集团)+$", "")
    s = F.when(s.rlike(LEGAL), F.regexp_replace(s, LEGAL, "")).when(F.levenshtein(_right(s, 6), F.lit("有限责任公司")) <= 1, cut_(6)).when(F.levenshtein(_right(s, 4), F.lit("有限公司")) <= 1, cut_(4)).otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, r"[(\[（【][^)\]）】]*[)\]）】]", ""), r"[^\p{IsHan}a-z0-9]", "")


def known_cities(x: DataFrame, places: DataFrame | None) -> DataFrame:
    """city: the list's, those in brackets or before 市 in names (``x``: t), and those of ``places`` (place)."""
    bracket = F.regexp_extract("t", r"[(\[（【](?:中国)?(\p{IsHan}{2,4}?)市?[)\]）】]", 1)
    lead = F.regexp_extract("t", r"^(\p{IsHan}{2,3})市(?=\p{IsHan}{3})", 1)
    out = _rows(x, CITIES, "city").unionByName(x.select(F.explode(F.array(bracket, lead)).alias("city")))
    if places is not None:
        p = F.regexp_replace(_plain(F.col("place")), r"^.*(?:省|自治区)", "")
        out = out.unionByName(places.select(F.regexp_extract(p, r"^(\p{IsHan}{2,4}?)市", 1).alias("city")))
    return out.filter(F.col("city").rlike(r"^\p{IsHan}{2,4}$") & ~F.col("city").rlike(NO_CITY)).distinct()


def known_trades(b: DataFrame) -> DataFrame:
    """trade: the list's, and the endings of bodies (``b``: rest, without their city) that many brands share."""
    e = b.select("rest", F.explode(F.sequence(F.lit(1), F.least(F.lit(7), F.length("rest") - 2))).alias("k")).filter("k >= 1 AND length(rest) >= k + 2")
    n = e.select(F.expr("right(rest, k)").alias("s"), "rest").groupBy("s").agg(F.countDistinct("rest").alias("n"))
    shorter = n.select(F.col("s").alias("tail"), F.col("n").alias("n_tail"))
    longer = n.filter("length(s) > 1").groupBy(F.expr("substring(s, 2)").alias("s")).agg(F.max("n").alias("n_next"))
    x = n.filter(f"length(s) BETWEEN 2 AND 6 AND n >= {HEADS}").join(shorter, F.expr("substring(s, 2)") == F.col("tail")).join(longer, "s", "left")
    learned = x.filter((F.col("n") >= 0.5 * F.col("n_tail")) & (F.coalesce("n_next", F.lit(0)) < 0.5 * F.col("n")))
    return _rows(b, TRADES, "trade").unionByName(learned.select(F.col("s").alias("trade"))).distinct()


def _looked_up(x: DataFrame, candidates: Column, table: DataFrame, to: str) -> DataFrame:
    """``x`` with ``to``: the first of its candidates (structs ordered by what comes first, the text last) that the table holds, or NULL."""
    c = x.select("name", F.explode(F.array_compact(candidates)).alias("c"))
    hit = c.join(table, F.col("c.text") == F.col(table.columns[0])).groupBy("name").agg(F.min("c").alias(to))
    return x.join(hit, "name", "left")


def read_names(names: DataFrame, column: str, places: str | None = None) -> DataFrame:
    """name, city, trade ('' if not said), brand of each distinct name that is a firm's."""
    x = cut(names.filter(~blank(F.col(column))).select(F.col(column).alias("name")).distinct())  # far fewer than rows: all reading starts here
    t = F.regexp_replace(F.regexp_replace(_plain(F.col("name")), r"[·•・]", ""), r"(?U)^\s+|\s+$", "")
    x = x.withColumn("t", t).filter(~F.col("t").rlike(WITHHELD))
    han = cut(x.filter(F.col("t").rlike(r"\p{IsHan}")).withColumns({"body": _body(F.col("t")), "bracket": F.regexp_extract("t", r"[(\[（【](?:中国)?(\p{IsHan}{2,4}?)市?[)\]）】]", 1)}))
    cities = (known_cities(han, None if places is None else names.select(F.col(places).alias("place")).distinct()))
    cand = lambda first, k, text: F.struct(F.lit(first).alias("first"), F.lit(-k).alias("size"), text.alias("text"))
    body, back = F.col("body"), F.regexp_replace("body", r"(?<=.{4})市$", "")
    options = [F.when(F.col("bracket") != "", cand(0, 0, F.col("bracket")))]
    options += [F.when(F.length("body") >= k + 2, cand(1, k, F.left(body, F.lit(k)))) for k in (2, 3, 4)] + [F.when(F.length(back) >= k + 2, cand(2, k, _right(back, k))) for k in (2, 3, 4)]
    han = _looked_up(han, F.array(*options), cities, "_c")
    city = F.coalesce(F.col("_c.text"), F.lit(""))
    front = F.regexp_replace(F.substring(body, F.length(city) + 1, F.lit(1 << 20)), r"^市(?=.{2})", "")
    rest = F.when(F.col("_c.first") == 1, front).when(F.col("_c.first") == 2, F.left(back, F.length(back) - F.length(city))).otherwise(body)
    han = cut(han.select("name", city.alias("city"), rest.alias("rest"), F.col("t").rlike(r"公.$").alias("formal")))
    trades = (known_trades(han.filter("formal").select("rest")))
    r, short = F.col("rest"), F.when(F.col("rest").rlike(r"..公.$"), F.left("rest", F.length("rest") - 2))
    options = [F.when(F.length("rest") > k, cand(first, k, x)) for k in range(2, 7) for first, x in ((0, _right(r, k)), (2, F.left(r, F.lit(k))))] + [F.when(F.length(short) > k, cand(1, k, _right(short, k))) for k in range(2, 7)]
    han = _looked_up(han, F.array(*options), trades, "_t")
    trade = F.coalesce(F.col("_t.text"), F.lit(""))
    brand = F.when(F.col("_t.first") == 0, F.left(r, F.length(r) - F.length(trade))).when(F.col("_t.first") == 1, F.left(short, F.length(short) - F.length(trade))).when(F.col("_t.first") == 2, F.substring(r, F.length(trade) + 1, F.lit(1 << 20))).otherwise(r)
    cn = han.select("name", "city", trade.alias("trade"), brand.alias("brand"))
    # Latin: the words left after forms, city and trade are the brand
    e = F.trim(F.regexp_replace(F.regexp_replace(F.col("t"), r"[^a-z0-9]+", " "), LEGAL_EN, " "))
    cities_en = "|".join(CITIES_EN)
    y = cut(x.filter(~F.col("t").rlike(r"\p{IsHan}")).select("name", "t", F.regexp_replace(e, " +", " ").alias("_e")))
    inside = F.trim(F.regexp_replace(F.regexp_extract("t", r"\(([a-z][a-z .-]{2,})\)", 1), r"[^a-z]+", " "))
    inside = F.when((inside != "") & ~inside.rlike(rf"\b(?:{'|'.join(TRADES_EN)})\b|{LEGAL_EN}"), inside)
    y = y.withColumn("_ce", F.coalesce(inside, F.regexp_extract("_e", rf"\b({cities_en})\b", 1)))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.concat(F.lit(" "), "_e", F.lit(" ")), F.concat(F.lit(" "), F.when(F.col("_ce") == "", F.lit("\n")).otherwise(F.col("_ce")), F.lit(" ")), F.lit(" "))), " +"), lambda w: w != "")
    y = cut(y.withColumn("_w", words).select("name", "_e", "_ce", "_w"))
    known = F.array(*map(F.lit, TRADES_EN))
    y = y.withColumn("_te", F.try_element_at(F.array_compact(F.transform("_w", lambda w: F.try_element_at(F.filter(known, lambda k: (k == w) | ((F.length(w) == 4) & k.startswith(w))), F.lit(1)))), F.lit(1)))
    glued = F.array_join(F.when(F.col("_te").isNull(), F.col("_w")).otherwise(F.filter("_w", lambda w: ~((w == F.col("_te")) | ((F.length(w) == 4) & F.col("_te").startswith(w))))), "")
    y = cut(y.withColumn("_g", glued).select("name", "_e", "_ce", "_te", "_g"))
    ending = F.regexp_extract("_g", rf"^.{{3,}}({'|'.join(TRADES_EN)})$", 1)
    brand_en = F.when(F.col("_te").isNull() & (ending != ""), F.expr("left(_g, length(_g) - length(regexp_extract(_g, '(" + "|".join(TRADES_EN) + ")$', 1)))")).otherwise(F.col("_g"))
    en = y.select("name", F.col("_ce").alias("city"), F.coalesce("_te", ending).alias("trade"), brand_en.alias("brand"), "_e")
    en = en.select("name", "city", "trade", F.when(F.col("brand") == "", F.regexp_replace("_e", " ", "")).otherwise(F.col("brand")).alias("brand"))
    return cn.unionByName(en).filter(F.col("brand") != "")


def _distance(c1: Column, t1: Column, s1: Column, c2: Column, t2: Column, s2: Column) -> Column:
    return F.when(c1 != c2, APART).otherwise(0) + F.when(t1 != t2, APART).otherwise(0) + F.levenshtein(s1, s2)


def radius_join(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """x, y, sx, sy, d: every pair of ``left`` (x) and ``right`` (y) at most ``radius`` apart.

    Both: id, city, trade, brand.  What differs in city or trade is further apart than the radius, so the space falls into blocks; of each
    block of ``right`` as many members as the root of its size, spread by hash, are pivots (any choice gives the same pairs).  A
    left member goes to its nearest pivot's cell; a right one to all cells p with d(y, p) <= reach(p) +
    radius, where reach(p) is the largest distance of a left member of the cell: by the triangle inequality no pair is lost.
    """
    if radius >= APART:
        raise ValueError("the radius must be less than the distance of two cities")
    w = W.partitionBy("city", "trade")
    p = right.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(F.xxhash64("id"), "id"))}).filter("_i <= ceil(sqrt(_n))")
    p = p.select("city", "trade", F.col("id").alias("p"), F.col("brand").alias("sp"))
    x = left.join(p, ["city", "trade"]).withColumn("_d", F.levenshtein("brand", "sp")).groupBy("id").agg(F.min(F.struct("_d", "p")).alias("m"), F.first("brand").alias("sx"))
    x = x.select(F.col("id").alias("x"), "sx", "m.p", F.col("m._d").alias("_near"))
    reach = x.groupBy("p").agg(F.max("_near").alias("_reach"))
    y = right.join(p.join(reach, "p"), ["city", "trade"]).filter(F.levenshtein("brand", "sp") <= F.col("_reach") + radius).select(F.col("id").alias("y"), F.col("brand").alias("sy"), "p")
    near = x.select("x", "sx", "p").join(y, "p").filter(F.abs(F.length("sx") - F.length("sy")) <= radius)
    return near.withColumn("d", F.levenshtein("sx", "sy", radius)).filter("d >= 0").select("x", "y", "sx", "sy", "d")


def human_edit(s1: Column, s2: Column, d: Column) -> Column:
    """Whether two brands at distance ``d`` differ as people make them differ: one edit, one swap, or an abbreviation (half the characters or more, in order, the first among them)."""
    swap = (d == 2) & (F.length(s1) == F.length(s2)) & (F.array_sort(F.split(s1, "")) == F.array_sort(F.split(s2, "")))
    short, long = F.when(F.length(s1) < F.length(s2), s1).otherwise(s2), F.when(F.length(s1) < F.length(s2), s2).otherwise(s1)
    fewer = F.length(long) - F.length(short)
    skip = (d == 2) & (fewer == 2) & (F.length(short) >= 2) & (F.length(long) <= 2 * F.length(short)) & (F.left(short, F.lit(1)) == F.left(long, F.lit(1))) & short.rlike(r"^\p{IsHan}+$")
    one = (d == 1) & (F.length(long) >= 3)
    return (d == 0) | one | swap | skip


def link(names: DataFrame, column: str = "company_name", places: str | None = None) -> DataFrame:
    """name, firm: the firm (a number of its own) of each distinct name that is a firm's.  ``places``: a column of cities to learn from."""
    read = cut(read_names(names, column, places).withColumn("id", F.xxhash64("city", "trade", "brand")))
    nodes = cut(read.select("id", "city", "trade", "brand").distinct())
    full = nodes.filter("city <> '' AND trade <> ''")
    # full readings with one another; an abbreviation then joins the firm that it fits, if it fits one only
    near = radius_join(full, full).filter("x <> y").withColumn("ok", human_edit(F.col("sx"), F.col("sy"), F.col("d"))).filter("ok")
    near = cut(near.withColumn("short", (F.col("d") == 2) & (F.length("sx") < F.length("sy"))))
    firms = (components(near.filter("NOT short AND NOT (d = 2 AND length(sx) > length(sy))").select("x", "y"), full).withColumnRenamed("component", "firm"))
    fits = near.filter("short").join(firms.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("firm").alias("f"), F.countDistinct("firm").alias("n")).filter("n = 1")
    firms = cut(firms.join(fits.select(F.col("x").alias("id"), "f"), "id", "left").select("id", F.coalesce("f", "firm").alias("firm")))
    # readings that leave city, trade or both unsaid lie in the space of full readings without them
    part = nodes.filter("city = '' OR trade = ''")
    seen = full.join(firms, "id").select("firm", "brand", F.explode(F.array(*[F.struct(F.lit("").alias("city") if not c else F.col("city"), F.lit("").alias("trade") if not t else F.col("trade")) for c, t in ((0, 1), (1, 0), (0, 0))])).alias("p"))
    seen = (seen.select("firm", "p.city", "p.trade", "brand").distinct().withColumn("k", F.xxhash64("city", "trade", "brand")))
    points = seen.select(F.col("k").alias("id"), "city", "trade", "brand").distinct()
    reach = radius_join(part, points).withColumn("ok", human_edit(F.col("sx"), F.col("sy"), F.col("d"))).filter("ok")
    reach = reach.join(seen.select(F.col("k").alias("y"), "firm"), "y").select("x", "firm", "d").distinct()
    best = cut(reach.withColumn("m", F.min("d").over(W.partitionBy("x"))).filter("d = m").groupBy("x").agg(F.min("firm").alias("f"), F.countDistinct("firm").alias("n")).withColumnRenamed("x", "id"))
    # what fits no firm is linked with its like; what fits several joins none
    alone = (part.join(best, "id", "left_anti"))
    like = radius_join(alone, alone).filter(F.col("x") < F.col("y")).filter(human_edit(F.col("sx"), F.col("sy"), F.col("d")) & (F.col("d") < 2) | (F.length("sx") == F.length("sy")) & human_edit(F.col("sx"), F.col("sy"), F.col("d")))
    own = components(like.select("x", "y"), alone).withColumnRenamed("component", "firm")
    out = firms.unionByName(best.filter("n = 1").select("id", F.col("f").alias("firm"))).unionByName(own)
    return read.join(out, "id").select("name", "firm").distinct()


def found(df: DataFrame) -> DataFrame:
    """name_a < name_b: different spellings of one firm.  A firm has a bounded number of spellings, its rows any number."""
    x = cut(link(df, places="work_city" if "work_city" in df.columns else None))
    a, b = x.toDF("name_a", "firm"), x.toDF("name_b", "firm")
    return a.join(b, "firm").filter("name_a < name_b").select("name_a", "name_b").distinct()
