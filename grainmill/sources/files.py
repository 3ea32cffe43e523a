"""Files in and out: readers that cope with what exports look like, and writers with defined semantics.

Readers return frames; only the probe of an encoding and lists of terms touch the driver, a bounded number of bytes each.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.relational import first_per_key

ENCODINGS = ["utf-8-sig", "utf-8", "gbk", "gb2312", "latin-1"]  #: The order in which an export's encoding is tried.
PROBE_BYTES = 1 << 20


def head_bytes(spark: SparkSession, path: str, limit: int = PROBE_BYTES) -> bytes:
    """The first bytes of the first file that ``path`` (a file, folder or pattern) names; nothing else is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(p) or []]
    found = sorted((f for d in found for f in ([s.getPath() for s in fs.listStatus(d) if s.isFile()] if fs.getFileStatus(d).isDirectory() else [d])), key=lambda f: f.toString())
    found = [f for f in found if not f.getName().startswith(("_", "."))]
    if not found:
        return b""
    stream = fs.open(found[0])
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, limit)))
    finally:
        stream.close()


def sniff_encoding(spark: SparkSession, path: str, limit: int = PROBE_BYTES) -> str:
    """The first of ``ENCODINGS`` that decodes the start of one file of ``path`` (a cut last character is forgiven)."""
    raw = head_bytes(spark, path, limit)
    for e in ENCODINGS:
        for cut in range(4):
            try:
                raw[: len(raw) - cut].decode(e)
                return e
            except UnicodeDecodeError:
                continue
    return "latin-1"


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, encoding: str | None = None, normalise: bool = False, lines_in_fields: bool = True) -> DataFrame:
    """All columns as strings, by header; a byte-order mark is no part of the first name; ``required`` names that are missing raise.

    ``normalise``: column names by :func:`normal_names`.  Files whose fields hold no line breaks are split among tasks with ``lines_in_fields=False``.
    """
    e = encoding or sniff_encoding(spark, path)
    if e in ("gbk", "gb2312"):
        df = _decoded_csv(spark, path, e)
    else:
        df = spark.read.csv(path, header=True, encoding="ISO-8859-1" if e == "latin-1" else "UTF-8", multiLine=lines_in_fields, escape='"')
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if normalise:
        df = df.toDF(*normal_names(df.columns))
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def _decoded_csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """CSV in an encoding that Spark's reader does not take: each file is decoded by one Python worker, so files must be of bounded size."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    head = head_bytes(spark, path)
    names = pd.read_csv(io.BytesIO(head.split(b"\n", 1)[0]), encoding=encoding, dtype=str).columns.tolist()

    def decode(frames):
        for f in frames:
            for b in f["content"]:
                x = pd.read_csv(io.BytesIO(b), encoding=encoding, dtype=str, keep_default_na=False, na_values=[""])
                yield x.reindex(columns=names)

    return raw.mapInPandas(decode, ", ".join(f"`{n}` string" for n in names))


def normal_names(names: list[str]) -> list[str]:
    """Column names in lower case with underscores; blanks become column, and a name met before gets _2, _3, ..."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", n.strip().lower())).strip("_") or "column"
        if base[0].isdigit():
            base = f"c_{base}"
        k, name = 1, base
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a line; lines that are none become rows of NULLs and are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The elements of files that hold one JSON array each; a file cut off keeps the elements that end before the cut.

    ``item``: the DDL type of an element.  Each file is one row of text: this is for exports of bounded size.
    """
    t = spark.read.text(path, wholetext=True).select(F.trim(F.col("value")).alias("v"))
    whole = F.from_json("v", f"array<{item}>")
    # cut off: back to the last element that ends at the array's level
    back = F.concat(F.regexp_extract("v", r"(?s)^(.*\})\s*,?", 1), F.lit("]"))
    return t.select(F.explode(F.coalesce(whole, F.from_json(back, f"array<{item}>"))).alias("e")).select("e.*")


def json_elements(stream, chunk: int = 1 << 20):
    """The elements of a JSON array as text, one at a time, from a binary stream read ``chunk`` bytes at once; a cut last element is left out."""
    decode = codecs.getincrementaldecoder("utf-8-sig")(errors="replace").decode
    depth, quoted, escaped, begun, part = 0, False, False, False, []
    while raw := stream.read(chunk):
        text = decode(raw)
        at = 0
        for m in _MARK.finditer(text):
            i, ch = m.start(), m.group()
            if escaped:  # the mark after a backslash is plain text
                escaped = False
                if i == gone:  # noqa: F821
                    continue
            if quoted:
                if ch == "\\":
                    escaped, gone = True, i + 1  # noqa: F841
                elif ch == '"':
                    quoted = False
                continue
            if ch == '"':
                quoted = True
            elif ch in "[{":
                depth += 1
                if depth == 1:
                    begun, at, part = True, i + 1, []
            elif ch in "]}" or (ch == "," and depth == 1):
                if depth == 1 and begun:
                    value = ("".join(part) + text[at:i]).strip()
                    if value:
                        yield value
                    at, part = i + 1, []
                depth -= ch != ","
        if escaped:
            gone -= len(text)
        part.append(text[at:])


_MARK = re.compile(r'["\\\[\]{},]')


def read_json_elements(spark: SparkSession, paths: list[str], item: str, chunk: int = 1 << 20) -> DataFrame:
    """path, position and the elements (DDL type ``item``) of files that hold one JSON array each, of any size: a worker holds a chunk and an element at a time."""

    def run(frames):
        from pyarrow import fs

        for f in frames:
            for p in f["path"]:
                store, inner = fs.FileSystem.from_uri(p)
                with store.open_input_file(inner) as stream:
                    rows = []
                    for i, e in enumerate(json_elements(stream, chunk)):
                        rows.append((p, i, e))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=["path", "position", "e"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["path", "position", "e"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    got = files.mapInPandas(run, "path string, position bigint, e string")
    return got.select("path", "position", F.from_json("e", item).alias("e")).select("path", "position", "e.*")


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A worksheet as strings, by its first row: a workbook is one bounded file, read by the driver."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            last = 0
            for c in row:
                n = 0
                for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                    n = n * 26 + ord(ch) - 64
                n = last = n or last + 1
                v = next((e.text or "" for e in c if tag(e) == "v"), None)
                cells[n] = shared[int(v)] if c.get("t") == "s" else text(c) if c.get("t") == "inlineStr" else v
            rows.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
    names = normal_names([x or "" for x in rows[0]]) if rows else ["column"]
    body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))


def write_xlsx(sheets: dict[str, DataFrame], path: str, limit: int = 100_000) -> None:
    """A report workbook, a sheet a result, at most ``limit`` rows each (a report's first rows); without styling."""
    esc = lambda v: escape("" if v is None else str(v))
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            lines = [df.columns, *df.limit(limit).collect()]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in lines) + "</sheetData></worksheet>")


def simple_yaml(text: str) -> dict:
    """Nested mappings, lists and scalars of the plain subset of YAML that configurations use; comments and blank lines are skipped."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def scalar(v: str):
        v = re.sub(r"\s+#.*$", "", v).strip()
        if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
            return v[1:-1]
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        if v.lower() in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                continue
        return v

    def block(i: int, depth: int):
        out: dict | list = [] if lines[i][1].startswith("- ") or lines[i][1] == "-" else {}
        while i < len(lines) and lines[i][0] == depth:
            line = lines[i][1]
            if isinstance(out, list):
                if not line.startswith("-"):
                    break
                out.append(scalar(line[1:]))
                i += 1
                continue
            k, _, v = line.partition(":")
            i += 1
            if v.strip() or i == len(lines) or (lines[i][0] <= depth and not (lines[i][0] == depth and lines[i][1].startswith("-"))):
                out[k.strip()] = scalar(v)
            else:
                out[k.strip()], i = block(i, lines[i][0])
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """term, weight, tag of a term list: one a line, comments and blank lines skipped, fields by white space."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' AND NOT startswith(v, '#')")
    p = F.split("v", r"\s+")
    return t.select(p[0].alias("term"), F.try_element_at(p, F.lit(2)).try_cast("bigint").alias("weight"), F.try_element_at(p, F.lit(3)).alias("tag")).distinct()


def pointed(spark: SparkSession, folder: str, pointer: str = "current.txt") -> str:
    """The path that a pointer file of ``folder`` names."""
    row = spark.read.text(f"{folder}/{pointer}").filter("trim(value) <> ''").head()
    if not row:
        raise ValueError(f"{folder}/{pointer} names nothing")
    return f"{folder}/{row['value'].strip()}"


def with_platform(df: DataFrame, table: str = "source_table") -> DataFrame:
    """Add source_platform by the table's name."""
    n = F.lower(table)
    return df.withColumn("source_platform", F.when(n.contains("51job"), "51job").when(n.contains("liepin"), "Liepin").when(n.contains("zhilian"), "Zhilian").otherwise("unknown"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Delete-and-insert by version: only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, legacy: str | None = None) -> None:
    """CSV with header, and a second copy under a legacy name from the same files' rows.

    The first column's name carries a byte-order mark, so that spreadsheets read the files as UTF-8.
    """
    df.toDF("\ufeff" + df.columns[0], *df.columns[1:]).write.mode("overwrite").option("header", True).csv(path)
    if legacy:
        df.sparkSession.read.option("header", True).schema(df.schema).csv(path).toDF("\ufeff" + df.columns[0], *df.columns[1:]).write.mode("overwrite").option("header", True).csv(legacy)


def write_shards(df: DataFrame, path: str, rows: int = 3000) -> DataFrame:
    """JSON lines in files of at most ``rows`` rows; returns their manifest: shard, n_rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(path)
    back = df.sparkSession.read.text(path)
    return back.groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.count("*").alias("n_rows"))


def append_latest(history: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key over a registry and what is appended to it."""
    both = history.unionByName(new)
    return first_per_key(both, keys, [F.col(at).desc_nulls_last(), *[F.col(c) for c in both.columns if c not in (*keys, at)]])


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet: resuming from a results table."""
    return todo.join(done.select(*keys), keys, "left_anti")


def single_current(releases: DataFrame, version: str) -> DataFrame:
    """Release metadata with exactly ``version`` as the current row."""
    return releases.withColumn("is_current", F.col("version") == version)


def manifest(df: DataFrame, name: str, keys: list[str]) -> str:
    """A JSON manifest of a result: rows, distinct keys and NULLs per column, in one pass."""
    a = df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("keys"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"nulls_{i}") for i, c in enumerate(df.columns)]).head()
    return json.dumps({"name": name, "rows": a["rows"], "distinct_keys": a["keys"], "nulls": {c: a[f"nulls_{i}"] for i, c in enumerate(df.columns)}}, ensure_ascii=False, sort_keys=True)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A small result as a Markdown table (a report's ``limit`` first rows)."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(limit).collect()])


def conll(df: DataFrame, words: str, tags: str) -> DataFrame:
    """One text column: a sentence's words and tags, a pair a line, an empty line at the end."""
    pairs = F.transform(F.arrays_zip(F.col(words).alias("w"), F.col(tags).alias("t")), lambda x: F.concat(x["w"], F.lit(" "), x["t"]))
    return df.select(F.concat(F.array_join(pairs, "\n"), F.lit("\n")).alias("value"))
