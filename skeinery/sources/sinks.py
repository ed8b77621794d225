"""Sinks: Parquet, CSV, workbooks, charts, JSON lines with resume, marked Markdown, redacted bundle."""

from __future__ import annotations

import io
import itertools
import json
import re
import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that name a person.
ATTRIBUTION = ["manager", "role", "role_secondary", "delegate_to", "top_managers"]
#: Rows and name length that a spreadsheet takes.
SHEET_ROWS, SHEET_NAME = 1_000_000, 31


_local: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder; a temporary one only where all executors are the driver's threads (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or _local.get(sc.applicationId)
    if not root:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="skeinery-")
    return f"{root}/skeinery-{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: what several steps go on from is worked out once."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(p) else ""


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def export_csv(df: DataFrame, path: str) -> None:
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": "\""}
    df.write.mode("overwrite").options(**keep).csv(path, header=True)


def sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:SHEET_NAME]


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Characters that XML text can't hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_BARRED.sub("", str(v)))}</t></is></c>'


def export_workbook(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One workbook (.xlsx) with a sheet for each table, in df's order; returns the sheets' names.

    Rows stream through the driver, one partition at a time.  A table of over
    SHEET_ROWS rows is refused, as none may go missing; names that a sheet can't have
    are mended, and equal ones numbered.
    """
    names: list[str] = []
    spark = next(iter(tables.values())).sparkSession
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, df) in enumerate(tables.items(), 1):
            name, n = sheet_name(name) or "sheet", 2
            while name.lower() in (x.lower() for x in names):
                name, n = f"{name[: SHEET_NAME - 4]}_{n}", n + 1
            names.append(name)
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for i, row in enumerate(itertools.chain([df.columns], df.toLocalIterator()), 1):
                    if i > SHEET_ROWS + 1:
                        raise ValueError(f"{name} has over {SHEET_ROWS} rows, which a sheet can't hold; export it as CSV")
                    out.write(f'<row r="{i}">{"".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(row))}</row>'.encode())
                out.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        rels = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>')
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
    write_bytes(spark, path, data.getvalue())
    return names


def read_workbook(spark: SparkSession, path: str, sheet: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows (as text, '' where there is no cell) of a sheet that ``export_workbook`` wrote."""
    import xml.etree.ElementTree as ET

    (content,) = spark.read.format("binaryFile").load(path).select("content").first()
    tag = lambda n: f"{{{_MAIN}}}{n}"
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet"))]
        rows = []
        for r in ET.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml")).iter(tag("row")):
            cells = {re.match("[A-Z]+", c.get("r"))[0]: "".join(t.text or "" for t in c.iter() if t.tag in (tag("v"), tag("t"))) for c in r.iter(tag("c"))}
            rows.append(cells)
    width = len(rows[0])
    table = [[r.get(_column(j), "") for j in range(width)] for r in rows]
    return table[0], table[1:]


#: Bars that a chart shows at most.
MOST_BARS = 500


def bar_chart(df: DataFrame, label: str, value: str, path: str, title: str) -> None:
    """A page with a horizontal bar chart (SVG) and its table, in df's order; frames of over MOST_BARS rows are refused."""
    rows = df.select(label, value).limit(MOST_BARS + 1).collect()
    if len(rows) > MOST_BARS:
        raise ValueError(f"a chart takes {MOST_BARS} bars; give it a summary")
    top = max([abs(float(r[1] or 0)) for r in rows], default=0) or 1
    text = lambda v: escape(_BARRED.sub("", "" if v is None else str(v)))
    bars = "".join(
        f'<text x="195" y="{24 * i + 16}" text-anchor="end">{text(r[0])}</text><rect x="200" y="{24 * i + 2}" width="{abs(float(r[1] or 0)) / top * 480:.1f}" height="18" fill="#4472a8"><title>{text(r[1])}</title></rect>'
        for i, r in enumerate(rows)
    )
    table = "".join(f"<tr><td>{text(r[0])}</td><td>{text(r[1])}</td></tr>\n" for r in rows)
    page = f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{text(title)}</title></head><body>\n<h1>{text(title)}</h1>\n<svg xmlns="http://www.w3.org/2000/svg" width="700" height="{24 * len(rows) + 4}" font-family="sans-serif" font-size="12">{bars}</svg>\n<table>\n<tr><th>{text(label)}</th><th>{text(value)}</th></tr>\n{table}</table>\n</body></html>\n'
    write_text(df.sparkSession, path, page)


def append_new(rows: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Appends the rows whose key the JSON lines at path don't have yet, and returns them."""
    spark = rows.sparkSession
    fs, p = _fs(spark, path)
    new = rows
    if fs.exists(p):
        done = spark.read.schema(schema).json(path, mode="DROPMALFORMED").select(key).filter(F.col(key).isNotNull()).distinct()
        new = rows.join(done, key, "left_anti")
    new.write.mode("append").json(path)
    return new


def marked(text: str, marker: str, addition: str) -> str:
    """text up to the marker, then the marker and the addition: done twice it is the same."""
    head = text.split(marker)[0].rstrip()
    return (head + "\n\n" if head else "") + marker + "\n" + addition.strip() + "\n"


def markdown_table(df: DataFrame, most: int = 12) -> str:
    """The first rows, in df's order, as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def redacted(df: DataFrame) -> DataFrame:
    return df.drop(*ATTRIBUTION)


def bundle_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """name, row: every redacted row as JSON text with all values as strings."""
    out = None
    for name, df in tables.items():
        df = redacted(df)
        part = df.select(F.lit(name).alias("name"), F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def write_bundle(tables: dict[str, DataFrame], path: str, variable: str = "DATA", most: int = 50_000) -> None:
    """One script that assigns the bundle to a variable; small tables only, a larger one is refused."""
    data: dict[str, list] = {}
    for name, df in tables.items():
        rows = bundle_rows({name: df}).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has over {most} rows; a bundle is for summaries")
        data[name] = [json.loads(r.row) for r in rows]
    spark = next(iter(tables.values())).sparkSession
    write_text(spark, path, f"window.{variable} = {json.dumps(data, ensure_ascii=False)};\n")
