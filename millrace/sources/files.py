"""Files as tables: delimited text, workbooks, JSON and Parquet."""

from __future__ import annotations

import csv
import io
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import table_name
from . import legacy

EXTENSIONS = {
    "delimited": (".csv", ".tsv", ".txt"), "excel": (".xlsx", ".xlsm", ".xls"), "json": (".json", ".jsonl", ".ndjson"), "parquet": (".parquet",), "orc": (".orc",),
}
#: Tried in order; the last takes any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
SEPARATORS = (",", ";", "\t", "|")
HEAD = 64 * 1024
# What delimited files write for a missing value.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class LoadError(ValueError):
    """A file that cannot be read as a table, and why."""


@dataclass
class LoadedTable:
    name: str
    frame: DataFrame
    source_file: str
    source_format: str
    sheet_name: str | None = None
    notes: list[str] = field(default_factory=list)


def head_of(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file in any store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise LoadError(f"File not found: {path}")
    status = fs.getFileStatus(p)
    if status.isDirectory():
        return b"\0"
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(size, status.getLen()))))
    finally:
        stream.close()


def detect_encoding(head: bytes) -> str:
    """The first encoding that reads the head; a character cut at its end does not count."""
    for name in ENCODINGS:
        try:
            head.decode(name)
            if name == "utf-8-sig" and not head.startswith(b"\xef\xbb\xbf"):
                continue
            return name
        except UnicodeDecodeError as e:
            if name.startswith("utf") and e.start >= len(head) - 4 and len(head) >= HEAD:
                return "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-8"
    return "latin-1"


def encoding_of(spark: SparkSession, path: str, head: bytes) -> str:
    """The first encoding that reads the whole file; its lines are tested where they lie, in parallel."""
    name = detect_encoding(head)
    lines = spark.read.text(path)
    if name.startswith("utf") and not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        name = "cp1252"
    if name == "cp1252":  # five bytes mean nothing in it
        codes = F.hex(F.col("value").cast("binary"))
        if not lines.filter(F.regexp_like(codes, F.lit("^(?:..)*(?:81|8D|8F|90|9D)"))).isEmpty():
            name = "latin-1"
    return name


def detect_separator(text: str) -> str:
    """The separator that cuts the lines most alike; of equal ones that with most columns; a comma by default."""
    lines = [x for x in text.splitlines() if x.strip()][:50]
    best, score = ",", (0.0, 0)
    for sep in SEPARATORS:
        widths = [len(r) for r in csv.reader(lines, delimiter=sep)] if lines else []
        if widths and widths[0] > 1:
            alike = sum(w == widths[0] for w in widths) / len(widths)
            if (alike, widths[0]) > score:
                best, score = sep, (alike, widths[0])
    return best


def read_delimited(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Every column as text; blank lines go, and the usual texts for missing values become null."""
    head = head_of(spark, path)
    if not head.strip():
        raise LoadError("The file is empty.")
    encoding = encoding_of(spark, path, head)
    sep = detect_separator(head.decode(encoding, "replace"))
    charset = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}[encoding]
    df = (
        spark.read.option("header", True).option("sep", sep).option("encoding", charset).option("multiLine", True).option("escape", '"')
        .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    )
    if not df.columns:
        raise LoadError("The file is empty.")
    names = [c.lstrip("\ufeff") or f"_c{k}" for k, c in enumerate(df.columns)]
    df = df.toDF(*names)
    if encoding == "cp1252":  # Spark reads Latin-1; the two differ in 27 characters
        odd = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
        old, new = "".join(map(chr, odd)), bytes(odd).decode("cp1252")
        names = [c.translate(str.maketrans(old, new)) for c in names]
        df = df.toDF(*names).select(*[F.translate(F.col(f"`{c}`"), old, new).alias(c) for c in names])
    df = df.select(*[F.when(F.col(f"`{c}`").isin(NA_TEXTS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
    return df, [f"encoding {encoding}, separator {sep!r}"]


# -- JSON ----------------------------------------------------------------------------------


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as columns a_b; lists stay."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A list of records, the longest list of an object, one record, or a record per line."""
    head = head_of(spark, path)
    text = head.decode(detect_encoding(head), "replace").lstrip()
    if not text:
        raise LoadError("The file is empty.")
    if text[0] not in "[{":
        raise LoadError("JSON must hold records, not a single value.")
    lines = path.endswith((".jsonl", ".ndjson")) or (text[0] == "{" and bool(re.match(r"\{[^\n]*\}\s*\n\s*\{", text)))
    reader = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    df = reader.json(path)
    if "_corrupt" in df.columns:
        bad = df.filter(F.col("_corrupt").isNotNull()).select("_corrupt").limit(1).collect() if len(df.columns) > 1 else [("",)]
        if bad:
            raise LoadError(f"Invalid JSON: {str(bad[0][0])[:80]}")
        df = df.drop("_corrupt")
    if not lines and text[0] == "{":
        lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if lists:
            sizes = df.agg(*[F.max(F.size(f"`{c}`")).alias(c) for c in lists]).first()
            longest = max(lists, key=lambda c: sizes[c] or 0)
            df = df.select(F.inline(f"`{longest}`"))
    return flatten(df), []


# -- workbooks --------------------------------------------------------------------------------

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


# Number formats of the workbook standard that show dates or times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def dated_formats(own: dict[int, str]) -> set[int]:
    """The number formats that show dates or times, of the standard's and the workbook's ``own``."""
    # in a format's code, letters of dates count outside of quotes, escapes, brackets and colours
    bare = {k: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code).lower().replace("general", "") for k, code in own.items()}
    return (_DATE_FORMATS - own.keys()) | {k for k, code in bare.items() if re.search("[dmyhs]", code.split(";")[0])}


def _dated_styles(book: zipfile.ZipFile, names: set[str]) -> list[bool]:
    """For each style of cells: does it show its number as a date?"""
    if "xl/styles.xml" not in names:
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = dated_formats({int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_NS}numFmt")})
    styles = root.find(f"{_NS}cellXfs")
    return [] if styles is None else [int(x.get("numFmtId") or 0) in dated for x in styles.iter(f"{_NS}xf")]


def serial_date(number: float, from_1904: bool = False) -> str | None:
    """The ISO text of a workbook's day number: a date, a date with time, or below 1 a time of day."""
    if not 0 <= number < 2_958_466:
        return None
    # day 60 of the usual count is 29 February 1900, which never was
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if number < 60 else datetime(1899, 12, 30)
    at = first + timedelta(seconds=round(number * 86_400))
    if number < 1 and not from_1904:
        return at.strftime("%H:%M:%S")
    return at.date().isoformat() if at.time() == time() else at.isoformat(" ")


def sheets_of(data: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(name, rows of texts) of each sheet of a workbook; numbers that are shown as dates become ISO dates."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        dated = _dated_styles(book, names)
        settings = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_NS}row"):
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.iter(f"{_NS}c")):
                    v = c.find(f"{_NS}v")
                    text = None if v is None else v.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif c.get("t") == "b" and text is not None:
                        text = "TRUE" if text == "1" else "FALSE"
                    elif c.get("t") in (None, "n") and text and int(c.get("s") or 0) < len(dated) and dated[int(c.get("s") or 0)]:
                        text = serial_date(float(text), from_1904) or text
                    cells[_column(c.get("r")) if c.get("r") else k] = text
                rows.append([cells.get(k) for k in range(max(cells) + 1)] if cells else [])
            yield sheet.get("name"), rows


def read_excel(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    """The sheets that have rows, every column as text.  A workbook is one file and is read whole on the driver."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    out = []
    content = bytes(content)
    try:
        sheets = list(legacy.sheets_of(content, dated_formats, serial_date) if content[:8] == legacy.SIGNATURE else sheets_of(content))
    except (legacy.LegacyError, struct.error, zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise LoadError(f"Not a readable workbook: {path} ({e})") from e
    for name, rows in sheets:
        rows = [r for r in rows if any(v not in (None, "") for v in r)]
        if len(rows) < 2:
            continue
        width = max(map(len, rows))
        header = [(rows[0][k] if k < len(rows[0]) and rows[0][k] else f"Unnamed: {k}") for k in range(width)]
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
        data = [tuple([*r, *[None] * (width - len(r))]) for r in rows[1:]]
        out.append((name, spark.createDataFrame(data, schema).toDF(*header)))
    return out


# -- all kinds -----------------------------------------------------------------------------------


def load_file(spark: SparkSession, path: str) -> list[LoadedTable]:
    """The tables of a file, by its extension; a file without rows is an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = next((k for k, es in EXTENSIONS.items() if ext in es), None)
    if kind is None:
        raise LoadError(f"Unsupported file type '{ext}'. Supported: {', '.join(sorted(e for es in EXTENSIONS.values() for e in es))}.")
    head_of(spark, path, 1)
    name = table_name(os.path.basename(path.rstrip("/")))
    if kind == "excel":
        found = read_excel(spark, path)
        tables = [LoadedTable(name if len(found) == 1 else f"{name}_{table_name(s)}", df, path, kind, s if len(found) > 1 else None) for s, df in found]
    else:
        df, notes = {"delimited": read_delimited, "json": read_json}[kind](spark, path) if kind in ("delimited", "json") else (spark.read.format(kind).load(path), [])
        tables = [LoadedTable(name, df, path, kind, None, notes)]
    if not tables or all(t.frame.isEmpty() for t in tables):
        raise LoadError("The file has no rows.")
    for t in tables:
        if all(re.match(r"Unnamed: \d+$|_c\d+$", c) for c in t.frame.columns):
            t.notes.append("no column has a name")
    return tables


def validate_csv(spark: SparkSession, path: str) -> dict:
    """rows, columns and column_names of a delimited file, or an error."""
    try:
        if not path.lower().endswith(".csv"):
            raise LoadError("Only .csv files are accepted.")
        df, _ = read_delimited(spark, path)
        if df.isEmpty():
            raise LoadError("The file has no rows.")
    except LoadError as e:
        return {"valid": False, "error": str(e)}
    return {"valid": True, "rows": df.count(), "columns": len(df.columns), "column_names": df.columns}


def register(tables: dict[str, DataFrame]) -> None:
    """Each table as a view under its name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def catalog(tables: dict[str, DataFrame]) -> list[dict]:
    return [{"table": n, "columns": df.columns, "rows": df.count()} for n, df in sorted(tables.items())]


def write_table(df: DataFrame, path: str) -> None:
    """The typed result, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A download: one file with a header.  For exports of bounded size; tables stay Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
