"""Workbooks (.xlsx) as rows of cells, and as Markdown: one table a sheet.

A workbook is a zip of XML parts; rows leave the worker in small batches while the sheet is read. Cell values are the stored
texts; a date is the number that the sheet holds. Defined results: null bytes, or bytes that are no workbook: one row with
``error`` and no sheet; a sheet without cells gives no row; rows that the file leaves out are not made up.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .uploads import MOST_BYTES

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SCHEMA = "id string, sheet_no int, sheet string, row_no long, cells array<string>, error string"
BATCH = 1000


def column_of(reference: str) -> int:
    """The column number, from 0, of a cell such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def words_of(item: ElementTree.Element) -> str:
    """All runs of a string, without the phonetic ones."""
    return "".join(t.text or "" for run in item for t in ([run] if run.tag == MAIN + "t" else run if run.tag == MAIN + "r" else ()) if t.tag == MAIN + "t")


def value_of(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, inline, value = cell.get("t"), cell.find(MAIN + "is"), cell.findtext(MAIN + "v") or ""
    if inline is not None:
        return words_of(inline)
    if kind == "s":
        return shared[int(value)]
    return {"0": "False", "1": "True"}.get(value, value) if kind == "b" else value


def sheet_rows(raw: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """sheet number, sheet name, row number, cells, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [words_of(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(MAIN + "sheets")
        for no, sheet in enumerate(sheets if sheets is not None else ()):
            target = targets[sheet.get(REL + "id")]
            with z.open(target.lstrip("/") if target.startswith("/") else "xl/" + target) as part:
                last = 0
                for _, e in ElementTree.iterparse(part):
                    if e.tag == MAIN + "row":
                        cells: list[str] = []
                        for c in e.iter(MAIN + "c"):
                            at = column_of(c.get("r") or "")
                            cells += [""] * (at - len(cells) if at >= 0 else 0)
                            cells.append(value_of(c, shared))
                        last = int(e.get("r") or last + 1)
                        if cells:
                            yield no, sheet.get("name"), last, cells
                        e.clear()


def rows_of(books: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """One row for each row of each sheet; one Arrow pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out: list[tuple] = []
        for pdf in batches:
            for key, raw in zip(pdf["id"], pdf["raw"], strict=True):
                try:
                    for row in sheet_rows(bytes(raw) if raw is not None else b""):
                        out.append((key, *row, None))
                        if len(out) >= BATCH:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                    out.append((key, None, None, None, None, type(e).__name__))
        yield pd.DataFrame(out, columns=names)

    kind = books.schema[id_col].dataType.simpleString()
    got = books.select(F.col(id_col).cast("string").alias("id"), F.col(raw_col).alias("raw")).mapInPandas(run, SCHEMA)
    return got.select(F.col("id").cast(kind).alias(id_col), *got.columns[1:])


def line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(rows: DataFrame, id_col: str) -> DataFrame:
    """id, markdown, sheet_count, row_count: a table for each sheet, its first row the header; no row for a book without cells.

    A blank header is col_<number>; rows are filled to the widest; line ends in a cell are blanks.
    """
    tidy = F.transform("cells", lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" "))))
    book = rows.filter("sheet_no IS NOT NULL").groupBy(id_col, "sheet_no", "sheet").agg(F.sort_array(F.collect_list(F.struct("row_no", tidy.alias("c")))).alias("rows"))
    book = book.withColumn("wide", F.array_max(F.transform("rows", lambda r: F.size(r["c"]))))
    filled = F.transform("rows", lambda r: F.concat(r["c"], F.array_repeat(F.lit(""), F.col("wide") - F.size(r["c"]))))
    book = book.withColumn("cells", filled)
    head = F.transform(F.col("cells")[0], lambda c, i: F.when(c == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(c))
    rule = F.transform(F.col("cells")[0], lambda c: F.lit("---"))
    rest = F.slice("cells", F.lit(2), F.size("cells"))
    table = F.array_join(F.concat(F.array(line(head), line(rule)), F.transform(rest, line)), "\n")
    parts = book.select(id_col, "sheet_no", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n\n"), table).alias("part"), F.size(rest).cast("long").alias("table_rows"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_no", "part"))), lambda p: p["part"]), "\n\n---\n\n")
    return parts.groupBy(id_col).agg(joined.alias("markdown"), F.count("*").alias("sheet_count"), F.sum("table_rows").alias("row_count"))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks under a path that are not above the upload cap."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return rows_of(files.filter(F.col("length") <= MOST_BYTES), "path", "content")
