"""XLSX workbooks as record sets, by the standard library: one row a cell, then joins on the header row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CELLS = "path string, sheet string, row long, col long, value string"
# Sheets, and headers of their columns -> fields of their records.
COMMON = {
    "Alternativní název": "alternativeName", "Popis": "description", "Definice": "definition", "Zdroj": "source", "Související zdroj": "relatedSource", "Ekvivalentní pojem": "equivalentConcept",
    "Identifikátor": "identifier", "Agendový informační systém": "agendaSystemCode", "Agenda": "agendaCode", "Je pojem veřejný?": "isPublic", "Ustanovení dokládající neveřejnost pojmu": "privacyProvision",
    "Způsob sdílení údaje": "sharingMethod", "Způsob získání údaje": "acquisitionMethod", "Typ obsahu údaje": "contentType",
}
SHEETS = {
    "classes": ("Subjekty a objekty práva", {"Název": "name", "Typ": "type", **COMMON, "Nadřazený pojem": "superClass"}),
    "properties": ("Vlastnosti", {"Název": "name", "Subjekt nebo objekt práva": "domain", **COMMON, "Datový typ": "dataType", "Je pojem sdílen v PPDF?": "sharedInPPDF", "Nadřazený pojem": "superProperty"}),
    "relationships": ("Vztahy", {"Název": "name", "Subjekt nebo objekt práva": "domain", **COMMON, "Je pojem sdílen v PPDF?": "sharedInPPDF", "Nadřazený pojem": "superRelation"}),
}
VOCABULARY_SHEET = "Slovník"
VOCABULARY_KEYS = {"Název slovníku": "name", "Popis slovníku": "description", "Adresa lokálního katalogu dat": "namespace"}
#: Number formats that are dates by the file format's rules.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def date_styles(styles: bytes | None) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if styles is None:
        return set()
    root = ElementTree.fromstring(styles)
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(MAIN + "numFmt")}
    held = root.find(MAIN + "cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in held] if held is not None else []
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or re.search("[dmyhs]", own.get(n, ""), re.I)}


def cell_text(kind: str | None, text: str | None, shared: list[str], is_date: bool = False) -> str | None:
    """A cell as text: shared and inline texts trimmed, whole numbers without .0, dates as ISO texts, booleans as words."""
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)].strip()
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind is None or kind == "n":
        if is_date:
            moment = datetime(1899, 12, 30) + timedelta(days=float(text))
            return moment.date().isoformat() if float(text) == int(float(text)) else moment.replace(microsecond=0).isoformat()
        return text[:-2] if re.fullmatch(r"-?\d+\.0", text) else text
    return text.strip()


def cells_of(path: str, content: bytes) -> list[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    part = lambda name: book.read(name) if name in names else None
    strings = part("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in ElementTree.fromstring(strings)] if strings else []
    dates, targets = date_styles(part("xl/styles.xml")), {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    rows = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"):
        target = targets[sheet.get(REL + "id")].lstrip("/")
        for c in ElementTree.fromstring(book.read(target if target.startswith("xl/") else "xl/" + target)).iter(MAIN + "c"):
            letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            col = 0
            for x in letters:
                col = col * 26 + ord(x) - 64
            v, formula, inline = c.find(MAIN + "v"), c.find(MAIN + "f"), c.find(MAIN + "is")
            text = formula.text if formula is not None else "".join(t.text or "" for t in inline.iter(MAIN + "t")) if inline is not None else v.text if v is not None else None
            value = cell_text("str" if formula is not None or inline is not None else c.get("t"), text, shared, int(c.get("s", 0)) in dates)
            if value:
                rows.append((path, sheet.get("name"), int(number), col - 1, value, None))
    missing = {VOCABULARY_SHEET, *(name for name, _ in SHEETS.values())} - {r[1] for r in rows}
    if missing:
        raise ValueError(f"sheets are missing or empty: {', '.join(sorted(missing))}")
    return rows


def checked_cells(files: DataFrame) -> DataFrame:
    """The cells of the workbooks in ``files`` (path, content), and a row with an ``error`` for each workbook that can't be
    opened or lacks a sheet."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = cells_of(where, content)
                except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, ElementTree.ParseError) as e:
                    rows = [(where, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value", "error"])
                yield out.astype({"row": "Int64", "col": "Int64"})

    return files.select("path", "content").mapInPandas(split, CELLS + ", error string")


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, value) of the cells with a value."""
    return checked_cells(files).where("error IS NULL").drop("error")


def workbook_errors(spark: SparkSession, path: str) -> DataFrame:
    return checked_cells(workbooks(spark, path)).where("error IS NOT NULL").select("path", "error")


def sheet_records(cells: DataFrame, sheet: str, fields: dict[str, str]) -> DataFrame:
    """A row for each row below the header: the header is the first row that has the sheet's first two headers; a header
    names its column by being equal to a field's header, or else by holding it. The file is ``model``."""
    held = cells.where(F.col("sheet") == sheet)
    need = list(fields)[:2]
    head_row = held.where(F.col("value").isin(*need)).groupBy("path", "row").agg(F.countDistinct("value").alias("n")).where(F.col("n") == len(need)).groupBy("path").agg(F.min("row").alias("head"))
    rows = held.join(head_row, "path")
    longest_first = sorted(fields.items(), key=lambda x: -len(x[0]))
    label = F.coalesce(*[F.when(F.col("value") == k, v) for k, v in fields.items()], *[F.when(F.col("value").contains(k), v) for k, v in longest_first])
    columns = rows.where("row = head").select("path", "col", label.alias("field")).where("field is not null")
    if "domain" in fields.values():  # of two columns for subjects or objects the first is the domain, the second the range
        columns = columns.join(columns.where("field = 'domain'").groupBy("path").agg(F.min("col").alias("first")), "path", "left").select("path", "col", F.when((F.col("field") == "domain") & (F.col("col") > F.col("first")), "range").otherwise(F.col("field")).alias("field"))
    body = rows.where("row > head").join(columns, ["path", "col"], "left")
    if sheet == SHEETS["relationships"][0]:  # the third column is the range, whether it has a header or not
        body = body.withColumn("field", F.coalesce("field", F.when(F.col("col") == 2, "range")))
    wanted = [*dict.fromkeys([*fields.values(), *(["range"] if "domain" in fields.values() else [])])]
    # Of several columns for one field the first with a value counts.
    wide = body.groupBy(F.col("path").alias("model"), "row").agg(*[F.min_by("value", F.when(F.col("field") == v, F.col("col"))).alias(v) for v in wanted])
    return wide.where(F.col("name").isNotNull())


def vocabulary_records(cells: DataFrame) -> DataFrame:
    """(model, name, description, namespace) from the key and value columns of the vocabulary's sheet."""
    at = lambda i, name: F.max(F.when(F.col("col") == i, F.col("value"))).alias(name)
    pairs = cells.where(F.col("sheet") == VOCABULARY_SHEET).groupBy("path", "row").agg(at(0, "key"), at(1, "value"))
    told = lambda start, name: F.min_by("value", F.when(F.col("key").startswith(start), F.col("row"))).alias(name)
    return pairs.groupBy(F.col("path").alias("model")).agg(*[told(k, v) for k, v in VOCABULARY_KEYS.items()])


def read_xlsx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The record sets of the workbooks at ``path``. A workbook that can't be read has no records but a row of ``workbook_errors``."""
    return records_of(read_cells(workbooks(spark, path)))


def records_of(cells: DataFrame) -> dict[str, DataFrame]:
    """The record sets ``vocabulary``, ``classes``, ``properties`` and ``relationships`` of the cells, and as ``hierarchies`` their super-concepts."""
    out = {k: sheet_records(cells, sheet, fields) for k, (sheet, fields) in SHEETS.items()}
    out["relationships"] = out["relationships"].where(F.col("domain").isNotNull())
    above = [out[k].select("model", F.col("name").alias("subClass"), F.col(c).alias("superClass")) for k, c in (("classes", "superClass"), ("properties", "superProperty"), ("relationships", "superRelation"))]
    out["hierarchies"] = above[0].union(above[1]).union(above[2]).where(F.col("superClass").isNotNull())
    out["vocabulary"] = vocabulary_records(cells)
    return out
