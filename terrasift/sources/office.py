"""Workbooks and text documents of office suites (zipped XML), and pickled plain values."""

from __future__ import annotations

import io
import json
import os
import pickle
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.session import ship
from terrasift.sources.layers import write_files

#: Names of the formats' parts and namespaces; fixed by the standard.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
ERROR = "error"


def column_number(cell: str) -> int:
    """The number of a cell's column from 0: A is 0, AA is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def workbook_cells(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value as text) of the cells that hold something, in the order of the sheets."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{{{MAIN}}}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{MAIN}}}t")))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
            target = links[sheet.get(f"{{{LINKS}}}id")].removeprefix("/xl/")
            with z.open(f"xl/{target}") as part:
                row, at = 0, 0
                for event, e in ElementTree.iterparse(part, ("start", "end")):
                    if event == "start" and e.tag == f"{{{MAIN}}}row":
                        row, at = int(e.get("r", row + 1)), 0
                    elif event == "end" and e.tag == f"{{{MAIN}}}c":
                        at = column_number(e.get("r")) if e.get("r") else at
                        kind, value = e.get("t"), e.findtext(f"{{{MAIN}}}v")
                        if kind == "inlineStr":
                            value = "".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t"))
                        elif kind == "s" and value is not None:
                            value = shared[int(value)]
                        if value is not None:
                            yield sheet.get("name"), row - 1, at, value
                        at += 1
                    elif event == "end" and e.tag == f"{{{MAIN}}}row":
                        e.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, r, c, value, error) of the cells of the .xlsx files of a folder, values as text.

    A file that can't be read gives one row with its error.
    """
    ship(spark)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sheet", "r", "c", "value"]
        for rows in batches:
            for name, raw in zip(rows["path"], rows["content"]):
                out, file = [], os.path.basename(name)
                try:
                    for cell in workbook_cells(bytes(raw)):
                        out.append(cell)
                        if len(out) == 50_000:
                            yield pd.DataFrame(out, columns=names).assign(file=file, error=None)[["file", *names, ERROR]]
                            out = []
                except (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError) as e:
                    yield pd.DataFrame([(None, None, None, None)], columns=names).assign(file=file, error=f"{type(e).__name__}: {e}")[["file", *names, ERROR]]
                if out:
                    yield pd.DataFrame(out, columns=names).assign(file=file, error=None)[["file", *names, ERROR]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(cells, "file string, sheet string, r long, c long, value string, error string")


def read_table(spark: SparkSession, path: str, schema: dict[str, str], skip: int = 1) -> DataFrame:
    """(file, sheet, columns) of sheets that are tables: columns by position, without the first ``skip`` rows."""
    cells = read_workbooks(spark, path).where(F.col(ERROR).isNull() & (F.col("r") >= skip))
    one = lambda k, name, kind: F.max(F.when(F.col("c") == k, F.col("value"))).try_cast(kind).alias(name)
    return cells.groupBy("file", "sheet", "r").agg(*(one(k, n, t) for k, (n, t) in enumerate(schema.items()))).drop("r")


class WorkbookWriter:
    """An .xlsx with one sheet, written row by row; numbers stay numbers."""

    def __init__(self, path: str, names: list[str], sheet: str):
        self.zip, self.sheet, self.row = zipfile.ZipFile(f"{path}.xlsx", "w", zipfile.ZIP_DEFLATED), sheet, 0
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w")
        self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.add(names)

    def add(self, values: list) -> None:
        self.row += 1
        cells = []
        for k, v in enumerate(values):
            at = f"{column_name(k)}{self.row}"
            if v is None or v != v:
                continue
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_visible(str(v)))}</t></is></c>')
        self.part.write(f'<row r="{self.row}">{"".join(cells)}</row>'.encode())

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        book = f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name="{escape(self.sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>'
        _close(self.zip, "xl/workbook.xml", book, "spreadsheetml.sheet.main", {"rId1": ("worksheet", "worksheets/sheet1.xml", "spreadsheetml.worksheet")})


class DocumentWriter:
    """A .docx of paragraphs."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(f"{path}.docx", "w", zipfile.ZIP_DEFLATED)
        self.part = self.zip.open("word/document.xml", "w")
        self.part.write(f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD}"><w:body>'.encode())

    def add(self, text: str) -> None:
        self.part.write(f'<w:p><w:r><w:t xml:space="preserve">{escape(_visible(text or ""))}</w:t></w:r></w:p>'.encode())

    def close(self) -> None:
        self.part.write(b"</w:body></w:document>")
        self.part.close()
        _close(self.zip, "word/document.xml", None, "wordprocessingml.document.main", {})


def _visible(text: str) -> str:
    """A text without the control characters that XML has no place for."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text)


def _close(z: zipfile.ZipFile, main: str, content: str | None, kind: str, parts: dict[str, tuple[str, str, str]]) -> None:
    office, folder = "application/vnd.openxmlformats-officedocument", os.path.dirname(main)
    if content is not None:
        z.writestr(main, f'<?xml version="1.0" encoding="UTF-8"?>{content}')
    links = lambda rows: f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{LINKS}/{t}" Target="{p}"/>' for i, t, p in rows) + "</Relationships>"
    z.writestr("_rels/.rels", links([("rId1", "officeDocument", main)]))
    if parts:
        z.writestr(f"{folder}/_rels/{os.path.basename(main)}.rels", links([(i, t, p) for i, (t, p, _) in parts.items()]))
    types = "".join(f'<Override PartName="/{folder}/{p}" ContentType="{office}.{t}+xml"/>' for _, p, t in parts.values())
    z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
               f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/{main}" ContentType="{office}.{kind}+xml"/>{types}</Types>')
    z.close()


def write_workbooks(rows: DataFrame, folder: str, key: str, order: str, sheet: str = "Sheet1") -> DataFrame:
    """One .xlsx for each ``key`` with the other columns, rows by ``order``; the result lists the files, which are written
    when it is computed."""
    names = [c for c in rows.columns if c != key]

    def add(writer: WorkbookWriter, part: pd.DataFrame) -> None:
        for values in zip(*(part[n].astype(object).where(part[n].notna(), None) for n in names)):
            writer.add([v.item() if hasattr(v, "item") else v for v in values])

    return write_files(rows, folder, key, lambda path: WorkbookWriter(path, names, sheet), add, order)


def write_documents(rows: DataFrame, folder: str, key: str, order: str, text: str) -> DataFrame:
    """One .docx for each ``key``, a paragraph for each ``text`` by ``order``; the result lists the files."""

    def add(writer: DocumentWriter, part: pd.DataFrame) -> None:
        for t in part[text]:
            writer.add(t if isinstance(t, str) else "")

    return write_files(rows, folder, key, DocumentWriter, add, order)


class _Plain(pickle.Unpickler):
    """Reads numbers, texts and their containers; anything that would run code is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} isn't a plain value")


def read_pickles(spark: SparkSession, path: str) -> DataFrame:
    """(file, value as JSON, error) of the pickled plain values of a folder."""
    ship(spark)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, raw in zip(rows["path"], rows["content"]):
                try:
                    plain = _Plain(io.BytesIO(bytes(raw))).load()
                    out.append((os.path.basename(name), json.dumps(plain, ensure_ascii=False, default=list), None))
                except (pickle.UnpicklingError, EOFError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
                    out.append((os.path.basename(name), None, str(e)))
            yield pd.DataFrame(out, columns=["file", "value", ERROR])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(values, "file string, value string, error string")
