"""Uploaded documents to cells and text: dispatch by kind, pluggable parsers, word-processor files by the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "path string, source string, table_idx int, row_idx int, col_idx int, col_name string, raw_value string"
TEXT = "path string, page int, text string, confidence double"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> list[str]:
    """Texts of the body's paragraphs outside tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")]


def docx_tables(data: bytes) -> list[list[list[str]]]:
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    cell = lambda c: "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.findall(f"{_W}p"))
    return [[[cell(c) for c in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")] for table in body.findall(f"{_W}tbl")]


def docx_images(data: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, z.read(n)) for n in z.namelist() if n.startswith("word/media/")]


def parse_docx(data: bytes) -> tuple[list[str], list[list[list[str]]], float]:
    return ["\n".join(docx_paragraphs(data))], docx_tables(data), 1.0


#: Parsers by kind: bytes to (page texts, tables, confidence). Others (native text, optical) are the caller's.
PARSERS: dict[str, Callable[[bytes], tuple[list[str], list[list[list[str]]], float]]] = {"docx": parse_docx}


def scan_cells(files: DataFrame, parsers=PARSERS, source: str = "native", least_rows: int = 3) -> DataFrame:
    """Cells of the tables of files (path, kind, content); tables of fewer rows are dropped, broken files give none."""
    chosen = files.filter(F.col("kind").isin(*parsers)).select("path", "kind", "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    tables = parsers[kind](bytes(content))[1]
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                for t, table in enumerate([x for x in tables if len(x) >= least_rows]):
                    names = table[0]
                    out += [(path, source, t, r, c, names[c] if c < len(names) else "", v) for r, row in enumerate(table[1:]) for c, v in enumerate(row)]
            yield pd.DataFrame(out, columns=["path", "source", "table_idx", "row_idx", "col_idx", "col_name", "raw_value"])

    return chosen.mapInPandas(cells, CELLS)


def scan_text(files: DataFrame, parsers=PARSERS) -> DataFrame:
    """Page texts of files."""
    chosen = files.filter(F.col("kind").isin(*parsers)).select("path", "kind", "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    texts, _, confidence = parsers[kind](bytes(content))
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                out += [(path, i, t, confidence) for i, t in enumerate(texts)]
            yield pd.DataFrame(out, columns=["path", "page", "text", "confidence"])

    return chosen.mapInPandas(pages, TEXT)


def document_text(pages: DataFrame, least: int = 50) -> DataFrame:
    """(path, text, scanned): pages joined by a blank line; a first page under 50 characters means a scan, text empty."""
    by = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    scanned = F.length(F.trim(F.get("p", F.lit(0))["text"])) < least
    return by.select("path", F.when(scanned, "").otherwise(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text"), scanned.alias("scanned"))


def better_strategy(first: DataFrame, second: DataFrame, garbled: DataFrame, keys) -> DataFrame:
    """Cells of the first reading, but of the second where the first is garbled and the second has more columns."""
    n = lambda df, name: df.groupBy(*keys).agg(F.countDistinct("col_idx").alias(name))
    swap = garbled.filter("garbled").join(n(first, "a"), list(keys)).join(n(second, "b"), list(keys)).filter("b > a").select(*keys)
    return first.join(swap, list(keys), "left_anti").unionByName(second.join(swap, list(keys), "left_semi"))


def reading_grades(pages: DataFrame) -> DataFrame:
    """(path, ocr, layout, grades) from page scores; the low grade is the worse of the two."""
    from ..functions.numbers import score_to_grade

    by = pages.groupBy("path").agg(F.avg("ocr_score").alias("ocr"), F.avg("layout_score").alias("layout"))
    out = by.withColumns({"ocr_grade": F.when(F.col("ocr") > 0, score_to_grade(F.col("ocr"))).otherwise("FAIR"), "layout_grade": F.when(F.col("layout") > 0, score_to_grade(F.col("layout"))).otherwise("FAIR")})
    rank = lambda c: F.when(F.col(c) == "POOR", 0).when(F.col(c) == "FAIR", 1).when(F.col(c) == "GOOD", 2).otherwise(3)
    return out.withColumn("low_grade", F.when(rank("ocr_grade") <= rank("layout_grade"), F.col("ocr_grade")).otherwise(F.col("layout_grade")))


def synthetic_boxes(rows: DataFrame, keys, order: str = "row_idx") -> DataFrame:
    """Boxes down the page for rows without any: top 0.05 + 0.08 i, bottom at most 0.95."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("top", F.least(F.lit(0.87), 0.05 + 0.08 * i)).withColumn("bottom", F.least(F.lit(0.95), F.col("top") + 0.08))
