"""Sheets of workbooks (Office Open XML) as rows of cells, each file in a task of its own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard's name spaces, the transitional and the strict one.
_SPACES = ("http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://purl.oclc.org/ooxml/spreadsheetml/main")
CELLS = "file string, row long, cells map<string,string>"


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """Number of a cell's column from 0: A is 0, AA is 26."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """What an inline or shared string says; the readings beside it (phonetic runs) are left out."""
    return "".join(t.text or "" for run in node if _plain(run.tag) != "rPh" for t in run.iter() if _plain(t.tag) == "t")


def cells_of(content: bytes, sheet: str | int = 0) -> list[dict[str, str]]:
    """The rows below the first one, each a map of the first row's names to what its cells hold; empty cells are left out.

    Numbers are given as they are written in the file, truth values as 'true' and 'false', errors as their names.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        listed = [(s.get("name"), next(v for k, v in s.attrib.items() if _plain(k) == "id")) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _plain(s.tag) == "sheet"]
        found = [r for n, (name, r) in enumerate(listed) if sheet in (n, name)]
        if not found:
            raise KeyError(f"no sheet {sheet!r} among {[n for n, _ in listed]}")
        target = targets[found[0]]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rows: list[dict[int, str]] = []
        with book.open(path) as stream:
            for _, node in ElementTree.iterparse(stream):
                if _plain(node.tag) != "row":
                    continue
                own = {}
                for place, cell in enumerate(c for c in node if _plain(c.tag) == "c"):
                    kind, parts = cell.get("t"), {_plain(x.tag): x for x in cell}
                    value = _text(parts["is"]) if "is" in parts else (parts["v"].text if "v" in parts else None)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "b" and value is not None:
                        value = "true" if value == "1" else "false"
                    if value is not None:
                        own[_column(cell.get("r")) if cell.get("r") else place] = value
                rows.append(own)
                node.clear()
    head = rows[0] if rows else {}
    return [{head[k]: x for k, x in row.items() if k in head} for row in rows[1:]]


def sheets(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """file, row (from 0, below the head), cells (name to text) of a sheet, by number or name, of each workbook below a path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = cells_of(content, sheet)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, StopIteration) as bad:
                    raise ValueError(f"{file}: {bad!r}") from bad
                yield pd.DataFrame({"file": file, "row": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, CELLS)


def named(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """file, row and a column for each ``name: heading``; a heading that a sheet lacks, or an empty cell, gives null."""
    return cells.select("file", "row", *(F.try_element_at("cells", F.lit(h)).alias(n) for n, h in names.items()))
