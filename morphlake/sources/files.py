"""Grammar files and spreadsheets as Spark tables: listed and read by Spark, parsed where they are read."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.sources.grammar import FOLDERS, Grammar, problem
from morphlake.sources.schemas import Schemas
from morphlake.sources.tables import exists

FILES = "kind string, name string, is_valid boolean, error string, data string"


def located(path: str) -> str:
    """A path with its file system; one without is local."""
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else Path(path).absolute().as_uri()


def contents(spark: SparkSession, paths: Iterable[str], pattern: str) -> DataFrame:
    """path, content of the files of folders, or of single files, by Spark's own listing; what isn't there gives no rows."""
    found = [p for p in map(located, paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(found).select("path", "content")


def grammar_files(spark: SparkSession, path: str, kind: str | None = None, name: str | None = None) -> DataFrame:
    """kind, name, is_valid, error, data (JSON) of a grammar's files: all, those of one kind, or a single one.

    Only folders and files that are asked for are listed and read. A kind that there isn't gives no rows.
    """
    kinds = [k for k in FOLDERS if kind in (None, k)]
    end = f"/{name.removeprefix('$').removesuffix('.yaml')}.yaml" if name else ""
    raw = contents(spark, [f"{path.rstrip('/')}/{FOLDERS[k]}/{k}{end}" for k in kinds], "*.yaml")

    def parse(batches):
        import yaml

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                own, stem = file.rsplit("/", 2)[-2], file.rsplit("/", 1)[-1].removesuffix(".yaml")
                try:
                    data = yaml.safe_load(bytes(content).decode("utf-8"))
                    error = problem(own, data)
                except (yaml.YAMLError, UnicodeDecodeError) as e:
                    data, error = None, f"not YAML: {e}"
                rows.append((own, stem, error is None, error, json.dumps(data, default=str)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FILES.split(", ")])

    return raw.mapInPandas(parse, FILES)


def read_grammar(spark: SparkSession, path: str) -> Grammar:
    """The grammar of a folder on any file system that Spark reads; its files, which don't grow with data, come to the driver parsed."""
    files: dict[str, dict[str, dict]] = {}
    invalid: dict[str, dict[str, str]] = {}
    order = {k: i for i, k in enumerate(FOLDERS)}
    for r in sorted(grammar_files(spark, path).collect(), key=lambda r: (order[r["kind"]], r["name"])):
        if r["is_valid"]:
            files.setdefault(r["kind"], {})[r["name"]] = json.loads(r["data"])
        else:
            invalid.setdefault(r["kind"], {})[r["name"]] = r["error"]
    return Grammar(path, files, invalid)


def schema_report(spark: SparkSession, path: str, schemas: str) -> DataFrame:
    """kind, name, path, error: what of a grammar's files breaks the JSON schemas of a folder (one file for each kind)."""
    loaded = {r["path"].rsplit("/", 1)[-1]: json.loads(bytes(r["content"])) for r in contents(spark, [schemas], "*.json").collect()}
    rules = Schemas(loaded)

    def check(batches):
        for batch in batches:
            rows = [(k, n, p, e) for k, n, d in zip(batch["kind"], batch["name"], batch["data"], strict=True) if k in rules.files for p, e in rules.errors(k, json.loads(d))]
            yield pd.DataFrame(rows, columns=["kind", "name", "path", "error"])

    return grammar_files(spark, path).where("NOT startswith(coalesce(error, ''), 'not YAML')").select("kind", "name", "data").mapInPandas(check, "kind string, name string, path string, error string")


def _column(reference: str) -> int:
    """The number of a cell's column from its name, such as BC12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[list[str]]:
    """The first sheet of a workbook as rows of strings; cells that aren't there are empty."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = [text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(e) == "si"] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        sheet = ElementTree.fromstring(book.read(first))
    rows = []
    for row in (e for e in sheet.iter() if local(e) == "row"):
        own: list[str] = []
        for cell in (e for e in row if local(e) == "c"):
            at = _column(cell.attrib["r"]) if "r" in cell.attrib else len(own)
            value = next((e.text or "" for e in cell if local(e) == "v"), "")
            value = text(cell) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value
            own += [""] * (at - len(own)) + [value]
        rows.append(own)
    return rows


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """at, cells (map by the names of the first row) of a workbook's rows, parsed by the task that reads the file."""

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                head, *rows = sheet_rows(bytes(content)) or [[]]
                yield pd.DataFrame({"at": range(len(rows)), "cells": [dict(zip(head, [*own, *[""] * len(head)])) for own in rows]})

    return contents(spark, [path], "*.xlsx").select("content").mapInPandas(parse, "at int, cells map<string,string>")
