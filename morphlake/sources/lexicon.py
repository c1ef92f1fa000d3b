"""Lexicon tables: one CSV file for each part of speech, all columns as strings."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.sources.files import located, spreadsheet
from morphlake.sources.grammar import Grammar
from morphlake.sources.tables import exists


def columns_of(grammar: Grammar, part_of_speech: str) -> list[str]:
    data = grammar.parts_of_speech[part_of_speech.removeprefix("$")]
    return ["root", "gloss", *map(str, data.get("lexical_features") or ()), *map(str, data.get("principal_parts") or ())]


def lexicon_path(grammar: Grammar, part_of_speech: str) -> str:
    name = part_of_speech.removeprefix("$").removesuffix(".csv").removesuffix(".xlsx")
    return f"{grammar.path.rstrip('/')}/Lexicon/Wordlists/{name}.csv"


def load_lexicon(spark: SparkSession, grammar: Grammar, part_of_speech: str) -> DataFrame:
    """The words of a part of speech; no rows if it has no file. A spreadsheet is preferred. Files may be on any file system that Spark reads."""
    names = columns_of(grammar, part_of_speech)
    path = located(lexicon_path(grammar, part_of_speech))
    sheet = path.removesuffix(".csv") + ".xlsx"
    if exists(spark, sheet):
        return spreadsheet(spark, sheet).select(*(F.col("cells")[n].alias(n) for n in names))
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    found = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return found.select(*(F.col(f"`{n}`") if n in found.columns else F.lit(None).cast("string").alias(n) for n in names))


def init_lexicon(spark: SparkSession, grammar: Grammar, part_of_speech: str) -> str:
    """Writes a lexicon file with a header only, if there is none; its path."""
    path = Path(lexicon_path(grammar, part_of_speech))
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(",".join(columns_of(grammar, part_of_speech)) + "\n", encoding="utf-8")
    return str(path)


def roots(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("root")


def with_features(lexicon: DataFrame, features: dict[str, str]) -> DataFrame:
    """Rows whose lexical features have the values given; plain comparisons, which reach a Parquet scan."""
    return lexicon.where(reduce(Column.__and__, (F.col(f) == F.lit(str(v)) for f, v in features.items()), F.lit(True)))


def with_gloss(lexicon: DataFrame, gloss: str) -> DataFrame:
    return lexicon.where(F.col("gloss") == gloss).select("root")


def first_rows(lexicon: DataFrame, order: str | None = None) -> DataFrame:
    """The first row of each root, by the order column (file order if none is given)."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col(order) if order else F.monotonically_increasing_id()))
    return lexicon.withColumn("__k", rank).where("__k = 1").drop("__k")


def principal_part(lexicon: DataFrame, part: str, fallback_to_root: bool = True) -> DataFrame:
    """root, stem: the principal part of every row, blank ones replaced by the root."""
    stem = F.nullif(F.col(part), F.lit(""))
    return lexicon.select("root", (F.coalesce(stem, "root") if fallback_to_root else stem).alias("stem"))


def features_of(lexicon: DataFrame, names: list[str]) -> DataFrame:
    """root, features: lexical features of each root's first row."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n))]
    return first_rows(lexicon).select("root", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("features"))
