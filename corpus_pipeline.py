"""From raw documents to training sequences: STAGES in order, each over what the one before has kept.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns are taken as the operators' docstrings say: null,
empty and letterless texts go in the first stage; from then on rows go by id and text together, rows alike in both are treated alike, and an
empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from morphlake.llm.common import written
from morphlake.llm.jaccard_join import keep_one
from morphlake.llm.language_id import fit, keep_known
from morphlake.llm.line_dedup import delete_repeated_runs
from morphlake.llm.mixing import sample
from morphlake.llm.packing import pack
from morphlake.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; texts without letters, of no clear language, or that no language codes as it does its own, go."""
    return keep_known(docs, fit(docs, most=400, hold=5), least=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three or more lines in a row go, and of fewer that have 50 words or more; n_chars stays that of the original text."""
    return delete_repeated_runs(docs, run=3, words=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 hold together."""
    return keep_one(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of over-represented sources, languages and topics are thinned out, those of rare ones repeated, to the target weights."""
    return sample(docs, rate=1.0, rounds=12)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4,096 tokens."""
    return pack(docs, tokenizer_path(), size=4096, segments=256)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express language identification and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
