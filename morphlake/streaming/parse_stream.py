"""Extension: parsing a stream of forms against a stored relation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from morphlake.operators.paradigm import parse


def parse_stream(forms: DataFrame, relation: DataFrame) -> DataFrame:
    """A streaming DataFrame of forms joined to the static relation: stateless, so each micro-batch is one equality join."""
    return parse(relation, forms)


def start_parsing(forms: DataFrame, relation: DataFrame, path: str, checkpoint: str):
    """Writes analyses as Parquet; a restart goes on where the checkpoint says."""
    return parse_stream(forms, relation).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
