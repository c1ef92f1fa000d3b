"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import unused, written

#: Fixed value: the characters that normalisation deletes.
SPACES = r"[\x20\x09-\x0D]+"


def _rank(length: Column, ident: Column) -> Column:
    """One number that is greatest for the longest text, then for the smallest id (a null id ranks last)."""
    below = F.lit(9223372036854775807).cast("decimal(20,0)") - ident.cast("decimal(20,0)")
    return length.cast("decimal(11,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") + F.coalesce(below, F.lit(-1).cast("decimal(20,0)"))


def _ident(rank: Column) -> Column:
    rest = F.pmod(rank + F.lit(1), F.lit("20000000000000000000").cast("decimal(38,0)"))
    return F.when(rest > 0, F.lit("9223372036854775808").cast("decimal(38,0)") - rest).cast("bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after white space is deleted. Of equal texts the longest
    original stays, then the smallest id. A digest names a group, and full content is part of the
    key in each stage: rows combine inside their map task, then by (digest, content, salt), then
    the salts' winners by (digest, content). So a group of any size reaches a task as at most one
    row for each map task and salt. Rows learn their winner by a join on the digest; only where
    one digest stands for several contents (a SHA-256 collision) the full content is part of that join too.

    Null text counts as empty; empty texts are one group. A null id is allowed: it ranks last, and
    with equal ids the group is still counted by rows (every row of the smallest id is kept).
    Very long texts are keys like others. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.regexp_replace(text, SPACES, "")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.length(text).alias("length"),
        body.alias("content"),
    ).withColumn("text_sha256", F.sha2("content", 256))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_sha256", "content", "salt")
        .agg(F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best"), F.count("*").alias("n"))
    )
    classes = salted.groupBy("text_sha256", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    light = written(classes.select("text_sha256", _ident(F.col("best")).alias("keep_id"), "group_size"), "exact")
    twins = written(light.groupBy("text_sha256").count().where("count > 1").select("text_sha256"), "twins")
    # a digest with one class has one content, as classes were told apart by content
    out = rows.select("doc_id", "text_sha256").join(light, "text_sha256")
    if not twins.isEmpty():
        own = classes.join(twins, "text_sha256", "left_semi").select("text_sha256", "content", _ident(F.col("best")).alias("keep_id"), "group_size")
        again = rows.join(twins, "text_sha256", "left_semi").join(own, ["text_sha256", "content"])
        out = out.join(twins, "text_sha256", "left_anti").unionByName(again.select(out.columns))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they were; a row goes by its id and its own text's class."""
    ident, digest = unused(docs, "__id"), unused(docs, "__digest")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, ""), 256)
    on = F.col(id_col).cast("bigint").eqNullSafe(F.col(ident)) & (own == F.col(digest))
    return docs.join(kept, on, "left_semi")
