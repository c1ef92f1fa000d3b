"""Importance resampling towards a target: documents drawn by how much likelier their word runs are in the target than in the corpus."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import discard, row_key, small_batches, written
from morphlake.llm.wordruns import bounded, byte_kinds, chunks

#: Words are runs of digits, letters and whatever isn't ASCII.
KINDS = byte_kinds(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))
FEATURES = "doc_id {id}, k1 long, k2 long, chunk int, n_words long, n_features long, buckets binary"


def _buckets(words: pa.LargeStringArray, text: np.ndarray, own: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each run of 1 to `orders` words that starts at an owned word, runs of one length after the other."""
    bare = pc.utf8_slice_codeunits(words, 0, -1) if len(words) else words
    out, where, run = [], [], bare
    for m in range(1, orders + 1):
        n = len(words) - m + 1
        if n <= 0:
            break
        if m > 1:
            run = pc.binary_join_element_wise(run.slice(0, n), bare.slice(m - 1), pa.scalar(" ", pa.large_string()))
        coded = pc.dictionary_encode(run)
        known = np.array([zlib.crc32(w.encode()) % buckets for w in coded.dictionary.to_pylist()], np.int32)
        keep = own[:n] & (text[:n] == text[m - 1 :])
        out.append(known[coded.indices.to_numpy()][keep])
        where.append(text[:n][keep])
    return (np.concatenate(out), np.concatenate(where)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def features(texts: DataFrame, orders: int, buckets: int, size: int) -> DataFrame:
    """doc_id, k1, k2, chunk, n_words, n_features, buckets (32-bit numbers) of texts (doc_id, k1, k2, text): one row for a short text, with no chunk number.

    A text over `size` bytes is split at word boundaries with orders - 1 words carried over; its chunks go to tasks of their own
    and own the runs that start in them.
    """
    schema = FEATURES.format(id=texts.schema["doc_id"].dataType.simpleString())

    def emit(batches, chunk_at: int | None):
        source = small_batches(batches) if chunk_at else batches
        for batch, rows, words, _, text, own in bounded(source, 3, KINDS, 1 << 40 if chunk_at else 4 << 20):
            if chunk_at:
                carried = batch.column(chunk_at + 1).to_numpy()[rows]
                ends = np.searchsorted(text, np.arange(len(rows)), side="right")
                for k in np.flatnonzero(carried):
                    own[ends[k] - carried[k] : ends[k]] = False
            found, where = _buckets(words, text, own, orders, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(len(rows) + 1)).astype(np.int64)
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((cuts * 4).tobytes()), pa.py_buffer(found[order].astype(np.int32).tobytes())])
            own_words = np.bincount(text[own], minlength=len(rows))
            taken = pa.array(rows)
            number = batch.column(chunk_at).take(taken) if chunk_at else pa.nulls(len(rows), pa.int32())
            columns = [*(batch.column(k).take(taken) for k in range(3)), number, pa.array(own_words, pa.int64()), pa.array(np.diff(cuts), pa.int64()), values.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "chunk", "n_words", "n_features", "buckets"])

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(3)[row].as_py().encode()
                for k, _, behind, body in chunks(text, size, KINDS, 0, orders - 1):
                    fixed = [batch.column(c).slice(row, 1) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array([body.decode()]), pa.array([k], pa.int32()), pa.array([behind], pa.int32())], names=["doc_id", "k1", "k2", "text", "chunk", "carried"])

    long = F.octet_length("text") > size
    whole = texts.where(~long).mapInArrow(lambda b: emit(b, None), schema)
    kind = texts.schema["doc_id"].dataType.simpleString()
    parts = texts.where(long).mapInArrow(cut, f"doc_id {kind}, k1 long, k2 long, text string, chunk int, carried int")
    return whole.unionByName(parts.repartition("k1", "k2", "chunk").mapInArrow(lambda b: emit(b, 4), schema))


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket: added up in each task, then over tasks; the driver sees one number for each bucket."""

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), np.int32), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _keyed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    k1, k2 = row_key(id_col, text_col)
    return table.select(F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def weighed(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10000, size: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, n_features, weight of every row of docs, the stored table that this is read from).

    A weight is the sum over a document's features of how much likelier the target has them. Repeated rows are each there; null and empty
    texts have no features and weight 0; an empty target is a uniform one.
    """
    own = written(features(_keyed(docs, id_col, text_col), orders, buckets, size), "features")
    corpus, aim = bucket_counts(own, buckets), bucket_counts(features(_keyed(target, target_id, target_text), orders, buckets, size), buckets)
    s, t = corpus.astype(np.float64), aim.astype(np.float64)
    gains = np.array([np.floor(1000 * math.log((t[k] + 1) * (s.sum() + buckets) / ((s[k] + 1) * (t.sum() + buckets)))) for k in range(buckets)]).astype(np.int64)
    kind = own.schema["doc_id"].dataType.simpleString()

    def weigh(batches):
        for batch in batches:
            value = [int(gains[np.frombuffer(v.as_buffer(), np.int32)].sum()) for v in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(value, pa.int64())], names=[*batch.schema.names[:6], "weight"])

    schema = f"doc_id {kind}, k1 long, k2 long, chunk int, n_words long, n_features long, weight long"
    sums = ["n_words", "n_features", "weight"]
    whole = own.where("chunk IS NULL").mapInArrow(weigh, schema).select("doc_id", *sums)
    parts = own.where("chunk IS NOT NULL").mapInArrow(weigh, schema).groupBy("doc_id", "k1", "k2").agg(*(F.sum(c).alias(c) for c in sums), F.count_if(F.col("chunk") == 0).alias("copies"))
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *(F.expr(f"{c} div copies").alias(c) for c in sums))
    return whole.unionByName(parts), own


def draw_key(id_col: Column, seed: str = "2024") -> Column:
    """A Gumbel variate of an id, in thousandths: the greatest sums with the log weights are a draw without replacement."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; of those with at least `least_words` words the floor(percent * N / 100) of greatest score are drawn.

    Ranks run from 1 by score, ties to the smaller id (null ids last, equal rows in any order); what isn't drawn has none. Scores are dealt
    out by range, so ranks are counts of the ranges in front and places within one: no task orders all documents.
    """
    found, own = weighed(docs, target, id_col=id_col, **options)
    scored = found.withColumn("score", F.col("weight") + draw_key(F.col("doc_id"))).withColumn("key", F.when(F.col("n_words") >= least_words, F.col("score")))
    order = [F.col("key").desc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    slots = written(scored.repartitionByRange(*order).withColumn("slot", F.spark_partition_id()), "scored")
    discard(own)
    sizes = {r["slot"]: r["n"] for r in slots.where("key IS NOT NULL").groupBy("slot").agg(F.count("*").alias("n")).collect()}  # a number for each partition
    drawn, before, bases = percent * sum(sizes.values()) // 100, 0, []
    for slot in sorted(sizes):
        bases.append((slot, before))
        before += sizes[slot]
    base = docs.sparkSession.createDataFrame(bases, "slot int, base long")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(*order))
    ranked = slots.withColumn("place", place).join(F.broadcast(base), "slot", "left").withColumn("rank", F.col("base") + F.col("place"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("key").isNotNull() & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))
