"""Helpers that several operators share: cut lineage, connected components, byte hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks a null id behind all others.
LAST = 9223372036854775807


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a local session names none, as in tests, a folder of our own is set; on a cluster that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='morphlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(table: DataFrame) -> None:
    """Deletes a written table that nothing will read again: all that came from it must be written itself by now."""
    spark, path = table.sparkSession, _PATHS.pop(table)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a row by its id and text (null as empty); rows alike in both share them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.col(id_col), text), F.xxhash64(F.lit(1), F.col(id_col), text)


#: Rows of a table that one task may as well hold: below, iterations over it need no exchange.
FEW = 15000


def together(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition if it has so few rows that dealing them out costs more than it saves; else as it is."""
    return df.coalesce(1) if rows <= FEW else df


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that links reach.

    Alternating large-star and small-star rounds; every round is a grouped minimum and an
    equi-join, so a node of any degree is split by partial aggregation and skew joins. Goes on until
    a round changes nothing, however long a chain of links is (a checksum of the edge set is the only thing the driver sees).
    """
    pairs = written(edges.select("a", "b").where("a <> b").distinct(), name)
    check = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen, now = None, pairs.agg(*check).first()
    while now != seen and now[0]:
        seen = now
        pairs = together(pairs, 2 * now[0])
        either = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
        both = pairs.select(either).select("p.a", "p.b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every greater neighbour is tied to the smallest one
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p")
        pairs = written(down.join(least, "a").select(tied).select("p.a", "p.b").where("a <> b").distinct(), name)
        now = pairs.agg(*check).first()
    star = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


#: An odd multiplier for polynomial hashes modulo 2**64 and the finaliser's constants.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scrambled, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of an Arrow string column; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]] if len(ends) else data[:0], ends - ends[0]


def small_batches(batches, most: int = 4 << 20):
    """Arrow batches cut by rows so that each holds about `most` bytes, or one row."""
    for batch in batches:
        n, size = batch.num_rows, max(1, batch.nbytes)
        if not n:
            continue
        step = max(1, int(n * most / size))
        for at in range(0, n, step):
            yield batch.slice(at, step)
