"""Nearest neighbours by inner product: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from morphlake.llm.common import written


@dataclass
class Index:
    """Coarse centres (k, d) and 16 code words for each of the d / width stretches of the residual: (stretches, 16, width).

    spread is what coding leaves of each stretch in the fitted vectors, as a mean square for one number.
    """

    centres: np.ndarray
    words: np.ndarray
    eta: float
    spread: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norm = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norm - 2 * x[at : at + 4096] @ centres.T).argmin(1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def encode(x: np.ndarray, centre: np.ndarray, words: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes (n, stretches) of least loss: the residual's part along x counts eta times, that across it once.

    Starts from the nearest word of each stretch and goes over the stretches, each time with the others fixed.
    """
    n, (stretches, _, width) = len(x), words.shape
    rest = (x - centre).reshape(n, stretches, width)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, stretches, width)
    codes = np.stack([_nearest(rest[:, m], words[m]) for m in range(stretches)], 1)
    error = rest - words[np.arange(stretches), codes]
    along = (error * unit).sum((1, 2))
    for _ in range(rounds):
        for m in range(stretches):
            others = along - (error[:, m] * unit[:, m]).sum(1)
            tries = rest[:, m, None] - words[m][None]
            par = others[:, None] + (tries * unit[:, m, None]).sum(2)
            codes[:, m] = ((tries**2).sum(2) + (eta - 1) * par**2).argmin(1)
            error[:, m] = rest[:, m] - words[m][codes[:, m]]
            along = others + (error[:, m] * unit[:, m]).sum(1)
    return codes


def train(x: np.ndarray, k: int, width: int = 2, threshold: float = 0.2, seed: int = 7, rounds: int = 4) -> Index:
    """Centres by k-means; words by turns of score-aware coding and weighted least squares.

    eta follows from the threshold on the cosine over which scores matter: the expected share of a
    residual's effect on such scores that comes from its part along the vector.
    """
    rng, d = np.random.default_rng(seed), x.shape[1]
    width = next(w for w in (width, 1) if d % w == 0)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    centres = _kmeans(x, k, rng)
    centre = centres[_nearest(x, centres)]
    rest = (x - centre).reshape(len(x), -1, width)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), -1, width)
    words = np.zeros((rest.shape[1], 16, width))
    for m in range(rest.shape[1]):
        own = _kmeans(rest[:, m], 16, rng, 6)
        words[m, : len(own)] = own
        words[m, len(own) :] = own[0]
    for _ in range(rounds):
        codes = encode(x, centre, words, eta, 1)
        error = rest - words[np.arange(len(words)), codes]
        along = (error * unit).sum((1, 2))
        for m in range(len(words)):
            others = along - (error[:, m] * unit[:, m]).sum(1)
            u = unit[:, m]
            left = np.eye(width)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
            right = rest[:, m] + (eta - 1) * u * ((u * rest[:, m]).sum(1) + others)[:, None]
            for c in range(16):
                own = codes[:, m] == c
                if own.any():
                    words[m, c] = np.linalg.solve(left[own].sum(0), right[own].sum(0))
            error[:, m] = rest[:, m] - words[m][codes[:, m]]
            along = others + (error[:, m] * u).sum(1)
    codes = encode(x, centre, words, eta)
    return Index(centres, words, eta, ((rest - words[np.arange(len(words)), codes]) ** 2).mean((0, 2)))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, top: int = 20, every: int = 20, probes: float = 1.0, least_probes: int = 16, rerank: int = 10, sample: int = 20000, block: int = 65536, margin: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the `top` rows of greatest inner product, its own row aside.

    Equal vectors are one entry with their smallest top + 1 ids, as many as can be asked for. The index is
    fitted on at most `sample` entries (least hash first) and holds all, each with the length of what its code leaves of it. A cell is
    left out for a query only if no vector within its radius can reach what the fitted entries reach already (and, with `probes` below 1,
    beyond that share of the cells, `least_probes` at least). The codes of the others are scanned by tables of 16 sums a stretch. In each part, the best
    rerank * top entries meet their original vectors, and so does every other one that `margin` deviations of its own coding error could bring
    among the top; double-precision inner products decide, ties to the smaller id. Cells are scanned in parts of about `block`
    entries (fewer if they are long) and in groups of queries, so no cell makes a task of unbounded size.

    Vectors that are null, all zero, of another length than most, or hold null or non-finite components
    take no part, nor do rows with a null id; rows that repeat (one id, one vector) count once.
    With no vectors the result is empty.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0))
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, block = sizes["d"], min(block, max(1024, (8 << 20) // sizes["d"]))
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"  # how original vectors are packed
    rows = rows.where(F.size("v") == d).dropDuplicates(["id", "v"]).withColumn("e", F.xxhash64("v"))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("e", "v").orderBy("id"))).where(F.col("k") <= top + 1)
    entries = written(few.groupBy("e", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    count = entries.count()
    fitted = np.array([r["v"] for r in entries.orderBy(F.xxhash64("e", F.lit(1))).limit(sample).select("v").collect()])
    cells = max(1, min(len(fitted) // 39 or 1, round(count**0.5)))
    shared = spark.sparkContext.broadcast((train(fitted, cells), fitted[: max(1024, (1 << 20) // d)]))
    asked = min(cells, max(least_probes, round(probes * cells)))

    def code(batches):
        import pyarrow as pa

        index, _ = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            cell = _nearest(x, index.centres)
            rest = x - index.centres[cell]
            codes = encode(x, index.centres[cell], index.words, index.eta)
            left = np.linalg.norm(rest - index.words[np.arange(codes.shape[1]), codes].reshape(len(x), d), axis=1)
            codes = codes.astype(np.uint8)
            if codes.shape[1] % 2:
                codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
            packed = codes[:, ::2] | codes[:, 1::2] << 4
            columns = [pa.array(cell.astype(np.int32)), batch.column(0), batch.column(2), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(left), pa.array(np.linalg.norm(rest, axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "e", "id", "codes", "x", "left", "away"])

    coded = written(entries.select("e", "v", F.col("ids")[0].alias("id")).mapInArrow(code, "cell int, e long, id long, codes binary, x binary, left double, away double"), "codes")
    # at most sample / 39 cells: neighbouring ones make up a part of about `block` entries, a larger one several
    part, parts, filled, radius = {}, 0, 0, np.zeros(cells)
    for r in sorted(coded.groupBy("cell").agg(F.count("*").alias("count"), F.max("away").alias("away")).collect()):
        radius[r["cell"]] = r["away"]
        own = -(-r["count"] // block)
        if own > 1 or filled + r["count"] > block:
            parts, filled = parts + bool(filled), 0
        part[r["cell"]] = (parts, own)
        parts, filled = (parts + own, 0) if own > 1 else (parts, filled + r["count"])
    asking = rows.where(F.col("id") % every == 0).select("id", "v")
    n_asking = asking.count()
    groups = max(1, min(n_asking // 32, -(-24 // (parts + 1))), -(-n_asking // 16384))  # of queries

    def probe(batches):
        import pyarrow as pa

        index, known = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            near, length = x @ index.centres.T, np.linalg.norm(x, axis=1)
            best = np.argpartition(-near, asked - 1, axis=1)[:, :asked]
            reached = np.full(len(x), -np.inf)
            if len(known) > top:  # one may be the query's own
                for at in range(0, len(x), 1024):
                    reached[at : at + 1024] = np.partition(x[at : at + 1024] @ known.T, len(known) - top - 1, axis=1)[:, len(known) - top - 1]
            reach = near + length[:, None] * radius * (1 + 1e-9) + 1e-9 * np.abs(reached)[:, None]
            row, to, cells_of = [], [], []
            for k, own in enumerate(best):
                by: dict[int, list[int]] = {}
                for c in own[reach[k, own] >= reached[k]].tolist():
                    first, more = part.get(c, (0, 0))
                    for p in range(first, first + more):
                        by.setdefault(p, []).append(c)
                row += [k] * len(by)
                to += by
                cells_of += by.values()
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), batch.column(1).take(pa.array(row, pa.int64())), pa.array(cells_of, pa.list_(pa.int32()))], ["part", "q", "v", "cells"])

    sent = asking.mapInArrow(probe, "part int, q long, v array<double>, cells array<int>").withColumn("turn", F.pmod(F.xxhash64("q"), F.lit(groups)))
    places = spark.createDataFrame([(c, p, n) for c, (p, n) in part.items()], "cell int, first int, nb int")
    held = coded.join(F.broadcast(places), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("e"), F.col("nb"))).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    take, kept = rerank * top, 2 * top

    def scan(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(queries) and len(codes):
            index, _ = shared.value
            raw = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(len(codes), -1)
            original = np.frombuffer(b"".join(codes["x"]), kind).reshape(len(codes), d)
            stretches, _, width = index.words.shape
            four = np.empty((raw.shape[1] * 2, len(codes)), np.intp)
            four[::2], four[1::2] = (raw & 15).T, (raw >> 4).T
            cell, e, first = codes["cell"].to_numpy(), codes["e"].to_numpy(), codes["id"].to_numpy()
            usual = np.sqrt(max(index.spread.sum() * width, 1e-300))
            left = (codes["left"].to_numpy() / usual).astype(np.float32)
            n = min(take, len(e))
            for at in range(0, len(queries), 64):
                some = queries.iloc[at : at + 64]
                x = np.array(some["v"].tolist())
                stretched = x.reshape(len(x), stretches, width)
                tables = np.einsum("qmw,mcw->mcq", stretched, index.words).astype(np.float32)
                near = (x @ index.centres.T).T.astype(np.float32)[cell]
                for m in range(stretches):
                    near += tables[m][four[m]]
                probed = np.zeros((len(index.centres), len(x)), bool)
                for k, own in enumerate(some["cells"]):
                    probed[own, k] = True
                near[~probed[cell]] = -np.inf
                # the coding error along a query: by stretch in the fitted vectors, at its own length in each entry
                spread = margin * np.sqrt(np.maximum((stretched**2).sum(2) @ index.spread, 0))
                for k, q in enumerate(some["q"].to_numpy()):
                    own = np.ascontiguousarray(near[:, k])
                    best = np.argpartition(-own, n - 1)[:n]
                    best = best[np.isfinite(own[best])]
                    if len(best) > top:
                        least = np.partition(original[best].astype(np.float64) @ x[k], len(best) - top - 1)[len(best) - top - 1]
                        slack = 1e-5 * np.abs(own[best]).max()  # sums of four bytes
                        best = np.union1d(best, np.flatnonzero(own + np.float32(spread[k]) * left >= least - slack))
                    score = original[best].astype(np.float64) @ x[k]
                    best, score = (y[np.lexsort((first[best], -score))[:kept]] for y in (best, score))
                    for to, new in zip(out, (np.full(len(best), q), e[best], first[best], score), strict=True):
                        to.append(new)
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("q", "e", "first", "near"), out, strict=True)})

    near = sent.select("part", "turn", "q", "v", "cells").groupBy("part", "turn").cogroup(held.select("part", "turn", "cell", "e", "id", "codes", "x", "left").groupBy("part", "turn")).applyInPandas(scan, "q long, e long, first long, near double")
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "first"))).where(F.col("k") <= kept).select("q", "e")
    exact = chosen.join(entries.select("e", F.col("v").alias("x"), "ids"), "e").join(rows.where(F.col("id") % every == 0).select(F.col("id").alias("q"), "v"), "q")
    dot = F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = exact.select("q", dot.alias("score"), F.explode("ids").alias("vec_id")).where(F.col("q") != F.col("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
