"""Weighted edit distance, tries as arc tables, and beam search over pairs of automata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.operators.search import Prices, pair_distances
from morphlake.sources.tables import stored


def edit_costs(matrix: DataFrame) -> DataFrame:
    """src, dst, cost, op from cells (i, j, src, dst, cost) of a cost matrix whose row and column 0 stand for nothing.

    Row 0 holds insertions, column 0 deletions; the diagonal and cells without a cost are left out.
    """
    op = F.when(F.col("i") == 0, "insert").when(F.col("j") == 0, "delete").otherwise("substitute")
    return matrix.where((F.col("i") != F.col("j")) & F.col("cost").isNotNull() & ~F.isnan("cost")).select("src", "dst", "cost", op.alias("op"))


def matrix_cells(matrix: DataFrame, alphabet: list[str], column: str = "costs") -> DataFrame:
    """Cells of a matrix that is one row with an array of rows; the alphabet names rows and columns from 1 on."""
    names = F.array(F.lit(""), *map(F.lit, alphabet))
    rows = matrix.select(F.posexplode(column).alias("i", "row")).select("i", F.posexplode("row").alias("j", "cost"))
    return rows.select("i", "j", F.element_at(names, F.col("i") + 1).alias("src"), F.element_at(names, F.col("j") + 1).alias("dst"), "cost")


def weighted_distance(left: Column, right: Column, costs: list[tuple[str, str, float]] = (), insert: float = 1.0, delete: float = 1.0, substitute: float = 1.0, bound: float | None = 5.0) -> Column:
    """Least cost of edits from left to right, symbol by symbol; null beyond the bound (none if the bound is None or 0).

    costs: (source, target, cost); an empty source is an insertion, an empty target a deletion. They go before the defaults. Where every edit
    costs 1 and the bound is whole, that is the built-in distance.
    """
    if not costs and insert == delete == substitute == 1 and (not bound or bound == int(bound)):
        plain = F.levenshtein(left, right, int(bound)) if bound else F.levenshtein(left, right)
        return F.when(plain >= 0, plain).cast("double")
    prices = Prices(costs, insert, delete, substitute)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            known = (a.notna() & b.notna()).to_numpy()
            out = np.full(len(a), np.nan)
            out[known] = pair_distances(pa.array(a[known], pa.string()), pa.array(b[known], pa.string()), prices)
            near = known & (out <= bound) if bound else known
            yield pd.Series(out).astype(object).where(near, None).astype("Float64")

    return run(left, right)


def trie_arcs(words: DataFrame, column: str = "word") -> DataFrame:
    """state, label, next, final: arcs of the trie of distinct words; states are named by their prefixes, the first by the empty string. final: whether next is a word's end."""
    own = words.select(F.col(column).alias("w")).where(F.col("w").isNotNull()).distinct()
    at = own.select("w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("n")).where(F.length("w") > 0)
    each = at.select(F.expr("substring(w, 1, n - 1)").alias("state"), F.expr("substring(w, n, 1)").alias("label"), F.expr("substring(w, 1, n)").alias("next"), (F.col("n") == F.length("w")).alias("end"))
    return each.groupBy("state", "label", "next").agg(F.max("end").alias("final"))


def trie_csr(words: DataFrame, column: str = "word") -> DataFrame:
    """prefix, n_arcs, offset, final: states in order of their prefixes with the number of their arcs and of all arcs before.

    The running sum is taken in two passes: states are dealt out by range of prefix and stored, the sums of ranges are added up (a number for each
    partition), and each range counts on from what lies in front of it. No task orders all states, whatever letter they begin with.
    """
    arcs = trie_arcs(words, column)
    out = arcs.groupBy(F.col("state").alias("prefix")).agg(F.count("*").alias("n_arcs"))
    ends = arcs.where("final").select(F.col("next").alias("prefix"), F.lit(True).alias("final"))
    first = arcs.where("state = ''").select(F.lit("").alias("prefix")).distinct()
    states = arcs.select(F.col("next").alias("prefix")).unionByName(first)
    rows = states.join(out, "prefix", "left").join(ends, "prefix", "left").select("prefix", F.coalesce("n_arcs", F.lit(0)).cast("bigint").alias("n_arcs"), F.coalesce("final", F.lit(False)).alias("final"))
    ranges = stored(rows.repartitionByRange("prefix").withColumn("range", F.spark_partition_id()), "ranges")
    sums = sorted((r["range"], r["m"]) for r in ranges.groupBy("range").agg(F.sum("n_arcs").alias("m")).collect())
    bases = [(k, sum(m for _, m in sums[:i])) for i, (k, _) in enumerate(sums)]
    base = words.sparkSession.createDataFrame(bases, "range int, base long")
    before = F.sum("n_arcs").over(Window.partitionBy("range").orderBy("prefix")) - F.col("n_arcs")
    return ranges.withColumn("before", before).join(F.broadcast(base), "range").select("prefix", "n_arcs", (F.col("base") + F.col("before")).cast("bigint").alias("offset"), "final")


def linear_arcs(queries: DataFrame, column: str = "query") -> DataFrame:
    """q, ls, llabel, ln, lfinal: each query as an automaton of one path."""
    at = queries.select(F.col(column).alias("q")).distinct().select("q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("k")).where(F.length("q") > 0)
    return at.select("q", (F.col("k") - 1).alias("ls"), F.expr("substring(q, k, 1)").alias("llabel"), F.col("k").alias("ln"), (F.col("k") == F.length("q")).alias("lfinal"))


def beam_search(queries: DataFrame, words: DataFrame, num_beam: int = 5, fuzzy: bool = False, unique_only: bool = False, longest: int | None = None, costs: DataFrame | None = None, query_col: str = "query", word_col: str = "word") -> DataFrame:
    """q, labels, weight: for each query up to num_beam strings that both it and the words' trie accept, cheapest first; see beam_automata."""
    left = linear_arcs(queries, query_col).select("q", F.col("ls").cast("string").alias("ls"), "llabel", F.col("ln").cast("string").alias("ln"), "lfinal")
    right = trie_arcs(words, word_col).select(F.col("state").alias("rs"), F.col("label").alias("rlabel"), F.col("next").alias("rn"), F.col("final").alias("rfinal"))
    return beam_automata(left, right, num_beam, fuzzy, unique_only, longest, costs, ("0", ""))


def final_arcs(arcs: DataFrame, ends: DataFrame, side: str, *keys: str) -> DataFrame:
    """Arcs (state, label, next) and ends (state) as one side, l or r, of a beam search: xs, xlabel, xn, and whether xn is an end."""
    end = ends.select(*keys, F.col("state").alias("next"), F.lit(True).alias("end")).distinct()
    own = arcs.join(end, [*keys, "next"], "left")
    return own.select(*keys, F.col("state").alias(f"{side}s"), F.col("label").alias(f"{side}label"), F.col("next").alias(f"{side}n"), F.coalesce("end", F.lit(False)).alias(f"{side}final"))


def beam_automata(left: DataFrame, right: DataFrame, num_beam: int | None = 5, fuzzy: bool = False, unique_only: bool = False, longest: int | None = None, costs: DataFrame | None = None, start: tuple[str, str] = ("0", "")) -> DataFrame:
    """q, labels, weight: for each left automaton q up to num_beam strings that both it and the right one accept, cheapest first.

    left: q, ls, llabel, ln, lfinal; right: rs, rlabel, rn, rfinal; arcs without empty labels (see `automata.without_epsilon`), from the start states
    on; a num_beam of None keeps all. Either side may have cycles; with cycles on both, or on one in a fuzzy search, `longest` bounds the steps. Exact search advances on equal labels. Fuzzy search also substitutes, drops a query's label or adds one of the trie's, at cost 1 or as
    in costs (src, dst, cost; empty for nothing). After each step a query keeps its num_beam cheapest hypotheses, ties by label.
    One step is a few equality joins for all queries at once, stored before the next, until no hypothesis is alive or `longest` steps, if given, are done.
    An exact search takes the arcs of a right state at one step alone where it is a trie whose states are named by their prefixes: with a
    column `step` (from 1), each step reads its own arcs, and all steps together read the right side once.
    """
    by_step = "step" in right.columns
    if by_step and fuzzy:
        raise ValueError("a fuzzy search meets arcs at any step")
    left = stored(left, "left")
    right = stored(right.repartition("step", F.pmod(F.xxhash64("rs"), F.lit(16))), "right", "step") if by_step else stored(right, "right")
    spark = left.sparkSession
    price = (costs if costs is not None else spark.createDataFrame([], "src string, dst string, cost double")).select("src", "dst", F.col("cost").alias("price"))

    def priced(df: DataFrame, src: str, dst: str) -> DataFrame:
        return df.join(price.withColumnRenamed("src", src).withColumnRenamed("dst", dst), [src, dst], "left")

    schema = ["q", "ls", "rs", "weight", "labels", "lend", "rend"]
    live = left.select("q").distinct().select("q", F.lit(start[0]).alias("ls"), F.lit(start[1]).alias("rs"), F.lit(0.0).alias("weight"), F.lit("").alias("labels"), F.lit(False).alias("lend"), F.lit(False).alias("rend"))
    found = None
    for k in count(1) if longest is None else range(1, longest + 1):
        both = live.join(left, ["q", "ls"]).join(right.where(F.col("step") == k).drop("step") if by_step else right, "rs")
        if not fuzzy:
            new = both.where("llabel = rlabel").select("q", F.col("ln").alias("ls"), F.col("rn").alias("rs"), "weight", F.concat("labels", "rlabel").alias("labels"), F.col("lfinal").alias("lend"), F.col("rfinal").alias("rend"))
        else:
            change = priced(both, "llabel", "rlabel").select("q", F.col("ln").alias("ls"), F.col("rn").alias("rs"), (F.col("weight") + F.when(F.col("llabel") == F.col("rlabel"), 0.0).otherwise(F.coalesce("price", F.lit(1.0)))).alias("weight"), F.concat("labels", "rlabel").alias("labels"), F.col("lfinal").alias("lend"), F.col("rfinal").alias("rend"))
            drop = priced(live.join(left, ["q", "ls"]).withColumn("none", F.lit("")), "llabel", "none").select("q", F.col("ln").alias("ls"), "rs", (F.col("weight") + F.coalesce("price", F.lit(1.0))).alias("weight"), "labels", F.col("lfinal").alias("lend"), "rend")
            add = priced(live.join(right, "rs").withColumn("none", F.lit("")), "none", "rlabel").select("q", "ls", F.col("rn").alias("rs"), (F.col("weight") + F.coalesce("price", F.lit(1.0))).alias("weight"), F.concat("labels", "rlabel").alias("labels"), "lend", F.col("rfinal").alias("rend"))
            new = change.unionByName(drop).unionByName(add)
        keys = ["q", "labels"] if unique_only else ["q", "labels", "ls", "rs"]
        best = new.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("weight", "ls"))).where("k = 1")
        if num_beam is not None:
            best = best.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("weight", "labels", "ls"))).where(F.col("k") <= num_beam)
        live = stored(best.select(*schema), "beam")
        if live.isEmpty():
            break
        ends = live.where("lend and rend").select("q", "labels", "weight")
        found = ends if found is None else found.unionByName(ends)
    if found is None:
        return spark.createDataFrame([], "q string, labels string, weight double")
    best = found.groupBy("q", "labels").agg(F.min("weight").alias("weight"))
    if num_beam is None:
        return best
    return best.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("weight", "labels"))).where(F.col("k") <= num_beam).drop("k")


def beam_search_both_ways(queries: DataFrame, words: DataFrame, num_beam: int = 5, query_col: str = "query", word_col: str = "word", **options) -> DataFrame:
    """beam_search forwards and, over mirrored strings, backwards; the cheaper weight of each string, cut to num_beam."""
    ahead = beam_search(queries, words, num_beam, query_col=query_col, word_col=word_col, **options)
    back = beam_search(queries.select(F.reverse(query_col).alias(query_col)), words.select(F.reverse(word_col).alias(word_col)), num_beam, query_col=query_col, word_col=word_col, **options)
    both = ahead.unionByName(back.select(F.reverse("q").alias("q"), F.reverse("labels").alias("labels"), "weight"))
    best = both.groupBy("q", "labels").agg(F.min("weight").alias("weight"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("weight", "labels"))).where(F.col("k") <= num_beam).drop("k")


def random_transition_matrix(spark: SparkSession, alphabet: list[str], alpha: float, seed: int = 0, masked: tuple[int, ...] = ()) -> DataFrame:
    """src, dst, p: rows drawn from a symmetric Dirichlet distribution, without the diagonal and masked symbols, each summing to 1."""
    n = len(alphabet)
    p = np.random.default_rng(seed).dirichlet([alpha] * n, n)
    np.fill_diagonal(p, 0)
    p[list(masked)] = 0
    p[:, list(masked)] = 0
    total = p.sum(1, keepdims=True)
    p = np.divide(p, total, out=np.zeros_like(p), where=total > 0)
    return spark.createDataFrame([(a, b, float(p[i, j])) for i, a in enumerate(alphabet) for j, b in enumerate(alphabet)], "src string, dst string, p double")


def kl_from_uniform(rows: DataFrame, key: str = "src", p: str = "p") -> DataFrame:
    """key, kl: the divergence of each key's (normalised) distribution over its rows from the uniform one, in nats; 0 ln 0 is 0."""
    total, n = F.sum(p).over(Window.partitionBy(key)), F.count("*").over(Window.partitionBy(key))
    share = rows.select(key, (F.col(p) / total).alias("__p"), n.alias("__n"))
    return share.groupBy(key).agg(F.sum(F.when(F.col("__p") > 0, F.col("__p") * F.log(F.col("__p") * F.col("__n"))).otherwise(0.0)).alias("kl"))


def conditional_kl(rows: DataFrame, prior: DataFrame, key: str = "src", p: str = "p") -> DataFrame:
    """kl: mean over the keys of prior (key, prior) times the divergence from the uniform distribution."""
    return kl_from_uniform(rows, key, p).join(prior, key).agg(F.avg(F.col("prior") * F.col("kl")).alias("kl"))
