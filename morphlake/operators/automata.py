"""Patterns as automata tables: matching without backtracking, and intersection, difference, emptiness and shortest strings as joins.

An automaton is two tables, arcs (state, label, next) and ends (state), with one start state; where several are worked on at once, a column `a`
tells them apart. A trie of words is one, whose states are its prefixes; `Automaton.of(pattern).tables` is another.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.derivatives import Automaton
from morphlake.operators.edit import trie_arcs
from morphlake.sources.tables import discard, stored

__all__ = ["Automaton", "minimal", "n_shortest", "only_string", "product", "trie", "without_epsilon"]

def trie(words: DataFrame, column: str = "word") -> tuple[DataFrame, DataFrame]:
    """(arcs, ends) of the trie of distinct words; the start is the empty string, which is an end if it is a word."""
    arcs = trie_arcs(words, column)
    ends = arcs.where("final").select(F.col("next").alias("state"))
    return arcs.select("state", "label", "next"), ends.unionByName(words.where(F.col(column) == "").select(F.lit("").alias("state")).distinct())


def without_epsilon(arcs: DataFrame, ends: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Arcs and ends of the same strings without arcs whose label is empty or null; keys tell automata apart.

    What a state reaches without a symbol is a fixed point of joins; it takes over the arcs of those states, and is an end if one of them is.
    """
    silent = F.coalesce(F.col("label"), F.lit("")) == ""
    free = arcs.where(silent).select(*keys, F.col("state").alias("mid"), F.col("next").alias("to")).distinct()
    reach = stored(arcs.where(silent).select(*keys, "state", F.col("next").alias("to")).distinct(), "reach")
    fresh = reach
    while not fresh.isEmpty():
        more = fresh.select(*keys, "state", F.col("to").alias("mid")).join(free, [*keys, "mid"]).select(*keys, "state", "to").distinct()
        fresh = stored(more.join(reach, [*keys, "state", "to"], "left_anti"), "reach")
        reach = stored(reach.unionByName(fresh), "reach")
    own = arcs.where(~silent).select(*keys, "state", "label", "next")
    taken = reach.join(own.withColumnRenamed("state", "to"), [*keys, "to"]).select(*keys, "state", "label", "next")
    last = reach.join(ends.select(*keys, F.col("state").alias("to")), [*keys, "to"]).select(*keys, "state")
    return own.unionByName(taken).distinct(), ends.select(*keys, "state").unionByName(last).distinct()


def product(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], minus: bool = False, start: tuple[str, str] = ("", "0")) -> tuple[DataFrame, DataFrame]:
    """(arcs, ends) of what both automata accept, or what the left one does and the right one doesn't; states are (l, r), r null where the right one is lost.

    Pairs of states are reached level by level: the new ones join both tables of arcs on the label, until there are none. The right one is deterministic.
    """
    a = stored(left[0].select(F.col("state").alias("l"), "label", F.col("next").alias("l2")), "left")  # every level reads it: a trie is built once
    b = right[0].select(F.col("state").alias("r"), "label", F.col("next").alias("r2"))
    spark = a.sparkSession
    fresh = seen = stored(spark.createDataFrame([start], "l string, r string"), "pairs")
    parts = []
    for _ in count():
        step = fresh.join(a, "l").join(b, ["r", "label"], "left" if minus else "inner").select("l", "r", "label", "l2", "r2")
        parts.append(stored(step, "product"))
        found = parts[-1].select(F.col("l2").alias("l"), F.col("r2").alias("r")).distinct().alias("f")
        same = (F.col("f.l") == F.col("s.l")) & F.col("f.r").eqNullSafe(F.col("s.r"))
        fresh = stored(found.join(seen.alias("s"), same, "left_anti"), "pairs")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)  # stored tables all
    arcs = parts[0]
    for p in parts[1:]:
        arcs = arcs.unionByName(p)
    ends = seen.join(left[1].select(F.col("state").alias("l")), "l").join(right[1].select(F.col("state").alias("r"), F.lit(True).alias("end")), "r", "left")
    return arcs, ends.where(F.coalesce("end", F.lit(False)) != F.lit(minus)).select("l", "r")


def n_shortest(arcs: DataFrame, ends: DataFrame, n: int, start: str = "") -> DataFrame:
    """a, string, rank: the n shortest strings of each deterministic automaton a, by length and then in order; of an infinite one too.

    How far each state is from an end is a fixed point of joins backwards. Then prefixes grow by a symbol at a time, of which each automaton keeps the n
    with the shortest completions, ties in order: whatever others complete to comes behind those. It stops once n strings are out and
    no prefix can be shorter.
    """
    back = stored(arcs.select("a", F.col("next").alias("state"), F.col("state").alias("from")).distinct(), "back")
    far = fresh = stored(ends.select("a", "state").distinct().withColumn("far", F.lit(0)), "far")
    for d in count(1):
        more = fresh.join(back, ["a", "state"]).select("a", F.col("from").alias("state")).distinct()
        fresh = stored(more.join(far, ["a", "state"], "left_anti").withColumn("far", F.lit(d)), "far")
        if fresh.isEmpty():
            break
        far = far.unionByName(fresh)  # stored tables all
    moves = stored(arcs.join(far.select("a", F.col("state").alias("next"), "far"), ["a", "next"]).select("a", "state", "label", "next", "far"), "moves")
    live = stored(far.where(F.col("state") == start).select("a", "state", F.lit("").alias("string"), "far"), "live")
    done = stored(live.where("far = 0").select("a", "string"), "done")
    order = Window.partitionBy("a").orderBy("far", "string")
    for k in count(1):
        grown = live.select("a", "state", "string").join(moves, ["a", "state"]).select("a", F.col("next").alias("state"), F.concat("string", "label").alias("string"), "far")
        best = grown.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")
        out = done.groupBy("a").agg(F.count("*").alias("out"))
        after = stored(best.join(out, "a", "left").where(F.coalesce("out", F.lit(0)) < n).drop("out"), "live")
        discard(live)
        live = after
        ended = live.join(ends.select("a", "state").distinct(), ["a", "state"], "left_semi").select("a", "string")
        done, before = stored(done.unionByName(ended), "done"), done
        discard(before)
        if live.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.length("string"), "string"))
    return done.withColumn("rank", rank).where(F.col("rank") <= n)


def only_string(arcs: DataFrame, ends: DataFrame, start: str = "") -> DataFrame:
    """a, string: the string of each automaton that accepts exactly one; any other that accepts something is an error."""
    own = n_shortest(arcs, ends, 2, start).groupBy("a").agg(F.count("*").alias("n"), F.min("string").alias("string"))
    return own.select("a", F.when(F.col("n") == 1, F.col("string")).otherwise(F.raise_error(F.concat(F.lit("more than one string: "), "a"))).alias("string"))


def minimal(words: DataFrame, column: str = "word") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, ends, members) of the least deterministic automaton of distinct words; members: prefix, state.

    Prefixes that the same endings follow are one state, named by the first of them in order. Endings are told by two sums of hashes and their
    number, so this is one grouping of all prefixes, whatever the length of words.
    """
    own = words.select(F.col(column).alias("w")).where(F.col("w").isNotNull()).distinct()
    each = own.select("w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("k")).select(F.expr("substring(w, 1, k)").alias("prefix"), F.expr("substring(w, k + 1)").alias("rest"))
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    sums = stored(each.groupBy("prefix").agg(wide("rest").alias("x"), wide(F.lit(1), "rest").alias("y"), F.count("*").alias("n"), F.max(F.col("rest") == "").alias("end")), "endings")
    key = ["x", "y", "n"]
    names = sums.groupBy(*key).agg(F.min("prefix").alias("state"), F.any_value("end").alias("end"))
    members = stored(sums.join(names.drop("end"), key).select("prefix", "state"), "members")
    arcs = members.where("prefix <> ''").select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("head"), F.expr("right(prefix, 1)").alias("label"), F.col("state").alias("next"))
    arcs = arcs.join(members.select(F.col("prefix").alias("head"), "state"), "head").select("state", "label", "next").distinct()
    return arcs, names.where("end").select("state"), members
