"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.common import together, unused, written

WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def form(text: Column) -> Column:
    """A topic from a text's form: table (bars on the average line), notes (many short lines), long or prose."""
    n = tokens(text)
    lines = F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1
    bars = F.coalesce(F.regexp_count(text, F.lit(r"\|")), F.lit(0))
    return F.when(bars >= 2 * lines, "table").when((lines >= 8) & (n < 12 * lines), "notes").when(n >= 1000, "long").otherwise("prose")


def uniform(ident: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on nothing but the id and salt."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(ident.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(cells: DataFrame, dimension: str, power: float, given: Mapping[str, float] | None) -> DataFrame:
    """(dimension, share): as given, or the token share to a power; shares of the values that occur add up to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("t").cast("double").alias("t"))
    if given is None:
        raw = F.pow("t", F.lit(power))
    else:
        known = F.create_map(*(F.lit(x) for pair in given.items() for x in pair)) if given else F.create_map().cast("map<string,double>")
        raw = F.coalesce(F.try_element_at(known, F.col(dimension)), F.lit(0.0)).cast("double")
    shares = sums.where("t > 0").select(dimension, raw.alias("share"))
    total = F.sum("share").over(Window.partitionBy(F.lit(1)))
    return shares.withColumn("share", F.col("share") / F.nullif(total, F.lit(0.0)))


def fit_weights(cells: DataFrame, dimensions: dict[str, tuple[float, Mapping[str, float] | None]], rounds: int) -> DataFrame:
    """cells (dimensions, t) with weight: raked so that t * weight has the target share in each dimension.

    A round scales the cells to the targets of one dimension after the other. The table has a row for each
    combination of values that occurs, whatever the number of documents; each step is a grouped sum over it.
    """
    x = cells.where("t > 0")
    for d, (power, given) in dimensions.items():
        x = x.join(targets(cells, d, power, given).withColumnRenamed("share", f"share_{d}"), d)
    x = written(x.withColumn("w", F.lit(1.0)), "cells")
    count = x.count()
    x = together(x, count)
    for k in range(rounds):
        for d in dimensions:
            own = F.sum(F.col("t") * F.col("w")).over(Window.partitionBy(d))
            x = x.withColumn("w", F.coalesce(F.col("w") * F.col(f"share_{d}") / F.nullif(own, F.lit(0.0)), F.lit(0.0)))
        if k % 6 == 5:
            x = together(written(x, "cells"), count)
    total = cells.agg(F.sum("t").cast("double").alias("total"))
    return x.crossJoin(F.broadcast(total)).select(*dimensions, (F.col("w") * F.col("total")).alias("weight"))


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("none"))


def _weights(rows: DataFrame, rounds: int, powers: Mapping[str, float], shares: Mapping[str, Mapping[str, float] | None]) -> DataFrame:
    """(source, lang, topic, weight) from rows with these and n_tokens."""
    cells = written(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")), "cells")
    return written(fit_weights(cells, {d: (powers[d], shares[d]) for d in powers}, rounds), "weights")


def _copies(weight: Column, rate: float, ident: Column, salt: str) -> Column:
    times = weight * F.lit(rate)
    return (F.floor(times) + (uniform(ident, salt) < times - F.floor(times)).cast("bigint")).cast("bigint")


def _final(weight: str) -> Column:
    return F.round(F.coalesce(weight, F.lit(0.0)), 6)


def mix(docs: DataFrame, rate: float = 1.0, rounds: int = 12, topic: Column | None = None, source_power: float = 0.5, lang_power: float = 0.5, topic_power: float = 0.75, source_shares: Mapping[str, float] | None = None, lang_shares: Mapping[str, float] | None = None, topic_shares: Mapping[str, float] | None = None, salt: str = "mix", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, copies: one row for each row of docs.

    Weights are raked so that tokens times weight have target shares by source, language and topic at once: the
    shares given, or each value's token share to a power below 1, which lifts the rare. A document is
    taken rate * weight times on average: the whole part always, one more with the fraction's probability, by a
    number drawn from its id and salt.

    A null source, language or topic is the value "none". Null and empty texts have no tokens; in a cell without
    tokens weight and copies are 0. Rows with one id draw the same number. An empty table gives an empty result.
    Very long texts are only counted through. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _named(F.col(source_col)).alias("source"), _named(F.col(lang_col)).alias("lang"), _named(topic if topic is not None else form(text)).alias("topic"), tokens(text).alias("n_tokens"))
    rows = written(rows, "rows")
    weights = _weights(rows, rounds, {"source": source_power, "lang": lang_power, "topic": topic_power}, {"source": source_shares, "lang": lang_shares, "topic": topic_shares})
    out = rows.join(weights, ["source", "lang", "topic"], "left").withColumn("weight", _final("weight"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", _copies(F.col("weight"), rate, F.col("doc_id"), salt).alias("copies"))


def sample(docs: DataFrame, rate: float = 1.0, rounds: int = 12, topic: Column | None = None, source_power: float = 0.5, lang_power: float = 0.5, topic_power: float = 0.75, source_shares: Mapping[str, float] | None = None, lang_shares: Mapping[str, float] | None = None, topic_shares: Mapping[str, float] | None = None, salt: str = "mix", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each row of docs as often as mix takes it: not at all, once, or several times. Columns as they were.

    So the tokens of the result have the target shares, but for the draws of fractions. Each row goes by its own
    source, language and topic, whatever other rows have its id. Nulls, empty and very long texts, repeated rows and
    empty tables as for mix: rows without tokens go, rows alike are each taken as often.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {c: unused(docs, f"__{c}") for c in ("source", "lang", "topic", "weight")}
    of = {"source": _named(F.col(source_col)), "lang": _named(F.col(lang_col)), "topic": _named(topic if topic is not None else form(text))}
    cells = docs.select(*(e.alias(c) for c, e in of.items()), tokens(text).alias("n_tokens"))
    weights = _weights(cells, rounds, {"source": source_power, "lang": lang_power, "topic": topic_power}, {"source": source_shares, "lang": lang_shares, "topic": topic_shares})
    weights = weights.select(*(F.col(c).alias(k) for c, k in keys.items()))
    rows = docs.withColumns({keys[c]: e for c, e in of.items()}).join(weights, [keys[c] for c in of])
    copies = _copies(_final(keys["weight"]), rate, F.col(id_col).cast("bigint"), salt)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*own, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(keys["weight"])).select(*own)
