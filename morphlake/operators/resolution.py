"""Marker resolution as joins over tables, for cells and marker tables of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNRANKED = 2147483647


def feature_combos(values: list[DataFrame]) -> DataFrame:
    """Every combination of one row of each table (feature values, `unmarked` included): the product of the grammar's own dimensions, which is what is asked for."""
    out = values[0]
    for more in values[1:]:
        own = more.agg(F.collect_list(F.struct(*more.columns)).alias("__own"))
        out = out.withColumn("__one", F.lit(1)).join(own.withColumn("__one", F.lit(1)), "__one").drop("__one").select(*out.columns, F.explode("__own").alias("__x")).select(*out.columns, "__x.*")
    return out


def matched(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """cell with the columns of each entry (file, ord, features, pattern) whose pattern the cell's bundle holds.

    A pattern is looked up by one of its pairs of feature and value, the one that fewest cells have; what shares that pair is
    compared whole. A pair of a pattern that no cell has drops it. An empty pattern is one of a pair that all cells have, so it fits each. A null
    value, in a pattern or a bundle, fits null only.
    """
    everywhere = F.map_from_arrays(F.array(F.lit("")), F.array(F.lit("")))
    pairs = lambda m: F.explode(F.transform(F.map_entries(F.map_concat(m, everywhere)), lambda e: F.struct(e["key"].alias("f"), F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")).alias("v"))))
    own = cells.select("cell", "bundle", pairs("bundle").alias("p")).select("cell", "bundle", "p.*")
    held = own.groupBy("f", "v").agg(F.count("*").alias("n"))
    asked = entries.select("file", "ord", pairs("pattern").alias("p")).select("file", "ord", "p.*").join(held, ["f", "v"])
    rarest = asked.groupBy("file", "ord").agg(F.min(F.struct("n", "f", "v")).alias("p")).select("file", "ord", "p.f", "p.v")
    met = own.join(rarest.join(entries, ["file", "ord"]), ["f", "v"])
    return met.where(F.forall(F.map_entries("pattern"), lambda e: F.map_contains_key("bundle", e["key"]) & F.try_element_at("bundle", e["key"]).eqNullSafe(e["value"]))).drop("f", "v", "bundle")


def _entries(contingent: DataFrame) -> DataFrame:
    return contingent.groupBy("file", "ord").agg(F.any_value("features").alias("features"), F.any_value("pattern").alias("pattern"))


def resolve_markers(cells: DataFrame, contingent: DataFrame, regular: DataFrame) -> DataFrame:
    """cell, file, feature, pos, marker: contingent entries first, then regular ones for features that none of them expresses.

    cells: cell, bundle (map). contingent: file, features (array), ord, pattern (map), pos, marker; of a file's entries whose pattern
    the bundle holds, the first counts, and it expresses all features of its file. regular: file, feature, value, pos, marker.
    """
    hit = matched(cells, _entries(contingent)).groupBy("cell", "file").agg(F.min_by(F.struct("ord", "features"), "ord").alias("x")).select("cell", "file", "x.*")
    own = hit.join(contingent.select("file", "ord", "pos", "marker"), ["file", "ord"]).where(F.col("marker").isNotNull()).select("cell", "file", F.array_join("features", "+").alias("feature"), "pos", "marker")
    done = hit.select("cell", F.explode("features").alias("feature")).distinct()
    each = cells.select("cell", F.explode("bundle").alias("feature", "value"))
    rest = each.join(done, ["cell", "feature"], "left_anti").join(regular, ["feature", "value"]).select("cell", "file", "feature", "pos", "marker")
    return own.unionByName(rest)


def unexpressed(cells: DataFrame, contingent: DataFrame, regular: DataFrame) -> DataFrame:
    """cell, feature: what neither kind of file says anything about; a cell with such a feature has no forms."""
    done = matched(cells, _entries(contingent)).select("cell", F.explode("features").alias("feature")).distinct()
    each = cells.select("cell", F.explode("bundle").alias("feature", "value"))
    return each.join(done, ["cell", "feature"], "left_anti").join(regular.select("feature", "value").distinct(), ["feature", "value"], "left_anti").select("cell", "feature")


def stage_rank(stage: Column, order: list[str]) -> Column:
    """0 for a principal part, the place in the order for a stage of it, last for any other; ties keep their position."""
    place = F.array_position(F.array(*map(F.lit, order)), stage)
    return F.when(stage == "principal_part", 0).otherwise(F.coalesce(F.nullif(place, F.lit(0)), F.lit(UNRANKED))).cast("bigint")
