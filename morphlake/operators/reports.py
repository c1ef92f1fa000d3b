"""Tests of patterns and rules, statistics of a grammar, and what a form for inflection needs to know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.rules import rewritten
from morphlake.functions.symbols import decoded, encoded
from morphlake.operators.paradigm import Paradigm
from morphlake.sources.grammar import Grammar
from morphlake.sources.lexicon import first_rows, load_lexicon


def test_patterns(grammar: Grammar, cases: DataFrame) -> DataFrame:
    """cases (ref, string, test_kind) with pass: an include must match the pattern of ref, an exclude must not; a string with a part that is no symbol doesn't match."""
    refs = F.create_map(*(F.lit(x) for r, own in grammar.pattern_records.items() for x in (r, grammar.patterns.whole(own.get("pattern")))))
    s = grammar.symbols
    rows = cases.withColumn("__regex", F.try_element_at(refs, F.col("ref"))).withColumn("__code", F.concat(F.lit(s.bow), encoded(s, F.col("string")), F.lit(s.eow)))
    hit = F.coalesce(F.regexp_like(F.col("__code"), F.col("__regex")), F.lit(False))
    return rows.withColumn("pass", F.when(F.col("test_kind") == "include", hit).otherwise(~hit)).drop("__regex", "__code")


test_patterns.__test__ = False


def pattern_report(spark: SparkSession, grammar: Grammar) -> DataFrame:
    """ref, all_pass, results: the strings that patterns themselves list."""
    cases = grammar.patterns_table(spark).select("ref", F.explode(F.concat(F.transform("test_includes", lambda x: F.struct(x.alias("string"), F.lit("include").alias("test_kind"))), F.transform("test_excludes", lambda x: F.struct(x.alias("string"), F.lit("exclude").alias("test_kind"))))).alias("c")).select("ref", "c.*")
    return test_patterns(grammar, cases).groupBy("ref").agg(F.every("pass").alias("all_pass"), F.collect_list(F.struct("string", "test_kind", "pass")).alias("results"))


def run_rule(grammar: Grammar, rule: str, cases: DataFrame) -> DataFrame:
    """cases (input, expected, ...) with output, all results of the rule (tags dropped), and pass: whether expected is one of them."""
    s = grammar.symbols
    code = F.concat(F.lit(s.bow), encoded(s, F.col("input")), F.lit(s.eow))
    rows = cases.withColumn("__code", code).withColumn("output", F.transform(rewritten(grammar.rules(rule), F.col("__code")), lambda x: decoded(s, x)))
    return rows.withColumn("pass", F.coalesce(F.array_contains("output", decoded(s, encoded(s, F.col("expected")))), F.lit(False))).drop("__code")


def rule_report(spark: SparkSession, grammar: Grammar) -> DataFrame:
    """rule, all_pass, results: the mappings that rules themselves list."""
    out = None
    for name, data in grammar.rule_records.items():
        if data.get("test_mappings"):
            cases = spark.createDataFrame([(name, *map(str, m)) for m in data["test_mappings"]], "rule string, input string, expected string")
            own = run_rule(grammar, name, cases)
            out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "rule string, all_pass boolean, results array<struct<input:string,output:array<string>,expected:string,pass:boolean>>")
    return out.groupBy("rule").agg(F.every("pass").alias("all_pass"), F.collect_list(F.struct("input", "output", "expected", "pass")).alias("results"))


def grammar_stats(spark: SparkSession, grammar: Grammar) -> DataFrame:
    """kind, files, invalid_files, total: counts for each kind of file; feature markers count feature values."""
    return grammar.stats_table(spark).groupBy("kind").agg(F.count_if("is_valid").alias("files"), F.count_if(~F.col("is_valid")).alias("invalid_files"), F.sum("items").alias("total"))


def inventory_stats(spark: SparkSession, grammar: Grammar) -> DataFrame:
    """One row: phones, tags, classes, stages, roots."""
    words = [load_lexicon(spark, grammar, p).select("root") for p in grammar.parts_of_speech]
    count = sum(w.distinct().count() for w in words)
    return spark.createDataFrame([(len(grammar.symbols.phones), len(grammar.symbols.tags), len(grammar.classes), len(grammar.stages()), count)], "phones int, tags int, classes int, stages int, roots long")


def inflection_meta(spark: SparkSession, grammar: Grammar) -> DataFrame:
    """name, part_of_speech, free_features, fixed_features, lexical_features of each paradigm."""
    rows = []
    for name in grammar.kind("Paradigm"):
        p = Paradigm(grammar, name)
        rows.append((name, p.pos, p.free, p.fixed, list(map(str, grammar.parts_of_speech[p.pos].get("lexical_features") or ()))))
    return spark.createDataFrame(rows, "name string, part_of_speech string, free_features array<string>, fixed_features map<string,string>, lexical_features array<string>")


def roots_of(spark: SparkSession, grammar: Grammar, kind: str, name: str) -> DataFrame:
    """Roots of a paradigm (those that its filter lets through) or of a whole lexicon."""
    if kind == "Paradigm":
        p = Paradigm(grammar, name)
        return p.roots(load_lexicon(spark, grammar, p.pos)).select("root").distinct()
    if kind == "Lexicon":
        return load_lexicon(spark, grammar, name).select("root").distinct()
    raise ValueError(f"no roots of a {kind}")


def lexical_features(spark: SparkSession, grammar: Grammar, kind: str, name: str) -> DataFrame:
    """root and lexical features of each root's first row."""
    pos = Paradigm(grammar, name).pos if kind == "Paradigm" else name
    names = list(map(str, grammar.parts_of_speech[pos.removeprefix("$")].get("lexical_features") or ()))
    return first_rows(load_lexicon(spark, grammar, pos)).select("root", *names)


def marker_file_problems(grammar: Grammar, feature_files: list[str], contingent_files: list[str], features: set[str]) -> list[str]:
    """What speaks against a set of marker files: missing ones, a feature that two regular files express, features out of scope."""
    out, seen = [], set()
    for name in feature_files:
        data = grammar.kind("FeatureMarkers").get(name.removeprefix("$"))
        if data is None:
            out.append(f"no valid file {name}")
        elif data["feature"] in seen:
            out.append(f"two files express {data['feature']}")
        elif data["feature"] not in features:
            out.append(f"{data['feature']} isn't asked for")
        if data is not None:
            seen.add(data["feature"])
    for name in contingent_files:
        data = grammar.kind("ContingentFeatureMarkers").get(name.removeprefix("$"))
        if data is None:
            out.append(f"no valid file {name}")
        elif not set(map(str, data["features"])) <= features:
            out.append(f"{name} speaks of features that aren't asked for")
    return out
