"""Paradigms as relations: cells and their markers, the inflected table, and the queries over it."""

from __future__ import annotations

import hashlib
import itertools
import json
import logging
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.patterns import strings
from morphlake.functions.rules import make_rule, rewritten_all
from morphlake.functions.symbols import decoded, encoded, feature_key, feature_key_column
from morphlake.operators.search import nearest
from morphlake.sources.grammar import Grammar, GrammarError, Marker
from morphlake.sources.lexicon import first_rows, load_lexicon, with_features
from morphlake.sources.tables import delete, discard, exists, stored

LAST = 1 << 30
log = logging.getLogger(__name__)


class NotExponed(GrammarError):
    """No marker file says how a feature of the bundle is expressed."""


@dataclass
class Paradigm:
    """One paradigm of a grammar: its fixed and free features, marker files and cells."""

    grammar: Grammar
    name: str
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.name = self.name.removeprefix("$")
        self.data = self.grammar.kind("Paradigm")[self.name]
        self.pos = self.data["part_of_speech"].removeprefix("$")
        self.features = list(map(str, self.grammar.parts_of_speech[self.pos]["features"]))
        own = self.data["feature_markers"]
        self.fixed = {f: str(v) for f, v in own.items() if v is not None and not str(v).startswith("$")}
        self.files = [str(v)[1:] for v in own.values() if v is not None and str(v).startswith("$")]
        self.contingent = [str(v).removeprefix("$") for v in self.data.get("contingent_markers") or ()]
        if unknown := set(own) - set(self.features):
            raise GrammarError(f"paradigm {self.name} speaks of features that {self.pos} doesn't have: {sorted(unknown)}")
        self.order = list(map(str, self.data.get("stage_order") or ()))

    @property
    def free(self) -> list[str]:
        """Features that a marker file of the paradigm expresses."""
        return [f for f, v in self.data["feature_markers"].items() if v is not None and str(v).startswith("$")]

    def combos(self) -> list[dict[str, str]]:
        """Every bundle of the free features, `unmarked` included, in order; fixed ones aren't in it."""
        names = []
        for f in self.features:
            if f in self.fixed:
                continue
            if f in self.grammar.features:
                names.append(f)
            else:
                self.warnings.append(f"feature {f} has no values")
        out = [dict(zip(names, v, strict=True)) for v in itertools.product(*(self.grammar.features[f] for f in names))]
        only = self.data.get("feature_value_combinations")
        if isinstance(only, list):
            out = [c for c in out if any(all(c.get(k) == str(v) for k, v in want.items()) for want in only)]
        return out

    def dependencies(self) -> dict:
        """Everything in the grammar that the paradigm's forms come from, by kind."""
        g, texts = self.grammar, []
        own: dict = {"paradigm": self.data, "part_of_speech": g.parts_of_speech[self.pos], "symbols": list(g.symbols.kind.items()), "features": {f: g.features.get(f) for f in self.features}}
        files = list(self.files)
        regular = own["markers"] = {}
        for name in files:
            if name not in regular:
                regular[name] = data = g.kind("FeatureMarkers").get(name)
                if data and data.get("inherits"):
                    files.append(str(data["inherits"]).removeprefix("$"))
        own["contingent"] = {name: g.kind("ContingentFeatureMarkers").get(name) for name in self.contingent}
        texts.append(json.dumps(own, default=str))
        rules = own["rules"] = {}
        names = re.findall(r"\$([^\"\\]+)", texts[0])
        for name in names:
            if name in g.rule_records and name not in rules:
                rules[name] = g.rule_records[name]
                names += [str(x).removeprefix("$") for x in rules[name].get("rule_sequence") or ()]
        named = own["patterns"] = {}
        refs = re.findall(r"<[^<>]+>", json.dumps(own, default=str))
        for ref in refs:
            if ref not in named and (ref in g.pattern_records or ref in g.classes):
                named[ref] = g.classes[ref] if ref in g.classes else g.pattern_records[ref].get("pattern")
                refs += re.findall(r"<[^<>]+>", json.dumps(named[ref], default=str))
        return own

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.dependencies(), sort_keys=True, default=str).encode()).hexdigest()[:32]

    def _file(self, kind: str, name: str) -> dict:
        found = self.grammar.kind(kind).get(name)
        if found is None:
            raise GrammarError(f"no valid {kind} file {name}")
        return found

    def _regular(self, name: str) -> tuple[str, dict]:
        """(feature, value -> markers) of a file; a file that inherits overrides by value."""
        data = self._file("FeatureMarkers", name)
        base = self._regular(str(data["inherits"]).removeprefix("$"))[1] if data.get("inherits") else {}
        stage = data.get("global_stage")
        read = lambda own: [m if m.stage or not stage else Marker(m.kind, m.value, stage) for m in map(Marker.read, own or ())]
        general = read(data.get("global_markers"))
        return data["feature"], {**base, **{str(v): read(own) + general for v, own in data["markers"].items()}}

    def resolved(self, bundle: dict[str, str]) -> list[tuple[Marker, str]]:
        """(marker, what it stands for) of a bundle without fixed features: contingent files first, then regular ones for what is left."""
        done: set[str] = set()
        out: list[tuple[Marker, str]] = []
        for name in self.contingent:
            data = self._file("ContingentFeatureMarkers", name)
            hit = next((x for x in data["markers"] if all(bundle.get(k) == str(v) for k, v in x["features"].items())), None)
            if hit is not None:
                out += [(Marker.read(m), feature_key({k: str(v) for k, v in hit["features"].items()})) for m in hit.get("realization") or ()]
                done |= set(map(str, data["features"]))
        for name in self.files:
            feature, values = self._regular(name)
            if feature in bundle and feature not in done and bundle[feature] in values:
                out += [(m, feature_key({feature: bundle[feature]})) for m in values[bundle[feature]]]
                done.add(feature)
        if missing := set(bundle) - done:
            raise NotExponed(f"{self.name}: nothing expresses {sorted((f, bundle[f]) for f in missing)}")
        return out

    def markers(self, bundle: dict[str, str]) -> list[tuple[Marker, str]]:
        """Markers of a bundle in the order they apply: principal part, stages in order, all others."""
        bundle = {k: v for k, v in bundle.items() if self.fixed.get(k) != v}
        if bundle not in self.combos():
            raise GrammarError(f"{self.name} has no cell {feature_key(bundle)}")
        found = self.resolved(bundle)
        for m in map(Marker.read, self.data.get("global_markers") or ()):
            if m.kind != "principal_part" or all(x.kind != "principal_part" for x, _ in found):
                found.append((m, "global"))
        if stage := self.data.get("global_stage"):
            found = [(m if m.stage else Marker(m.kind, m.value, stage), why) for m, why in found]
        rank = lambda m: 0 if m.kind == "principal_part" else self.order.index(m.stage) + 1 if m.stage in self.order else LAST
        return sorted(found, key=lambda x: rank(x[0]))

    def cells(self) -> list[tuple[dict[str, str], list[tuple[Marker, str]]]]:
        """(whole bundle, markers) of every cell that is expressed; the others are skipped with a warning."""
        out = []
        for bundle in self.combos():
            try:
                out.append(({**bundle, **self.fixed}, self.markers(bundle)))
            except (ValueError, KeyError) as e:
                self.skip(bundle, e)
        return out

    def skip(self, bundle: dict[str, str], why: Exception) -> None:
        """Notes that a cell has no forms: nothing expresses it, or one of its markers can't be applied."""
        expected = isinstance(why, NotExponed)  # as every bundle with an unmarked value is, as a rule
        self.warnings.append(str(why) if expected else f"{self.name}, cell {feature_key(bundle)}: {why}")
        log.log(logging.INFO if expected else logging.WARNING, "skipped: %s", self.warnings[-1])

    def roots(self, lexicon: DataFrame) -> DataFrame:
        """Rows of the lexicon that the paradigm's filter lets through."""
        rule = self.data.get("filter") or {}
        own = rule.get("lexical_features") or {}
        found = with_features(lexicon, {str(k): str(v) for k, v in (own.items() if isinstance(own, dict) else own)})
        if rule.get("pattern"):
            found = found.where(self.grammar.patterns.matches(encoded(self.grammar.symbols, F.col("root")), rule["pattern"]))
        return found


class Forms:
    """Strings of codes that a root has become: one (a string column) or several (an array column)."""

    def __init__(self, grammar: Grammar, column: Column, many: bool = False):
        self.grammar, self.column, self.many = grammar, column, many

    def array(self) -> Column:
        return F.array_sort(F.array_distinct(self.column)) if self.many else F.array(self.column)

    def _each(self, change, values: list[str]) -> Forms:
        """change(form, value) for each value."""
        if len(values) == 1 and not self.many:
            return Forms(self.grammar, change(self.column, values[0]))
        wide = F.flatten(F.transform(self.array(), lambda x: F.array(*(change(x, v) for v in values))))
        return Forms(self.grammar, wide, True)

    def _rules(self, rules: list) -> Forms:
        bow, eow = self.grammar.symbols.bow, self.grammar.symbols.eow
        edged = lambda x: F.concat(F.lit(bow), x, F.lit(eow))
        bare = lambda x: F.translate(x, bow + eow, "")

        def native(x: Column) -> Column | None:
            x = edged(x)
            for r in rules:
                x = r.native(x) if x is not None else None
            return None if x is None else bare(x)

        if native(F.lit("")) is None:
            out = rewritten_all(rules, F.transform(self.array(), edged))
            return Forms(self.grammar, F.transform(out, bare), True)
        return Forms(self.grammar, F.transform(self.column, native) if self.many else native(self.column), self.many)

    def apply(self, marker: Marker) -> Forms:
        g = self.grammar
        values = lambda: strings(g.patterns.parse(marker.value))
        if marker.kind == "prefix":
            return self._each(lambda x, v: F.concat(F.lit(v), x), values())
        if marker.kind == "suffix":
            return self._each(lambda x, v: F.concat(x, F.lit(v)), values())
        if marker.kind == "suppletion":
            return self._each(lambda x, v: F.when(x.isNotNull(), F.lit(v)), values())
        if marker.kind == "replace":
            return self._rules([make_rule(g.patterns, [tuple(marker.value)])])
        if marker.kind == "rule":
            return self._rules(g.rules(str(marker.value)))
        raise GrammarError(f"marker {marker.kind} can't be applied here")


def start(grammar: Grammar, root: Column, stems: dict[str, Column], markers: list[tuple[Marker, str]]) -> tuple[Forms, list]:
    """The root's codes, or its stems if the first marker asks for a principal part; and the markers that are left."""
    if markers and markers[0][0].kind == "principal_part":
        part = str(markers[0][0].value)
        if part not in stems:
            raise GrammarError(f"no principal part {part}")
        return Forms(grammar, stems[part], True), markers[1:]
    return Forms(grammar, root), markers


def inflected(spark: SparkSession, grammar: Grammar, name: str, lexicon: DataFrame | None = None) -> DataFrame:
    """paradigm, root, feature_key, features, form, form_tagged, form_code: every form of every root of a paradigm.

    One pass over the lexicon: each cell is an expression over the root's codes, all cells are exploded from one row.
    """
    p = Paradigm(grammar, name)
    lexicon = load_lexicon(spark, grammar, p.pos) if lexicon is None else lexicon
    parts = [c for c in map(str, grammar.parts_of_speech[p.pos].get("principal_parts") or ())]
    stems = [F.array_sort(F.collect_set(F.coalesce(F.nullif(F.col(c), F.lit("")), "root"))).alias(c) for c in parts]
    rows = p.roots(lexicon).groupBy("root").agg(F.count("*").alias("__n"), *stems).withColumn("__code", encoded(grammar.symbols, F.col("root")))
    for c in parts:
        each = rows.select("root", F.explode(c).alias("__stem")).withColumn("__stem", encoded(grammar.symbols, F.col("__stem")))
        rows = rows.drop(c).join(each.where(F.col("__stem").isNotNull()).groupBy("root").agg(F.collect_set("__stem").alias(c)), "root", "left")
    cells = []
    for features, markers in p.cells():
        try:
            forms, rest = start(grammar, F.col("__code"), {c: F.col(c) for c in parts}, markers)
            for m, _ in rest:
                forms = forms.apply(m)
        except (ValueError, KeyError) as e:  # one cell that can't be built doesn't stop the others
            p.skip(features, e)
            continue
        cells.append(F.struct(F.lit(feature_key(features)).alias("feature_key"), F.create_map(*(F.lit(x) for pair in sorted(features.items()) for x in pair)).alias("features"), forms.array().alias("forms")))
    schema = "paradigm string, root string, feature_key string, features map<string,string>, form string, form_tagged string, form_code string"
    if not cells:
        return spark.createDataFrame([], schema)
    out = rows.select("root", F.explode(F.array(*cells)).alias("c")).select("root", "c.feature_key", "c.features", F.explode("c.forms").alias("tagged"))
    s = grammar.symbols
    drop = "".join(sorted(s.of_kind("tag", "feature", "edge", "edit")))
    rows = out.where(F.col("tagged").isNotNull())  # roots, cells and each cell's forms are distinct already
    tagged = F.col("tagged")
    return rows.select(F.lit(p.name).alias("paradigm"), "root", "feature_key", "features", decoded(s, tagged).alias("form"), decoded(s, tagged, tags=True).alias("form_tagged"), F.translate(tagged, drop, "").alias("form_code"))


#: Parts that a stored relation is dealt to by root, each of which is written anew when one of its roots changes.
PARTS = 64


def _row_hashes(p: Paradigm, lexicon: DataFrame, parts: int) -> DataFrame:
    """root, part, x, y: two sums of hashes over a root's rows of the lexicon, of the columns that forms come from."""
    used = sorted({"root", *map(str, p.grammar.parts_of_speech[p.pos].get("principal_parts") or ())} & set(lexicon.columns))
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    own = p.roots(lexicon).where(F.col("root").isNotNull())
    return own.groupBy("root").agg(wide(*used).alias("x"), wide(F.lit(1), *used).alias("y")).withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts)).cast("int"))


def refresh(spark: SparkSession, grammar: Grammar, name: str, path: str, lexicon: DataFrame | None = None, force: bool = False, parts: int = PARTS) -> list[int]:
    """Brings the stored relation of one paradigm up to date; the parts that were written.

    A relation lies under the hash of what its paradigm depends on (its own record, part of speech, markers, rules, patterns and symbols), so
    a change of those starts a new one and leaves other paradigms alone. Within it, roots whose rows of the lexicon are new, changed or gone are
    found by anti-joins with the hashes stored beside the forms; only parts that hold such a root are worked out and written again. The hashes go
    last: what is lost in between is written again by the next call.
    """
    p = Paradigm(grammar, name)
    lexicon = load_lexicon(spark, grammar, p.pos) if lexicon is None else lexicon
    base = store_path(p, path)
    seen, forms = f"{base}/rows", f"{base}/forms"
    now = stored(_row_hashes(p, lexicon, parts), "rows")
    before = spark.createDataFrame([], now.schema) if force or not exists(spark, f"{seen}/_SUCCESS") else spark.read.schema(now.schema).parquet(seen)
    key = ["root", "x", "y", "part"]
    changed = now.select(key).join(before.select(key), key, "left_anti").unionByName(before.select(key).join(now.select(key), key, "left_anti"))
    if force:
        delete(spark, base)
    stale = sorted(r["part"] for r in changed.select("part").distinct().collect())  # at most `parts` numbers
    if stale or not exists(spark, f"{seen}/_SUCCESS"):
        there = F.pmod(F.xxhash64("root"), F.lit(parts)).cast("int")
        built = inflected(spark, grammar, name, lexicon.where(there.isin(stale))).drop("paradigm").withColumn("part", there)
        held = {r["part"] for r in now.select("part").distinct().collect()}
        for part in set(stale) - held:
            delete(spark, f"{forms}/part={part}")
        built.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(forms)
        now.repartition(1 + len(held) // 16, "part").write.mode("overwrite").parquet(seen)
    discard(now)
    return stale


def store_path(p: Paradigm, path: str) -> str:
    return f"{path.rstrip('/')}/paradigm={p.name}/{p.fingerprint()}"


FORMS = "root string, feature_key string, features map<string,string>, form string, form_tagged string, form_code string"


def materialize(spark: SparkSession, grammar: Grammar, names: list[str], path: str, force: bool = False, lexicon: DataFrame | None = None) -> DataFrame:
    """The inflected relation of paradigms as Parquet under path; only what has changed since it was stored is worked out."""
    tables = []
    for name in names:
        refresh(spark, grammar, name, path, lexicon, force)
        p = Paradigm(grammar, name)
        own = spark.read.schema(FORMS + ", part int").parquet(f"{store_path(p, path)}/forms")
        tables.append(own.drop("part").withColumn("paradigm", F.lit(p.name)))
    return reduce(DataFrame.unionByName, tables)


def bucketed(relation: DataFrame, name: str, by: str = "form", buckets: int = 64, path: str | None = None) -> DataFrame:
    """The relation as a table of the catalog, bucketed and sorted by form (for parsing) or root (for inflecting): joins on it leave it where it is."""
    writer = relation.write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return relation.sparkSession.table(name)


def checked(grammar: Grammar, name: str, requests: DataFrame) -> DataFrame:
    """requests (root, features) with the fixed features filled in and feature_key; a bundle with other features than the paradigm's is an error."""
    p = Paradigm(grammar, name)
    fixed = F.create_map(*(F.lit(x) for pair in p.fixed.items() for x in pair)) if p.fixed else F.create_map().cast("map<string,string>")
    whole = F.map_from_entries(F.array_distinct(F.concat(F.map_entries("features"), F.filter(F.map_entries(fixed), lambda e: ~F.map_contains_key("features", e["key"])))))
    want = F.array(*map(F.lit, sorted(p.features)))
    rows = requests.withColumn("features", whole)
    fine = F.array_sort(F.map_keys("features")) == want
    return rows.withColumn("feature_key", F.when(fine, feature_key_column(F.col("features"))).otherwise(F.raise_error(F.lit(f"paradigm {p.name} needs the features {sorted(p.features)}"))))


def inflect(relation: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (root, feature_key, ...) with form: equality joins over the relation; no form, no row. Forms that differ in tags alone count once."""
    forms = relation.groupBy("root", "feature_key").agg(F.collect_set("form").alias("form"))
    return requests.join(forms, ["root", "feature_key"]).withColumn("form", F.explode("form"))


def parse(relation: DataFrame, forms: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """forms (form, ...) with root, feature_key, features and gloss of every analysis.

    Forms, relation and lexicon all grow with the data, and stored ones are far smaller on disk than in memory, so none is ever broadcast.
    """
    found = forms.join(relation.select("form", "paradigm", "root", "feature_key", "features").hint("merge"), "form")
    if lexicon is None:
        return found
    return found.join(first_rows(lexicon).select("root", "gloss").hint("merge"), "root", "left")


def search(relation: DataFrame, queries: DataFrame, n: int | None = 10, bound: float = 5, **costs) -> DataFrame:
    """query, form, distance, rank: for each query (query, query_code) the n nearest forms within `bound` edits of symbols, ties by form.

    costs: those of `search.nearest`. Forms are looked up in a trie, which drops whole branches that are too far.
    """
    return nearest(relation.select("form", "form_code"), queries, n, bound, **costs)


def search_parse(relation: DataFrame, queries: DataFrame, lexicon: DataFrame | None = None, n: int = 10) -> DataFrame:
    """search, with one row for each analysis of each hit."""
    return parse(relation, search(relation, queries, n), lexicon)


def stages(grammar: Grammar, name: str, requests: DataFrame, lexicon: DataFrame) -> DataFrame:
    """root, feature_key, stage_no, stage, surface_forms, feature_values, marker_kind, marker_value: how each request's form comes about.

    requests: root, feature_key. The root need not be in the lexicon; a feature_key that is no cell of the paradigm, or one whose markers
    can't be applied, is an error for those who ask for it and for no one else. At most five forms a step, tags kept; the last row has none.
    """
    p, s = Paradigm(grammar, name), grammar.symbols
    parts = list(map(str, grammar.parts_of_speech[p.pos].get("principal_parts") or ()))
    known = lexicon.groupBy("root").agg(*(F.collect_set(F.coalesce(F.nullif(F.col(c), F.lit("")), "root")).alias(c) for c in parts)) if parts else lexicon.select("root").distinct()
    rows = requests.join(known, "root", "left").withColumn("__code", encoded(s, F.col("root")))
    for c in parts:
        own = rows.select("root", "feature_key", F.explode(F.coalesce(c, F.array("root"))).alias("__stem")).withColumn("__stem", encoded(s, F.col("__stem")))
        rows = rows.drop(c).join(own.groupBy("root", "feature_key").agg(F.collect_set("__stem").alias(c)), ["root", "feature_key"], "left")
    show = lambda f, tags: F.slice(F.transform(f.array(), lambda x: decoded(s, x, tags=tags)), 1, 5)
    note = lambda k, stage, forms, why, kind, value: F.struct(F.lit(k).alias("stage_no"), F.lit(stage).alias("stage"), forms.alias("surface_forms"), F.lit(why).alias("feature_values"), F.lit(kind).alias("marker_kind"), F.lit(value).alias("marker_value"))
    whole = None
    for features, markers in p.cells():
        key = feature_key(features)
        try:
            forms, rest = start(grammar, F.col("__code"), {c: F.col(c) for c in parts}, markers)
            steps = [("Initial", Forms(grammar, F.col("__code")), "", "", "")]
            if len(rest) < len(markers):
                steps.append((markers[0][0].stage or "", forms, markers[0][1], markers[0][0].kind, str(markers[0][0].value)))
            for m, why in rest:
                forms = forms.apply(m)
                steps.append((m.stage or "", forms, why, m.kind, " > ".join(m.value) if isinstance(m.value, tuple) else str(m.value)))
            history = [note(k, stage, show(f, True), why, kind, value) for k, (stage, f, why, kind, value) in enumerate(steps)]
            found = F.array(*history, note(len(steps), "Final", show(forms, False), key, "", ""))
        except (ValueError, KeyError) as e:
            p.skip(features, e)
            found = F.raise_error(F.lit(f"{p.name}, cell {key}: {e}"))
        cell = F.when(F.col("feature_key") == key, found)
        whole = cell if whole is None else F.coalesce(whole, cell)
    if whole is None:
        raise GrammarError(f"{p.name} has no cells")
    found = F.when(whole.isNotNull(), whole).otherwise(F.raise_error(F.concat(F.lit(f"{p.name} has no cell "), F.coalesce("feature_key", F.lit("null")))))
    return rows.select("root", "feature_key", F.explode(found).alias("x")).select("root", "feature_key", "x.*")
