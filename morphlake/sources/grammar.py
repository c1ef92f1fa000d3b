"""Grammar folders: YAML files by kind, validated, as records and as DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from morphlake.functions.patterns import Patterns
from morphlake.functions.rules import Rule, make_rule
from morphlake.functions.symbols import Symbols

# Folder of each kind, and the names that each kind must and may have.
FOLDERS = {
    "Inventory": "Phonology", "Patterns": "Phonology", "Rules": "Phonology",
    "PartOfSpeech": "Lexicon", "FeatureDefinitions": "Exponence", "FeatureMarkers": "Exponence",
    "ContingentFeatureMarkers": "Exponence", "Paradigm": "Morphotactics",
}
REQUIRED = {
    "Inventory": {"data": list}, "Patterns": {"patterns": list}, "Rules": {"rules": list},
    "PartOfSpeech": {"name": str, "features": list}, "FeatureDefinitions": {"features": dict},
    "FeatureMarkers": {"feature": str, "markers": dict}, "ContingentFeatureMarkers": {"features": list, "markers": list},
    "Paradigm": {"part_of_speech": str, "feature_markers": dict},
}
KINDS = ("prefix", "suffix", "replace", "suppletion", "rule", "principal_part", "infix")
UNMARKED = "unmarked"


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Marker:
    kind: str
    value: object
    stage: str | None = None

    @classmethod
    def read(cls, data: dict) -> Marker:
        value = data.get("value")
        return cls(data["kind"], tuple(value) if isinstance(value, list) else value, data.get("stage"))


@dataclass
class Grammar:
    path: str
    files: dict[str, dict[str, dict]] = field(default_factory=dict)
    invalid: dict[str, dict[str, str]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.classes: dict[str, list[str]] = {}
        phones, tags = [], []
        for data in self.kind("Inventory").values():
            for node in data["data"]:
                p, t = self._flatten(node)
                phones, tags = phones + p, tags + t
        self.features: dict[str, tuple[str, ...]] = {}
        self.feature_list: list[tuple[str, tuple[str, ...]]] = []
        for data in self.kind("FeatureDefinitions").values():
            for name, values in data["features"].items():
                own = (*map(str, values or ()), UNMARKED)
                self.feature_list.append((name, own))
                self._first(self.features, name, own, "feature")
        pairs = [f"[{f}={v}]" for f, values in self.features.items() for v in values]
        self.symbols = Symbols(phones, tags, pairs)
        self.pattern_records: dict[str, dict] = {}
        for data in self.kind("Patterns").values():
            for item in data["patterns"]:
                self._first(self.pattern_records, item["ref"], item, "pattern")
        self.patterns = Patterns(self.symbols, self.classes, {r: x.get("pattern") for r, x in self.pattern_records.items()})
        self.rule_records: dict[str, dict] = {}
        for data in self.kind("Rules").values():
            for item in data["rules"]:
                self._first(self.rule_records, item["name"], item, "rule")
        self.parts_of_speech = {d["name"]: d for d in self.kind("PartOfSpeech").values()}

    def kind(self, name: str) -> dict[str, dict]:
        return self.files.get(name, {})

    def _first(self, table: dict, key: str, value, what: str) -> None:
        """Of records with one name the first counts."""
        if key in table:
            self.warnings.append(f"{what} {key} is defined twice; the first one counts")
        else:
            table[key] = value

    def _flatten(self, node: dict) -> tuple[list[str], list[str]]:
        phones, tags = [str(p) for p in node.get("phones") or ()], [str(t) for t in node.get("tags") or ()]
        for child in node.get("children") or ():
            p, t = self._flatten(child)
            phones, tags = phones + p, tags + t
        if node.get("ref"):
            self._first(self.classes, node["ref"], phones + tags, "class")
        return phones, tags

    def rules(self, name: str) -> list[Rule]:
        """The rule of a name ($ or not) as a row of rules; a sequence's parts in order."""
        data = self.rule_records[name.removeprefix("$")]
        if data.get("rule_sequence"):
            return [r for part in data["rule_sequence"] for r in self.rules(part)]
        pairs = data["string_map"] if data.get("string_map") else [(data.get("input_pattern"), data.get("output_pattern"))]
        return [make_rule(self.patterns, [tuple(p) for p in pairs], data.get("left_context"), data.get("right_context"), data.get("direction") or "ltr", name, data.get("test_mappings"))]

    def feature_values(self, feature: str) -> tuple[str, ...]:
        return self.features.get(feature, ())

    def stages(self) -> list[str]:
        """Distinct stage names of all markers and paradigms."""
        found = [m.stage for lists in self._marker_lists() for m in lists if m.stage]
        found += [s for p in self.kind("Paradigm").values() for s in p.get("stage_order") or ()]
        return sorted(dict.fromkeys(found))

    def _marker_lists(self):
        for data in self.kind("FeatureMarkers").values():
            yield from ([Marker.read(m) for m in own or ()] for own in data["markers"].values())
        for data in self.kind("ContingentFeatureMarkers").values():
            yield from ([Marker.read(m) for m in x.get("realization") or ()] for x in data["markers"])

    def fingerprint(self) -> str:
        """Of the content of all files, spreadsheets included, so that stored relations are told apart by what they were made from; of a grammar without a folder, of its records."""
        h = hashlib.sha256(b"" if self.path else json.dumps(self.files, sort_keys=True, default=str).encode())
        for p in sorted(Path(self.path).rglob("*")) if self.path else ():
            if p.suffix in (".yaml", ".yml", ".csv", ".xlsx"):
                h.update(f"{p.relative_to(self.path)}\0".encode() + p.read_bytes() + b"\0")
        return h.hexdigest()

    def file_path(self, kind: str, name: str) -> str:
        return str(Path(self.path, FOLDERS[kind], kind, f"{name.removeprefix('$').removesuffix('.yaml')}.yaml"))

    def stats_table(self, spark: SparkSession) -> DataFrame:
        """kind, name, is_valid, error, items: a row for each file; items counts what the kind holds."""
        rows = []
        for kind in FOLDERS:
            for name, data in self.kind(kind).items():
                first = next((data[k] for k in REQUIRED[kind] if isinstance(data.get(k), (list, dict))), [])
                rows.append((kind, name, True, None, len(first)))
            rows += [(kind, name, False, error, 0) for name, error in self.invalid.get(kind, {}).items()]
        return spark.createDataFrame(rows, "kind string, name string, is_valid boolean, error string, items int")

    def classes_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, m) for r, m in self.classes.items()], "ref string, members array<string>")

    def features_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, v, k) for f, values in self.features.items() for k, v in enumerate(values)], "feature string, value string, ord int")

    def patterns_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, x.get("pattern"), x.get("name"), list(map(str, x.get("test_includes") or ())), list(map(str, x.get("test_excludes") or ())), self.patterns.whole(x.get("pattern"))) for r, x in self.pattern_records.items()]
        return spark.createDataFrame(rows, "ref string, pattern string, name string, test_includes array<string>, test_excludes array<string>, regex string")

    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, x.get("description"), x.get("input_pattern"), x.get("output_pattern"), [list(p) for p in x.get("string_map") or ()], list(x.get("rule_sequence") or ()), x.get("left_context"), x.get("right_context")) for n, x in self.rule_records.items()]
        return spark.createDataFrame(rows, "name string, description string, input_pattern string, output_pattern string, string_map array<array<string>>, rule_sequence array<string>, left_context string, right_context string")


def problem(kind: str, data) -> str | None:
    """What is wrong with a file's content, if anything is."""
    if not isinstance(data, dict):
        return "not a mapping"
    if data.get("kind") != kind:
        return f"kind is {data.get('kind')!r}, not {kind}"
    for name, want in REQUIRED[kind].items():
        if not isinstance(data.get(name), want):
            return f"{name} must be a {want.__name__}"
    lists: list = []
    if kind == "FeatureMarkers":
        lists = list(data["markers"].values())
    elif kind == "ContingentFeatureMarkers":
        if not all(isinstance(x, dict) and isinstance(x.get("features"), dict) for x in data["markers"]):
            return "each entry of markers needs features"
        lists = [x.get("realization") for x in data["markers"]]
    elif kind == "Paradigm":
        lists = [data.get("global_markers")]
        for name, want in (("stage_order", list), ("filter", dict), ("contingent_markers", list), ("global_stage", str)):
            if data.get(name) is not None and not isinstance(data[name], want):
                return f"{name} must be a {want.__name__}"
    for own in lists:
        for m in own or ():
            if not isinstance(m, dict) or m.get("kind") not in KINDS:
                return f"unknown marker {m!r}"
            if m["kind"] == "replace" and not (isinstance(m.get("value"), list) and len(m["value"]) == 2):
                return "replace needs a pair"
    if kind == "Patterns" and not all(isinstance(x, dict) and x.get("ref") for x in data["patterns"]):
        return "each pattern needs a ref"
    if kind == "Rules" and not all(isinstance(x, dict) and x.get("name") and ({"string_map", "rule_sequence"} & set(x) or {"input_pattern", "output_pattern"} <= set(x)) for x in data["rules"]):
        return "each rule needs a name and an input and output, a string map or a sequence"
    return None


def load_grammar(path: str | os.PathLike) -> Grammar:
    """The grammar of a folder; files that aren't valid are set aside with the reason."""
    files: dict[str, dict[str, dict]] = {}
    invalid: dict[str, dict[str, str]] = {}
    for kind, group in FOLDERS.items():
        for p in sorted(Path(path, group, kind).glob("*.yaml")):
            try:
                data = yaml.safe_load(p.read_text(encoding="utf-8"))
                error = problem(kind, data)
            except yaml.YAMLError as e:
                data, error = None, f"not YAML: {e}"
            if error:
                invalid.setdefault(kind, {})[p.stem] = error
            else:
                files.setdefault(kind, {})[p.stem] = data
    return Grammar(str(path), files, invalid)
