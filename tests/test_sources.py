import json
import zipfile

import grammar_fixture as g
import pytest

from morphlake.operators.paradigm import inflected
from morphlake.sources.files import grammar_files, read_grammar, schema_report, sheet_rows
from morphlake.sources.grammar import load_grammar
from morphlake.sources.lexicon import load_lexicon
from morphlake.sources.schemas import Schemas


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return g.write(tmp_path_factory.mktemp("g"))


def test_files_by_kind_and_one_by_one(spark, folder):
    every = {(r["kind"], r["name"]): r for r in grammar_files(spark, str(folder)).collect()}
    assert len(every) == 14 and not every["Rules", "zbroken"]["is_valid"] and every["Rules", "zbroken"]["error"]
    assert {r["name"] for r in grammar_files(spark, f"file://{folder}", "Paradigm").collect()} == {f"noun_{n}" for n in g.ENDINGS}
    one = grammar_files(spark, str(folder), "PartOfSpeech", "$noun").collect()
    assert len(one) == 1 and json.loads(one[0]["data"])["lexical_features"] == ["sort"]
    assert grammar_files(spark, str(folder), "Rules", "none").count() == grammar_files(spark, str(folder), "Nothing").count() == 0
    (folder / "Phonology/Rules/zz.yaml").write_text("a: [", encoding="utf-8")
    assert "not YAML" in grammar_files(spark, str(folder), "Rules", "zz").first()["error"]
    (folder / "Phonology/Rules/zz.yaml").unlink()


def test_a_grammar_read_by_spark_is_the_same(spark, folder):
    own, plain = read_grammar(spark, f"file://{folder}"), load_grammar(folder)
    assert own.files == plain.files and own.invalid.keys() == plain.invalid.keys()
    assert own.rule_records == plain.rule_records and list(own.symbols.code) == list(plain.symbols.code)
    forms = lambda x: sorted(r["form"] for r in inflected(spark, x, "noun_hard").collect())
    assert forms(own) == forms(plain)


def workbook(path, rows):
    """A workbook with shared, inline and plain cells, and gaps."""
    shared, cells = [], []
    for y, row in enumerate(rows, 1):
        own = ""
        for x, v in enumerate(row):
            at = f"{chr(65 + x)}{y}"
            if v is None:
                continue
            if (x + y) % 3 == 0:
                shared.append(f"<si><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r></si>")
                own += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
            elif (x + y) % 3 == 1:
                own += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                own += f'<c r="{at}" t="str"><v>{v}</v></c>'
        cells.append(f'<row r="{y}">{own}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_a_spreadsheet_goes_before_a_csv(spark, tmp_path):
    folder = g.write(tmp_path / "g")
    rows = [["root", "gloss", "sort", "oblique"], ["tamb", "a drum", "hard", None], ["vit", None, "dulled", "vis"], ["é12", "x", "7"]]
    workbook(folder / "Lexicon/Wordlists/noun.xlsx", rows)
    own = load_lexicon(spark, load_grammar(folder), "noun")
    assert sorted(tuple(r) for r in own.collect()) == [("tamb", "a drum", "hard", ""), ("vit", "", "dulled", "vis"), ("é12", "x", "7", "")]
    assert sheet_rows((folder / "Lexicon/Wordlists/noun.xlsx").read_bytes())[1] == ["tamb", "a drum", "hard"]


SCHEMAS = {
    "Rules.json": {"type": "object", "required": ["kind", "rules"], "properties": {"kind": {"const": "Rules"}, "rules": {"type": "array", "minItems": 1, "items": {"$ref": "Parts.json#/definitions/rule"}}}, "additionalProperties": False},
    "Parts.json": {"definitions": {
        "rule": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "pattern": "^[a-z]+$"}, "direction": {"enum": ["ltr", "rtl"]}, "weight": {"type": ["integer", "null"], "minimum": 0, "maximum": 9}, "more": {"oneOf": [{"$ref": "#/definitions/pair"}, {"type": "string", "minLength": 2}]}}},
        "pair": {"type": "array", "items": [{"type": "string"}, {"type": "string"}], "minItems": 2, "maxItems": 2, "uniqueItems": True, "additionalItems": False},
    }},
}


@pytest.mark.parametrize(
    "value,path",
    [
        ([], "$"),
        ({"kind": "Rules"}, "$"),
        ({"kind": "Other", "rules": [{"name": "a"}]}, "$.kind"),
        ({"kind": "Rules", "rules": []}, "$.rules"),
        ({"kind": "Rules", "rules": [{"name": "a"}], "own": 1}, "$.own"),
        ({"kind": "Rules", "rules": [{"name": "a"}, {}]}, "$.rules[1]"),
        ({"kind": "Rules", "rules": [{"name": "A1"}]}, "$.rules[0].name"),
        ({"kind": "Rules", "rules": [{"name": 1}]}, "$.rules[0].name"),
        ({"kind": "Rules", "rules": [{"name": "a", "direction": "up"}]}, "$.rules[0].direction"),
        ({"kind": "Rules", "rules": [{"name": "a", "weight": 10}]}, "$.rules[0].weight"),
        ({"kind": "Rules", "rules": [{"name": "a", "weight": True}]}, "$.rules[0].weight"),
        ({"kind": "Rules", "rules": [{"name": "a", "more": ["x", "x"]}]}, "$.rules[0].more"),
        ({"kind": "Rules", "rules": [{"name": "a", "more": "x"}]}, "$.rules[0].more"),
    ],
)
def test_each_violation_has_its_place(value, path):
    assert [p for p, _ in Schemas(SCHEMAS).errors("Rules", value)] == [path]


def test_what_fits_has_no_errors():
    fine = {"kind": "Rules", "rules": [{"name": "a", "direction": "ltr", "weight": None, "more": ["x", "y"]}, {"name": "b", "weight": 3, "more": "xy", "free": {}}]}
    assert Schemas(SCHEMAS).errors("Rules", fine) == []
    assert [p for p, _ in Schemas({"X": {"not": {"type": "null"}, "if": {"type": "string"}, "then": {"maxLength": 1}, "else": {"anyOf": [{"type": "number"}, {"contains": {"const": 1}}]}}}).errors("X", "ab")] == ["$"]


def test_report_over_files(spark, folder, tmp_path):
    for name, data in SCHEMAS.items():
        (tmp_path / name).write_text(json.dumps(data), encoding="utf-8")
    got = {(r["kind"], r["name"], r["path"]) for r in schema_report(spark, str(folder), str(tmp_path)).collect()}
    assert got == {("Rules", "zbroken", "$.rules[0]")}
