"""Stored relations: only what has changed is worked out again, and joins leave bucketed tables where they are."""

from pathlib import Path

import grammar_fixture as g
import pytest

from morphlake.operators.paradigm import Paradigm, bucketed, inflect, inflected, materialize, parse, refresh, store_path
from morphlake.sources.grammar import load_grammar
from morphlake.sources.lexicon import load_lexicon


def rows(df):
    return sorted(map(repr, df.select("root", "feature_key", "form", "form_tagged", "form_code").collect()))


def files(grammar, name, store):
    base = Path(store_path(Paradigm(grammar, name), str(store)))
    return {str(f.relative_to(base)) for f in base.rglob("forms/**/*.parquet")}


@pytest.fixture()
def folder(tmp_path):
    return g.write(tmp_path / "g")


def test_a_changed_row_rewrites_one_part(spark, folder, tmp_path):
    grammar, store = load_grammar(folder), tmp_path / "store"
    schema = "root string, gloss string, sort string, oblique string"
    words = [(f"{a}{b}{c}", "x", "hard", "") for a in "bdgk" for b in "aeiou" for c in "lmnr"]
    refresh_with = lambda own: refresh(spark, grammar, "noun_hard", f"file://{store}", spark.createDataFrame(own, schema), parts=16)
    whole = lambda own: materialize(spark, grammar, ["noun_hard"], f"file://{store}", lexicon=spark.createDataFrame(own, schema))
    assert len(refresh_with(words)) > 12
    before = files(grammar, "noun_hard", store)
    assert refresh_with(words) == [] and files(grammar, "noun_hard", store) == before
    assert refresh_with([(r, "another gloss", s, o) for r, _, s, o in words]) == []  # no form comes from a gloss
    changed = [("bal", "x", "hard", "bolt"), *words[1:]]
    assert len(refresh_with(changed)) == 1
    after = files(grammar, "noun_hard", store)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    fewer = [w for w in changed if w[0] not in ("bal", "kur")] + [("pal", "new", "hard", None), ("pal", "new", "soft", None)]
    assert 1 <= len(refresh_with(fewer)) <= 3
    own = spark.read.parquet(f"file://{store_path(Paradigm(grammar, 'noun_hard'), str(store))}/forms")
    assert rows(own) == rows(inflected(spark, grammar, "noun_hard", spark.createDataFrame(fewer, schema)))
    assert refresh_with([]) != [] and not list(store.rglob("forms/part=*/*.parquet"))
    assert whole(words[:3]).count() == 18


def test_only_paradigms_that_depend_on_it_are_rebuilt(spark, folder, tmp_path):
    names, store = ["noun_hard", "noun_gliding", "noun_dulled"], f"file://{tmp_path}/store"
    prints = lambda: {n: Paradigm(load_grammar(folder), n).fingerprint() for n in names}
    first = prints()
    materialize(spark, load_grammar(folder), names, store)
    g.put(folder / "Phonology/Rules", "rules", {"kind": "Rules", "rules": [
        {"name": "glide", "input_pattern": "u", "output_pattern": "ooo", "right_context": "<Beat>#"},
        {"name": "dull", "input_pattern": "t", "output_pattern": "s", "right_context": "#"},
    ]})
    second = prints()
    assert {n for n in names if first[n] != second[n]} == {"noun_gliding"}
    g.put(folder / "Phonology/Patterns", "patterns", {"kind": "Patterns", "patterns": [{"ref": "<Beat>", "pattern": "<Core>?<C>*"}, {"ref": "<Core>", "pattern": "<V>"}]})
    assert {n for n in names if prints()[n] != second[n]} == {"noun_gliding"}  # through the rule's context
    own = load_grammar(folder)
    assert [refresh(spark, own, n, store) for n in ("noun_hard", "noun_dulled")] == [[], []]
    assert refresh(spark, own, "noun_gliding", store) != []
    got = materialize(spark, own, names, store)
    assert rows(got) == sorted(r for n in names for r in rows(inflected(spark, own, n)))
    assert materialize(spark, own, names[:1], store, force=True).count() == 12


def test_bucketed_tables_stay_where_they_are(spark, folder, tmp_path):
    grammar = load_grammar(folder)
    lexicon = load_lexicon(spark, grammar, "noun")
    own = inflected(spark, grammar, "noun_hard", lexicon)
    by_form = bucketed(own, "forms_by_form", "form", 8, f"file://{tmp_path}/by_form")
    by_root = bucketed(own, "forms_by_root", "root", 8, f"file://{tmp_path}/by_root")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        asked = spark.createDataFrame([("tamb-un",), ("none",)], "form string").repartition(3)
        found = parse(by_form, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 1
        wanted = spark.createDataFrame([("tamb", own.first()["feature_key"])], "root string, feature_key string")
        assert inflect(by_root, wanted).count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.sql("DROP TABLE forms_by_form")
        spark.sql("DROP TABLE forms_by_root")
