import unicodedata

import pytest
from grammar_fixture import GOLDEN, ROLES, WORDS
from pyspark.sql import functions as F

from morphlake.functions.symbols import encoded, feature_key
from morphlake.operators.paradigm import NotExponed, Paradigm, checked, inflect, inflected, materialize, parse, search, search_parse, stages
from morphlake.sources.grammar import GrammarError
from morphlake.sources.lexicon import load_lexicon

nfkd = lambda s: unicodedata.normalize("NFKD", s)
NAMES = ["noun_hard", "noun_soft", "noun_gliding", "noun_dulled"]
REST = {"number": "one", "style": "plain"}


@pytest.fixture(scope="module")
def relation(spark, grammar, tmp_path_factory):
    return materialize(spark, grammar, NAMES, f"file://{tmp_path_factory.mktemp('relation')}").cache()


def test_every_form_of_every_root(relation):
    rows = relation.collect()
    assert len(rows) == 6 * len(WORDS)
    got = {(r["root"], r["features"]["role"]): r["form"] for r in rows}
    for root, forms in GOLDEN.items():
        assert [got[root, role] for role in ROLES] == [nfkd(f) for f in forms.split()]


def test_tags_block_a_rule_and_are_kept_apart(relation):
    row = relation.where("root = 'pal' and features['role'] = 'agent'").first()
    assert row["form_tagged"] == "pa[Hold]lt-a" and row["form"] == "palt-a"


def test_inflect_and_its_checks(spark, grammar, relation):
    ask = spark.createDataFrame([("tamb", {"role": "patient"}), ("xyz", {"role": "patient"})], "root string, features map<string,string>")
    assert [r["form"] for r in inflect(relation, checked(grammar, "noun_hard", ask)).collect()] == ["tamb-un"]
    wrong = spark.createDataFrame([("tamb", {"case": "nom"})], "root string, features map<string,string>")
    with pytest.raises(Exception, match="needs the features"):
        checked(grammar, "noun_hard", wrong).collect()


def test_parse_gives_all_analyses_with_gloss(spark, grammar, relation):
    forms = spark.createDataFrame([("tamb-un",), ("tambun",), ("raks-e",)], "form string")
    rows = parse(relation, forms, load_lexicon(spark, grammar, "noun")).collect()
    assert {(r["form"], r["root"], r["gloss"], r["features"]["role"]) for r in rows} == {("tamb-un", "tamb", "drum", "patient"), ("raks-e", "rat", "knot", "agent")}


def test_search_counts_symbols(spark, grammar, relation):
    own = relation.where("root = 'tamb'")
    ask = spark.createDataFrame([("tamb-os",)], "query string").withColumn("query_code", encoded(grammar.symbols, F.col("query")))
    got = [(r["form"], r["distance"]) for r in search(own, ask, 6).orderBy("rank").collect()]
    assert got == [("tamb-a", 2), ("tamb-ist", 2), ("tamb-olo", 2), ("tamb-un", 2), ("tamb-ur", 2), (nfkd("tamb-eká"), 4)]
    assert search_parse(own, ask, load_lexicon(spark, grammar, "noun"), 2).count() == 2


def test_search_finds_every_form_within_the_bound(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    forms = {word(rng.randint(0, 16)) for _ in range(300)}
    asked = {word(rng.randint(0, 16)) for _ in range(40)}
    relation = spark.createDataFrame([(f, f) for f in forms], "form string, form_code string")
    queries = spark.createDataFrame([(q, q) for q in asked], "query string, query_code string")
    both = queries.crossJoin(relation).withColumn("d", F.levenshtein("query_code", "form_code"))
    for bound in (2, 5):
        want = {(r["query"], r["form"], float(r["d"])) for r in both.where(F.col("d") <= bound).collect()}
        assert {(r["query"], r["form"], r["distance"]) for r in search(relation, queries, 1000, bound).collect()} == want


def test_stages_show_each_step_even_for_unknown_roots(spark, grammar):
    key = feature_key({"role": "patient", **REST})
    lexicon = load_lexicon(spark, grammar, "noun")
    ask = spark.createDataFrame([("mur", key), ("dur", key)], "root string, feature_key string")
    rows = stages(grammar, "noun_gliding", ask, lexicon).orderBy("root", "stage_no").collect()
    assert [(r["stage"], r["surface_forms"]) for r in rows[4:]] == [("Initial", ["mur"]), ("stem", ["muir"]), ("ending", ["muir-un"]), ("Final", ["muir-un"])]
    assert rows[3]["surface_forms"] == ["duir-un"]
    wrong = spark.createDataFrame([("mur", feature_key({"role": "none", **REST}))], "root string, feature_key string")
    with pytest.raises(Exception, match="has no cell"):
        stages(grammar, "noun_gliding", wrong, lexicon).collect()


def test_unexpressed_cells_are_skipped(grammar):
    p = Paradigm(grammar, "noun_hard")
    assert len(p.cells()) == 6 and "unmarked" in p.warnings[0]
    with pytest.raises(NotExponed):
        p.markers({"role": "unmarked"})
    with pytest.raises(GrammarError):
        p.markers({"role": "seventh"})


def test_cells_that_cannot_be_built_are_skipped_each(spark, tmp_path, caplog):
    import grammar_fixture as g

    from morphlake.sources.grammar import load_grammar

    root = g.write(tmp_path / "g")
    bad = {"agent": {"kind": "infix", "value": "o"}, "patient": {"kind": "rule", "value": "$nowhere"}, "place": {"kind": "principal_part", "value": "missing"}, "source": {"kind": "suffix", "value": "("}}
    markers = {role: [bad.get(role, {"kind": "suffix", "value": "-o"})] for role in ROLES}
    g.put(root / "Exponence/FeatureMarkers", "hard_roles", {"kind": "FeatureMarkers", "feature": "role", "markers": markers})
    rows = inflected(spark, load_grammar(root), "noun_hard").collect()
    assert {(r["root"], r["features"]["role"]) for r in rows} == {(w, role) for w in ("tamb", "lok") for role in ("tool", "company")}
    assert sum("skipped" in r.getMessage() for r in caplog.records) >= 4


def test_a_changed_rule_changes_the_stored_relation(spark, tmp_path):
    import grammar_fixture as g

    from morphlake.sources.grammar import load_grammar

    root, store = g.write(tmp_path / "g"), f"file://{tmp_path}/store"
    patient = lambda: {r["root"]: r["form"] for r in materialize(spark, load_grammar(root), ["noun_gliding"], store).where("features['role'] = 'patient'").collect()}
    assert patient() == {"mur": "muir-un", "pal": "paul-un"}
    rules = [{"name": "glide", "input_pattern": "u", "output_pattern": "ooo", "right_context": "<C>*#"}]
    g.put(root / "Phonology/Rules", "rules", {"kind": "Rules", "rules": rules})
    assert patient() == {"mur": "mooor-un", "pal": "pal-un"}


def test_contingent_files_come_first_and_values_may_be_many(spark, tmp_path):
    import grammar_fixture as g

    from morphlake.sources.grammar import load_grammar

    root = g.write(tmp_path / "g")
    g.put(root / "Exponence/FeatureMarkers", "number", {"kind": "FeatureMarkers", "feature": "number", "markers": {"one": None, "many": [{"kind": "prefix", "value": "o-"}]}})
    g.put(root / "Exponence/ContingentFeatureMarkers", "special", {"kind": "ContingentFeatureMarkers", "features": ["number", "role"], "markers": [
        {"features": {"number": "many", "role": "place"}, "realization": [{"kind": "suffix", "value": "i{sz}e"}]},
        {"features": {"number": "many"}, "realization": [{"kind": "suppletion", "value": "dun"}]},
    ]})
    g.put(root / "Morphotactics/Paradigm", "both", {"kind": "Paradigm", "part_of_speech": "$noun", "feature_markers": {"role": "$hard_roles", "number": "$number", "style": "plain"}, "contingent_markers": ["$special"], "global_markers": [{"kind": "replace", "value": ["b", "p"], "stage": "last"}], "stage_order": ["ending", "last"], "filter": {"pattern": "<C><V><C>b"}})
    rows = inflected(spark, load_grammar(root), "both").collect()
    got = {}
    for r in rows:
        got.setdefault((r["features"]["number"], r["features"]["role"]), set()).add(r["form"])
    assert {r["root"] for r in rows} == {"tamb"}
    assert got["many", "place"] == {"tampise", "tampize"} and got["many", "agent"] == {"dun"} and got["one", "patient"] == {"tamp-un"}


def test_stages_of_a_cell_beside_one_that_cannot_be_built(spark, tmp_path):
    import grammar_fixture as g

    from morphlake.sources.grammar import load_grammar

    root = g.write(tmp_path / "g")
    markers = {role: [{"kind": "infix" if role == "place" else "suffix", "value": "-o"}] for role in ROLES}
    g.put(root / "Exponence/FeatureMarkers", "hard_roles", {"kind": "FeatureMarkers", "feature": "role", "markers": markers})
    loaded = load_grammar(root)
    key = lambda role: feature_key({"role": role, **REST})
    ask = lambda role: spark.createDataFrame([("tamb", key(role))], "root string, feature_key string")
    lexicon = load_lexicon(spark, loaded, "noun")
    assert [r["surface_forms"] for r in stages(loaded, "noun_hard", ask("tool"), lexicon).orderBy("stage_no").collect()] == [["tamb"], ["tamb-o"], ["tamb-o"]]
    with pytest.raises(Exception, match="infix can't be applied"):
        stages(loaded, "noun_hard", ask("place"), lexicon).collect()


def test_parse_broadcasts_nothing(spark, grammar):
    """What parsing joins grows with the data: however small it looks on disk, the driver never holds it."""
    from morphlake.operators import paradigm

    relation = spark.createDataFrame([("p", "a", "[x=1]", {"x": "1"}, "as")], "paradigm string, root string, feature_key string, features map<string,string>, form string")
    lexicon = spark.createDataFrame([("a", "g")], "root string, gloss string")
    found = paradigm.parse(relation, spark.createDataFrame([("as",), ("b",)], "form string"), lexicon)
    assert [(r["form"], r["root"], r["gloss"]) for r in found.collect()] == [("as", "a", "g")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
