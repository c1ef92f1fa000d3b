import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from morphlake.operators.edit import beam_search, beam_search_both_ways, conditional_kl, edit_costs, kl_from_uniform, matrix_cells, random_transition_matrix, trie_csr, weighted_distance
from morphlake.operators.reports import grammar_stats, inflection_meta, inventory_stats, lexical_features, marker_file_problems, pattern_report, roots_of, rule_report, run_rule
from morphlake.sources.lexicon import features_of, init_lexicon, load_lexicon, principal_part, with_gloss


def words(spark, items, name="word"):
    return spark.createDataFrame([(w,) for w in items], f"{name} string")


def brute(a, b, cost):
    table = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        best = [0.0] if i == j == 0 else []
        if i:
            best.append(table[i - 1, j] + cost.get((a[i - 1], ""), 1))
        if j:
            best.append(table[i, j - 1] + cost.get(("", b[j - 1]), 1))
        if i and j:
            best.append(table[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else cost.get((a[i - 1], b[j - 1]), 1)))
        table[i, j] = min(best)
    return table[len(a), len(b)]


def test_weighted_distance(spark):
    rng = random.Random(2)
    costs = [("a", "b", 0.25), ("", "c", 0.5), ("b", "", 2.5)]
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for bound in (None, 2.0):
        for r in df.withColumn("d", weighted_distance(F.col("a"), F.col("b"), costs, bound=bound)).collect():
            want = brute(r["a"], r["b"], {(x, y): c for x, y, c in costs})
            assert r["d"] == (None if bound and want > bound else want)


def test_cost_matrix(spark):
    matrix = spark.createDataFrame([([[None, 1.0, 2.0], [3.0, 0.0, 4.0], [5.0, None, 0.0]],)], "costs array<array<double>>")
    got = {(r["src"], r["dst"], r["cost"], r["op"]) for r in edit_costs(matrix_cells(matrix, ["a", "b"])).collect()}
    assert got == {("", "a", 1.0, "insert"), ("", "b", 2.0, "insert"), ("a", "", 3.0, "delete"), ("b", "", 5.0, "delete"), ("a", "b", 4.0, "substitute")}


def test_trie(spark):
    rows = trie_csr(words(spark, ["ab", "ac", "b", "ab"])).orderBy("prefix").collect()
    assert [(r["prefix"], r["n_arcs"], r["offset"], r["final"]) for r in rows] == [("", 2, 0, False), ("a", 2, 2, False), ("ab", 0, 4, True), ("ac", 0, 4, True), ("b", 0, 4, True)]


@pytest.mark.parametrize("both", [False, True])
def test_beam_is_exact_when_wide(spark, both):
    lexicon, asked = ["cat", "cart", "dog"], ["cat", "cot"]
    run = beam_search_both_ways if both else beam_search
    exact = {(r["q"], r["labels"]) for r in run(words(spark, asked, "query"), words(spark, lexicon)).collect()}
    assert exact == {("cat", "cat")}
    got = {(r["q"], r["labels"]): r["weight"] for r in run(words(spark, asked, "query"), words(spark, lexicon), num_beam=400, fuzzy=True, longest=7).collect()}
    assert got == {(q, w): brute(q, w, {}) for q in asked for w in lexicon}


def test_divergence(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "y", 0.0)], "src string, dst string, p double")
    got = {r["src"]: r["kl"] for r in kl_from_uniform(rows).collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(math.log(2))
    prior = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "src string, prior double")
    assert conditional_kl(rows, prior).first()["kl"] == pytest.approx(math.log(2) / 4)
    drawn = random_transition_matrix(spark, list("abcd"), 0.5, masked=(3,)).groupBy("src").agg(F.sum("p").alias("p")).collect()
    assert {r["src"]: round(r["p"], 9) for r in drawn} == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_reports(spark, grammar):
    assert {r["ref"]: r["all_pass"] for r in pattern_report(spark, grammar).collect()} == {"<Beat>": True}
    assert [r["all_pass"] for r in rule_report(spark, grammar).collect()] == [True]
    case = spark.createDataFrame([("rat", "raus"), ("rat", "ras")], "input string, expected string")
    assert [(r["output"], r["pass"]) for r in run_rule(grammar, "$both", case).collect()] == [(["raus"], True), (["raus"], False)]
    stats = {r["kind"]: r for r in grammar_stats(spark, grammar).collect()}
    assert stats["Paradigm"]["files"] == 4 and stats["Rules"]["invalid_files"] == 1 and stats["FeatureMarkers"]["total"] == 24
    assert inventory_stats(spark, grammar).first()["roots"] == 8
    meta = inflection_meta(spark, grammar).where("name = 'noun_hard'").first()
    assert meta["free_features"] == ["role"] and meta["lexical_features"] == ["sort"]
    assert grammar.stages() == ["ending", "stem"]
    assert marker_file_problems(grammar, ["hard_roles", "soft_roles", "none"], [], {"number"}) == ["role isn't asked for", "two files express role", "no valid file none"]


def test_lexicon(spark, grammar, tmp_path):
    lexicon = load_lexicon(spark, grammar, "noun")
    assert {r["root"]: r["stem"] for r in principal_part(lexicon, "oblique").collect()}["vit"] == "vit"
    assert [r[0] for r in with_gloss(lexicon, "drum").collect()] == ["tamb"]
    assert features_of(lexicon, ["sort"]).where("root = 'mur'").first()["features"] == {"sort": "gliding"}
    assert roots_of(spark, grammar, "Paradigm", "noun_soft").count() == 2
    assert lexical_features(spark, grammar, "Lexicon", "noun").count() == 8
    assert init_lexicon(spark, grammar, "noun").endswith("noun.csv")


def test_stream(spark, tmp_path):
    from morphlake.streaming.parse_stream import start_parsing

    relation = spark.createDataFrame([("f1", "p", "r1", "k", {"a": "b"}), ("f1", "p", "r2", "k", {"a": "b"})], "form string, paradigm string, root string, feature_key string, features map<string,string>")
    words(spark, ["f1", "f2"], "form").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("form string").parquet(str(tmp_path / "in"))
    query = start_parsing(stream, relation, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_beam_search_has_no_limit_on_length(spark, monkeypatch):
    from morphlake.operators import edit

    monkeypatch.setattr(edit, "range", lambda n: iter((0, 1)), raising=False)  # any bounded loop ends after two steps
    got = beam_search(words(spark, ["abc"], "query"), words(spark, ["abc", "abd"])).collect()
    assert [tuple(r) for r in got] == [("abc", "abc", 0.0)]
