import collections

from helpers import empty, odd

from morphlake.llm.mixing import mix, sample


def rows(spark, n=400):
    data = [(i, "word " * (5 + i % 7), "en" if i % 3 else "fr", "big" if i % 4 else "small", 1, [1], 2) for i in range(n)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, weight array<int>, t int")


def test_marginals_reach_their_targets(spark):
    got = mix(rows(spark), rounds=20, source_shares={"big": 0.25, "small": 0.75}, lang_shares={"en": 0.5, "fr": 0.5}).collect()
    total = sum(r["n_tokens"] * r["weight"] for r in got)
    assert abs(total / sum(r["n_tokens"] for r in got) - 1) < 1e-4
    for dim, want in (("source", {"big": 0.25, "small": 0.75}), ("lang", {"en": 0.5, "fr": 0.5})):
        share = collections.Counter()
        for r in got:
            share[r[dim]] += r["n_tokens"] * r["weight"] / total
        assert all(abs(share[k] - v) < 1e-3 for k, v in want.items())


def test_copies_follow_weights(spark):
    got = mix(rows(spark, 3000), rate=0.7, source_shares={"big": 0.5, "small": 0.5}).collect()
    assert all(int(0.7 * r["weight"]) <= r["copies"] <= int(0.7 * r["weight"]) + 1 for r in got)
    assert abs(sum(r["copies"] for r in got) / sum(0.7 * r["weight"] for r in got) - 1) < 0.05
    kept = {r["doc_id"] for r in sample(rows(spark, 3000), rate=0.7, source_shares={"big": 0.5, "small": 0.5}).collect()}
    assert kept == {r["doc_id"] for r in got if r["copies"]}


def test_the_sample_has_the_target_shares(spark):
    source, lang = {"big": 0.25, "small": 0.75}, {"en": 0.5, "fr": 0.5}
    table = rows(spark, 6000)
    got = sample(table, rounds=20, source_shares=source, lang_shares=lang)
    assert got.columns == table.columns
    tokens = collections.Counter()
    for r in got.collect():
        n = len(r["text"].split())
        tokens.update({"all": n, r["source"]: n, r["lang"]: n})
    assert all(abs(tokens[k] / tokens["all"] - v) < 0.02 for k, v in {**source, **lang}.items())
    want = {r["doc_id"]: r["copies"] for r in mix(table, rounds=20, source_shares=source, lang_shares=lang).collect()}
    assert collections.Counter(r["doc_id"] for r in got.collect()) == {k: v for k, v in want.items() if v}


def test_rows_of_one_id_go_by_their_own_cells(spark):
    data = [(1, "a b c d", "en", "none"), (1, "e f g h", "fr", "some"), (1, None, "en", "none")]
    got = sample(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as __source", "2 as weight"), rate=0.99, source_shares={"some": 1.0})
    assert {r["lang"] for r in got.collect()} <= {"fr"}


def test_odd_rows(spark):
    got = mix(odd(spark)).collect()
    assert len(got) == 8
    assert {r["source"] for r in got if r["doc_id"] in (1, 2)} == {"none"}
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 4)} == {0}
    assert mix(empty(spark)).count() == 0
    assert sample(empty(spark)).count() == 0
    assert sample(odd(spark), rate=100.0).columns == odd(spark).columns
