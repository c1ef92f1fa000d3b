import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from morphlake.functions.patterns import Patterns
from morphlake.functions.symbols import Symbols
from morphlake.operators import automata as m
from morphlake.operators.edit import beam_automata, final_arcs

P = Patterns(Symbols(list("abcd")), {"<V>": ["a"], "<C>": ["b", "c", "d"]})
PATTERNS = ["a", "ab*", "(a|ab)(c|bcd)", "{ab}+c?", "(<C><V>|<C><V><C>)+", "((a|aa)*b)?", "<Phone>*d", "(a|b)*a(a|b)(a|b)", "a?a?a?aaa", "<Empty>", "{^ab}c"]
WORDS = ["".join(w) for n in range(5) for w in itertools.product("abcd", repeat=n)]


def code(w):
    return "".join(P.symbols.code[c] for c in w)


def plain(codes):
    return P.symbols.decode(codes)


def matching(pattern, words=WORDS):
    rx = re.compile(P.regex(pattern))
    return {w for w in words if rx.fullmatch(code(w))}


def words_table(spark, words):
    return spark.createDataFrame([(code(w),) for w in words], "word string")


def test_accepts_what_the_regular_expression_does(spark):
    table = spark.createDataFrame([(w, code(w)) for w in WORDS], "w string, c string")
    checks = [m.Automaton.of(P.parse(p)).accepts(F.col("c")).alias(f"p{k}") for k, p in enumerate(PATTERNS)]
    rows = table.select("w", *checks).collect()
    for k, p in enumerate(PATTERNS):
        assert {r["w"] for r in rows if r[f"p{k}"]} == matching(p), p


def test_no_backtracking(spark):
    """A pattern on which a backtracking engine takes time exponential in the length."""
    table = spark.createDataFrame([(code("a" * 4000),), (code("a" * 4000 + "b"),)], "c string")
    began = time.time()
    assert [r[0] for r in table.select(m.Automaton.of(P.parse("((a|aa)+)+b")).accepts(F.col("c"))).collect()] == [False, True]
    assert time.time() - began < 20
    with pytest.raises(ValueError, match="states"):
        m.Automaton.of(P.parse("(a|b)*a" + "(a|b)" * 12), most=1000)


@pytest.mark.parametrize("minus", [False, True])
def test_product_with_a_trie(spark, minus):
    own = random.Random(3).sample(WORDS, 150)
    for p in ("(a|ab)(c|bcd)*", "{ab}+c?"):
        right = m.Automaton.of(P.parse(p)).tables(spark)
        _, ends = m.product(m.trie(words_table(spark, own)), right, minus)
        got = {plain(r["l"]) for r in ends.collect()}
        assert got == ({w for w in own if w not in matching(p)} if minus else set(own) & matching(p))


def test_product_of_patterns_and_emptiness(spark):
    table = lambda p: m.Automaton.of(P.parse(p)).tables(spark)
    arcs, ends = m.product(table("(ab)*"), table("a*b*"), start=("0", "0"))
    name = lambda c: F.concat_ws("/", *c)
    one = arcs.select(F.lit("x").alias("a"), name(["l", "r"]).alias("state"), "label", name(["l2", "r2"]).alias("next"))
    got = m.n_shortest(one, ends.select(F.lit("x").alias("a"), name(["l", "r"]).alias("state")), 9, "0/0").collect()
    assert sorted((r["rank"], plain(r["string"])) for r in got) == [(1, ""), (2, "ab")]
    assert m.product(table("a+"), table("b+"), start=("0", "0"))[1].isEmpty()
    assert m.product(table("ab"), table("a{bc}"), True, ("0", "0"))[1].isEmpty()


def test_n_shortest(spark):
    arcs = ends = None
    for p in PATTERNS:
        a, e = m.Automaton.of(P.parse(p)).tables(spark)
        a, e = a.withColumn("a", F.lit(p)), e.withColumn("a", F.lit(p))
        arcs, ends = (a, e) if arcs is None else (arcs.unionByName(a), ends.unionByName(e))
    got = {}
    for r in m.n_shortest(arcs, ends, 6, "0").collect():
        got.setdefault(r["a"], []).append((r["rank"], plain(r["string"])))
    for p in PATTERNS:
        want = sorted(matching(p), key=lambda w: (len(w), code(w)))[:6]
        assert [w for _, w in sorted(got.get(p, []))][: len(want)] == want, p
    single = m.Automaton.of(P.parse("a<Empty>b")).tables(spark)
    named = lambda t, n: t.withColumn("a", F.lit(n))
    assert [plain(r["string"]) for r in m.only_string(named(single[0], "s"), named(single[1], "s"), "0").collect()] == ["ab"]
    more = m.Automaton.of(P.parse("ab*")).tables(spark)
    with pytest.raises(Exception, match="more than one string"):
        m.only_string(named(more[0], "s"), named(more[1], "s"), "0").collect()


def test_epsilon_and_cycles_in_a_beam(spark):
    """(ab)* with silent arcs in a circle, against a lexicon."""
    c = P.symbols.code
    arcs = spark.createDataFrame([("q", "0", c["a"], "1"), ("q", "1", c["b"], "2"), ("q", "2", "", "3"), ("q", "3", None, "0"), ("q", "0", "", "2")], "q string, state string, label string, next string")
    left = final_arcs(*m.without_epsilon(arcs, spark.createDataFrame([("q", "3")], "q string, state string"), "q"), "l", "q")
    right = final_arcs(*m.trie(words_table(spark, WORDS)), "r")
    got = {plain(r["labels"]) for r in beam_automata(left, right, 1000).collect()}
    assert got == {w for w in WORDS if w and re.fullmatch("(ab)*", w)}
    near = beam_automata(left, final_arcs(*m.trie(words_table(spark, ["abb", "ca"])), "r"), 500, fuzzy=True, longest=8).collect()
    assert {(plain(r["labels"]), r["weight"]) for r in near} == {("abb", 1.0), ("ca", 2.0)}


def test_minimal_automaton(spark):
    rng = random.Random(7)
    own = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(200)})
    arcs, ends, members = m.minimal(spark.createDataFrame([(w,) for w in own], "word string"))
    moves = {(r["state"], r["label"]): r["next"] for r in arcs.collect()}
    assert len(moves) == arcs.count()
    last = {r["state"] for r in ends.collect()}
    prefixes = {w[:k] for w in own for k in range(len(w) + 1)}
    follow = {p: frozenset(w[len(p) :] for w in own if w.startswith(p)) for p in prefixes}
    assert len({r["state"] for r in members.collect()}) == len(set(follow.values()))

    def accepted(w):
        s = ""
        for x in w:
            s = moves.get((s, x))
        return s in last

    assert {"".join(w) for n in range(8) for w in itertools.product("abc", repeat=n) if accepted(w)} == set(own)


def test_product_reads_its_left_arcs_once(spark):
    """However many levels there are: a trie isn't built anew for each."""
    from morphlake.operators import automata

    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    word = "abcdef"
    rows = [(word[:k], word[k], word[: k + 1]) for k in range(6)]
    arcs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(counted), "state string, label string, next string")
    other = spark.createDataFrame([("0", c, "0") for c in word], "state string, label string, next string")
    _, ends = automata.product((arcs, spark.createDataFrame([(word,)], "state string")), (other, spark.createDataFrame([("0",)], "state string")))
    assert [tuple(r) for r in ends.collect()] == [(word, "0")] and seen.value == 6


def test_a_beam_reads_arcs_of_a_step_at_that_step(spark):
    """A trie dealt out by steps gives what the whole one gives; an arc of another step isn't taken."""
    arcs, ends = m.Automaton.of(P.parse("<V>*<C>*")).tables(spark)
    left = final_arcs(arcs, ends, "l").withColumn("q", F.lit("q"))
    right = final_arcs(*m.trie(words_table(spark, WORDS)), "r")
    rows = lambda r: sorted((x["q"], x["labels"], x["weight"]) for x in beam_automata(left, r, None).collect())
    assert rows(right.withColumn("step", F.length("rs") + 1)) == rows(right)
    assert rows(right) and rows(right.withColumn("step", F.length("rs") + 2)) == []
