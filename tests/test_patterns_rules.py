import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from morphlake.functions.patterns import Patterns, PatternSyntaxError, expression, mirrored, strings
from morphlake.functions.rules import Rule, make_rule, rewritten
from morphlake.functions.symbols import SymbolError, Symbols, decoded, encoded

SYMBOLS = Symbols([*"abcde", "ch"], ["[T]"], ["[n=1]"])
P = Patterns(SYMBOLS, {"<V>": ["a", "e"], "<C>": ["b", "c", "d", "ch"]}, {"<Syl>": "<Onset><V>", "<Onset>": "<C>?"})


def hit(pattern, word):
    return bool(re.fullmatch(P.whole(pattern), SYMBOLS.bow + SYMBOLS.encode(word) + SYMBOLS.eow))


@pytest.mark.parametrize(
    "pattern,yes,no",
    [
        ("a|bc", ["a", "bc"], ["ab", "b", ""]),
        ("{ab}+c?", ["ab", "bac", "a"], ["c", "acc"]),
        ("{^ab}", ["c", "ch", "-"], ["a", "ca"]),
        ("(a|b)*<C>", ["abch", "d"], ["a"]),
        ("<Syl><Syl>", ["chabe", "ae"], ["b", "bab"]),
        ("#a.#", ["ab", "a-"], ["a", "abc"]),
        ("<Phone>[T]", ["a[T]"], ["[T]a"]),
        ("a<Empty>b", ["ab"], ["a"]),
        ("b(u|)".replace("u|", "a"), ["ba"], ["b"]),
    ],
)
def test_patterns(pattern, yes, no):
    assert [w for w in yes if not hit(pattern, w)] == [] and [w for w in no if hit(pattern, w)] == []


@pytest.mark.parametrize("pattern", ["a**", "(a", "{a", "a|", "|a", "a)", "^a", "{a*}", "<None>", "x", "{}"])
def test_syntax_errors(pattern):
    with pytest.raises(PatternSyntaxError):
        P.parse(pattern)


def test_circles_and_infinite_values():
    with pytest.raises(PatternSyntaxError):
        Patterns(SYMBOLS, {}, {"<x>": "<y>", "<y>": "<x>a"})
    with pytest.raises(PatternSyntaxError):
        strings(P.parse("a*"))
    assert [SYMBOLS.decode(x) for x in strings(P.parse("a{bc}"))] == ["ab", "ac"]


def test_longest_symbol_wins(spark):
    assert len(SYMBOLS.encode("chc")) == 2
    with pytest.raises(SymbolError):
        SYMBOLS.encode("ax")
    df = spark.createDataFrame([("cha[T]b-",), ("zz",), (None,)], "w string").withColumn("c", encoded(SYMBOLS, F.col("w")))
    assert [r[0] for r in df.select(decoded(SYMBOLS, F.col("c"))).collect()] == ["chab-", None, None]


def apply(rule, word):
    return [SYMBOLS.decode(x, tags=True) for x in rule.rewrite(SYMBOLS.bow + SYMBOLS.encode(word) + SYMBOLS.eow)]


def test_rewriting():
    assert apply(make_rule(P, [("a", "b")], "b"), "baaa") == ["bbbb"]  # what is written feeds the left context
    assert apply(make_rule(P, [("a", "b")], "b", direction="sim"), "baaa") == ["bbaa"]
    assert apply(make_rule(P, [("a", "b"), ("b", "a")]), "aabb") == ["bbaa"]
    assert apply(make_rule(P, [(None, "e")], "b", "c"), "abcbd") == ["abecbd"]
    assert apply(make_rule(P, [("b", None)], right="c"), "abcb") == ["acb"]
    assert apply(make_rule(P, [("a", "{bc}")]), "a") == ["b", "c"]
    assert apply(make_rule(P, [("a", "e")], right="<C>*#"), "aba[T]") == ["aba[T]"]
    assert apply(make_rule(P, [("a", "b")], right="b", direction="rtl"), "aab") == ["bbb"]


def test_native_and_general_paths_agree(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice(["a", "b", "c", "d", "e", "ch", "[T]", "-"]) for _ in range(rng.randint(0, 7))) for _ in range(150)})
    codes = [SYMBOLS.bow + SYMBOLS.encode(w) + SYMBOLS.eow for w in words]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    native = 0
    for pairs, left, right in itertools.product([[("a", "b")], [("a", "ch"), ("e", "b")], [("a", None)], [("{ab}", "c")], [("a", "b"), ("b", "a")]], [None, "c", "d", "#"], [None, "<C>*#", "a"]):
        rule = make_rule(P, pairs, left, right)
        native += rule.native(F.col("c")) is not None
        got = {r["c"]: r["out"] for r in df.select("c", rewritten([rule], F.col("c")).alias("out")).collect()}
        assert got == {c: rule.rewrite(c) for c in codes}, (pairs, left, right)
    assert native > 20


def plain_rewrite(rule, codes):
    """The same from the definition: whole strings, and a regular expression for each place."""
    if rule.direction == "rtl":
        back = Rule([(mirrored(a), [o[::-1] for o in b]) for a, b in rule.pairs], mirrored(rule.right), mirrored(rule.left))
        return sorted(x[::-1] for x in plain_rewrite(back, codes[::-1]))
    before = lambda x: re.search(f"(?:{expression(rule.left)})$", x)
    after = lambda q: re.compile(expression(rule.right)).match(codes, q)
    n = len(codes)
    states, done = [{""}] + [set() for _ in range(n)], set()
    for p in range(n + 1):
        for out in states[p]:
            fits = before(codes[:p] if rule.direction == "sim" else out)
            hits = [(q, o) for a, outs in rule.pairs for q in range(p + 1, n + 1) if fits and re.fullmatch(expression(a), codes[p:q]) and after(q) for o in outs]
            more = [o for a, outs in rule.pairs if fits and re.fullmatch(expression(a), "") and after(p) for o in outs]
            for q, o in hits:
                states[q].add(out + o)
            if not hits:
                for start in [out + o for o in more] or [out]:
                    (states[p + 1] if p < n else done).add(start + codes[p : p + 1])
    return sorted(done)


def test_two_passes_give_what_the_definition_does():
    rng = random.Random(12)
    parts = ["a", "b", "c", "{ab}", "<C>", "<V>+", "ab", "a?b", "<C>*a", "(a|bc)", "[T]", "{^a}"]
    pick = lambda: None if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(1, 2)))
    outs = [None, "a", "b", "{ab}", "c?", "ba", "(a|bc)"]
    several = 0
    for _ in range(300):
        pairs = [(rng.choice(parts + [None]), rng.choice(outs)) for _ in range(rng.randint(1, 2))]
        right = rng.choice([pick(), "#", "<C>*#"])
        rule = make_rule(P, pairs, rng.choice([pick(), None]), right, rng.choice(["ltr", "ltr", "rtl", "sim"]))
        for _ in range(4):
            word = "".join(rng.choice(["a", "b", "c", "d", "[T]"]) for _ in range(rng.randint(0, 5)))
            codes = SYMBOLS.bow + SYMBOLS.encode(word) + SYMBOLS.eow
            want = plain_rewrite(rule, codes)
            several += len(want) > 1
            assert rule.rewrite(codes) == want, (pairs, rule.direction, right, word)
    assert several > 100


def test_long_words_take_linear_time():
    import time

    rule = make_rule(P, [("a", "b"), ("ba", "c")], "<C>", "<C>*a|<C>*#")
    rule.rewrite(SYMBOLS.bow)
    began = time.time()
    assert len(rule.rewrite(SYMBOLS.encode("abbac" * 2000))) >= 1
    assert time.time() - began < 1
