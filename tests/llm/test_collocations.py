import random
import re
from collections import Counter

import pytest
from helpers import docs, empty, odd

from morphlake.llm import collocations as c

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=5, least=100, top=2000):
    """Rows of COLUMNS for (lang, text) pairs, in plain Python."""
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = count.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            own.update(tuple(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, own in count.items():
        held = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        kept = []
        for p, a in held.items():
            if any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in held.items()):
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("hot,stretch,bits,top", [(1 << 16, 2 << 20, 22, 2000), (5, 60, 10, 2000), (1, 90, 22, 2000), (40, 200, 2, 7)])
def test_same_as_plain_python(spark, monkeypatch, hot, stretch, bits, top):
    rng = random.Random(hot)
    words = ["the", "The", "of", "b", "é", "\xa0z", "rare", "x" * 20, "new york", "as well as it"]
    weights = [9, 3, 6, 4, 3, 2, 1, 1, 4, 4]
    text = lambda: "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t ", ", ", "\n"]) for _ in range(rng.randint(0, 90)))
    rows = [(rng.choice(["en", "en", "fr", None]), text()) for _ in range(70)]
    rows += rows[:9] + [("en", "deep in the old wood " * 12)] * 3 + [("de", None), ("de", "a b")]
    monkeypatch.setattr(c, "STRETCH", stretch)
    table = spark.createDataFrame(rows, "lang string, text string")
    want = brute(rows, 5, 12, top)
    assert plain(c.collocations(table, 5, 12, top, bits=bits, hot=hot, share=1 << 19 if hot > 9 else 400)) == want
    assert len(want) > 15 and {r[0] for r in want} == {"en", "fr", "und"}


def test_other_lengths(spark):
    rows = [("en", "a b a b a b c d"), ("en", "b a, b a b\nc d c d")]
    table = spark.createDataFrame(rows, "lang string, text string")
    for longest, least in ((2, 1), (3, 2), (7, 1)):
        assert plain(c.collocations(table, longest, least)) == brute(rows, longest, least)


def test_odd_rows(spark):
    for table in (odd(spark), empty(spark), docs(spark, [None, ""])):
        rows = [(r["lang"], r["text"]) for r in table.collect()]
        for least in (1, 100):
            assert plain(c.collocations(table, 3, least)) == brute(rows, 3, least)
