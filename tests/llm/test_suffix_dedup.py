import collections
import hashlib
import random

import numpy as np
import pytest
from helpers import docs, empty, odd

from morphlake.llm import suffix_dedup
from morphlake.llm.suffix_dedup import remove_repeats, repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(6)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return texts + texts[:5] + ["ab" * 100, "a" * 300, "abc" * 15, None, "", "z" * 7, "ab" * 3]


@pytest.mark.parametrize("length", [12, 25])
def test_transform_finds_what_repeats(length):
    rng = random.Random(length)
    bodies = sorted({t.encode() for t in corpus(rng) if t and len(t.encode()) >= length})
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    for b, flags in zip(bodies, repeats(bodies, length), strict=True):
        assert flags.tolist() == [seen[b[i : i + length]] > 1 for i in range(len(b) - length + 1)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(random.Random(7))
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(docs(spark, texts), 25).collect()}
    assert got == dict(enumerate(brute(texts, 25)))


def test_odd_rows(spark):
    rows = remove_repeats(odd(spark), 200, with_text=True).collect()
    assert len(rows) == 8
    assert all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] in (3, 6))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows)
    assert remove_repeats(empty(spark)).count() == 0
