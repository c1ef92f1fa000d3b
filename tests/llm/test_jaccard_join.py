import random
import re

import pytest
from helpers import docs, empty, odd

from morphlake.llm import jaccard_join
from morphlake.llm.jaccard_join import jaccard_components, keep_one


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(texts, size, percent):
    sets = [shingle_set(t, size) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    line = "one common line of words that many texts share all over the place"
    texts = []
    for _ in range(30):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([2, 5, 30, 120, 300]))]
        if rng.random() < 0.4:
            base += line.split()
        for _ in range(rng.choice([1, 1, 3, 8])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"W{rng.randint(0, 3000)}"
            texts.append(" ".join(own) + rng.choice(["", " ", "\n"]))
    return [*texts, *texts[:5], None, "", " \n", "UPPER case Words", "upper CASE words", "é É"]


@pytest.mark.parametrize("size,percent,block", [(3, 90, 4096), (5, 80, 4096), (3, 90, 6)])
def test_components_against_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SETS", min(block, 512))
    texts = corpus(size + block)
    rows = jaccard_components(docs(spark, texts), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, size, percent)
    own = {shingle_set(t, size) for t in texts} - {frozenset()}
    links = {x: sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in own) for x in own}
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: links.get(shingle_set(t, size), 0) for i, t in enumerate(texts)}


def test_keep_one(spark):
    texts = corpus(4)
    want = {i for i, (n, c) in brute(texts, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in keep_one(docs(spark, texts)).collect()} == want


def test_keep_one_goes_by_id_and_text(spark):
    x, y = "one text of some words that is here to be found again", "quite another text that has no words in common with it"
    rows = [(3, x), (5, x), (5, y), (None, x), (None, "of no id and of no kin to any other row here"), (7, None), (7, x), (7, x)]
    docs_ = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, __k int, root int")
    got = keep_one(docs_)
    assert got.columns == docs_.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted([(3, x), (5, y), (-1, "of no id and of no kin to any other row here"), (7, "")])


def test_low_similarities_lose_no_link(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    texts = []
    for n, extra in ((60, 0), (62, 71), (60, 200), (40, 0), (300, 30), (700, 0)):
        own = words[:n] if extra < 100 else [f"v{k}" for k in range(n)]
        texts.append(" ".join([*own, *(f"x{rng.randint(0, 10**6)}" for _ in range(extra))]))
    rows = jaccard_components(docs(spark, texts), 3, 45).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, 3, 45)
    sizes = [60, 133, 64, 128, 250, 500]
    sets = [{*range(min(n, 58))} | {1000 * k + i for i in range(n - min(n, 58))} for k, n in enumerate(sizes)]
    bitmap = lambda x: sum(1 << b for b in {e % jaccard_join.width_of(len(x)) for e in x})
    found = {tuple(sorted(p)) for p in jaccard_join.survivors([(len(x), bitmap(x), len(x), k, 0) for k, x in enumerate(sets)], 10)}
    want = {(i, j) for j in range(6) for i in range(j) if 10 * len(sets[i] | sets[j]) <= 100 * len(sets[i] & sets[j])}
    few = {tuple(sorted(p)) for p in jaccard_join._few([(len(x), bitmap(x).to_bytes(jaccard_join.width_of(len(x)) // 8, "little"), len(x), k, 0) for k, x in enumerate(sets)], 10)}
    assert want and want <= found and want <= few


def test_odd_rows(spark):
    rows = jaccard_components(odd(spark)).collect()
    assert len(rows) == 8
    assert {r["component_id"] for r in rows if r["doc_id"] == 3} == {3}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert keep_one(odd(spark)).count() == 8
    assert keep_one(empty(spark)).count() == 0
    assert jaccard_components(empty(spark)).count() == 0
