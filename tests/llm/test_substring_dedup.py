import random

import numpy as np
from helpers import docs, empty, odd

from morphlake.llm.common import mixed
from morphlake.llm.substring_dedup import Stretches, alike, compact_windows, leading, matched, merged, passages, promising, repeats_within, supported


def test_windows_cover_every_stretch_once():
    rng = np.random.default_rng(3)
    for n in (3, 10, 60):
        h = rng.integers(1, 30, n).astype(np.uint64)
        left, centre, right = compact_windows(h, 5)
        for i in range(n):
            for j in range(i + 4, n):
                own = [c for a, c, b in zip(left, centre, right, strict=True) if a <= i <= c <= j <= b]
                assert own == [i + int(np.argmin(h[i : j + 1]))]


def _lists(rng):
    """Lists of tokens from few and from many kinds, with stretches of the first one, some of them altered, in the others."""
    out = []
    for n in (0, 3, 40, 120, 200):
        own = rng.integers(0, rng.choice([4, 30, 5000]), n)
        if len(out) > 2:
            at, stretch = int(rng.integers(0, n - 30)), out[2][5:35].copy()
            stretch[rng.integers(0, 30, 2)] = 9999
            own[at : at + 30] = stretch
        out.append(own)
    return out


def test_passages_of_pairs_are_those_of_plain_comparison():
    rng, least, percent = np.random.default_rng(5), 10, 70
    some = 0
    for block in (1, 40, 1 << 20) * 6:
        lists = _lists(rng)
        begin = np.cumsum([0, *map(len, lists)])
        a, b = np.array([2, 3, 4, 3, 0, 1]), np.array([3, 4, 2, 3, 2, 1])
        pair, ca, cb, want = [], [], [], []
        for p, (x, y) in enumerate(zip(a, b, strict=True)):
            x, same = lists[x], x == y
            y = lists[y]
            for _ in range(60 if len(x) and len(y) else 0):
                pair.append(p), ca.append(rng.integers(0, len(x))), cb.append(rng.integers(0, len(y)))
            near = lambda s, d: len({*x[s : s + least]} & {*y[s + d : s + d + least]}) / len({*x[s : s + least]} | {*y[s + d : s + d + least]})  # noqa: B023, E731
            for q, i, j in zip(pair, ca, cb, strict=True):
                d = j - i
                if q == p and not (same and abs(d) < least):
                    want += [(p, s, s + d) for s in range(max(0, i - least + 1, -d), min(i, len(x) - least, len(y) - least - d) + 1) if near(s, d) >= percent / 100 - 1e-9]
        span = np.full(len(pair), 60 << 16 | 60)
        got = matched(np.concatenate(lists), begin, a, b, np.array(pair), np.zeros(len(pair), np.int32), np.array(ca), np.array(cb), span, least, percent, 1, block)
        assert sorted({(p, s + k, t + k) for p, s, e, t, f in zip(*(g.tolist() for g in got), strict=True) for k in range(e - s - least + 1)}) == sorted({tuple(map(int, w)) for w in want})
        assert all(e - s == f - t >= least for _, s, e, t, f in zip(*(g.tolist() for g in got), strict=True))
        some += len(want)
    assert some > 100


def test_promising_stretches_keep_every_near_duplicate():
    rng, least, percent = np.random.default_rng(8), 8, 75
    for _ in range(200):
        a, b = rng.integers(0, 40, 50), rng.integers(0, 40, 50)
        at, to = rng.integers(0, 38, 2)
        b[to : to + 12] = a[at : at + 12]
        run = np.repeat([0, 1], [20, 30])
        keep = promising(np.isin(a, b), repeats_within(a.astype(np.uint64), least), run, least, percent)
        for i in [*range(13), *range(20, 43)]:
            for j in range(43):
                x, y = {*a[i : i + least].tolist()}, {*b[j : j + least].tolist()}
                if 100 * len(x & y) >= percent * len(x | y):
                    assert keep[i : i + least].all()


def _linked_stretches(texts, least=46, percent=80):
    """(a, b) -> words of a and of b in stretches of `least` shingles that are near-duplicates, by plain comparison."""
    tokens = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in map(str.split, texts)]
    out = {}
    for a in range(len(texts)):
        for b in range(a):
            common = {*tokens[a]} & {*tokens[b]}
            if 100 * len(common) < percent * least:
                continue
            own = [[s for s in range(len(t) - least + 1) if 100 * len(common.intersection(t[s : s + least])) >= percent * len({*t[s : s + least]})] for t in (tokens[a], tokens[b])]
            sets = [[{*t[s : s + least]} for s in starts] for t, starts in zip((tokens[a], tokens[b]), own, strict=True)]
            for s, x in zip(own[0], sets[0], strict=True):
                for u, y in zip(own[1], sets[1], strict=True):
                    if 100 * len(x & y) >= percent * len(x | y):
                        words = out.setdefault((a, b), (set(), set()))
                        words[0].update(range(s, s + least + 4))
                        words[1].update(range(u, u + least + 4))
    return out


def test_result_against_plain_comparison_of_all_stretches(spark):
    """Families of passages with substituted, lost and added words, and a line that all texts share: share of links and of words found."""
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    line, texts = prose(14), []
    for _ in range(30):
        base = prose(rng.choice([52, 60, 80, 130]))
        for _ in range(rng.choice([1, 2, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at, how = rng.randrange(len(own)), rng.random()
                own[at : at + (how < 0.75)] = prose(1) if how < 0.5 or how >= 0.75 else []
            texts.append(" ".join([*prose(rng.randint(0, 60)), *line, *prose(3), *own, *prose(rng.randint(0, 60))]))
    want, got = _linked_stretches(texts), {}
    for r in passages(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    links = sum(any(r["class_id"] == q["class_id"] for r in got.get(a, ()) for q in got.get(b, ())) for a, b in want)
    words = {}
    for (a, b), own in want.items():
        for d, w in zip((a, b), own, strict=True):
            words.setdefault(d, set()).update(w)
    covered = sum(len(w & {k for r in got.get(d, ()) for k in range(r["start_word"], r["end_word"])}) for d, w in words.items())
    extra = sum(len({k for r in rows for k in range(r["start_word"], r["end_word"])} - words.get(d, set())) for d, rows in got.items())
    print("links", links / len(want), "of", len(want), "words", covered / sum(map(len, words.values())), "others", extra)
    assert len(want) > 40 and links >= 0.95 * len(want)
    assert covered >= 0.95 * sum(map(len, words.values())) and extra == 0


def test_support_counts_functions_near_the_diagonal():
    rng, least = np.random.default_rng(6), 9
    for _ in range(20):
        n = 150
        pair, i, ca, shift = (rng.integers(*r, n) for r in ((0, 3), (0, 4), (0, 60), (-20, 20)))
        lo, hi = ca - rng.integers(0, 12, n), ca + rng.integers(0, 12, n)
        want = [len({i[x]} | {i[y] for y in range(n) if pair[x] == pair[y] and abs(ca[x] - ca[y]) < least and abs(shift[x] - shift[y]) <= least // 4 and min(hi[x], hi[y]) - max(lo[x], lo[y]) + 1 >= least}) for x in range(n)]
        for enough in (1, 2, 3):
            assert supported(pair, i, ca, shift, lo, hi, least, enough).tolist() == [w >= enough for w in want]


def test_merged_stretches_of_a_group_meet():
    group, start, stop = (np.array(x) for x in ([1, 0, 0, 0, 1, 0], [5, 0, 3, 9, 0, 1], [7, 3, 4, 12, 5, 2]))
    assert [x.tolist() for x in merged(group, start, stop)] == [[0, 0, 1], [0, 9, 0], [4, 12, 7]]


def test_planted_passages_are_found_and_plain_texts_left(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    prose = lambda n: [word() for _ in range(n)]
    shared, line = prose(70), prose(12)
    texts, want = [], {}
    for d in range(40):
        own = prose(rng.randint(60, 300))
        own[10:10] = line
        if d % 4 == 0:
            passage = list(shared)
            if d % 8 == 0:
                passage[35] = word()
            at = rng.randint(0, len(own))
            own[at:at] = passage
            want[d] = (at, at + 70)
        texts.append(" ".join(own))
    copy = " ".join(prose(80))
    twice = prose(60)
    texts += [copy, copy, " ".join([*twice, *prose(100), *twice]), "short text", "short text"]
    got = {}
    for r in passages(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["class_id"]))
    assert set(got) == {*want, 40, 41, 42}
    for d, (a, b) in want.items():
        assert any(s <= a + 8 and e >= b - 8 and c == 0 for s, e, c in got[d]), (d, got[d])
        assert all(s >= a - 12 and e <= b + 12 for s, e, _ in got[d]), (d, got[d])
    assert got[40] == got[41] == [(0, 80, 40)]
    assert len(got[42]) == 2


def test_odd_rows(spark):
    rows = passages(odd(spark)).collect()
    assert {r["doc_id"] for r in rows} == {3}
    assert passages(empty(spark)).count() == 0


def test_rare_passages_within_common_boilerplate_are_found(spark):
    rng = random.Random(7)
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    stock, texts, pairs = prose(40), [], 25
    rare = [prose(15) for _ in range(pairs)]
    for d in range(4 * pairs):
        texts.append(" ".join([*prose(30), *stock, *(rare[d % pairs] if d < 2 * pairs else prose(15)), *prose(30)]))
    got = {r["doc_id"]: r for r in passages(docs(spark, texts)).collect()}
    near = lambda x, y: len(x & y) / len(x | y)
    sets = [[{tuple(t[k : k + 5]) for k in range(s, s + 46)} for s in range(len(t) - 49)] for t in map(str.split, texts)]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if any(near(x, y) >= 0.8 for x, y in zip(sets[a], sets[b], strict=True))}
    assert want == {(d + pairs, d) for d in range(pairs)}
    assert {d: r["class_id"] for d, r in got.items()} == {d: d % pairs for d in range(2 * pairs)}
    assert all(r["start_word"] <= 30 and r["end_word"] >= 85 for r in got.values())


def test_a_block_of_equal_stretches_leaves_nothing_open():
    tokens = np.tile(np.arange(40), 2)
    one = np.array([0]), np.array([0], np.int32), np.array([20]), np.array([20]), np.array([40 << 16 | 40])
    got = matched(tokens, np.array([0, 40, 80]), np.array([0]), np.array([1]), *one, 10, 80, 1)
    assert [x.tolist() for x in got] == [[0], [11], [30], [11], [30]]


def test_chains_of_copies_keep_every_link(spark):
    """Chains of texts that are each one word off the one before, the new words of some of them shared with other chains, so that ends are no near-duplicates of each other; and variants of one passage that link with its altered copies alone."""
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    chains, common = [], prose(12)
    for k in range(12):
        chain = [prose(70)]
        for _ in range(9):
            own = list(chain[-1])
            own[rng.randrange(70)] = rng.choice(common) if k % 2 else prose(1)[0]
            chain.append(own)
        chains += chain
    hot = prose(60)
    for k in range(30):
        own = list(hot)
        own[20 + k % 2 * 15] = f"variant{k % 2}"
        chains.append([*own, *prose(1)] if k % 3 else own)
    rng.shuffle(chains)
    texts = [" ".join([*prose(5), *own, *prose(5)]) for own in chains]
    want, got = _linked_stretches(texts), {}
    for r in passages(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    root = list(range(len(texts)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    words = {}
    for (a, b), own in want.items():
        a_, b_ = sorted((top(a), top(b)))
        root[b_] = a_
        for d, w in zip((a, b), own, strict=True):
            words.setdefault(d, set()).update(w)
    assert len(want) > 200
    assert {d: {k for r in rows for k in range(r["start_word"], r["end_word"])} for d, rows in got.items()} == words
    assert {d: {r["class_id"] for r in rows} for d, rows in got.items()} == {d: {top(d)} for d in words}


def test_runs_of_one_word_are_compared_as_sets_at_every_distance(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    pool, texts = prose(4), []
    for _ in range(24):
        own = [w for _ in range(rng.randint(4, 9)) for w in [rng.choice(pool)] * rng.randint(8, 20)]
        texts.append(" ".join([*prose(5), *own * rng.choice([1, 1, 2]), *prose(5)]))
    owner, start, sets = [], [], []
    for d, t in enumerate(map(str.split, texts)):
        for s in range(len(t) - 49):
            owner.append(d), start.append(s), sets.append({tuple(t[k : k + 5]) for k in range(s, s + 46)})
    names = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for k, x in enumerate(sets):
        held[k, [names[y] for y in x]] = 1
    owner, start, size = np.array(owner), np.array(start), held.sum(1)
    both = held @ held.T
    near = (100 * both >= 80 * (size[:, None] + size - both)) & ((owner[:, None] != owner) | (abs(start[:, None] - start) >= 46))
    words, root = {}, np.arange(len(texts))
    for k in np.flatnonzero(near.any(1)):
        words.setdefault(int(owner[k]), set()).update(range(start[k], start[k] + 50))
    linked = np.zeros((len(texts), len(texts)), bool)
    np.logical_or.at(linked, (owner[np.nonzero(near)[0]], owner[np.nonzero(near)[1]]), True)
    for _ in texts:
        root = np.minimum(root, np.where(linked, root, len(texts)).min(1))
    got = {}
    for r in passages(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(words) > 15
    assert {d: {k for r in rows for k in range(r["start_word"], r["end_word"])} for d, rows in got.items()} == words
    assert {d: {r["class_id"] for r in rows} for d, rows in got.items()} == {d: {root[d]} for d in words}


def test_near_stretches_of_two_lists_are_those_of_plain_comparison():
    rng, least, percent, some = np.random.default_rng(12), 10, 70, 0
    for _ in range(60):
        lists = _lists(rng)[1:]
        lists[1], lists[2] = np.tile(lists[1][:7], 9), np.concatenate([lists[2], lists[3][:60], lists[2][40:]])
        begin = np.cumsum([0, *map(len, lists)])
        kinds, code = np.unique(np.concatenate(lists), return_inverse=True)
        at, stretches = np.full(len(kinds), -1), [Stretches(code[a:b], mixed(kinds.astype(np.uint64) + np.uint64(1)), least) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        for a, b in ((0, 2), (2, 3), (3, 2), (1, 2), (1, 1), (2, 2), (3, 3)):
            sets = [[{*x[s : s + least].tolist()} for s in range(len(x) - least + 1)] for x in (lists[a], lists[b])]
            near = np.array([[100 * len(x & y) >= percent * len(x | y) and (a != b or abs(s - u) >= least) for u, y in enumerate(sets[1])] for s, x in enumerate(sets[0])]).reshape(len(sets[0]), len(sets[1]))
            got = alike(stretches[a], stretches[b], percent, at, least if a == b else 0, block=16)
            assert [x.tolist() for x in got] == [np.flatnonzero(near.any(1)).tolist(), np.flatnonzero(near.any(0)).tolist()] and (at == -1).all()
            some += int(near.sum())
    assert some > 1000


def test_first_shingles_reach_over_their_own_stretches_alone():
    g = np.full(60, 2**64 - 1, np.uint64)
    g[10:40] = 1 + np.arange(30, dtype=np.uint64) * 16
    place, low, high = leading(g, 10, 80, np.zeros(51, bool))
    assert place.tolist() == high.tolist() == list(range(10, 32)) and low.tolist() == list(range(9, 31))
