"""Near-duplicate passages by compact windows over token min-hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import BASE, batch_bytes, components, discard, mixed, powers, small_batches, written
from morphlake.llm.shingles import WHITE, shingles


def compact_windows(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right) of each node of the Cartesian tree over h that spans `least` tokens or more.

    Every stretch from a token between left and centre to one between centre and right has its minimum at
    centre (the first of equal ones). Only a token that is the minimum of some `least` tokens in a row can span as
    many, and the nearest smaller token on either side of such a one is such a one itself; so the stack runs over those alone.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    low, have = h.copy(), 1
    while have < least:
        step = min(have, least - have)
        low[:-step] = np.minimum(low[:-step], low[step:])
        have += step
    low[n - least + 1 :] = 0  # minima of the rows of tokens that start here
    high, have = low.copy(), 1
    while have < least:
        step = min(have, least - have)
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        have += step
    place = np.flatnonzero(h == high)
    value = h[place].tolist()
    place = place.tolist()
    left, right, stack = [0] * len(place), [n - 1] * len(place), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[k] - 1
        left[k] = place[stack[-1]] + 1 if stack else 0
        stack.append(k)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left + 1 >= least
    return left[wide], np.array(place, np.int64)[wide], right[wide]


#: Groups of shingles by the first bits of their hash, in which they are counted.
BLOCKS = 10
#: Bytes of text in a group of texts.
GROUP = 2 << 20


def promising(some: np.ndarray, repeats: np.ndarray, run: np.ndarray, least: int, percent: int, near: np.ndarray | None = None) -> np.ndarray:
    """Which tokens of runs lie in a stretch of `least` tokens that may have a near-duplicate, given which tokens stand elsewhere too (or repeat).

    Of a stretch's distinct tokens at least percent / 100 must stand in the other stretch as well; where none repeats those are as many places.
    With near (which tokens stand in stretches that repeat a token, anywhere) the bound is that of two stretches that repeat none,
    2 percent / (100 + percent), except where percent / 100 of the tokens are near.
    """
    n = len(run)
    if n < least:
        return np.zeros(n, bool)

    def held(x):
        total = np.concatenate([[0], np.cumsum(x)])
        return total[least:] - total[:-least]

    fits = 100 * held(some) >= percent * least if near is None else ((100 + percent) * held(some) >= 2 * percent * least) | (100 * held(near) >= percent * least)
    fits = (run[least - 1 :] == run[: n - least + 1]) & (fits | repeats)
    edge = np.zeros(n + 1, np.int64)
    edge[: n - least + 1] += fits
    edge[least:] -= fits
    return np.cumsum(edge[:-1]) > 0


def leading(g: np.ndarray, least: int, percent: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, start, start): the tokens that are among the first of a stretch of `least` tokens, by g, of which two near-duplicates always share one, with the first and the last such stretch.

    Tokens with the greatest g stand in one place: they come first in every stretch and are shared by none. Of the others as many distinct ones count as can be missing, and
    one more. odd: which stretches are bounded by percent / 100 of their own tokens alone.
    """
    none = np.uint64(2**64 - 1)
    low, high = np.full(len(g), len(g)), np.full(len(g), -1)
    strong = -(-2 * percent * least // (100 + percent))
    for at in range(0, len(g) - least + 1, 1 << 14):
        own = np.arange(at, min(at + (1 << 14), len(g) - least + 1))
        own = own[(g[own] > 0) & (g[own + least - 1] > 0)]
        rows = g[own[:, None] + np.arange(least)]
        order = np.sort(rows, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = none
        again = odd[own]
        order[again] = np.sort(order[again], axis=1)
        held = (order < none).sum(1)
        size = np.where(again, held + (rows == none).sum(1), least)
        most = held - np.where(again, -(-percent * size // 100), strong) + 1
        fine = most > 0
        bound = np.take_along_axis(order[fine], most[fine, None] - 1, axis=1)
        which, k = np.nonzero(rows[fine] <= bound)
        start = own[fine][which]
        np.minimum.at(low, start + k, start)
        np.maximum.at(high, start + k, start)
    out = np.flatnonzero(high >= 0)
    return out, low[out], high[out]


def distinct(x: np.ndarray, some: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens, distinct tokens that some marks) of the stretches of `least` tokens at starts."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    size, held = np.zeros((2, len(starts)), np.int64)
    for at in range(0, len(starts), 1 << 14):
        own = starts[at : at + (1 << 14), None]
        places = own + np.arange(least)
        new = before[places] < own
        size[at : at + len(own)], held[at : at + len(own)] = new.sum(1), (new & (some[places] > 0)).sum(1)
    return size, held


class Stretches:
    """A list of tokens, by their code, with what is known of its stretches of `least` tokens: distinct tokens of each, and a hash of its set, where nothing but sets counts."""

    def __init__(self, code: np.ndarray, names: np.ndarray, least: int):
        n = max(0, len(code) - least + 1)
        self.code, self.least, self.n = code, least, n
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        before, after = np.full(len(code), -1), np.full(len(code), 2 * len(code) + least)
        before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
        place = np.arange(len(code))
        #: which tokens are new to the stretch that ends with them, and lost to the one after that which begins with them
        self.enters, self.leaves = before <= place - least, after >= place + least
        self.repeats = bool(n) and not (self.enters.all() and self.leaves.all())
        self.first = before[:least] < 0
        self.size = self.sums(np.ones(len(code), np.int64))
        self.set = self.sums(names[code])

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """The sum over each stretch's distinct tokens."""
        least, n = self.least, self.n
        if not n:
            return weight[:0]
        step = np.empty(n, weight.dtype)
        if self.repeats:
            step[0] = weight[:least][self.first].sum(dtype=weight.dtype)
            step[1:] = weight[least:] * self.enters[least:] - weight[: n - 1] * self.leaves[: n - 1]
        else:
            step[0] = weight[:least].sum(dtype=weight.dtype)
            step[1:] = weight[least:] - weight[: n - 1]
        return np.cumsum(step, dtype=weight.dtype)


def _facing(x: Stretches, y: Stretches, s: np.ndarray, hit: np.ndarray, met: np.ndarray, at: np.ndarray, percent: int, most: int = 8) -> None:
    """Marks stretches that repeat no token and of which enough tokens face their like at one of the distances that most tokens have. at: a place in y of each token, or -1."""
    least, places = x.least, np.zeros(len(x.code) + 1, np.int64)
    for tried in range(most):
        open_ = s[~hit[s] & (x.size[s] == least)]
        if not len(open_):
            return
        if not tried:
            places[open_] += 1
            np.subtract.at(places, open_ + least, 1)
            own = np.flatnonzero(np.cumsum(places[:-1]) > 0)
            to = at[x.code[own]]
            far, often = np.unique((to - own)[to >= 0], return_counts=True)
            order = np.argsort(-often, kind="stable")[:most]
            far = far[order][often[order] >= least // 2].tolist()
        if tried >= len(far):
            return
        d = far[tried]
        lo, hi = max(0, -d), min(len(x.code), len(y.code) - d)
        if hi - lo < least:
            continue
        total = np.concatenate([[0], np.cumsum(x.code[lo:hi] == y.code[lo + d : hi + d])])
        both = total[least:] - total[:-least]
        k = np.flatnonzero((100 + percent) * both >= 2 * percent * least) + lo
        k = k[(x.size[k] == least) & (y.size[k + d] == least)]
        hit[k] = met[k + d] = True


def _meetings(x: Stretches, y: Stretches, own: np.ndarray, one: np.ndarray, two: np.ndarray, held: np.ndarray, fewest: int, percent: int, at: np.ndarray, block: int):
    """Blocks (k, m, near): which stretches of x, that begin at one[k], are near those of y that begin at two[m]; own: the k to look at. Left out are m that none of a block's can be near.

    A stretch that repeats no token and has held[...] of them in y shares one of any held - need + 1 of those with what it is near; need follows from the fewest tokens of a stretch of y.
    """
    least = x.least
    own = own[np.argsort(one[own])]
    for i in range(0, len(own), block):
        k = own[i : i + block]
        left_rows = x.code[one[k][:, None] + np.arange(least)]
        at[y.code] = 0
        some = at[left_rows] == 0
        at[y.code] = -1
        plain = x.size[one[k]] == least
        enough = held[one[k]] + 1 + -percent * (least + fewest) // (100 + percent)
        lead = some & (~plain[:, None] | (np.cumsum(some, axis=1) <= enough[:, None]))
        at[left_rows[lead]] = 0
        total = np.concatenate([[0], np.cumsum(at[y.code] == 0)])
        at[left_rows[lead]] = -1
        met = np.flatnonzero(total[two + least] > total[two])
        met = met[np.argsort(two[met])]
        for j in range(0, len(met), block):
            m = met[j : j + block]
            rows = y.code[two[m][:, None] + np.arange(least)]
            at[left_rows] = 0
            names = np.unique(rows[at[rows] == 0])
            at[left_rows] = -1
            if not len(names):
                continue
            at[names] = np.arange(len(names))
            left, right = np.zeros((len(k), len(names) + 1), np.float32), np.zeros((len(m), len(names) + 1), np.float32)
            left[np.arange(len(k))[:, None], at[left_rows]] = 1
            right[np.arange(len(m))[:, None], at[rows]] = 1
            at[names] = -1
            both = left[:, :-1] @ right[:, :-1].T
            yield k, m, 100 * both >= percent * (x.size[one[k]][:, None] + y.size[two[m]][None] - both)


def alike(x: Stretches, y: Stretches, percent: int, at: np.ndarray, apart: int = 0, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all stretches of x, and of y, that have a near-duplicate in the other list; with apart only at least so far from it (x and y being one list).

    at has -1 for every code, and has so again afterwards. Stretches of one set are one, in which its first and last places count. Stretches that are found by equal sets or
    by tokens that face each other need no more comparison; all others are compared with every stretch that may be near.
    """
    least, none = x.least, np.zeros(0, np.int64)
    if not x.n or not y.n:
        return none, none
    ends = []
    for own, other in ((x, y), (y, x)):
        at[other.code] = 0
        held = own.sums((at[own.code] == 0).astype(np.int64)) if not apart else own.size
        at[other.code] = -1
        ends.append((held, 100 * held >= percent * own.size))
    (held, fine), (kept, good) = ends
    if not fine.any() or not good.any():
        return none, none
    fine, good = fine & ((100 + percent) * held >= percent * (x.size + y.size[good].min())), good & ((100 + percent) * kept >= percent * (y.size + x.size[fine].min()))
    s, u = np.flatnonzero(fine), np.flatnonzero(good)
    if not len(s) or not len(u):
        return none, none
    hit, met = np.zeros(x.n, bool), np.zeros(y.n, bool)
    if not apart:
        at[y.code] = np.arange(len(y.code))
        _facing(x, y, s, hit, met, at, percent)
        at[y.code] = -1
    # sets of either side, with their first and last places
    a, one, of = np.unique(x.set[s], return_index=True, return_inverse=True)
    b, two, by = np.unique(y.set[u], return_index=True, return_inverse=True)
    low, high = u[two], np.zeros(len(b), np.int64)
    np.maximum.at(high, by, u)
    if not apart:
        hit[s] |= np.isin(a, b, assume_unique=True)[of]
        met[u] |= np.isin(b, a, assume_unique=True)[by]
    else:
        hit[s] = (high[of] - s >= apart) | (s - low[of] >= apart)
        met = hit
    lack, want = np.zeros(len(a), bool), np.zeros(len(b), bool)
    lack[of[~hit[s]]] = True
    want[by[~met[u]]] = True
    one, two = s[one], u[two]
    least_at, most_at = np.full(len(a), 1 << 60), np.full(len(a), -1)
    back = np.zeros(len(b), bool)
    for k, m, near in _meetings(x, y, np.flatnonzero(lack), one, two, held, int(y.size[two].min()), percent, at, block):
        most_at[k] = np.maximum(most_at[k], np.where(near, high[m], -1).max(1))
        least_at[k] = np.minimum(least_at[k], np.where(near, low[m], 1 << 60).min(1))
        back[m] |= near.any(0)
    if not apart:
        for k, _, near in _meetings(y, x, np.flatnonzero(want & ~back), two, one, kept, int(x.size[one].min()), percent, at, block):
            back[k] |= near.any(1)
    hit[s] |= (most_at[of] >= 0) & ((most_at[of] - s >= apart) | (s - least_at[of] >= apart)) if apart else most_at[of] >= 0
    if not apart:
        met[u] |= back[by]
    return np.flatnonzero(hit), np.flatnonzero(met)


def _sorted(table):
    """A group's rows in order of t, so that every pass over the group sees the same order."""
    table = table.sort_by("t").combine_chunks()
    return table.column("t").to_numpy(), table.column("text")


def _tokens(table, words: int):
    """(names of texts, shingles, text of each, begin of each text) of a group."""
    names, text = _sorted(table)
    h, where = shingles(*batch_bytes(text), words)
    return names, h, where, np.searchsorted(where, np.arange(len(names) + 1))


def _counted(texts: DataFrame, words: int, least: int) -> DataFrame:
    """(g, block, counts): for the shingles of a group of texts in order of their hashes, by blocks of hashes, a byte each: the power of two that its places reach (0: one
    place), and 128 more if it stands in a stretch of `least` that repeats a shingle, anywhere.

    Each group sends a block's shingles as one row, and gets one row back.
    """
    import pyarrow as pa

    def binary(parts):
        return pa.array(parts, pa.binary())

    def send(key, table):
        _, h, where, _ = _tokens(table, words)
        again = promising(np.zeros(len(h), bool), repeats_within(mixed(h) + where.astype(np.uint64), least), where, least, 100)
        order = np.argsort(h)
        h, again = h[order], again[order]
        cuts = np.searchsorted(h >> np.uint64(64 - BLOCKS), np.arange((1 << BLOCKS) + 1))
        low = (h >> np.uint64(64 - BLOCKS - 32)).astype(np.uint32)
        full = np.flatnonzero(np.diff(cuts))
        parts = [(low[cuts[k] : cuts[k + 1]].tobytes(), np.packbits(again[cuts[k] : cuts[k + 1]]).tobytes()) for k in full.tolist()]
        return pa.table({"g": pa.array(np.full(len(full), key[0].as_py(), np.int64)), "block": pa.array(full.astype(np.int32)), "low": binary([x for x, _ in parts]), "again": binary([x for _, x in parts])})

    def count(table):
        low = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        size = np.array([len(x) for x in low])
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("again").to_pylist(), size.tolist(), strict=True)])
        low = np.concatenate(low)
        order = np.argsort(low)
        new = np.diff(low[order], prepend=low[order[:1]]) != 0
        kind = np.empty(len(low), np.int64)
        kind[order] = np.cumsum(new)
        often = np.ceil(np.log2(np.bincount(kind))).astype(np.uint8)
        often[np.unique(kind[again > 0])] |= 128
        ends = np.cumsum(size)
        counts = [often[kind[e - n : e]].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        return pa.table({"g": table.column("g"), "block": table.column("block"), "counts": binary(counts)})

    sent = texts.groupBy("g").applyInArrow(send, "g long, block int, low binary, again binary")
    return sent.groupBy("block").applyInArrow(count, "g long, block int, counts binary")


def _windows(texts: DataFrame, words: int, least: int, percent: int, hashes: int) -> DataFrame:
    """(key, t, c, far, span, kind, weight, odd): windows of the stretches that may have a near-duplicate, by texts' groups (see _counted).

    key names hash function and value; span packs centre - left and right - centre, no further than a stretch with the centre reaches; kind: a hash of the shingles there that stand elsewhere
    too, and of their places about the centre; weight: how many those are; odd: whether a stretch there is bounded by percent / 100 alone. Shingles of one place can't be
    shared and come last in each order. Function number `hashes` has, instead of minima, all shingles that are among the first of a stretch (see leading), rare ones first; span reaches over the stretches where they are, in one
    row for places of a text whose stretches overlap: c is the place of the first stretch, far the last that one of them reaches, and weight the number of the shingle's places in the text.
    """
    import pyarrow as pa

    def run(table, bits):
        names, h, text, begin = _tokens(table, words)
        counts = np.frombuffer(b"".join(bits.sort_by("block").column("counts").to_pylist()), np.uint8)
        often, near = np.zeros((2, len(h)), np.uint8)
        order = np.argsort(h)
        often[order], near[order] = counts & 127, counts >> 7
        some = (often > 0).astype(np.uint8)
        marked = mixed(h) + text.astype(np.uint64)
        again = repeats_within(marked, least)
        twice = np.flatnonzero(again)
        size, kept = distinct(marked, some, twice, least)
        again[twice] = 100 * kept >= percent * size
        fine = np.flatnonzero(promising(some, again, text, least, percent, near))
        own = np.cumsum(np.diff(fine, prepend=-2) + np.diff(text[fine], prepend=0) != 1) - 1
        h, text, some, near, often = h[fine], text[fine], some[fine], near[fine], often[fine]
        # a gap of zeros between two runs: no window reaches over it
        place = np.arange(len(h)) + own * least
        wide = int(place[-1]) + 1 if len(h) else 0
        token, held, close = np.zeros(wide, np.uint64), np.zeros(wide, np.int64), np.zeros(wide, np.int64)
        token[place], held[place], close[place] = h, some, near
        at = np.full(wide, -1)
        at[place] = np.arange(len(h))
        marked = np.arange(wide, dtype=np.uint64)
        marked[place] = mixed(h) + text.astype(np.uint64)
        repeats = repeats_within(marked, least)
        near_sum = np.concatenate([[0], np.cumsum(close)])
        odd = repeats | (100 * (near_sum[least:] - near_sum[:-least]) >= percent * least)
        odd_sum = np.concatenate([[0], np.cumsum(odd)])
        held_sum = np.concatenate([[0], np.cumsum(held)])
        up, down = powers(wide), powers(wide, np.uint64(pow(int(BASE), -1, 2**64)))
        body = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(held > 0, mixed(token), 0).astype(np.uint64) * up[:wide])])
        parts = []
        for i in range(hashes + 1):
            g = mixed(token + np.uint64((i % hashes + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) & ~np.uint64(15) | np.uint64(16)
            if i == hashes:
                g[place] = g[place] >> np.uint64(6) & ~np.uint64(15) | often.astype(np.uint64) << np.uint64(58)
            g[held == 0] = 2**64 - 1
            g[at < 0] = 0
            if i < hashes:
                left, c, right = compact_windows(g, least)
                real = (g[c] > 0) & (held[c] > 0)
                left, c, right = left[real], c[real], right[real]
            else:
                c, left, right = leading(g, least, percent, odd)
                right = right + least - 1
            left, right = np.maximum(left, c - least + 1), np.minimum(right, c + least - 1)
            kind = mixed((body[right + 1] - body[left]) * down[c] + ((c - left) << 16 | (right - c)).astype(np.uint64))
            # stretches that hold the centre
            strange = odd_sum[np.maximum(np.minimum(right - least + 1, c) + 1, left)] > odd_sum[left] if len(c) else np.zeros(0, bool)
            doc, key = text[at[c]], g[c] & ~np.uint64(15) | np.uint64(i)
            first, reach, weight = fine[at[c]] - begin[doc], fine[at[c]] - begin[doc] + right - c, held_sum[right + 1] - held_sum[left]
            if i == hashes and len(c):
                order = np.lexsort((first - (c - left), key, doc))
                doc, key, kind, strange, left, right, c, first, reach = (x[order] for x in (doc, key, kind, strange, left, right, c, first, reach))
                other = (np.diff(doc, prepend=-1) != 0) | (np.diff(key, prepend=~key[:1]) != 0)
                group = np.cumsum(other) - 1
                # places of a text whose stretches overlap are one row
                high = int(reach.max()) + 2
                far = np.maximum.accumulate(group * high + reach)
                new = np.flatnonzero(other | np.append(True, group[1:] * high + (first - (c - left))[1:] > far[:-1]))
                weight = np.bincount(group)[group[new]]
                reach = np.maximum.reduceat(reach, new)
                doc, key, first, kind, left, right, c, strange = doc[new], key[new], first[new], kind[new], left[new], right[new], c[new], np.logical_or.reduceat(strange, new)
            parts.append((key.view(np.int64), names[doc], first.astype(np.int32), reach.astype(np.int32), ((c - left) << 16 | (right - c)).astype(np.int32), kind.view(np.int64), weight.astype(np.int32), strange))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["key", "t", "c", "far", "span", "kind", "weight", "odd"])

    bits = _counted(texts, words, least)
    return texts.groupBy("g").cogroup(bits.groupBy("g")).applyInArrow(run, "key long, t long, c int, far int, span int, kind long, weight int, odd boolean")


def _word_counts(texts: DataFrame) -> DataFrame:
    """(doc_id, t, n): the number of words of each text."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 18):
            data, offsets = batch_bytes(batch.column(2))
            inside = ~WHITE[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(data)]
            first[inner] = inside[inner]
            total = np.concatenate([[0], np.cumsum(first)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total[offsets[1:]] - total[offsets[:-1]])], ["doc_id", "t", "n"])

    return texts.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n long")


def repeats_within(x: np.ndarray, least: int) -> np.ndarray:
    """For each stretch of `least` tokens, by its start, whether it holds a token twice."""
    order = np.argsort(x, kind="stable")
    before = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    if not same.any() or len(x) < least:
        return np.zeros(max(0, len(x) - least + 1), bool)
    high, have = before, 1
    while have < least:
        step = min(have, least - have)
        high = np.maximum(high[: len(high) - step], high[step:])
        have += step
    return high >= np.arange(len(high))


def supported(pair, i, ca, shift, lo, hi, least: int, enough: int) -> np.ndarray:
    """For each anchor, whether windows of `enough` hash functions near its diagonal overlap its own by `least` tokens.

    Near: centres less than `least` tokens apart, diagonals at most a quarter of that. Anchors lie in
    strips of diagonals, in order of their centres, so those near one are three stretches of that order.
    """
    n = len(i)
    if enough <= 1 or not n:
        return np.ones(n, bool)
    strip = shift // (least // 4 + 1)
    strip = strip - strip.min() + 1
    high, wide = int(ca.max()) + 2 * least, int(strip.max()) + 2
    key = (pair * wide + strip) * high + ca + least
    order = np.argsort(key, kind="stable")
    key, i, shift, lo, hi = key[order], i[order].astype(np.int64), shift[order], lo[order], hi[order]
    functions = np.left_shift(1, i)
    open_ = np.arange(n)
    for side in (0, -1, 1):
        at = np.searchsorted(key, key[open_] + side * high - least, side="right")
        end = np.searchsorted(key, key[open_] + side * high + least, side="left")
        x = open_
        while len(x):
            left = at < end
            x, at, end = x[left], at[left], end[left]
            if not len(x):
                break
            fits = (abs(shift[at] - shift[x]) <= least // 4) & (np.minimum(hi[x], hi[at]) - np.maximum(lo[x], lo[at]) + 1 >= least)
            functions[x[fits]] |= np.left_shift(1, i[at[fits]])
            more = np.bitwise_count(functions[x]) < enough
            x, at, end = x[more], at[more] + 1, end[more]
        open_ = open_[np.bitwise_count(functions[open_]) < enough]
    out = np.zeros(n, bool)
    out[order] = np.bitwise_count(functions) >= enough
    return out


def merged(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of each group (numbers from 0) joined where they meet; ends exclusive."""
    if not len(group):
        return group, start, stop
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    base = group * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(base + stop)
    first = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    begin = np.flatnonzero(first)
    last = np.concatenate([begin[1:], [len(group)]]) - 1
    return group[begin], start[begin], reach[last] - base[last]


def runs(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, place in it) for each member of runs of these lengths."""
    which = np.repeat(np.arange(len(length)), length)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)


def shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens in common, distinct tokens of both) for each row of x and of y."""

    def distinct(rows: np.ndarray) -> np.ndarray:
        rows.sort(axis=1)
        return (rows[:, 1:] != rows[:, :-1]).sum(1) + 1

    either = distinct(np.concatenate([x, y], axis=1))
    return distinct(x) + distinct(y) - either, either


def matched(tokens: np.ndarray, begin: np.ndarray, a: np.ndarray, b: np.ndarray, pair: np.ndarray, i: np.ndarray, ca: np.ndarray, cb: np.ndarray, span: np.ndarray, least: int, percent: int, enough: int, block: int = 1 << 20):
    """Verified passages (pair, from a, to a, from b, to b) of pairs of token lists, ends exclusive.

    tokens: all lists, one after another, list k from begin[k]; a, b: the lists of each pair. Anchors: pair, hash function, centre in a,
    centre in b, steps that windows leave to the left and right, packed. Anchors near one diagonal that at least `enough` functions
    have, and whose windows overlap by `least` tokens, are one place to look at: all stretches of `least` tokens that hold
    an anchor are compared as sets, at the same distance from it in both lists. `block` bounds the places compared at once.
    """
    ca, cb, span = ca.astype(np.int64), cb.astype(np.int64), span.astype(np.int64)
    size = np.diff(begin)
    shift, lo, hi = cb - ca, ca - (span >> 16), ca + (span & 65535)
    first = np.maximum(np.maximum(lo, ca - least + 1), np.maximum(-shift, 0))
    last = np.minimum(np.minimum(hi - least + 1, ca), np.minimum(size[a[pair]] - least, size[b[pair]] - least - shift))
    fine = supported(pair, i, ca, shift, lo, hi, least, enough) & (first <= last)
    fine &= (a[pair] != b[pair]) | (abs(shift) >= least)
    pair, shift, first, last = pair[fine], shift[fine], first[fine], last[fine]
    if not len(pair):
        return [np.zeros(0, np.int64)] * 5
    # stretches to compare, by pair and diagonal
    low = int(shift.min())
    line = pair * (int(shift.max()) - low + 1) + shift - low
    names, line = np.unique(line, return_inverse=True)
    line, start, stop = merged(line, first, last + 1)
    pair, shift = np.divmod(names[line], int(shift.max()) - low + 1)
    shift += low
    text = np.repeat(np.arange(len(size)), size)
    _, code = np.unique(tokens, return_inverse=True)
    code = code.astype(np.int32)
    kinds = int(code.max()) + 1
    twice = repeats_within(text * kinds + code, least)
    mark = np.zeros(kinds, bool)
    at_a, at_b = begin[a[pair]] + start, begin[b[pair]] + start + shift
    found = []
    total = np.cumsum(stop - start + least)
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1], block), side="right"))
    for c0, c1 in zip(cuts.tolist(), [*cuts[1:].tolist(), len(start)], strict=True):
        ea, eb, count = at_a[c0:c1], at_b[c0:c1], (stop - start)[c0:c1]
        which, k = runs(count + least - 1)
        equal = np.concatenate([[0], np.cumsum(code[ea[which] + k] == code[eb[which] + k])])
        which, k = runs(count)
        from_a, from_b = ea[which] + k, eb[which] + k
        place = np.arange(len(which)) + which * (least - 1)
        common = equal[place + least] - equal[place]  # tokens that face each other: where none repeats, so many are shared at least
        plain = ~twice[from_a] & ~twice[from_b]
        sure = plain & (100 * common >= percent * (2 * least - common))
        open_ = np.flatnonzero(~sure)
        # where no token repeats, no more are shared than occur in the other list at all
        of = pair[c0:c1][which[open_]]
        known = np.zeros(len(open_), np.int64)
        edges = np.flatnonzero(np.diff(of, prepend=-1))
        for e, f in zip(edges.tolist(), np.append(edges, len(of))[1:].tolist(), strict=True):
            p = of[e]
            own, other = code[begin[a[p]] : begin[a[p] + 1]], code[begin[b[p]] : begin[b[p] + 1]]
            mark[other] = True
            held = np.concatenate([[0], np.cumsum(mark[own])])
            mark[other] = False
            s = from_a[open_[e:f]] - begin[a[p]]
            known[e:f] = held[s + least] - held[s]
        open_ = open_[~plain[open_] | (100 * known >= percent * (2 * least - known))]
        for at in range(0, len(open_), 1 << 14):
            own = open_[at : at + (1 << 14), None]
            both, either = shared(code[from_a[own] + np.arange(least)], code[from_b[own] + np.arange(least)])
            sure[own[:, 0]] = 100 * both >= percent * either
        fits = np.flatnonzero(sure)
        seam = np.ones(len(fits) + 1, bool)
        seam[1:-1] = (np.diff(which[fits]) > 0) | (np.diff(fits) > 1)
        s, e = fits[seam[:-1]], fits[seam[1:]]
        p = pair[c0:c1][which[s]]
        found.append((p, from_a[s] - begin[a[p]], from_a[e] - begin[a[p]] + least, from_b[s] - begin[b[p]], from_b[e] - begin[b[p]] + least))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _verify(words: int, least: int, percent: int, enough: int):
    """A function of Arrow batches (a, b, anchors, text of a, text of b) to (t, u, start, stop): verified passages of t that u holds too."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 20):
            n = batch.num_rows
            names = np.concatenate([batch.column(k).to_numpy() for k in (0, 1)])
            _, one, of = np.unique(names, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([batch.column(k).cast(pa.large_string()) for k in (3, 4)]).take(pa.array(one))
            h, where = shingles(*batch_bytes(texts), words)
            begin = np.searchsorted(where, np.arange(len(one) + 1))
            bounds = batch.column(2).offsets.to_numpy()
            anchors = [batch.column(2).values.field(f).to_numpy()[bounds[0] : bounds[-1]] for f in range(4)]
            pair, *ends = matched(h, begin, of[:n], of[n:], np.repeat(np.arange(n), np.diff(bounds)), *anchors, least, percent, enough)
            for side in (0, 1):
                p, start, stop = merged(pair, ends[2 * side], ends[2 * side + 1])
                t, u = (p, p + n) if side == 0 else (p + n, p)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (names[t], names[u], start, stop + words - 1)], ["t", "u", "start", "stop"])

    return run


def _near(every: DataFrame) -> DataFrame:
    """(key, t, c, span, lo, hi, pivot): the windows of values that stand in two places or more.

    Windows of one value and one kind can't be told apart by what may be shared; lo and hi are the first and the last of them, pivot the first lo of the value's windows that hold most.
    """
    place = F.struct("t", "c", "span")
    kinds = written(every.groupBy("key", "kind").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("weight").alias("weight"), F.count("*").alias("n")), "kinds")
    keys = written(kinds.groupBy("key").agg(F.min_by("lo", F.struct(-F.col("weight"), F.col("lo"))).alias("pivot"), F.sum("n").alias("n")).where("n > 1").select("key", "pivot"), "keys")
    pivots = written(kinds.select("key", "kind", "lo", "hi").join(keys, "key"), "pivots")
    near = written(every.select("key", "t", "c", "span", "kind").join(pivots, ["key", "kind"]), "windows")  # nothing but a join of stored tables in its stage, so that Spark splits a hot value
    for table in (kinds, keys, pivots):
        discard(table)
    return near


def _met(least: int):
    """A function of Arrow batches of near windows (see _near) to anchors (a, b, i, ca, cb, span) of two texts, the lesser place first: each window with one of its kind, and each kind
    with the pivot of its value; but places of one text that are too near each other."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            key, *fields = (batch.column(k).to_numpy() for k in range(13))
            own, lo, hi, pivot = (fields[k : k + 3] for k in range(0, 12, 3))
            close = (own[0] == lo[0]) & (own[1] - lo[1] < least)
            head = (own[0] == lo[0]) & (own[1] == lo[1])
            kin = [np.where(close, x, y) for x, y in zip(hi, lo, strict=True)]
            parts = []
            for x, y, some in ((own, kin, np.ones(len(key), bool)), (lo, pivot, head)):
                some &= (x[0] != y[0]) | (x[1] != y[1]) | (x[2] != y[2])
                x, y, i = [v[some] for v in x], [v[some] for v in y], (key[some] & 15).astype(np.int32)
                swap = (x[0] > y[0]) | (x[0] == y[0]) & ((x[1] > y[1]) | (x[1] == y[1]) & (x[2] > y[2]))
                (a, ca, sa), (b, cb, sb) = ([np.where(swap, v, u) for u, v in zip(*two, strict=True)] for two in ((x, y), (y, x)))
                left, right = np.minimum(sa >> 16, sb >> 16), np.minimum(sa & 65535, sb & 65535)
                fine = (left + right + 1 >= least) & ((a != b) | (cb - ca >= least))
                parts.append([v[fine] for v in (a, b, i, ca, cb, left << 16 | right)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["a", "b", "i", "ca", "cb", "span"])

    return run


def _compared(pairs: DataFrame, texts: DataFrame, verify) -> DataFrame:
    """(t, u, start, stop): verified passages of the texts a and b of pairs, a stored table, by verify, which gets what else pairs has between their names and their texts."""
    ends = pairs.select(F.col("a").alias("t")).unionByName(pairs.select(F.col("b").alias("t"))).distinct()
    bodies = written(texts.select("t", "text").join(ends, "t", "left_semi"), "bodies")
    both = pairs.join(bodies.select(F.col("t").alias("a"), F.col("text").alias("ta")), "a").join(bodies.select(F.col("t").alias("b"), F.col("text").alias("tb")), "b")
    spans = written(both.select(*pairs.columns, "ta", "tb").mapInArrow(verify, "t long, u long, start long, stop long"), "spans")
    discard(bodies)
    return spans


def _verify_all(words: int, least: int, percent: int):
    """A function of Arrow batches (a, b, text of a, text of b) to (t, u, start, stop): all passages of t that u holds too; of one text, those that don't overlap."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 20):
            n = batch.num_rows
            names = np.concatenate([batch.column(k).to_numpy() for k in (0, 1)])
            _, one, of = np.unique(names, return_index=True, return_inverse=True)
            texts = pa.concat_arrays([batch.column(k).cast(pa.large_string()) for k in (2, 3)]).take(pa.array(one))
            h, where = shingles(*batch_bytes(texts), words)
            kinds, code = np.unique(h, return_inverse=True)
            kinds, at = mixed(kinds), np.full(len(kinds), -1)
            lists = [Stretches(x, kinds, least) for x in np.split(code, np.searchsorted(where, np.arange(1, len(one))))]
            parts = [(np.zeros(0, np.int64),) * 4]
            for p, (a, b) in enumerate(zip(of[:n].tolist(), of[n:].tolist(), strict=True)):
                for own, other, starts in zip((names[p], names[p + n]), (names[p + n], names[p]), alike(lists[a], lists[b], percent, at, least if a == b else 0), strict=True):
                    _, start, stop = merged(np.zeros(len(starts), np.int64), starts, starts + least)
                    parts.append((np.full(len(start), own), np.full(len(start), other), start, stop + words - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], ["t", "u", "start", "stop"])

    return run


def _gathered(batches):
    """Arrow batches (a, b, i, ca, cb, span) to (a, b, anchors), a row for each pair, or some for one with very many anchors."""
    import pyarrow as pa

    def rows(parts):
        a, b, *anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((*anchor[::-1], b, a))
        a, b, *anchor = (x[order] for x in (a, b, *anchor))
        new = (np.diff(a, prepend=~a[:1]) != 0) | (np.diff(b, prepend=~b[:1]) != 0)
        keep = np.flatnonzero(new | np.logical_or.reduce([np.diff(x, prepend=x[:1]) != 0 for x in anchor]))
        first = np.flatnonzero(new[keep])
        structs = pa.StructArray.from_arrays([pa.array(x[keep]) for x in anchor], ["i", "ca", "cb", "span"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keep)).astype(np.int32)), structs)
        return pa.RecordBatch.from_arrays([pa.array(a[keep[first]]), pa.array(b[keep[first]]), lists], ["a", "b", "anchors"])

    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append([batch.column(k).to_numpy() for k in range(6)])
            held += batch.num_rows
        if held >= 1 << 22:
            yield from small_batches([rows(parts)])
            parts, held = [], 0
    if parts:
        yield from small_batches([rows(parts)])


def _first(near: DataFrame, least: int) -> DataFrame:
    """(a, b, anchors): the anchors (see _met) of pairs of texts."""
    places = near.select("key", "t", "c", "span", *(F.col(f"{x}.{f}").alias(f"{x}_{f}") for x in ("lo", "hi", "pivot") for f in ("t", "c", "span")))
    met = places.mapInArrow(_met(least), "a long, b long, i int, ca int, cb int, span int")
    return met.repartition("a", "b").mapInArrow(_gathered, "a long, b long, anchors array<struct<i:int,ca:int,cb:int,span:int>>")


def _rest(every: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """(a, b): all pairs of texts with a first shingle of a stretch in common, but those that can bring nothing new.

    Nothing new: all stretches where that shingle is among the first lie in verified passages of both, and links join them already. Of texts in which those stretches are of one kind, none odd, and
    lie in verified passages that links join, the first and the last stand for all.
    """
    keys = written(every.groupBy("key").agg(F.count("*").alias("n"), F.max("weight").alias("m")).where("n > 1 or m > 1").select("key"), "keys")
    cover = _lists(spans).join(components(spans.select(F.col("t").alias("a"), F.col("u").alias("b"))).withColumnRenamed("node", "t"), "t", "left")
    inside = F.coalesce(F.exists("own", lambda x: (x["start"] <= F.col("c") - F.shiftright("span", 16)) & (F.col("far") + words <= x["stop"])), F.lit(False))
    # a text that no link joins with another has no root
    near = every.join(keys, "key", "left_semi").join(cover, "t", "left").withColumn("label", F.when(inside, F.coalesce("root", "t")))
    kind = F.when(~F.col("odd") & (F.col("weight") == 1) & F.col("label").isNotNull(), F.col("kind")).otherwise(F.xxhash64("t"))
    kinds = near.groupBy("key", kind.alias("kind"), "label").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max(F.col("weight") > 1).alias("again"))
    rows = written(kinds.select("key", "label", "again", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("t")), "rest")
    open_ = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("m"), F.count("label").alias("k"), F.max("again").alias("again")).where("(n > 1 or again) and (k < n or l <> m)").select("key"), "open")
    left = written(rows.join(open_, "key", "left_semi"), "left")
    other = left.select("key", F.col("t").alias("b"), F.col("label").alias("other"))
    met = left.withColumnRenamed("t", "a").join(other, "key").where("(a < b or a = b and again) and not coalesce(label = other, false)")
    met = written(met.select("a", "b").distinct(), "met")
    for table in (keys, rows, open_, left):
        discard(table)
    return met


def _lists(spans: DataFrame) -> DataFrame:
    """(t, own): the stretches of each text joined where they meet, in order."""
    lists = spans.select("t", "start", "stop").groupBy("t").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("own"))
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate("own", F.array().cast("array<struct<start:bigint,stop:bigint>>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], x["stop"]).alias("stop"))))).otherwise(F.array_append(acc, x)))
    return lists.select("t", joined.alias("own"))


def passages(docs: DataFrame, least_words: int = 50, words: int = 5, percent: int = 80, hashes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, class_id: maximal stretches of words with a near-duplicate elsewhere.

    A near-duplicate is a stretch of at least `least_words` words whose sets of `words`-word shingles have a Jaccard similarity of
    percent / 100 or more. Documents that such passages join, directly or not, have one class_id, the smallest of their ids.

    Equal texts are one. Shingles are counted first, so that only stretches enough of whose shingles stand elsewhere too go on. Compact windows of those
    under some hash functions go by hash value, so one window stands for all the stretches with that min-hash. Windows of a value that can't be told apart by
    what may be shared are paired with the first of them, which is paired with the value's pivot. What that misses is made up for: all pairs of texts that share one of the first
    shingles of a stretch, rare ones first, are compared by all their stretches of `least_words` words, unless both lie wholly in passages that were
    verified, of texts that links join already. Every passage that is returned has passed the comparison of its sets.

    Null, empty and short texts have no passages and so no rows. Texts that repeat whole, of `least_words` words or more, are passages of each other.
    A very long text is read whole by one task, at about 60 bytes of memory for each of its bytes.
    Rows with a null id count as documents, and their passages have a null doc_id. An empty table gives an empty result. Other columns are ignored.
    """
    least = least_words - words + 1
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text).withColumn("t", F.xxhash64("text"))
    owners = written(_word_counts(rows).where(F.col("n") >= least_words), "owners")
    copies = owners.groupBy("t").agg(F.count("*").alias("m"), F.min("doc_id").alias("d"), F.max("n").alias("n"))
    long = rows.select("t", "text").where(F.octet_length("text") >= 2 * least_words - 1)
    groups = max(1, (long.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP)
    texts = written(long.dropDuplicates(["t"]).withColumn("g", F.pmod(F.xxhash64("t", F.lit(4)), F.lit(groups))), "distinct")
    every = written(_windows(texts, words, least, percent, hashes), "every")
    prefix = F.col("key").bitwiseAND(15) == hashes
    near = _near(every.where(~prefix))
    pairs = written(_first(near, least), "pairs")
    discard(near)
    spans = _compared(pairs, texts, _verify(words, least, percent, 1))
    discard(pairs)
    pairs = _rest(every.where(prefix), spans, words)
    discard(every)
    spans = spans.unionByName(_compared(pairs, texts, _verify_all(words, least, percent)))
    discard(pairs)
    star = components(spans.select(F.col("t").alias("a"), F.col("u").alias("b")))
    whole = copies.where("m > 1").select("t", F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("stop"))
    lists = _lists(spans.select("t", "start", "stop").unionByName(whole))
    lists = lists.join(star.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    found = owners.select("doc_id", "t").join(lists, "t")
    names = lists.select("t", "root").join(copies.select("t", "d"), "t").groupBy("root").agg(F.min("d").alias("class_id"))
    return found.join(names, "root").select("doc_id", "class_id", F.explode("own").alias("x")).select("doc_id", F.col("x.start").alias("start_word"), F.col("x.stop").alias("end_word"), "class_id")
