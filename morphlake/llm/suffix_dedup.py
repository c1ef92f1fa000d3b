"""Removal of byte strings that occur elsewhere, by column-wise construction of Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import BASE, MIX_1, batch_bytes, mixed, powers, small_batches, written

#: Distinct fragments of one bucket key beyond which its windows are compared by hash and count.
HOT = 2000
#: Bytes of fragments that one transform holds.
COLLECTION = 256 << 10


def seed_width(length: int) -> int:
    """A window's bucket is the least hash of the stretches of this many bytes in it."""
    return max(1, length * 8 // 25)


def _table(seed: int) -> np.ndarray:
    """A 64-bit number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * MIX_1 + np.uint64(seed))


def seeds(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each position on, by doubling; the last positions hold nothing of use."""
    power = lambda n: np.uint64(pow(int(BASE), n, 2**64))
    h, have, out, done = _table(1)[data], 1, None, 0
    while True:
        if width & have:  # what is done so far is followed by `have` bytes more
            if out is None:
                out = h.copy()
            else:
                out[: len(out) - done] = out[: len(out) - done] * power(have) + h[done:]
            done += have
        if 2 * have > width:
            return mixed(out)
        h[:-have] = h[:-have] * power(have) + h[have:]
        have *= 2


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of h[i : i + width] for each i, by doubling."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, bucket, hash, whether the bucket's seed repeats) of each fragment of a batch.

    A window is a stretch of `length` bytes within a document; a fragment is a run of windows of one
    bucket, with all their bytes. A bucket depends on nothing but a window's bytes, so equal windows have
    one bucket, wherever they are.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return none, none, none, none, none, none.astype(bool)
    width = seed_width(length)
    span = length - width + 1
    h = seeds(data, width)
    least = window_minima(h, span)
    doc = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    at = np.arange(total) - first[doc]  # window's start in its document
    where = offsets[:-1][doc] + at
    value = least[where]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, total))
    if (count > span).any():  # no more windows than hold one place of the seed, so that all fragments are about as long
        parts = -(-count // span)
        begin = np.repeat(begin, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.diff(np.append(begin, total))
    doc, at, value, where = doc[begin], at[begin], value[begin], where[begin]
    again = _seed_repeats(h, least, where, count, value, span, offsets, length)
    stop = where + count - 1 + length
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table(2)[data] * power[: len(data)], out=sums[1:])
    body = mixed((sums[stop] - sums[where]) * inverse[where] + stop.astype(np.uint64) - where.astype(np.uint64))
    return doc, at, count, value.view(np.int64), body.view(np.int64), again


def _seed_repeats(h, least, where, count, value, span, offsets, length) -> np.ndarray:
    """For each fragment whether its least seed stands at two places in it; else none of its windows can equal another of them."""
    n = len(h)
    valid = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[a : max(a, b - length + 1)] = True
    low = np.where(valid, least, np.uint64(0))
    # greatest minimum among the windows that hold the seed at p: those that start at p - span + 1 to p
    high, have = low.copy(), 1
    while have < span:
        step = min(have, span - have)
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        have += step
    places = np.flatnonzero((h == high) & (high > 0))
    names, ranks = np.unique(h[places], return_inverse=True)
    keys = np.sort((ranks.astype(np.int64) << 33) + places)
    own = np.searchsorted(names, value)
    own[own == len(names)] = 0
    base = own.astype(np.int64) << 33
    inside = np.searchsorted(keys, base + where + count - 1 + span) - np.searchsorted(keys, base + where)
    return (inside > 1) & (names[own] == value)


_POWERS: list = [powers(0), powers(0)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n + 1 of each."""
    if len(_POWERS[0]) <= n:
        _POWERS[:] = powers(n), powers(n, np.uint64(pow(int(BASE), -1, 2**64)))
    return _POWERS[0], _POWERS[1]


def repeats(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of `length` bytes stand elsewhere in the collection too.

    Round j inserts each string's suffix of j symbols into the order of all shorter suffixes. The
    transform holds the symbol before each suffix, so the new suffixes' places are those of their symbols
    in a stable sort of the transform; the common prefix with the suffix in front is one more than the
    least between the two places that they come from (held up to `length`).
    """
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies])
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(sizes)
    kinds = np.unique(flat)
    code = np.zeros(256, np.uint16)
    code[kinds] = np.arange(1, len(kinds) + 1)
    symbols = code[flat].astype(np.uint8 if len(kinds) < 255 else np.uint16)
    top = np.uint8(length) if length < 255 else np.uint16(length)
    before = lambda who, j: np.where(j < sizes[who], symbols[np.maximum(ends[who] - 1 - j, 0)], 0).astype(symbols.dtype)
    who = np.arange(n)
    bwt, lcp = before(who, 0), np.zeros(n + 1, top.dtype)
    place = np.arange(n)  # of the suffixes inserted last, in order
    for j in range(1, int(sizes.max(initial=0)) + 1):
        order = np.argsort(bwt, kind="stable")
        size = len(bwt)
        fresh = np.zeros(size, bool)
        fresh[place] = True
        done = int(np.searchsorted(bwt[order[: n + 1]], 1)) if size <= n + 1 else int(np.count_nonzero(bwt == 0))
        rank = np.flatnonzero(fresh[order[done:]]) + done
        if not len(rank):
            break
        came = order[rank]
        who = who[np.searchsorted(place, came)]
        letter = bwt[came]
        front = order[rank - 1]
        has_front = (rank > done) & (bwt[front] == letter)
        behind = order[np.minimum(rank + 1, size - 1)]
        has_behind = (rank + 1 < size) & (bwt[behind] == letter) & ~fresh[behind]
        a = np.concatenate([front[has_front] + 1, came[has_behind] + 1])
        b = np.concatenate([came[has_front] + 1, behind[has_behind] + 1])
        down = np.argsort(-a, kind="stable")  # so that no stretch between two pairs is read
        pairs = np.empty(2 * len(a), np.int64)
        pairs[::2], pairs[1::2] = a[down], b[down]
        least = np.empty(len(a), lcp.dtype)
        if len(a):
            least[down] = np.minimum.reduceat(lcp, pairs)[::2]
        least = np.minimum(least, top - 1) + lcp.dtype.type(1)
        place = n + rank - done
        old = np.ones(size + len(rank), bool)
        old[place] = False
        grown, common = np.empty(len(old), bwt.dtype), np.zeros(len(old) + 1, lcp.dtype)
        grown[old] = bwt
        grown[place] = before(who, j)
        common[:-1][old] = lcp[:-1]
        k = int(has_front.sum())
        common[place[has_front]] = least[:k]
        common[place[has_behind] + 1] = least[k:]
        bwt, lcp = grown, common
    twin = (lcp[:-1] >= top) | (lcp[1:] >= top)
    # walk back from each string's end to name the suffixes
    order = np.argsort(bwt, kind="stable")
    done = int(np.count_nonzero(bwt == 0))
    follow = np.zeros(len(bwt), np.int64)
    follow[order[done:]] = n + np.arange(len(bwt) - done)
    out = [np.zeros(max(0, s - length + 1), bool) for s in sizes.tolist()]
    flags = np.zeros(len(flat) + 1, bool)
    at, who = np.arange(n), np.arange(n)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[who] >= j
        at, who = follow[at[live]], who[live]
        flags[ends[who] - j] = twin[at]
    for k, (end, s) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        out[k] = flags[end - s : end - length + 1] if s >= length else out[k]
    return out


def partnered(bodies: list[bytes], keys: np.ndarray, length: int) -> np.ndarray:
    """False for strings none of whose windows can stand elsewhere in the collection.

    Equal windows hold equal seeds at equal places, so what they share in front of the seed and behind it adds
    up to all the rest of a window. For each seed the longest stretches on either side that
    another place of the same seed has too are found, in steps; if even the next steps don't add up, no window fits.
    """
    sizes = np.array([len(b) for b in bodies])
    flat, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes)
    width = seed_width(length)
    rest = length - width
    step = max(1, rest // 8)
    place = np.flatnonzero(seeds(flat, width) == np.repeat(keys.view(np.uint64), sizes))
    own = np.searchsorted(ends, place, side="right")
    begin, end, key = ends[own] - sizes[own], ends[own], keys.view(np.uint64)[own]
    power, inverse = _powers(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_table(2)[flat] * power[: len(flat)], out=sums[1:])
    reach = []
    for front in (True, False):
        longest = np.full(len(place), step - 1)
        alive = np.arange(len(place))
        for n in range(step, rest + step, step):
            n = min(n, rest)
            a = place[alive] - n if front else place[alive] + width
            fits = (a >= begin[alive]) & (a + n <= end[alive])
            alive, a = alive[fits], a[fits]
            _, which, times = np.unique(key[alive] + mixed((sums[a + n] - sums[a]) * inverse[a]), return_inverse=True, return_counts=True)
            alive = alive[times[which] > 1]
            longest[alive] = min(n + step - 1, rest)
            if not len(alive):
                break
        reach.append(longest)
    out = np.zeros(len(bodies), bool)
    out[own[reach[0] + reach[1] >= rest]] = True
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key names its id and text; rows that repeat share it, and so what is removed from them."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).cast("bigint").alias("doc_id"), text)


def _fragments(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 17):
            data, offsets = batch_bytes(batch.column(1))
            doc, at, count, value, body, again = fragments(data, offsets, length)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int32)), pa.array(body), pa.array(keys[doc]), pa.array(at.astype(np.int32)), pa.array(again)], ["mkey", "n", "f", "k", "start", "self"])

    return rows.select("k", "text").mapInArrow(run, "mkey long, n int, f long, k long, start int, self boolean")


def _cut_out(rows: DataFrame, places: DataFrame, length: int, groups: int) -> DataFrame:
    """The bytes of each place (k, start, n, ...), with the number of the collection that its bucket key goes to."""
    lists = places.groupBy("k").agg(F.collect_list(F.struct("mkey", "start", "n", "c", "d")).alias("parts"))

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [p["mkey"] % groups for p in parts],
                        "k": batch.column(0)[:1].to_pylist() * len(parts),
                        **{c: [p[c] for p in parts] for c in ("mkey", "start", "c", "d")},
                        "body": [raw[p["start"] : p["start"] + p["n"] - 1 + length] for p in parts],
                    },
                    pa.schema([("part", pa.int64()), ("k", pa.int64()), ("mkey", pa.int64()), ("start", pa.int32()), ("c", pa.int64()), ("d", pa.int64()), ("body", pa.binary())]),
                )

    def one_by_one(batches):
        for batch in batches:
            yield from run(batch.slice(i, 1) for i in range(batch.num_rows))

    return rows.select("k", "text").join(lists, "k").select("k", "text", "parts").mapInArrow(one_by_one, "part long, k long, mkey long, start int, c long, d long, body binary")


def _transformed(bodies: DataFrame, length: int) -> DataFrame:
    """(k, lo, hi) of what repeats in the fragments that occur once, by one transform for each collection."""

    def judge(pdf):
        pdf = pdf.drop_duplicates(["k", "start"])
        pdf = pdf[partnered(pdf["body"].tolist(), pdf["mkey"].to_numpy(np.int64), length)]
        out = {"k": [], "lo": [], "hi": []}
        for flags, k, start, c in zip(repeats(pdf["body"].tolist(), length), pdf["k"], pdf["start"], pdf["c"], strict=True):
            if c == 1 and flags.any():
                lo, hi = runs(flags)
                out["k"] += [k] * len(lo)
                out["lo"] += (start + lo).tolist()
                out["hi"] += (start + hi - 1 + length).tolist()
        return pd.DataFrame(out).astype({"k": "int64", "lo": "int32", "hi": "int32"})

    return bodies.groupBy("part").applyInPandas(judge, "k long, lo int, hi int")


def _counted(bodies: DataFrame, length: int) -> DataFrame:
    """The same for the windows of bucket keys with too many fragments for one task: grouped by two 64-bit hashes and counted."""

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            for k, start, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = np.frombuffer(body, np.uint8)
                n = len(raw) - length + 1
                one = seeds(raw, length)[:n].view(np.int64)
                power, inverse = _powers(len(raw))
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_table(3)[raw] * power[: len(raw)], out=sums[1:])
                two = mixed((sums[length:] - sums[:n]) * inverse[:n]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array([k] * n, pa.int64()), pa.array((start + np.arange(n)).astype(np.int32))], ["one", "two", "k", "lo"])

    windows = bodies.select("k", "start", "body").mapInArrow(hashes, "one long, two long, k long, lo int").distinct()
    twice = windows.groupBy("one", "two").count().where("count > 1").select("one", "two")
    return windows.join(twice, ["one", "two"], "left_semi").select("k", "lo", (F.col("lo") + length).cast("int").alias("hi"))


def repeated_ranges(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, lo, hi): byte ranges made of strings of `length` bytes that start elsewhere too, for rows keyed by _keyed."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    every = written(_fragments(rows, length), "fragments")
    keys = every.groupBy("mkey").agg(F.sum(F.lit(1) + F.col("self").cast("int")).alias("w")).where("w > 1").select("mkey")
    found = written(every.join(keys, "mkey", "left_semi"), "shared")
    kinds = written(found.groupBy("mkey", "f").agg(F.count("*").alias("c"), F.min("k").alias("k"), F.min_by("start", "k").alias("start"), F.min("n").alias("n"), F.max("self").alias("self")), "kinds")
    whole = found.join(kinds.where("c > 1").select("mkey", "f"), ["mkey", "f"], "left_semi").select("k", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + length).cast("int").alias("hi"))
    keyed = kinds.groupBy("mkey").agg(F.count("*").alias("d"), F.min("c").alias("least"), F.max("self").alias("again")).where("least = 1 and (d > 1 or again)")
    places = written(kinds.join(keyed.select("mkey", "d"), "mkey"), "places")
    size = places.agg(F.sum(F.col("n") + length)).first()[0] or 0
    bodies = written(_cut_out(rows, places, length, max(1, size // COLLECTION)), "bodies")
    ranges = whole.unionByName(_transformed(bodies.where(F.col("d") <= HOT), length))
    if not bodies.where(F.col("d") > HOT).isEmpty():
        ranges = ranges.unionByName(_counted(bodies.where(F.col("d") > HOT), length))
    return ranges


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of docs.

    Each byte goes that lies in a string of `length` bytes which starts at any other place of the corpus too.
    Windows of that length fall into buckets by their least seed hash; fragments (runs of windows
    of one bucket) that occur twice whole go whole; the other fragments of a shared bucket meet in
    collections of bounded size, whose Burrows-Wheeler transform and common prefixes are built column-wise.
    Identity of whole fragments is that of two 64-bit hashes. with_text adds what is left (kept, binary).

    Null text is empty: no bytes, no spans. Texts shorter than `length` stay whole. Rows that repeat are
    copies of one another, with their own or no id. An empty table gives an empty result.
    """
    ranges = repeated_ranges(docs, length, id_col, text_col).groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            out = []
            for doc, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, keep, gone, spans, at = text.encode(), [], 0, 0, 0
                end = -1
                for lo, hi in sorted((c["lo"], c["hi"]) for c in cuts or ()):
                    if lo > end:
                        spans += 1
                        keep.append(raw[at:lo])
                    gone += max(0, hi - max(lo, end, 0))
                    end = at = max(end, hi)
                keep.append(raw[at:])
                left = b"".join(keep)
                out.append((doc, len(raw), gone, spans, hashlib.sha256(left).hexdigest(), *([left] if with_text else ())))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    rows = _keyed(docs, id_col, text_col)
    return rows.join(ranges, "k", "left").select("doc_id", "text", "cuts").mapInArrow(run, schema)
