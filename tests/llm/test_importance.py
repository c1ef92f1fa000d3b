import hashlib
import math
import random
import re
import zlib

import pytest
from helpers import DOCS, docs, empty, odd

from morphlake.llm.importance import KINDS, resample
from morphlake.llm.wordruns import bounded, chunks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def runs(text, orders):
    words = WORD.findall(lowered(text))
    return [" ".join(words[k : k + m]) for m in range(1, orders + 1) for k in range(len(words) - m + 1)], len(words)


def brute(rows, target, orders=1, buckets=10000, percent=10, least=20):
    """Rows (doc_id, n_features, weight, score, rank) of (doc_id, text) pairs, in plain Python."""
    count = lambda texts: [zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, orders)[0]]
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [x for _, x in rows]), (t, target)):
        for b in count(texts):
            table[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, (doc, text) in enumerate(rows):
        found, words = runs(text, orders)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if words >= least:
            fit.append(i)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for k, i in enumerate(fit[: percent * len(fit) // 100]):
        out[i][4] = k + 1
    return [tuple(r) for r in out]


def plain(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize("orders,size", [(1, 1 << 17), (1, 50), (3, 40)])
def test_same_as_plain_python(spark, orders, size):
    rng = random.Random(orders)
    words = ["a", "B", "né", "x9", "\U0001f600", "longerword", "\xa0y"]
    texts = [rng.choice([" ", "-", ""]) + "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    target = [" ".join(rng.choice(words[:3]) for _ in range(30)) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = resample(docs(spark, texts), bench, percent=30, orders=orders, buckets=50, size=size)
    want = brute(list(enumerate(texts)), target, orders, 50, 30)
    assert plain(got) == sorted(map(repr, want))
    assert sum(r[4] is not None for r in want) > 5


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word b c"), (2, None)], "item_id long, text string")
    for table in (odd(spark), empty(spark)):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        for size in (1 << 17, 1000):
            assert plain(resample(table, bench, percent=60, least_words=3, size=size)) == sorted(map(repr, brute(rows, ["word b c", None], percent=60, least=3)))
    assert resample(odd(spark), spark.createDataFrame([], "item_id long, text string")).count() == 8
    assert spark.createDataFrame([], DOCS).columns == odd(spark).columns


def test_chunks_own_each_word_once():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "é", " ", "--", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 40))).encode()
        before, after, size = rng.randint(0, 3), rng.randint(0, 3), rng.randint(1, 40)
        whole = WORD.findall(text.decode())
        seen = []
        for _, front, behind, body in chunks(text, size, KINDS, before, after):
            own = WORD.findall(body.decode())
            at = len(seen)
            seen += own[front : len(own) - behind]
            assert own == whole[at - front : at - front + len(own)]
            assert front == min(before, at) and behind == min(after, len(whole) - len(seen))
        assert seen == whole


def test_long_and_short_texts_come_in_order():
    import pyarrow as pa

    texts = ["a b", None, "c " * 500, "d", "", "e f"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [(int(rows[t]), w.strip()) for b, rows, words, piece, text, own in bounded([batch], 0, KINDS, 64, 2, 2) for w, t, o in zip(words.to_pylist(), text.tolist(), own.tolist(), strict=True) if o]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
