import math

import numpy as np
import pandas as pd
from helpers import docs, empty, odd

from morphlake.llm.language_id import build, code_lengths, fit, identify, keep_known


def brute(text, texts):
    """Bits of text under a context tree of texts, byte by byte."""
    tree = {}
    for t in texts:
        raw = b"\0\0\0" + t
        for i in range(3, len(raw)):
            for o in range(4):
                tree.setdefault(raw[i - o : i], {}).setdefault(raw[i], 0)
                tree[raw[i - o : i]][raw[i]] += 1
    raw, bits = b"\0\0\0" + text, 0.0
    for i in range(3, len(raw)):
        out = set()
        for o in (3, 2, 1, 0):
            left = {s: n for s, n in tree.get(raw[i - o : i], {}).items() if s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if raw[i] in left:
                bits -= math.log2(left[raw[i]] / whole)
                break
            bits -= math.log2(len(left) / whole)
            out |= set(left)
        else:
            bits += math.log2(256 - len(out))
    return bits


def model_of(by_lang):
    rows = []
    for lang, texts in by_lang.items():
        for t in texts:
            raw = b"\0\0\0" + t
            rows += [(lang, int.from_bytes(raw[i - 3 : i + 1], "big"), 1) for i in range(3, len(raw))]
    return build(pd.DataFrame(rows, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False)["n"].sum())


def test_code_lengths_are_exact():
    by_lang = {"a": [b"the cat sat on the mat", b"that hat"], "b": [b"le chat est la", "été à la".encode()]}
    model = model_of(by_lang)
    texts = [b"the hat", b"le chat \xff zz", b"", b"q", "été".encode()]
    got = code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    want = np.array([[brute(t, by_lang[k]) for k in model.languages] for t in texts])
    assert np.allclose(got, want, atol=1e-3)


def test_held_out(spark):
    import pyspark.sql.functions as F

    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    model = fit(data, most=60, train=lambda c: ~held(c))
    got = identify(data, model).join(data.where(held(F.col("doc_id"))), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_foreign_texts_and_junk_go_and_clean_ones_stay(spark):
    import base64
    import random

    rng = random.Random(6)
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    sounds = ["kk", "yy", "jo", "ptä", "vuo", "nyk", "hja", "qo", "xi", "zhu", "wy", "kłó", "brz", "ąg"]
    foreign = [" ".join("".join(rng.choice(sounds) for _ in range(rng.randint(2, 5))) for _ in range(80)) for _ in range(20)]
    junk = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)] + ["".join(f"{rng.randint(0, 10**12):x};" for _ in range(60)) for _ in range(20)]
    planted = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(foreign + junk)], data.schema)
    model = fit(data, most=100, hold=5)
    assert set(model.limits) == {"de", "en", "es", "fr"}
    kept = {r["doc_id"] for r in keep_known(data.unionByName(planted), model).collect()}
    assert not any(i >= 10**6 for i in kept)
    known = {r["doc_id"] for r in identify(data, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert kept <= known and len(kept) >= 0.99 * len(known)


def test_the_stage_takes_odd_rows(spark):
    table = odd(spark).unionByName(docs(spark, ["the cat sat on the mat"] * 3))
    kept = keep_known(table, fit(table, hold=2))
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({4})
    assert keep_known(empty(spark), fit(empty(spark), hold=2)).count() == 0


def test_odd_rows(spark):
    model = fit(docs(spark, ["the cat sat on the mat"] * 3))
    rows = identify(odd(spark), model).collect()
    assert len(rows) == 8
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 4)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert identify(empty(spark), model).count() == 0
    nothing = fit(empty(spark))
    assert {r["lang_pred"] for r in identify(odd(spark), nothing).collect()} == {"und"}
