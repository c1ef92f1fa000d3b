import hashlib
import re

from helpers import docs, empty, odd

from morphlake.llm.exact_dedup import exact_dedup, keep_first


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    out = {}
    for body, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


def test_groups(spark):
    texts = ["a b", "ab", " a b ", "a b", None, "", "\t", "\U0001f600 x", "\U0001f600x", "ab"] + ["hot text"] * 50 + ["hot  text"]
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup(docs(spark, texts)).collect()}
    assert got == brute(texts)
    assert {r["doc_id"] for r in keep_first(docs(spark, texts)).collect()} == {i for i, x in brute(texts).items() if x[2]}


def test_a_row_stays_or_goes_by_its_own_text(spark):
    rows = [(2, "x y"), (3, "xy"), (3, "z"), (None, "z"), (None, "q")]
    docs_ = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, __id int, content int")
    got = keep_first(docs_)
    assert got.columns == docs_.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == [(-1, "q"), (2, "x y"), (3, "z")]


def test_odd_rows(spark):
    rows = exact_dedup(odd(spark)).collect()
    assert len(rows) == 8
    assert {r["group_size"] for r in rows if r["doc_id"] in (1, 2, 4)} == {3}
    assert [r["keep_id"] for r in rows if r["doc_id"] is None] == [None]
    assert all(r["kept"] for r in rows if r["doc_id"] == 3)
    assert exact_dedup(empty(spark)).count() == 0
