import numpy as np

from morphlake.llm.ann import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def exact(rows, top):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in rows if j != i))[:top]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA), probes=0.75).collect()
    want = exact(rows, 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(by) == set(want)
    hit = 0
    for q, own in by.items():
        assert len(own) == 20 and own == sorted(own)
        true = {j: s for s, j in exact([rows[q], *(rows[j] for _, j in own)], 20)[q]}
        assert all(abs(true[j] - s) < 1e-9 for s, j in own)
        hit += len({j for _, j in own} & {j for _, j in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (40, [0.0, 0.0]), (3, [nan, 1.0]), (60, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (1, [2.0, 1.0])]
    got = nearest(spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)}
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_over_uneven_lengths(spark):
    """A few long vectors, whose codes leave the most, are near everything; no query may miss many."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64)) * rng.lognormal(0, 2, (4000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, shares = x.astype(np.float32).astype(float), []
    for q, own in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        shares.append(len(own & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(shares) == 200 and min(shares) >= 0.9 and sum(shares) / 200 >= 0.99
