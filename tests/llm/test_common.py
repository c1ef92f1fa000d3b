import random

import numpy as np

from morphlake.llm.common import batch_bytes, components, mixed, shared_dir, unused
from morphlake.llm.shingles import sets


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-50, 300), rng.randint(-50, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_that_are_taken():
    import types

    assert unused(types.SimpleNamespace(columns=["a", "__K", "__k_"]), "__k") == "__k__"


def test_a_cluster_needs_a_shared_folder():
    import types

    import pytest

    none = types.SimpleNamespace(get=lambda *a: None)
    session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: none, master="spark://host:7077"), conf=none)
    with pytest.raises(ValueError):
        shared_dir(session)


def test_shingles_follow_words():
    import pyarrow as pa

    texts = ["A b  c", "a\tB c d", "", None, "x", "é É", "a b c\x1cd", "b c d"]
    one, two, *rest = sets(*batch_bytes(pa.array(texts)), 3)
    assert len(one) == 1 and len(two) == 2 and set(one) <= set(two) and [len(x) for x in rest] == [0, 0, 1, 1, 1, 1]
    assert not set(rest[4]) & set(two) and set(rest[5]) <= set(two)


def test_mixing_is_one_to_one():
    assert len(np.unique(mixed(np.arange(10000, dtype=np.uint64)))) == 10000
