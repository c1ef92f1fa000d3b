"""The pipeline stage by stage against what each stage should do, and the queries with SQL against that."""

import collections
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_jaccard_join import brute as linked
from test_line_dedup import brute as without_runs
from test_packing import whole
from tokenizers import Tokenizer

import corpus_pipeline
from morphlake.llm.common import written
from morphlake.llm.language_id import fit, identify
from morphlake.llm.queries import ORACLES, QUERIES, _mixing_sql

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}

    known = written(stages["language_id"](spark, docs, DATA), "t")
    clear = {r["doc_id"] for r in identify(docs, fit(docs, most=400, hold=5)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    fine = {r["doc_id"] for r in known.collect()}
    assert {r["doc_id"]: r for r in known.collect()} == {i: r for i, r in before.items() if i in fine}
    assert fine <= clear and len(clear - fine) <= 0.01 * len(clear)  # limits on code length are tested with planted texts

    lines = written(stages["line_dedup"](spark, known, DATA), "t")
    ids = sorted(fine)
    want = dict(zip(ids, without_runs([before[i]["text"] for i in ids], 3), strict=True))
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want

    single = written(stages["near_duplicates"](spark, lines, DATA), "t")
    groups = linked([want[i] for i in ids], 5, 80)
    kept = {ids[k] for k, (_, c) in groups.items() if c == k}
    assert {r["doc_id"] for r in single.collect()} == kept

    mixed = written(stages["mixing"](spark, single, DATA), "t")
    con = duckdb.connect()
    con.register("documents", single.toPandas())
    taken = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({_mixing_sql(1.0, 12)})").fetchall() if n}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == taken and set(taken) < kept and max(taken.values()) > 1
    assert known.columns == lines.columns == single.columns == mixed.columns == names

    pieces = stages["packing"](spark, mixed, DATA).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(want[i], add_special_tokens=False).ids, 2] for i in taken}
    whole([r for r in pieces if taken[r["doc_id"]] == 1], {i: x for i, x in ids.items() if taken[i] == 1}, gaps=True)
    tokens = collections.Counter()
    for r in pieces:
        x = np.asarray(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(x.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {i: n * len(ids[i]) for i, n in taken.items()}
    rows = lambda found: collections.Counter((r["doc_id"], r["ids_crc32"]) for r in found if r["start"] == 0)
    assert sum(rows(corpus_pipeline.run(spark, DATA).collect()).values()) == sum(rows(pieces).values()) == sum(taken.values())


def test_odd_and_empty_tables(spark, tmp_path):
    from helpers import empty, odd

    for name, table in (("odd", odd(spark)), ("empty", empty(spark))):
        for stage, run in corpus_pipeline.STAGES[:-1]:
            assert run(spark, table, "").columns == table.columns, stage
        table.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert name == "odd" or not rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    own, sql = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).fetchdf()
    names = sorted(own.columns)
    assert names == sorted(sql.columns)
    plain = lambda v: None if v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) else v.item() if isinstance(v, np.generic) else v
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[names].astype(object).itertuples(index=False, name=None))
    assert rows(own) == rows(sql)
