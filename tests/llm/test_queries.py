"""Queries with an oracle equal DuckDB; the pipeline equals its stages one by one."""

import pathlib

import duckdb
import pytest

import corpus_pipeline
from quietkey.llm import simhash
from quietkey.llm.decontamination import find_leaks
from quietkey.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in pathlib.Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = QUERIES[name](spark, SF)
    names = sorted(rows.columns)
    got = sorted(tuple(map(str, r)) for r in rows.select(*names).collect())
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        seen[name] = docs
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(seen[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert find_leaks(seen["benchmark_decontamination"], bench).count() == 0
    linked = simhash.link_documents(seen["simhash_near_dedup"]).collect()
    assert all(r.doc_id == r.component_id for r in linked)
    # Five-word shingles of the benchmark that brute force finds are gone, other documents stay.
    items = [f" {' '.join(plain(r.text))} " for r in bench.collect()]
    before = {r.doc_id: f" {' '.join(plain(r.text))} " for r in seen["simhash_near_dedup"].collect()}
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    assert {r.doc_id for r in seen["benchmark_decontamination"].collect()} == set(before) - leaked
    assert {r.doc_id for r in seen["pii_surrogates"].collect()} == set(before) - leaked
    mixed = seen["source_mixing"].collect()
    assert {r.doc_id for r in mixed} <= set(before) - leaked
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in mixed)


def plain(text):
    from quietkey.llm.common import plain_words

    return [w.decode() for w in plain_words(text)]
