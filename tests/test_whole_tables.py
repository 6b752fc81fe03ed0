"""Queries over records and models work on whole tables: small fixtures worked out by hand."""

from __future__ import annotations

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tamiz.operators import logreg
from tamiz.plans import model_queries, registry


@pytest.fixture
def late_lines(spark, tmp_path):
    """Three orders of one origin (numbers 4000 apart); lines beyond the third decide."""
    day = lambda y: dt.datetime(y, 3, 1)
    orders = [(4001, day(1995)), (20001, day(1995)), (16001, day(1996))]
    items = [(4001, 5, n, "A", day(1995)) for n in (1, 2, 3, 4, 5)] + [(4001, 6, 6, "R", day(1999)), (20001, 7, 7, "N", day(1998))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_match_reads_every_line(spark, late_lines):
    got = sorted(tuple(r) for r in registry.QUERIES["two_step_match"](spark, late_lines).collect())
    # 4001 has six lines (five with an empty conclusion, filled from the origin's last), 20001 (a multiple of 3 is not under its number) one.
    first = [("N4001", "C1", 1995, 1995, "R", "nro")] * 5 + [("N4001", "C1", 1995, 1999, "R", "nro")]
    assert got == sorted([*first, ("N20001", "C1", 1995, 1999, "R", "origen"), ("N16001", "C1", 1996, 1999, "R", "origen")])


def test_legacy_and_coverage_read_every_line(spark, late_lines):
    legacy = [tuple(r) for r in registry.QUERIES["two_step_match_legacy"](spark, late_lines).collect()]
    assert legacy == [("nro", 8, 8)]
    covered = sorted(tuple(r) for r in registry.QUERIES["coverage_by_year"](spark, late_lines).collect())
    assert covered == [(1995, 7, 7, 100.0), (1996, 1, 1, 100.0)]


def test_library_vectors_are_sparse(spark):
    rows = [(1, 1, [(4999, 0.5), (3, 0.1)]), (2, 0, [])]
    frame = spark.createDataFrame(rows, "row_id long, label int, features array<struct<idx:bigint,value:double>>")
    got = {r["row_id"]: r["features"] for r in logreg.vectors(frame, 5000).collect()}
    assert {k: (type(v).__name__, v.size, v.indices.tolist(), v.values.tolist()) for k, v in got.items()} == {1: ("SparseVector", 5000, [3, 4999], [0.1, 0.5]), 2: ("SparseVector", 5000, [], [])}


def test_library_query_has_the_whole_vocabulary(spark, monkeypatch):
    configs = []
    monkeypatch.setattr(model_queries.M, "run_once", lambda records, config: configs.append(config.normalised()))
    monkeypatch.setattr(model_queries.M, "evaluate", lambda run: None)
    model_queries.mllib_metrics(spark, "/root/testdata/sf0.001")
    assert configs[0].max_features == model_queries.M.RunConfig().max_features and configs[0].trainer == "library"


def test_generator_draws_as_many_as_the_reference(spark):
    """The whole result, row by row, against SQL."""
    d = "/root/testdata/sf0.001"
    made = registry.QUERIES["synth_complaints"](spark, d).cache()
    rows, last = made.agg(F.count(F.lit(1)), F.max("n")).first()
    assert 950_000 < rows <= 1_000_000 and 999_000 < last < 1_000_000
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    relation = con.sql(registry.ORACLE_SQL["synth_complaints"])
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    digest = lambda rows: hashlib.sha256("\n".join(sorted("|".join(map(text, r)) for r in rows)).encode()).hexdigest()
    assert digest(made.select(*relation.columns).toLocalIterator()) == digest(relation.fetchall())
    made.unpersist()


def test_generator_grows_with_its_source(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(model_queries, "DRAWS", 10)
    monkeypatch.setattr(model_queries.synth, "synthesise", lambda source, count, *rest: asked.append(count))
    with pytest.raises(AttributeError):
        registry.QUERIES["synth_complaints"](spark, "/root/testdata/sf0.001")
    assert asked == [5 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()]
