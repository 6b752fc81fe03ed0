"""The registry, the contract's guard, the command line's parsing, the run as a whole, and stream scoring."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tamiz import __main__ as cli
from tamiz.operators.logreg import Linear
from tamiz.plans import complaint_model as M
from tamiz.plans import registry
from tamiz.plans.model_queries import labelled
from tamiz.sources.files import reduce_synthetic
from tamiz.streaming import scoring

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["text_normalize", "vocabulary_idf", "category_encoder", "temporal_features", "parse_timestamp", "two_step_match", "clean_entity", "clean_records", "clean_report", "rule_alerts", "gd_one_step", "train_evaluate", "unmatched_rows", "coverage_by_year", "assembled_features", "synthetic_export", "header_names", "complaint_loader"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    relation = con.sql(registry.ORACLE_SQL[name])
    at = [relation.columns.index(c) for c in columns]
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(text(r[c]) for c in columns) for r in frame.collect())
    assert got == sorted(tuple(text(r[i]) for i in at) for r in relation.fetchall())


def test_command_line_values():
    assert cli.mode_name(" Secuencial ") == "sequential" and cli.worker_counts("1, ,4") == [1, 4]
    for bad in ("", " , ", "0", "-1"):
        with pytest.raises(ValueError):
            cli.worker_counts(bad)
    with pytest.raises(ValueError, match="unknown mode"):
        cli.mode_name("x")


def test_config_falls_back():
    made = M.RunConfig(epochs=0, ratio=3, max_features=-1, decay=-1.0).normalised()
    assert (made.epochs, made.ratio, made.max_features, made.decay) == (10, 0.2, 5000, -1.0)


def test_trainers_agree_when_a_batch_holds_all(spark):
    records = labelled(spark, DIR).cache()
    base = {"epochs": 2, "rate": 0.5, "max_features": 50}
    a = M.run_once(records, M.RunConfig(**base)).model
    b = M.run_once(records, M.RunConfig(**base, trainer="exact")).model
    assert a.bias == pytest.approx(b.bias) and a.weights == pytest.approx({k: b.weights.get(k, 0.0) for k in a.weights}, abs=1e-12)


def test_features_hold_no_forbidden_column(spark):
    records = labelled(spark, DIR)
    run = M.run_once(records, M.RunConfig(epochs=1, max_features=30))
    assert run.assembler.transform(M.prepare(records, M.RunConfig())[0]).columns == ["row_id", "idx", "value"]
    assert run.assembler.dimension == sum(run.assembler.sizes) + 10
    report = M.evaluate(run).first()
    assert report["tp"] + report["tn"] + report["fp"] + report["fn"] == run.scored.count()


def test_reduce_synthetic(spark):
    frame = spark.createDataFrame([("a", "2017", "m", "none")], "DENUNCIADOS_pres string, `año_pres` string, MATERIA_pres string, RES_MATCH_SOURCE string")
    assert reduce_synthetic(frame).columns == ["DENUNCIADOS", "MATERIA"]


def test_stream_scores_as_it_arrives(spark, tmp_path):
    vocabulary = spark.createDataFrame([("queja", 0, 1.0), ("banco", 1, 2.0)], "token string, idx long, idf double")
    rows = spark.createDataFrame([(1, "queja banco"), (2, "otro"), (1, "queja banco")], "id long, text string").withColumn("ts", F.lit("2026-01-01 10:00:00").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scored = scoring.score(scoring.once_each(stream, "id", "ts"), vocabulary, Linear({1: 6.0}, -1.0))
    query = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["id"], r["prediction"]) for r in spark.table("scored").collect()} == {(1, 1), (2, 0)}
