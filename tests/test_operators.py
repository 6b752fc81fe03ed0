"""Operators on small frames: joins, vocabulary, training, metrics, rules, generator."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.functions.text import tokens
from tamiz.operators import features, logreg, merge, metrics, ranking, rules, synth, vocab
from tamiz.sources import files


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("tokens", tokens(F.col("text")))


def test_tfidf_by_hand(spark):
    train = docs(spark, ["queja banco queja", "queja internet"])
    words = vocab.fit_vocabulary(train, max_features=10, min_df=1)
    table = {r["token"]: (r["idx"], r["idf"]) for r in words.collect()}
    assert {k: v[0] for k, v in table.items()} == {"queja": 0, "banco": 1, "internet": 2}
    assert table["banco"][1] == pytest.approx(math.log(1.5) + 1)
    got = {r["idx"]: r["value"] for r in features.tfidf(docs(spark, ["queja banco"]), words).collect()}
    assert got == pytest.approx({0: 0.5, 1: 0.702733}, abs=1e-6)


def test_vocabulary_of_nothing(spark):
    assert vocab.fit_vocabulary(docs(spark, ["", None])).count() == 0


def test_headers_and_union(spark):
    assert merge.header("  NRO. EXPEDIENTE ORIGEN ") == "NRO_EXPEDIENTE_ORIGEN"
    assert merge.header("F. RESOLUCIÓN") == "F_RESOLUCION"
    a = spark.createDataFrame([("1", None, "x")], "`INGRESO EN SALA` string, DENUNCIADOS string, `DENUNCIADO(S)` string")
    assert merge.rename(a, merge.PRESENTED_NAMES).first().asDict() == {"NRO_EXPEDIENTE": "1", "DENUNCIADOS": "x"}


def test_two_step_match(spark):
    key = lambda rows: sorted(rows, key=lambda r: tuple(str(x) for x in r))
    presented = spark.createDataFrame([("a ", "o1"), ("b", "o2"), ("c", None), ("d", "o9")], "NRO_EXPEDIENTE string, EXPEDIENTE_ORIGEN string")
    resolved = spark.createDataFrame([("a", "oX", 2017, "F1", 1), ("a", "oY", 2018, "", 2), ("z", "o2", 2017, "old", 3), ("y", "o2", 2019, "new", 4), ("w", None, 2018, "nul", 5)], "NRO_EXPEDIENTE string, EXPEDIENTE_ORIGEN string, `año` int, FORMA string, pos int")
    get = lambda legacy: key([(r["NRO_EXPEDIENTE"], r["RES_MATCH_SOURCE"], r["FORMA_res"]) for r in merge.two_step_match(presented, resolved, "pos", legacy).collect()])
    assert get(False) == key([("a", "nro", "F1"), ("a", "nro", None), ("b", "origen", "new"), ("c", "none", None), ("d", "none", None)])
    assert get(True) == key([("a", "nro", "F1"), ("a", "nro", None), ("b", "nro", "new"), ("c", "nro", "nul"), ("d", "none", None)])


def test_keep_last_takes_null_for_last(spark):
    rows = spark.createDataFrame([("k", 2020, 1), ("k", None, 2), ("m", 1, 1), ("m", 1, 2)], "k string, y int, p int")
    assert sorted(tuple(r) for r in merge.keep_last(rows, "k", F.col("y"), F.col("p")).collect()) == [("k", None, 2), ("m", 1, 2)]


def test_sigmoid_and_predict(spark):
    assert spark.range(1).select(logreg.sigmoid(F.lit(0.0)), logreg.sigmoid(F.lit(-800.0))).first() == (0.5, 0.0)
    rows = spark.createDataFrame([(1, 1), (2, 0)], "row_id long, label int")
    long = spark.createDataFrame([(1, 0, 1.0)], "row_id long, idx long, value double")
    got = {r["row_id"]: r["prediction"] for r in logreg.predict(rows, long, logreg.Linear({0: 2.0}, -1.0)).collect()}
    assert got == {1: 1, 2: 0}


def test_exact_sgd_learns(spark):
    w, b = logreg.sgd([(np.array([0]), np.array([0.0])), (np.array([0]), np.array([1.0]))], np.array([0.0, 1.0]), 1, logreg.TrainConfig(200, 0.5, 0.0, 1))
    assert b < 0 < w[0] + b


def test_full_batch_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((12, 4)), rng.integers(0, 2, 12)
    rows = spark.createDataFrame([(i, int(y[i])) for i in range(12)], "row_id long, label int")
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(12) for j in range(4)], "row_id long, idx long, value double")
    config = logreg.TrainConfig(3, 0.5, 0.01, 100)
    model = logreg.descend(rows, long, config)
    w, b = logreg.sgd([(np.arange(4), x[i]) for i in range(12)], y.astype(float), 4, config)
    assert [model.weights[i] for i in range(4)] == pytest.approx(w) and model.bias == pytest.approx(b)


def test_confusion(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (7, 1)], "t int, g int")
    r = metrics.confusion(rows, F.col("t"), F.col("g")).first()
    assert tuple(r) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 2)
    assert tuple(metrics.confusion(rows.limit(0), F.col("t"), F.col("g")).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0)


def test_counted_model_sums_to_nine(spark):
    bits = [1, 0, 1, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 1]
    chunks = spark.createDataFrame([(i // 5, b) for i, b in enumerate(bits)], "chunk int, bit int").groupBy("chunk").agg(F.sum("bit").alias("n"))
    assert [r["n"] for r in chunks.orderBy("chunk").collect()] == [2, 2, 3, 2] and chunks.agg(F.sum("n")).first()[0] == 9


def test_trimmed_mean(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", 2.0), ("b", 4.0), ("b", 6.0)], "k string, x double")
    assert {r[0]: r[1] for r in rows.groupBy("k").agg(metrics.trimmed_mean(F.col("x"))).collect()} == {"a": 2.0, "b": 5.0}


def test_split(spark):
    rows = spark.range(10).select(F.col("id").alias("k"), F.timestamp_micros(F.lit(10) - F.col("id")).cast("timestamp_ntz").alias("ts"))
    out, method = ranking.split_records(rows, "ts", "k")
    got = {r["k"]: (r["rn"], r["part"]) for r in out.collect()}
    assert method == "temporal" and got[9] == (1, "train") and got[0] == (10, "test") and sum(p == "test" for _, p in got.values()) == 2
    assert ranking.split_records(rows.withColumn("ts", F.when(F.col("k") > 0, F.col("ts"))), "ts", "k")[1] == "random"
    assert [ranking.test_rows(n, r) for n, r in ((2, 0.2), (5, 0.5), (10, 7), (3, 0.99))] == [1, 3, 2, 2]
    with pytest.raises(ValueError, match="two rows"):
        ranking.test_rows(1, 0.2)


def test_global_rank_without_rows_and_with_ties(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("o"), F.col("id").alias("t"))
    got = [(r["o"], r["t"], r["rn"]) for r in ranking.global_rank(rows, "o", "t").orderBy("rn").collect()]
    assert got == [(o, t, i + 1) for i, (o, t) in enumerate(sorted((i % 3, i) for i in range(50)))]
    assert ranking.global_rank(rows.limit(0), "o", "t").count() == 0


def test_rules(spark):
    rows = spark.createDataFrame([(1, "x", "EMPRESA_FANTASMA_1"), (2, "x", "EMPRESA_FANTASMA_1"), (3, "y", "EMPRESA_FANTASMA_1"), (4, None, None)], "id int, text string, entity string").withColumn("ts", F.timestamp_seconds(F.col("id") * 20000).cast("timestamp_ntz"))
    got = {r["id"]: (r["r_duplicate"], r["r_night"], r["r_ghost"]) for r in rules.detect(rows, "text", "ts", "entity", 2).collect()}
    assert got == {1: (True, False, True), 2: (True, False, True), 3: (False, False, True), 4: (False, False, False)}


def test_generator_is_reproducible(spark):
    source = spark.createDataFrame([(0, "Banco", "Tarjeta", "2020-02-02"), (1, "", "Seguro", "?")], "position long, entity string, matter string, day string")
    made = synth.synthesise(source, 400, "2026-01-01").collect()
    assert made == synth.synthesise(source.repartition(3), 400, "2026-01-01").orderBy("n").collect() or sorted(made) == sorted(synth.synthesise(source, 400, "2026-01-01").collect())
    assert all(r["entity"] and r["text"] for r in made)
    assert all((r["spam"] == 1) == bool(r["tags"]) and (r["score"] >= 0.7) == (r["spam"] == 1) for r in made)
    assert all(r["ts"].hour == 2 for r in made if r["tags"] and r["tags"][-1] == "night_activity" and "temporal_burst" not in r["tags"])


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a "q"\nline', "1", "2026-05-09 10:00:00"), ("b", "", "")], "DETALLE_QUEJA string, ES_SPAM string, TIMESTAMP string")
    files.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    back = files.complaint_records(files.read_csv(spark, str(tmp_path / "c")))
    assert sorted((r["text"], r["label"], r["ts"] is None) for r in back.collect()) == [('a "q"\nline', 1, False), ("b", 0, True)]
    assert files.complaint_records(files.read_csv(spark, str(tmp_path / "c")), limit=1).count() == 1
    with pytest.raises(ValueError, match="missing column"):
        files.complaint_records(rows.drop("ES_SPAM"))


def test_strict_csv_sets_bad_rows_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    good, bad = files.read_strict(spark, str(tmp_path / "x.csv"), ("a", "b"))
    assert [tuple(r) for r in good.collect()] == [("1", "2")] and bad.count() == 2


def test_yearly_sheets(spark, tmp_path):
    for year, name in ((2017, "DENUNCIADO(S)"), (2018, "DENUNCIADOS")):
        spark.createDataFrame([(f"n{year}", "x")], f"`INGRESO EN SALA` string, `{name}` string").coalesce(1).write.parquet(str(tmp_path / f"p{year}.parquet"))
    got = files.yearly_sheets(spark, [str(tmp_path / f"p{y}.parquet") for y in (2017, 2018)], merge.PRESENTED_NAMES)
    assert sorted((r["NRO_EXPEDIENTE"], r["DENUNCIADOS"], r["año"]) for r in got.collect()) == [("n2017", "x", 2017), ("n2018", "x", 2018)]
    with pytest.raises(ValueError, match="no sheets"):
        files.yearly_sheets(spark, [], {})


def test_reports(tmp_path):
    assert files.write_json({"a": 1}, str(tmp_path / "d/r.json")) == '{\n  "a": 1\n}'
    assert files.write_summary([{"run": 1, "s": 2}], str(tmp_path / "d/r.json")).read_text() == "run=1, s=2\n"
    assert files.route("Resueltos 2017.xlsx") == "resueltos" and files.route("x.xlsx") == "presentados"


def test_batches_are_honoured_or_refused(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.random((10, 3)), rng.integers(0, 2, 10)
    rows = spark.createDataFrame([(i, int(y[i])) for i in range(10)], "row_id long, label int")
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(10) for j in range(3)], "row_id long, idx long, value double")
    with pytest.raises(ValueError, match="full batch"):
        logreg.descend(rows, long, logreg.TrainConfig(2, 0.5, 0.01, 4))
    whole = logreg.descend(rows, long, logreg.TrainConfig(4, 0.5, 0.01, 0))
    monkeypatch.setattr(logreg, "FEW_VALUES", 0)  # a job per epoch
    assert logreg.descend(rows, long, logreg.TrainConfig(4, 0.5, 0.01, 0)).weights == pytest.approx(whole.weights)
    sparse = spark.createDataFrame([(i + 1, int(y[i]), [(j, float(x[i, j])) for j in range(3)]) for i in range(10)], "rn long, label int, features array<struct<idx:bigint,value:double>>").repartition(3)
    config = logreg.TrainConfig(4, 0.5, 0.01, 4)
    w, b = np.zeros(3), 0.0
    for _ in range(4):
        for part in (slice(0, 4), slice(4, 8), slice(8, 10)):
            error = 1 / (1 + np.exp(-(x[part] @ w + b))) - y[part]
            w, b = w - 0.5 * (error @ x[part] / len(error) + 0.01 * w), b - 0.5 * error.mean()
    model = logreg.sgd_exact(sparse, 3, config)
    assert [model.weights[j] for j in range(3)] == pytest.approx(w.tolist()) and model.bias == pytest.approx(b)
    with pytest.raises(ValueError, match="one task"):
        logreg.sgd_exact(sparse, 3, config, most=29)


def test_vectors_equal_the_long_features(spark):
    from tamiz.operators.features import Assembler

    rows = spark.createDataFrame([(1, ["a", "b", "a"], "2026-01-03 23:00:00", "M", "k"), (2, ["b"], None, "n", None), (3, [], "2026-01-05 10:00:00", "", "k")], "row_id long, tokens array<string>, ts string, materia string, tipo string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    made = Assembler.fit(rows, 10, 1)
    long = sorted(tuple(r) for r in made.transform(rows).collect())
    got = [(r["row_id"], f["idx"], f["value"]) for r in made.vectors(rows).collect() for f in r["features"]]
    assert sorted(got) == long and all([f["idx"] for f in r["features"]] == sorted(f["idx"] for f in r["features"]) for r in made.vectors(rows).collect())
