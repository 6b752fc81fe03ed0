"""Merge, clean, synthesise, inspect and monitor from the command line; reading CSV files in order."""

from __future__ import annotations

import json
import sys

import pytest

from tamiz import __main__ as cli
from tamiz import monitor
from tamiz.sources import files


@pytest.fixture
def sheets(tmp_path):
    for kind, name, text in (
        ("presentados", "Presentados 2017.csv", "INGRESO EN SALA,NRO. EXPEDIENTE ORIGEN,TIPO EXPEDIENTE,FECHA DE PRESENTACION,DENUNCIADO(S),TIPO Y NUMERO DE DOCUMENTO DENUNCIADO(S),MATERIA\nN1,C1,t,2017-02-03,Banco S.A.,RUC: 1,m\nN2,C2,t,03/02/2017,\"Caja, Ica\",RUC: 2,m\nN3,C9,t,x,Otro,RUC: 3,m\n"),
        ("resueltos", "Resueltos 2018.csv", "NRO. DE EXPEDIENTE,EXPEDIENTE DE ORIGEN,TIPO DE EXPEDIENTE,FECHA DE PRESENTACION,DENUNCIADOS,MATERIA SPC,F. RESOLUCION,NRO DE RESOLUCION,FORMA DE CONCLUSION\nN1,C1,t,2017-02-03,Banco,m,2018-01-01,R1,>> FUNDADA\nX7,C2,t,2017-02-03,Caja,m,2018-01-02,R2,INFUNDADA\n"),
    ):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / name).write_text(text)
    return tmp_path


def test_merge_clean_synthesise(spark, sheets, capsys):
    run = lambda *argv: (cli.main([str(x) for x in argv]), json.loads(capsys.readouterr().out))[1]
    assert run("merge", sheets / "presentados", sheets / "resueltos", sheets / "merged") == {"rows": 3, "matched_by_number": 1, "matched_by_origin": 1, "unmatched": 1}
    merged = files.read_csv(spark, str(sheets / "merged"))
    assert set(files.CLEAN_COLUMNS) <= set(merged.columns)
    report = run("clean", sheets / "merged", sheets / "clean", "--report", sheets / "report.json")
    assert (report["kept"], report["unmatched"], report["bad_days"], report["malformed"]) == (3, 1, 1, 0) and json.loads((sheets / "report.json").read_text()) == report
    rows = {r["NRO_EXPEDIENTE"]: r for r in files.read_csv(spark, str(sheets / "clean")).collect()}
    assert (rows["N2"]["DENUNCIADOS_pres"], rows["N2"]["FECHA_PRESENTACION_pres"], rows["N2"]["NRO_RESOLUCION"], rows["N2"]["RES_MATCH_SOURCE"], rows["N2"]["año_res"]) == ("CAJA, ICA", "2017-02-03", "R2", "origen", "2018")
    made = run("synthesise", sheets / "clean", sheets / "synthetic", "--rows", 500, "--anchor", "2026-01-01", "--reduced", sheets / "reduced")
    assert made["rows"] == 500 and 40 < made["spam"] < 150
    synthetic = files.read_csv(spark, str(sheets / "synthetic"))
    assert synthetic.columns == [*sorted(files.CLEAN_COLUMNS), "TIMESTAMP", "DETALLE_QUEJA", "ES_SPAM", "SPAM_TAGS", "SPAM_SCORE"]
    assert {r["NRO_EXPEDIENTE"] for r in synthetic.select("NRO_EXPEDIENTE").distinct().collect()} == {"N1", "N2", "N3"}
    assert "RES_MATCH_SOURCE" not in files.read_csv(spark, str(sheets / "reduced")).columns
    with pytest.raises(ValueError, match="empty"):
        (sheets / "none.csv").write_text("a,b\n")
        cli.main(["synthesise", str(sheets / "none.csv"), str(sheets / "no")])


def test_inspect_and_monitor(spark, tmp_path, capfd):
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    assert cli.main(["inspect", str(tmp_path / "x.parquet")]) == 0
    assert "id: long" in capfd.readouterr().out
    assert cli.main(["monitor", str(tmp_path / "m.json"), "--", sys.executable, "-c", "x = bytearray(30_000_000)\nfor _ in range(10_000_000): pass"]) == 0
    used = json.loads((tmp_path / "m.json").read_text())
    assert used["samples"] > 0 and used["max_mem_mb"] > 20 and used["max_cpu_percent"] > 10
    with pytest.raises(RuntimeError):
        monitor.monitored([sys.executable, "-c", "raise SystemExit(3)"])
    assert monitor.speedups({"a": {"seconds": 4.0}, "b": {"seconds": 2.0}}) == {"a": 1.0, "b": 2.0}


def test_header_and_row_order(spark, tmp_path):
    """Names are trimmed, of equal ones the last counts; rows are numbered in file order, whatever the splits."""
    (tmp_path / "x.csv").write_text(" a ,b,a\n1,2,3\n4,5\n")
    got = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [("3", "2"), (None, "5")]
    folder = tmp_path / "many"
    folder.mkdir()
    for k, n in enumerate((40, 4000, 7)):
        (folder / f"part{k}.csv").write_text("v\n" + "".join(f"{k}-{i:06d}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = files.file_index(files.read_csv(spark, str(folder), multiline=False), "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r["n"] for r in rows] == list(range(4047)) and [r["v"] for r in rows] == sorted(r["v"] for r in rows)
    assert [r["n"] for r in files.file_index(spark.range(10).repartition(3), "n").orderBy("n").collect()] == list(range(10))


def test_ingest_and_sheets(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name in ("Expedientes Resueltos 2017.csv", "Presentados 2018.csv", "notes.txt", "Presentados y Resueltos 2019.csv"):
        (tmp_path / "in" / name).write_text("MATERIA\nm\n")
    assert cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "raw")]) == 0
    assert json.loads(capsys.readouterr().out) == {"resueltos": ["Expedientes Resueltos 2017.csv", "Presentados y Resueltos 2019.csv"], "presentados": ["Presentados 2018.csv"]}
    assert len(cli.sheets(str(tmp_path / "raw/resueltos"))) == 2
    (tmp_path / "x.xlsx").write_bytes(b"")
    with pytest.raises((ImportError, ValueError, OSError)):
        files.read_sheet(spark, str(tmp_path / "x.xlsx"))


def test_chunks():
    assert cli.chunk_ranges(10, 4) == [(0, 3), (3, 6), (6, 9), (9, 10)] and cli.chunk_ranges(2, 9) == [(0, 1), (1, 2)] and cli.chunk_ranges(0, 3) == []
    assert (cli.clamp_workers(0, 1), cli.clamp_workers(5, 0), cli.clamp_workers(5, 3)) == (1, 1, 3)
