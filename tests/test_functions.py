"""Column functions against hand-written cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamiz.functions import cleaning, text, timefeat


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (cleaning.entity, {"BANCO DE CRÉDITO DEL PERÚ S.A.": "BANCO DE CREDITO DEL PERU SA", "SCOTIABANK PERÚ S.A.A.": "SCOTIABANK PERU SAA", "COMISIÓN DE PROTECCIÓN AL CONSUMIDOR N° 1": "COMISION DE PROTECCION AL CONSUMIDOR N1", "COMISION DE PROTECCIÓN AL CONSUMIDOR N°  1": "COMISION DE PROTECCION AL CONSUMIDOR N1", "SAN 123": "SAN123", "JR. LIMA": "JR LIMA", None: ""}),
        (cleaning.document_number, {"RUC : 20133840533": "20133840533", "RUC : 1 / DNI : 2": "1 / DNI : 2", " x ": "x", None: ""}),
        (cleaning.conclusion, {">>CONFIRMA\n>>CONSENTIDO": "CONFIRMA", "> > A": "> A", "": "", None: ""}),
        (cleaning.day, {"15/03/2017": "2017-03-15", "2017/03/15": "2017-03-15", "2017-03-15": "2017-03-15", "2017-02-30": "", "abc": "", None: ""}),
        (cleaning.year, {"2017.0": "2017", "2009": "", "x": "", "2030": "2030", None: ""}),
        (cleaning.label, {"1": 1, "true": 1, "t": 1, "spam": 1, "si": 1, "sí": 1, " YES ": 1, "0.5": 1, "1.0": 1, "0": 0, "false": 0, "f": 0, "no": 0, "": 0, "0.49": 0, None: 0}),
        (cleaning.squeeze, {" a \t b\tc ": "a b\tc"}),
        (text.normalize, {"Queja por TELÉFONO!!  Número 123": "queja por telefono numero 123", "a_b": "a b", "": "", None: None}),
        (text.category, {"  Crédito\t\tÁgil ": "credito agil", None: ""}),
        (text.trim_unicode, {" \t x  ": "x"}),
    ],
)
def test_cases(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_bad_label_raises(spark):
    with pytest.raises(Exception, match="not a binary label"):
        apply(spark, cleaning.label, ["maybe"])


def test_tokens(spark):
    assert apply(spark, text.tokens, ["Queja por TELÉFONO!!  Número 123"]) == [["queja", "por", "telefono", "numero", "123"]]
    assert apply(spark, lambda c: text.tokens(c, True), ["Queja banco", "solo", "", None]) == [["queja", "banco", "queja_banco"], ["solo"], [], []]


def test_timestamps(spark):
    got = apply(spark, timefeat.parse_stamp, ["2026-05-09 22:15:00", "2026-05-09 2:15", "2026-05-09T23:00:00-05:00", "09/05/2026", "2026/05/09 01:02:03.5", "2026-13-01", "", None])
    day = dt.datetime(2026, 5, 9)
    assert got == [day.replace(hour=22, minute=15), day.replace(hour=2, minute=15), day.replace(hour=23), day, day.replace(hour=1, minute=2, second=3, microsecond=500000), None, None, None]


def test_date_and_clock(spark):
    row = spark.sql("select '' as a, '2026-05-09' as b, '08:30' as c, '25:00' as d").select(timefeat.stamp_or_day(F.col("a"), F.col("b"), F.col("c")), timefeat.stamp_or_day(F.col("a"), F.col("b"), F.col("d")), timefeat.stamp_or_day(F.col("a"), F.col("d"), F.col("c"))).first()
    assert tuple(row) == (dt.datetime(2026, 5, 9, 8, 30), dt.datetime(2026, 5, 9), None)


def test_temporal_features(spark):
    ts = F.lit(dt.datetime(2026, 5, 9, 2, 15)).cast("timestamp_ntz")
    values = list(spark.range(1).select(*timefeat.temporal_features(ts)).first())
    assert len(values) == 10 and values[3] == 1 and values[5] == 1 and values[4] == 0
    assert list(spark.range(1).select(*timefeat.temporal_features(F.lit(None).cast("timestamp_ntz"))).first()) == [0.0] * 10
