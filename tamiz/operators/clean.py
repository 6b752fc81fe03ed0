"""The cleaning stage as a whole: merged records to clean ones, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import cleaning as C
from tamiz.functions.text import cell
from tamiz.sources.files import CLEAN_COLUMNS

#: What is done to each kept column; the others are squeezed.
CLEANERS = {
    "NRO_EXPEDIENTE": cell,
    "EXPEDIENTE_ORIGEN_pres": cell,
    "FECHA_PRESENTACION_pres": C.day,
    "FECHA_RESOLUCION": C.day,
    "FORMA_CONCLUSION": C.conclusion,
    "DENUNCIADOS_pres": C.entity,
    "DOC_DENUNCIADO": C.document_number,
    "año_pres": C.year,
    "año_res": C.year,
    "RES_MATCH_SOURCE": cell,
}


def clean_frame(merged: DataFrame) -> DataFrame:
    """The 13 clean text columns of merged records; rows without a number are left out. A missing column is an error."""
    missing = [c for c in CLEAN_COLUMNS if c not in merged.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    made = [CLEANERS.get(c, C.squeeze)(F.col(c)).alias(c) for c in CLEAN_COLUMNS]
    return merged.where(cell(F.col("NRO_EXPEDIENTE")) != "").select(*made)


def clean_report(merged: DataFrame) -> DataFrame:
    """n_read, skipped, kept, unmatched, unmatched_percent (null if none is kept), bad_days; one pass."""
    keep: Column = cell(F.col("NRO_EXPEDIENTE")) != ""
    day = cell(F.col("FECHA_PRESENTACION_pres"))
    counts = merged.agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(~keep).alias("skipped"), F.count_if(keep).alias("kept"),
        F.count_if(keep & (cell(F.col("RES_MATCH_SOURCE")) == "none")).alias("unmatched"), F.count_if(keep & (day != "") & (C.day(day) == "")).alias("bad_days"),
    )
    return counts.select("n_read", "skipped", "kept", "unmatched", F.when(F.col("kept") > 0, F.round(100.0 * F.col("unmatched") / F.col("kept"), 6)).alias("unmatched_percent"), "bad_days")
