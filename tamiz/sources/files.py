"""CSV sources and sinks of the record stages, and JSON and text reports."""

from __future__ import annotations

import json
import logging
import shutil
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.functions.cleaning import label
from tamiz.functions.text import cell
from tamiz.functions.timefeat import stamp_or_day
from tamiz.operators.merge import rename, union_by_name

# The columns of a clean file.
CLEAN_COLUMNS = (
    "NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN_pres", "TIPO_EXPEDIENTE_pres", "FECHA_PRESENTACION_pres", "DENUNCIADOS_pres", "DOC_DENUNCIADO", "MATERIA_pres", "año_pres",
    "FECHA_RESOLUCION", "NRO_RESOLUCION", "FORMA_CONCLUSION", "año_res", "RES_MATCH_SOURCE",
)
CORRUPT = "_corrupt_record"


def year_of(name: Column) -> Column:
    """The first run of four digits in a file name, or null."""
    return F.nullif(F.regexp_extract(name, r"(\d{4})", 1), F.lit("")).try_cast("int")


def route(name: str) -> str:
    """Which folder a downloaded sheet belongs to."""
    return "resueltos" if "Resueltos" in name else "presentados"


def ingest(source: str, target: str) -> dict[str, list[str]]:
    """Copy the sheets of a downloaded folder into ``resueltos`` and ``presentados`` under ``target``, by their names; other files stay behind."""
    taken: dict[str, list[str]] = {"resueltos": [], "presentados": []}
    for path in sorted(Path(source).rglob("*")):
        if path.is_file() and ("Resueltos" in path.name or "Presentados" in path.name):
            folder = Path(target) / route(path.name)
            folder.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(path, folder / path.name)
            taken[route(path.name)].append(path.name)
    return taken


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One sheet, all text: Parquet, CSV, or Excel where pandas finds a reader for it (an optional library; sheets are small)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        try:
            held = pd.read_excel(path, dtype=str)
        except ImportError as e:
            raise ImportError(f"reading {path} needs an Excel reader such as openpyxl; or export it as CSV") from e
        schema = T.StructType([T.StructField(str(c), T.StringType()) for c in held.columns])
        return spark.createDataFrame(held.astype(object).where(held.notna(), None).values.tolist(), schema)
    return read_csv(spark, path)


def yearly_sheets(spark: SparkSession, paths: list[str], names: dict[str, str]) -> DataFrame:
    """Yearly sheets (see ``read_sheet``) under one set of names, with ``año`` from the file name.

    Every file is renamed on its own before the union, as headers differ by year.
    No paths are an error.
    """
    if not paths:
        raise ValueError("no sheets to read")
    frames = []
    for path in paths:
        frames.append(rename(read_sheet(spark, path), names).withColumn("año", year_of(F.lit(path.rstrip("/").rpartition("/")[2]))))
    return union_by_name(frames)


def _reader(spark: SparkSession, multiline: bool) -> DataFrameReader:
    return spark.read.option("multiLine", multiline).option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """A CSV file with a header, all text; ragged rows are filled or cut. Header names are trimmed; of equal ones the last column counts.

    Quotes may hold line breaks; ``multiline=False``, for files without such, lets Spark split large files among tasks.
    """
    if schema is not None:
        return _reader(spark, multiline).option("header", True).schema(schema).csv(path)
    first = _reader(spark, multiline).option("header", False).option("inferSchema", False).csv(path).first()
    names = [(c or "").strip().removeprefix("\ufeff") for c in first or ()]
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    places = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    last = {name: i for i, name in enumerate(names)}
    return _reader(spark, multiline).option("header", True).option("enforceSchema", True).schema(places).csv(path).select(*[F.col(f"_c{i}").alias(name) for name, i in last.items()])


def _has_metadata(df: DataFrame) -> bool:
    """Whether rows still know their file; a frame that does not is no error worth a log entry."""
    log = logging.getLogger("DataFrameQueryContextLogger")
    before, log.disabled = log.disabled, True
    try:
        return bool(df.select("_metadata.file_path", "_metadata.file_block_start").columns)
    except AnalysisException:
        return False
    finally:
        log.disabled = before


def file_index(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the place of a row from 0 without gaps, in the order of files that ``df`` reads (with nothing but projections and filters between), else in partition order.

    Rows are numbered within their split, and splits are shifted by the counts of those before; only these counts are put in order.
    """
    if _has_metadata(df):
        split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    else:
        split = [F.lit("").alias("_file"), F.shiftright(F.monotonically_increasing_id(), 33).alias("_start")]
    numbered = df.select("*", *split, F.monotonically_increasing_id().alias("_id"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counts = numbered.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return numbered.join(F.broadcast(shift), ["_file", "_start"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before")).drop("_file", "_start", "_id", "_first", "_before")


def read_strict(spark: SparkSession, path: str, columns: tuple[str, ...] | list[str], multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows whose field count fits the header, and the raw text of the others; the parsed rows are persisted for both."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])
    rows = _reader(spark, multiline).schema(schema).option("header", True).option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).csv(path).persist()
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; null becomes empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that exists, trimmed; empty if none does."""
    found = next((n for n in names if n in df.columns), None)
    return cell(F.col(f"`{found}`")) if found else F.lit("")


def complaint_records(df: DataFrame, limit: int | None = None) -> DataFrame:
    """row_id, text, label, ts, materia, tipo of a complaint table.

    Text and flag are required columns; time, matter and kind fall back by name. A flag that is no
    label raises when read. row_id counts the rows in file order, from 0 without gaps; ``limit`` takes the first, for trials.
    """
    for c in ("DETALLE_QUEJA", "ES_SPAM"):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
    own = file_index(df, "row_id")
    if limit:
        own = own.where(F.col("row_id") < limit)
    stamp = stamp_or_day(first_present(df, ["TIMESTAMP"]), first_present(df, ["FECHA_PRESENTACION_pres", "FECHA_PRESENTACION"]), first_present(df, ["HORA_PRESENTACION"]))
    rows = own.select("row_id", cell(F.col("DETALLE_QUEJA")).alias("text"), label(F.col("ES_SPAM")).alias("label"), stamp.alias("ts"), first_present(df, ["MATERIA", "MATERIA_pres"]).alias("materia"), first_present(df, ["TIPO_EXPEDIENTE", "TIPO_EXPEDIENTE_pres"]).alias("tipo"))
    return rows


def reduce_synthetic(df: DataFrame) -> DataFrame:
    """Without bookkeeping columns, and with the plain names of four others."""
    plain = {f"{c}_pres": c for c in ("DENUNCIADOS", "TIPO_EXPEDIENTE", "MATERIA", "FECHA_PRESENTACION")}
    return df.drop("año_pres", "año_res", "RES_MATCH_SOURCE").withColumnsRenamed(plain)


def write_json(payload: dict, path: str | None = None) -> str:
    """A report as indented JSON; folders are made; without a path it is only returned."""
    text = json.dumps(payload, indent=2, ensure_ascii=False)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text + "\n")
    return text


def summary_path(path: str) -> Path:
    """Where the plain summary of a JSON report goes."""
    p = Path(path)
    return p.with_name(f"{p.stem}_runs.txt")


def write_summary(runs: list[dict], path: str) -> Path:
    """One line per run, next to the report."""
    lines = [", ".join(f"{k}={v}" for k, v in run.items()) for run in runs]
    out = summary_path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text("\n".join(lines) + "\n")
    return out
