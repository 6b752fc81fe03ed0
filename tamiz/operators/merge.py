"""Merging presented and resolved records: union by name, two-step match, provenance."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised headers of the yearly sheets and the names they get.
PRESENTED_NAMES = {
    "INGRESO_EN_SALA": "NRO_EXPEDIENTE",
    "NRO_EXPEDIENTE_ORIGEN": "EXPEDIENTE_ORIGEN",
    "TIPO_EXPEDIENTE": "TIPO_EXPEDIENTE",
    "FECHA_DE_PRESENTACION": "FECHA_PRESENTACION",
    "DENUNCIADO_S": "DENUNCIADOS",
    "DENUNCIADOS": "DENUNCIADOS",
    "TIPO_Y_NUMERO_DE_DOCUMENTO_DENUNCIADO_S": "DOC_DENUNCIADO",
    "MATERIA": "MATERIA",
}
RESOLVED_NAMES = {
    "NRO_DE_EXPEDIENTE": "NRO_EXPEDIENTE",
    "EXPEDIENTE_DE_ORIGEN": "EXPEDIENTE_ORIGEN",
    "TIPO_DE_EXPEDIENTE": "TIPO_EXPEDIENTE",
    "FECHA_DE_PRESENTACION": "FECHA_PRESENTACION",
    "DENUNCIADOS": "DENUNCIADOS",
    "MATERIA_SPC": "MATERIA",
    "F_RESOLUCION": "FECHA_RESOLUCION",
    "NRO_DE_RESOLUCION": "NRO_RESOLUCION",
    "FORMA_DE_CONCLUSION": "FORMA_CONCLUSION",
}


def header(name: str) -> str:
    """A header without accents, in capitals, other characters as single underscores."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return re.sub(r"[^A-Z0-9]+", "_", plain.upper()).strip("_")


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their target names; where several headers mean one column, the first non-null value counts."""
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        targets.setdefault(names.get(header(c), c), []).append(c)
    return df.select(*[F.coalesce(*[df[f"`{c}`"] for c in cs]).alias(t) for t, cs in targets.items()])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null. No frames is an error."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def match_key(c: Column, legacy: bool = False) -> Column:
    """A trimmed key. ``legacy``: missing keys become the text ``nan`` and so meet each other."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text, F.lit("nan")) if legacy else F.nullif(text, F.lit(""))


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Left join on ``key``; columns that both sides have get a suffix. Repeated keys on the right fan out."""
    both = (set(left.columns) & set(right.columns)) - {key}
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return a.join(b, key, "left")


def keep_last(df: DataFrame, key: str, order: Column, tie: Column) -> DataFrame:
    """One row per ``key``: the last by ``order`` (null counts as last), then by ``tie``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    last = F.max_by(row, F.struct(order.isNull().alias("none"), order.alias("order"), tie.alias("tie")))  # partial sums: no task gathers a key's rows
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*")


def two_step_match(presented: DataFrame, resolved: DataFrame, tie: str, legacy: bool = False) -> DataFrame:
    """Every presented record with its resolution: by number, else by origin.

    Columns of the resolution end in ``_res``; ``RES_MATCH_SOURCE`` tells ``nro``, ``origen`` or
    ``none`` from whether a row matched, before values are filled. ``legacy`` labels
    matches by origin ``nro``, and lets missing keys meet. ``tie`` orders resolutions of one year.
    """
    number, origin = "NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN"
    keys = {number, origin}
    left = presented.withColumns({c: match_key(F.col(c), legacy) for c in keys})
    right = resolved.withColumns({c: match_key(F.col(c), legacy) for c in keys})
    values = [c for c in right.columns if c not in keys and c != tie]
    by_number = right.select(number, *[F.col(c).alias(f"{c}_res") for c in values], F.lit(True).alias("_m1"))
    unique = keep_last(right.where(F.col(origin).isNotNull()), origin, F.col("año").try_cast("int"), F.col(tie))
    by_origin = unique.select(origin, *[F.col(c).alias(f"{c}_res2") for c in values], F.lit(True).alias("_m2"))
    joined = left.join(by_number, number, "left").join(by_origin, origin, "left")
    filled = {f"{c}_res": F.coalesce(F.nullif(F.col(f"{c}_res").cast("string"), F.lit("")).cast(right.schema[c].dataType), F.col(f"{c}_res2")) for c in values}
    source = F.when(F.col("_m1"), "nro").when(F.col("_m2"), "nro" if legacy else "origen").otherwise("none")
    return joined.withColumn("RES_MATCH_SOURCE", source).withColumns(filled).drop("_m1", "_m2", *[f"{c}_res2" for c in values])


def merged_table(presented: DataFrame, resolved: DataFrame) -> DataFrame:
    """The merged records as they are staged: columns of both sides end in ``_pres`` and ``_res``, the others keep their names.

    Resolutions of one origin and year are ordered as they come.
    """
    number, origin = "NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN"
    both = (set(presented.columns) & set(resolved.columns)) - {number}
    right = resolved.withColumns({"_pos": F.monotonically_increasing_id(), "_origin": F.col(origin)})
    found = two_step_match(presented, right, "_pos")
    left = [F.col(f"`{c}`").alias(c + "_pres" if c in both else c) for c in presented.columns]
    values = [F.col(f"`{c}_res`").alias(c + "_res" if c in both else c) for c in resolved.columns if c not in (number, origin)]
    own = F.when(F.col("RES_MATCH_SOURCE") == "nro", F.col("_origin_res")).alias(f"{origin}_res")
    return found.select(*left, own, *values, "RES_MATCH_SOURCE")


def coverage(merged: DataFrame, year: str) -> DataFrame:
    """Per year: records, resolved ones and their percentage."""
    matched = F.count_if(F.col("RES_MATCH_SOURCE") != "none")
    n = F.count(F.lit(1))
    return merged.groupBy(year).agg(n.alias("presented"), matched.alias("resolved"), F.round(100.0 * matched / n, 6).alias("percent"))


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, nulls, percent: one row per column, from one pass."""
    n = F.count(F.lit(1))
    counts = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select("_n", F.explode(pairs).alias("p")).select("p.column_name", "p.nulls", F.when(F.col("_n") > 0, F.round(100.0 * F.col("p.nulls") / F.col("_n"), 6)).alias("percent"))
