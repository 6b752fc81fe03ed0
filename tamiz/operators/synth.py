"""Synthetic labelled complaints with injected anomalies, from reproducible hash draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts, names and weights of the generator.
OPENINGS = ("Presento una queja", "Interpongo un reclamo", "Deseo registrar una denuncia", "Quiero reportar un problema")
REQUESTS = ("Solicito una investigación.", "Pido atención inmediata.", "Requiero solución urgente.")
PREFIXES = ("Corporación", "Grupo", "Servicios", "Consorcio")
CORES = ("Integral", "Andino", "Financiero", "Comercial")
SUFFIXES = ("SAC", "EIRL", "SA")
HOUR_WEIGHTS = (1, 1, 1, 1, 1, 2, 3, 5, 12, 18, 20, 18, 15, 14, 13, 12, 10, 8, 5, 4, 3, 2, 1, 1)
NO_ENTITY, NO_MATTER = "empresa", "servicio"
ANOMALY_SHARE, MOST_ANOMALIES = 0.18, 3
PLAIN_WORD_SHARE, SHOUT_SHARE, CAPITALS_SHARE = 0.15, 0.10, 0.08
TAGS = ("temporal_burst", "night_activity", "fake_entity", "duplicate_text")

RESOLUTION = 1 << 32


def draw(name: str, seed: int) -> Column:
    """An integer below 2^32 from the row's ``n``, the draw's name and the seed; independent of partitions and order."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{name}|"), F.col("n").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def below(name: str, seed: int, k: int) -> Column:
    """A uniform integer from 0 to k - 1."""
    return F.pmod(draw(name, seed), F.lit(k))


def chance(name: str, seed: int, share: float) -> Column:
    return draw(name, seed) < int(share * RESOLUTION)


def pick(options: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def weighted_hour(name: str, seed: int) -> Column:
    """An hour drawn by its weight: a place in the list that holds every hour as often as it weighs."""
    hours = [hour for hour, weight in enumerate(HOUR_WEIGHTS) for _ in range(weight)]
    return F.element_at(F.array(*[F.lit(h) for h in hours]), below(name, seed, len(hours)).cast("int") + 1)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c`` with ``c`` worked out once, so that chained steps do not multiply in the plan."""
    return F.element_at(F.transform(F.array(c), f), 1)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


# An anomaly takes the frame, the condition under which it strikes and the number of the round.
Anomaly = Callable[[DataFrame, Column, int, int], DataFrame]


def burst(df: DataFrame, hit: Column, turn: int, seed: int) -> DataFrame:
    """Later by its own seconds modulo 20."""
    return df.withColumn("ts", bound(F.col("ts"), lambda t: F.when(hit, add_seconds(t, F.pmod(F.second(t), F.lit(20)))).otherwise(t)))


def night(df: DataFrame, hit: Column, turn: int, seed: int) -> DataFrame:
    """At ten past two on the same day."""
    return df.withColumn("ts", bound(F.col("ts"), lambda t: F.when(hit, add_seconds(F.date_trunc("day", t).cast("timestamp_ntz"), F.lit(7800))).otherwise(t)))


def fake_entity(df: DataFrame, hit: Column, turn: int, seed: int) -> DataFrame:
    """An invented entity in the record; the text keeps the old one."""
    name = F.concat_ws(" ", *[pick(o, below(f"fake-{part}-{turn}", seed, len(o))) for part, o in (("prefix", PREFIXES), ("core", CORES), ("suffix", SUFFIXES))])
    return df.withColumn("entity", F.when(hit, name).otherwise(F.col("entity")))


def duplicate_text(df: DataFrame, hit: Column, turn: int, seed: int) -> DataFrame:
    """One of four variants of the text."""
    k = below(f"variant-{turn}", seed, 4)

    def variant(t: Column) -> Column:
        return F.when(~hit, t).when(k == 0, F.upper(t)).when(k == 1, F.lower(t)).when(k == 2, F.concat(t, F.lit(" urgente"))).otherwise(F.replace(t, F.lit("Solicito"), F.lit("Requiero")))

    return df.withColumn("text", bound(F.col("text"), variant))


#: The registry: a new anomaly is a function over frames under its tag.
ANOMALIES: dict[str, Anomaly] = dict(zip(TAGS, (burst, night, fake_entity, duplicate_text), strict=True))


def base_complaints(source: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` draws with replacement from ``source`` (position from 0, entity, matter, day as text)."""
    size = source.count()
    drawn = source.sparkSession.range(count).withColumnRenamed("id", "n").withColumn("position", below("sample", seed, max(size, 1)))
    return drawn.join(source, "position")


def synthesise(source: DataFrame, count: int, anchor: str, seed: int = 42, anomalies: dict[str, Anomaly] | None = None) -> DataFrame:
    """n, entity, matter, ts, text, spam, tags, score of valid synthetic complaints; and ``original``, where the source has it.

    Days that do not parse become days up to a year before ``anchor``. Text is made before
    anomalies rewrite the entity. Rows without a text or an entity in the end are left out.
    """
    registry = anomalies or ANOMALIES
    df = base_complaints(source, count, seed)
    filled = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    known = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date"))
    day = F.coalesce(known, F.date_sub(F.lit(anchor).cast("date"), below("back", seed, 365).cast("int")))
    clock = weighted_hour("hour", seed) * 3600 + below("minute", seed, 60) * 60 + below("second", seed, 60)
    df = df.withColumn("ts", add_seconds(day.cast("timestamp_ntz"), clock))
    text = F.concat(pick(OPENINGS, below("opening", seed, 4)), F.lit(" contra "), filled(F.col("entity"), NO_ENTITY), F.lit(" por problemas relacionados con "), filled(F.col("matter"), NO_MATTER), F.lit(". "), pick(REQUESTS, below("request", seed, 3)))
    text = bound(text, lambda t: F.when(chance("plain", seed, PLAIN_WORD_SHARE), F.replace(t, F.lit("ción"), F.lit("cion"))).otherwise(t))
    text = F.concat(text, F.when(chance("shout", seed, SHOUT_SHARE), "!!").otherwise(""))
    df = df.withColumn("text", bound(text, lambda t: F.when(chance("capitals", seed, CAPITALS_SHARE), F.upper(t)).otherwise(t)))
    strikes = F.when(chance("spam", seed, ANOMALY_SHARE), below("strikes", seed, MOST_ANOMALIES) + 1).otherwise(0)
    names = tuple(registry)
    df = df.withColumn("strikes", strikes)
    for turn in range(MOST_ANOMALIES):
        which = below(f"anomaly-{turn}", seed, len(names))
        for k, name in enumerate(names):
            df = registry[name](df, (F.col("strikes") > turn) & (which == k), turn, seed)
    drawn = [F.when(F.col("strikes") > t, pick(names, below(f"anomaly-{t}", seed, len(names)))) for t in range(MOST_ANOMALIES)]
    spam = (F.col("strikes") > 0).cast("int")
    share = draw("score", seed) / float(RESOLUTION) * 0.3
    valid = (F.trim("text") != "") & (F.trim(F.coalesce("entity", F.lit(""))) != "")
    return df.where(valid).select("n", "entity", "matter", "ts", "text", spam.alias("spam"), F.array_compact(F.array(*drawn)).alias("tags"), (F.when(F.col("strikes") > 0, 0.7 + share).otherwise(share)).alias("score"), *(["original"] if "original" in source.columns else []))


def _new_columns() -> list[Column]:
    """What the generator adds to a row: seconds, 0 or 1, tags joined by semicolons, two decimals."""
    return [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TIMESTAMP"), F.col("text").alias("DETALLE_QUEJA"), F.col("spam").cast("string").alias("ES_SPAM"), F.array_join("tags", ";").alias("SPAM_TAGS"), F.format_string("%.2f", "score").alias("SPAM_SCORE")]


def export_columns(complaints: DataFrame) -> DataFrame:
    """The entity, the matter and the new columns, as written to CSV."""
    return complaints.select(F.col("entity").alias(ENTITY), F.col("matter").alias(MATTER), *_new_columns())


ENTITY, MATTER, DAY = "DENUNCIADOS_pres", "MATERIA_pres", "FECHA_PRESENTACION_pres"


def synthetic_rows(records: DataFrame, count: int, anchor: str, seed: int = 42) -> DataFrame:
    """Whole rows as they are written: the original columns in bytewise order, the entity as anomalies left it, then the five new columns.

    ``records`` (clean records of any columns, with ``position`` from 0) are drawn with replacement. A column that they lack counts as empty.
    """
    columns = sorted(c for c in records.columns if c != "position")
    text = lambda c: F.col(f"`{c}`").cast("string") if c in columns else F.lit("")
    source = records.select("position", text(ENTITY).alias("entity"), text(MATTER).alias("matter"), text(DAY).alias("day"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("original"))
    own = [F.col("entity").alias(c) if c == ENTITY else F.col("original").getField(c).alias(c) for c in columns]
    return synthesise(source, count, anchor, seed).select(*own, *_new_columns())
