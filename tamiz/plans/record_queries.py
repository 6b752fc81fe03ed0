"""Queries over records: parsing, cleaning, splits, joins, dedup, reports, rules; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import cleaning as C
from tamiz.functions import timefeat
from tamiz.functions.text import cell
from tamiz.operators import clean, merge, metrics, ranking, rules
from tamiz.sources import files
from tamiz.sources.tables import table

SPACE_SQL = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def temporal_features(spark: SparkSession, d: str) -> DataFrame:
    made = [(F.round(c, 6) + 0.0).alias(n) for c, n in zip(timefeat.temporal_features(F.col("ts")), timefeat.FEATURES, strict=True)]
    return table(spark, d, "events").select("event_id", *made)


# Layouts as Spark and DuckDB print them; the k-th event is printed in layout k mod 10.
PRINTED = (
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"), ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy H:mm:ss", "%d/%m/%Y %-H:%M:%S"),
    ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"), ("dd/MM/yyyy", "%d/%m/%Y"), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S"), ("yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M"), ("yyyy/MM/dd", "%Y/%m/%d"),
)
#: What each layout keeps of the stamp.
KEPT = ("second", "minute", "second", "day", "second", "minute", "day", "second", "minute", "day")


def parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod(F.col("event_id"), F.lit(len(PRINTED)))
    printed = None
    for i, (layout, _) in enumerate(PRINTED):
        value = F.date_format("ts", layout)
        printed = F.when(k == i, value) if printed is None else printed.when(k == i, value)
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), printed, F.lit("\t")).alias("printed"))
    return rows.select("event_id", F.date_format(timefeat.parse_stamp(F.col("printed")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def parse_clock(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.pmod(F.col("event_id"), F.lit(5)))
    clock = F.when(F.col("k") == 0, F.date_format("ts", "HH:mm:ss")).when(F.col("k") == 1, F.date_format("ts", "H:mm")).when(F.col("k") == 2, F.concat(F.date_format("ts", "HH"), F.lit(":99"))).when(F.col("k") == 3, F.lit("x")).otherwise(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(":7")))
    day = F.date_format("ts", "dd/MM/yyyy")
    return e.select("event_id", timefeat.parse_clock(clock).cast("long").alias("seconds"), F.date_format(timefeat.stamp_or_day(F.lit(""), day, clock), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts")
    return ranking.split_records(events, "ts", "event_id")[0].select("event_id", "rn", "part", ranking.batch_id(F.col("rn"), 1024).alias("batch"))


def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").withColumn("h", ranking.hash_order(F.col("doc_id"), 42))
    return ranking.split(docs, "h", "doc_id").select("doc_id", "rn", "part")


def label_parse(spark: SparkSession, d: str) -> DataFrame:
    said = ("1", "true", " SPAM ", "Sí", "0.5", "1.0", "0", "no", "", "0.49", "FALSE", "yes")
    k = F.pmod(F.col("doc_id"), F.lit(len(said)))
    spelt = F.element_at(F.array(*[F.lit(x) for x in said]), k.cast("int") + 1)
    return table(spark, d, "labels").select("doc_id", C.label(spelt).alias("parsed"), C.label(F.col("toxic").cast("string")).alias("toxic_label"))


def left_join_suffix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"))
    return merge.left_join_suffixed(c, o, "key", ("_pres", "_res"))


def _presented(spark: SparkSession, d: str) -> DataFrame:
    """Orders as presented records; every seventh has no origin."""
    o = table(spark, d, "orders")
    origin = F.when(F.pmod("o_orderkey", F.lit(7)) != 0, F.concat(F.lit("C"), F.pmod("o_orderkey", F.lit(4000)).cast("string")))
    return o.select(F.concat(F.lit(" N"), F.col("o_orderkey").cast("string")).alias("NRO_EXPEDIENTE"), origin.alias("EXPEDIENTE_ORIGEN"), F.year("o_orderdate").alias("año_pres"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """All lineitems as resolutions; a third of them under other numbers."""
    items = table(spark, d, "lineitem")
    number = F.when(F.pmod("l_orderkey", F.lit(3)) != 0, F.concat(F.lit("N"), F.col("l_orderkey").cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("X"), F.col("l_orderkey").cast("string")))
    conclusion = F.when(F.pmod("l_partkey", F.lit(5)) == 0, F.lit("")).otherwise(F.col("l_returnflag"))
    tie = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return items.select(number.alias("NRO_EXPEDIENTE"), F.concat(F.lit("C"), F.pmod("l_orderkey", F.lit(4000)).cast("string")).alias("EXPEDIENTE_ORIGEN"), F.year("l_shipdate").alias("año"), conclusion.alias("FORMA_CONCLUSION"), tie.alias("pos"))


def two_step_match(spark: SparkSession, d: str) -> DataFrame:
    return merge.two_step_match(_presented(spark, d), _resolved(spark, d), "pos").select("NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN", "año_pres", "año_res", "FORMA_CONCLUSION_res", "RES_MATCH_SOURCE")


def two_step_match_legacy(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.two_step_match(_presented(spark, d), _resolved(spark, d), "pos", legacy=True)
    return merged.groupBy("RES_MATCH_SOURCE").agg(F.count(F.lit(1)).alias("n"), F.count("FORMA_CONCLUSION_res").alias("filled"))


def coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    return merge.coverage(merge.two_step_match(_presented(spark, d), _resolved(spark, d), "pos"), "año_pres")


def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("year", F.when(F.pmod("event_id", F.lit(11)) != 0, F.pmod("event_id", F.lit(6))))
    return merge.keep_last(events, "user_id", F.col("year"), F.col("event_id")).select("user_id", "event_id", "year")


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return merge.union_by_name([c, s])


# Literal entity names beside the table's.
ENTITIES = ("BANCO DE CRÉDITO DEL PERÚ S.A.", "SCOTIABANK PERÚ S.A.A.", "COMISIÓN DE PROTECCIÓN AL CONSUMIDOR N° 1", "COMISION DE PROTECCIÓN AL CONSUMIDOR N°  1", "SAN 123", "JR. LIMA", "  pingüino   Ñandú s.a.c. ")


def clean_entity(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select(F.col("s_name").alias("raw")).union(table(spark, d, "part").select("p_name"))
    marked = names.select(F.concat("raw", F.lit(" s.a. n° "), F.length("raw").cast("string")).alias("raw"))
    literal = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ENTITIES])).alias("raw"))
    return marked.union(names).union(literal).select("raw", C.entity(F.col("raw")).alias("entity"))


def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod(F.col("o_orderkey"), F.lit(5))
    printed = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 3, F.lit("2017-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", C.day(printed).alias("day"))


def clean_years(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod(F.col("o_orderkey"), F.lit(4))
    shifted = (F.year("o_orderdate") + 16).cast("string")
    printed = F.when(k == 0, F.concat(shifted, F.lit(".0"))).when(k == 1, shifted).when(k == 2, F.lit("x")).otherwise(F.lit("2009"))
    return table(spark, d, "orders").select("o_orderkey", C.year(printed).alias("year"))


def clean_conclusion(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.conclusion(F.concat(F.lit(">> "), F.col("text"))).alias("conclusion"), F.length(C.squeeze(F.col("text"))).cast("long").alias("squeezed"))


def extract_doc_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", C.document_number(F.col("props")).alias("number"), C.document_number(F.col("event_type")).alias("kind"))


def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("entity", F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("source")))
    return docs.agg(F.count(F.lit(1)).alias("n_read"), F.count_if((cell(F.col("text")) != "") & (cell(F.col("entity")) != "")).alias("kept"), F.count_if(cell(F.col("entity")) == "").alias("skipped"))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(table(spark, d, "labels"), 1 - F.col("quality"), F.col("toxic"))


def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(metrics.trimmed_mean(F.col("value")), 6).alias("trimmed"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))


def stage_means(spark: SparkSession, d: str) -> DataFrame:
    """Line items as runs: quantity the total, tax the time to read, workers the line number."""
    spent = metrics.processing(F.col("l_quantity"), F.col("l_tax") * 100)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("workers")).agg(F.round(F.avg("l_quantity"), 6).alias("total"), F.round(F.avg(F.col("l_tax") * 100), 6).alias("read"), F.round(metrics.trimmed_mean(spent), 6).alias("processing"))


def best_config(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best(stage_means(spark, d), "workers", "processing")


def unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Presented records that neither their number nor their origin resolves."""
    keyed = [f.withColumns({c: merge.match_key(F.col(c)) for c in ("NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN")}) for f in (_presented(spark, d), _resolved(spark, d))]
    left = keyed[0]
    for c in ("NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN"):
        left = left.join(keyed[1].select(c), c, "left_anti")
    return left.select("NRO_EXPEDIENTE", "EXPEDIENTE_ORIGEN", "año_pres")


def null_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(10)) != 0, F.col("text")).alias("text"), F.nullif("lang", F.lit("es")).alias("lang"), "source", "n_chars")
    return merge.null_profile(docs)


def rule_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rules.frequent(docs, "text", 3, "fires").select("doc_id", "fires")


def rule_night(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rules.night(F.col("ts")).alias("fires"))


def _ghosts(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.pmod("user_id", F.lit(5)) == 0, F.lit("EMPRESA_FANTASMA_")).otherwise(F.lit("E_"))
    return table(spark, d, "events").select("event_id", "ts", "event_type", F.concat(mark, F.col("user_id").cast("string")).alias("entity"), F.concat_ws("|", "event_type", F.round("value", 0).cast("long").cast("string")).alias("text"))


def rule_entity(spark: SparkSession, d: str) -> DataFrame:
    return rules.detect(_ghosts(spark, d), "text", "ts", "entity", 50).select("event_id", "r_ghost")


def rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    found = rules.detect(_ghosts(spark, d), "text", "ts", "entity", 50)
    return found.agg(*[F.count_if(c).alias(c) for c in ("r_duplicate", "r_bombing", "r_night", "r_ghost", "alert")], F.count(F.lit(1)).alias("n"))


def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _ghosts(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Orders as merged records: numbers missing from some, days in three layouts or broken."""
    o = table(spark, d, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(5))
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 2, F.lit("")).otherwise(F.lit("2017-02-30"))
    return o.select(
        F.when(F.pmod("o_orderkey", F.lit(13)) != 0, F.concat(F.lit(" N"), F.col("o_orderkey").cast("string"))).alias("NRO_EXPEDIENTE"), F.lit(None).cast("string").alias("EXPEDIENTE_ORIGEN_pres"), F.concat(F.lit("a  b "), "o_orderstatus").alias("TIPO_EXPEDIENTE_pres"), day.alias("FECHA_PRESENTACION_pres"),
        F.concat(F.lit("Compañía n° "), F.col("o_custkey").cast("string"), F.lit(" S.A.")).alias("DENUNCIADOS_pres"), F.concat(F.lit("RUC : "), F.col("o_custkey").cast("string")).alias("DOC_DENUNCIADO"), F.col("o_orderpriority").alias("MATERIA_pres"), F.lit("2017.0").alias("año_pres"),
        day.alias("FECHA_RESOLUCION"), F.lit(" r ").alias("NRO_RESOLUCION"), F.concat(F.lit(">> "), "o_orderstatus", F.lit("\nrest")).alias("FORMA_CONCLUSION"), F.lit("1999").alias("año_res"), F.when(k == 4, "none").otherwise("nro").alias("RES_MATCH_SOURCE"),
    )


def clean_records(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_frame(_merged(spark, d))


def clean_report(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_report(_merged(spark, d))


# Headers of the yearly sheets in several spellings, beside the names of the given tables.
HEADERS = ("INGRESO EN SALA", "Nro. Expediente Origen", "DENUNCIADO(S)", "  Denunciados ", "TIPO Y NÚMERO DE DOCUMENTO DENUNCIADO(S)", "MATERIA / SPC", "F. RESOLUCIÓN", "Forma de Conclusión", "año", "--", "")


def header_names(spark: SparkSession, d: str) -> DataFrame:
    """Normalised headers and the names that the two maps give them."""
    rows = [(raw, merge.header(raw), merge.PRESENTED_NAMES.get(merge.header(raw)), merge.RESOLVED_NAMES.get(merge.header(raw))) for raw in HEADERS]
    return spark.createDataFrame(rows, "raw string, header string, presented string, resolved string")


def complaint_loader(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as a complaint file would be loaded: flags in words, the day and the clock in two columns, names that fall back."""
    docs, labels, events = (table(spark, d, t) for t in ("documents", "labels", "events"))
    rows = docs.join(labels, "doc_id").join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id", "left")
    stamp = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("")
    raw = rows.select(
        F.concat(F.lit(" "), "text").alias("DETALLE_QUEJA"), F.when(F.col("quality") == 0, "Sí").otherwise("false").alias("ES_SPAM"), stamp.alias("TIMESTAMP"), F.date_format("ts", "dd/MM/yyyy").alias("FECHA_PRESENTACION"),
        F.date_format("ts", "HH:mm").alias("HORA_PRESENTACION"), F.col("doc_id").cast("string").alias("MATERIA_pres"), F.col("lang").alias("TIPO_EXPEDIENTE_pres"), F.lit("unused").alias("año_pres"),
    )
    made = files.complaint_records(raw)
    return made.select("materia", "tipo", "label", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.length("text").cast("long").alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (
        header_names, complaint_loader, temporal_features, parse_timestamp, parse_clock, temporal_split, hashed_split, label_parse, left_join_suffix, two_step_match, two_step_match_legacy, coverage_by_year, dedup_keep_last, union_by_name, clean_entity, clean_dates,
        clean_years, clean_conclusion, extract_doc_number, validate_rows, confusion_metrics, trimmed_mean, stage_means, best_config, unmatched_rows, null_profile, rule_duplicates, rule_night, rule_entity, rule_alerts, entity_frequency, clean_records, clean_report,
    )
}

TURN = "6.283185307179586 * "
_HOUR, _WEEK = "hour(ts)", "dayofweek(ts)"
_PRINT_SQL = " ".join(f"WHEN {i} THEN strftime(date_trunc('{unit}', ts), '%Y-%m-%d %H:%M:%S')" for i, unit in enumerate(KEPT))

_PRESENTED_SQL = "p AS (SELECT 'N' || o_orderkey AS nro, CASE WHEN o_orderkey % 7 <> 0 THEN 'C' || (o_orderkey % 4000) END AS ori, year(o_orderdate) AS y FROM orders)"
_RESOLVED_SQL = """r AS (SELECT CASE WHEN l_orderkey % 3 <> 0 THEN 'N' || l_orderkey ELSE 'X' || l_orderkey END AS nro, 'C' || (l_orderkey % 4000) AS ori, year(l_shipdate) AS y,
        CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_returnflag END AS f, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS pos FROM lineitem),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ori ORDER BY y DESC NULLS FIRST, pos DESC) AS rn FROM r) WHERE rn = 1)"""
_MATCH_SQL = f"""{_PRESENTED_SQL}, {_RESOLVED_SQL}, m AS (SELECT p.nro, p.ori, p.y AS y_pres, CASE WHEN r.nro IS NOT NULL THEN 'nro' WHEN u.ori IS NOT NULL THEN 'origen' ELSE 'none' END AS src,
    coalesce(r.y, u.y) AS y_res, coalesce(nullif(r.f, ''), u.f) AS f FROM p LEFT JOIN r ON p.nro = r.nro LEFT JOIN u ON p.ori = u.ori)"""
_LEGACY_SQL = f"""{_PRESENTED_SQL}, {_RESOLVED_SQL}, m AS (SELECT CASE WHEN r.nro IS NOT NULL OR u.ori IS NOT NULL THEN 'nro' ELSE 'none' END AS src, coalesce(nullif(r.f, ''), u.f) AS f
    FROM p LEFT JOIN r ON p.nro = r.nro LEFT JOIN u ON coalesce(p.ori, 'nan') = u.ori)"""


def entity_sql(c: str) -> str:
    upper = f"upper(translate({trim_sql(c)}, '{C.ACCENTED}', '{C.PLAIN}'))"
    ordinal = rf"regexp_replace({upper}, 'N[°º]?[\t\n\f\r ]*\.?[\t\n\f\r ]*([0-9])', 'N\1', 'g')"
    dots = rf"regexp_replace({ordinal}, '([A-Z])\.', '\1', 'g')"
    return trim_sql(rf"regexp_replace({dots}, '[\t\n\f\r ]{{2,}}', ' ', 'g')")


def number_sql(c: str) -> str:
    v = trim_sql(f"coalesce({c}, '')")
    return f"CASE WHEN contains({v}, ':') THEN {trim_sql(f'substr({v}, strpos({v}, chr(58)) + 1)')} ELSE {v} END"


def trimmed_sql(x: str) -> str:
    return f"CASE WHEN count({x}) > 2 THEN (sum({x}) - min({x}) - max({x})) / nullif(count({x}) - 2, 0) ELSE coalesce(avg({x}), 0.0) END"


_STAGE_SQL = f"SELECT l_linenumber AS workers, round(avg(l_quantity), 6) AS total, round(avg(l_tax * 100), 6) AS read, round({trimmed_sql('greatest(l_quantity - l_tax * 100, 0.0)')}, 6) AS processing FROM lineitem GROUP BY l_linenumber"
_GHOST_SQL = "g AS (SELECT event_id, ts, CASE WHEN user_id % 5 = 0 THEN 'EMPRESA_FANTASMA_' ELSE 'E_' END || user_id AS entity, event_type || '|' || CAST(round(value, 0) AS BIGINT) AS text FROM events)"
_RULES_SQL = f"""{_GHOST_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY text) >= 50 AS dup, hour(ts) BETWEEN 0 AND 4 AS night, count(*) OVER (PARTITION BY entity) >= 3 AND contains(entity, 'EMPRESA_FANTASMA_') AS ghost FROM g)"""



def _names_sql(names: dict[str, str]) -> str:
    return f"CASE header {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END"


ORACLE_SQL = {
    "header_names": f"""WITH h AS (SELECT raw, trim(regexp_replace(upper(strip_accents(raw)), '[^A-Z0-9]+', '_', 'g'), '_') AS header FROM (SELECT unnest([{", ".join(f"'{x}'" for x in HEADERS)}]) AS raw))
        SELECT raw, header, {_names_sql(merge.PRESENTED_NAMES)} AS presented, {_names_sql(merge.RESOLVED_NAMES)} AS resolved FROM h""",
    "complaint_loader": f"""SELECT CAST(d.doc_id AS VARCHAR) AS materia, {trim_sql("lang")} AS tipo, CAST(1 - quality AS INTEGER) AS label,
        strftime(CASE WHEN d.doc_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S') AS stamp, length({trim_sql("' ' || text")}) AS characters
        FROM documents d JOIN labels USING (doc_id) LEFT JOIN events e ON e.event_id = d.doc_id""",
    "temporal_features": f"""SELECT event_id, round({_HOUR} / 23.0, 6) AS hour, round({_WEEK} / 6.0, 6) AS weekday, round(month(ts) / 12.0, 6) AS month, CASE WHEN {_WEEK} IN (0, 6) THEN 1e0 ELSE 0e0 END AS weekend,
        CASE WHEN {_WEEK} NOT IN (0, 6) AND {_HOUR} >= 8 AND {_HOUR} < 18 THEN 1e0 ELSE 0e0 END AS business, CASE WHEN {_HOUR} < 5 OR {_HOUR} >= 22 THEN 1e0 ELSE 0e0 END AS night,
        round(sin({TURN}{_HOUR} / 24.0), 6) + 0.0 AS hour_sin, round(cos({TURN}{_HOUR} / 24.0), 6) + 0.0 AS hour_cos, round(sin({TURN}{_WEEK} / 7.0), 6) + 0.0 AS weekday_sin, round(cos({TURN}{_WEEK} / 7.0), 6) + 0.0 AS weekday_cos FROM events""",
    "parse_timestamp": f"SELECT event_id, CASE event_id % 10 {_PRINT_SQL} END AS parsed FROM events",
    "parse_clock": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) WHEN 1 THEN hour(ts) * 3600 + minute(ts) * 60 WHEN 4 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS seconds,
        strftime(CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 4 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""",
    "temporal_split": """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
        SELECT event_id, rn, CASE WHEN rn <= n - least(greatest(CAST(floor(n * 0.2 + 0.5) AS BIGINT), 1), n - 1) THEN 'train' ELSE 'test' END AS part, CAST(floor((rn - 1) / 1024) AS BIGINT) AS batch FROM r""",
    "hashed_split": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42|' || doc_id), 1, 13) AS BIGINT), doc_id) AS rn, count(*) OVER () AS n FROM documents)
        SELECT doc_id, rn, CASE WHEN rn <= n - least(greatest(CAST(floor(n * 0.2 + 0.5) AS BIGINT), 1), n - 1) THEN 'train' ELSE 'test' END AS part FROM r""",
    "label_parse": "SELECT doc_id, CAST([1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1][doc_id % 12 + 1] AS INTEGER) AS parsed, CAST(toxic AS INTEGER) AS toxic_label FROM labels",
    "left_join_suffix": "SELECT c_custkey AS key, c_name AS name, c_acctbal AS amount_pres, o_orderkey AS order_id, o_totalprice AS amount_res FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "two_step_match": f"WITH {_MATCH_SQL} SELECT nro AS NRO_EXPEDIENTE, ori AS EXPEDIENTE_ORIGEN, CAST(y_pres AS INTEGER) AS año_pres, CAST(y_res AS INTEGER) AS año_res, f AS FORMA_CONCLUSION_res, src AS RES_MATCH_SOURCE FROM m",
    "two_step_match_legacy": f"WITH {_LEGACY_SQL} SELECT src AS RES_MATCH_SOURCE, count(*) AS n, count(f) AS filled FROM m GROUP BY src",
    "coverage_by_year": f"WITH {_MATCH_SQL} SELECT CAST(y_pres AS INTEGER) AS año_pres, count(*) AS presented, count(*) FILTER (WHERE src <> 'none') AS resolved, round(100.0 * count(*) FILTER (WHERE src <> 'none') / count(*), 6) AS percent FROM m GROUP BY y_pres",
    "dedup_keep_last": "WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 11 <> 0 THEN event_id % 6 END AS year FROM events) SELECT user_id, event_id, year FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY year DESC NULLS FIRST, event_id DESC) AS rn FROM e) WHERE rn = 1",
    "union_by_name": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier",
    "clean_entity": f"""WITH n AS (SELECT s_name AS raw FROM supplier UNION ALL SELECT p_name FROM part), a AS (SELECT raw || ' s.a. n° ' || length(raw) AS raw FROM n UNION ALL SELECT raw FROM n UNION ALL SELECT unnest([{", ".join(f"'{x}'" for x in ENTITIES)}]))
        SELECT raw, {entity_sql("raw")} AS entity FROM a""",
    "clean_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day FROM orders",
    "clean_years": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 AND year(o_orderdate) + 16 BETWEEN 2010 AND 2030 THEN CAST(year(o_orderdate) + 16 AS VARCHAR) ELSE '' END AS year FROM orders",
    "clean_conclusion": rf"""SELECT doc_id, {trim_sql(rf"regexp_replace({trim_sql("regexp_split_to_array(" + trim_sql("'>> ' || text") + r", '[\r\n]+')[1]")}, '^>+[\t\n\f\r ]*', '')")} AS conclusion,
        length(regexp_replace({trim_sql("text")}, '[\t\n\f\r ]{{2,}}', ' ', 'g')) AS squeezed FROM documents""",
    "extract_doc_number": f"SELECT event_id, {number_sql('props')} AS number, {number_sql('event_type')} AS kind FROM events",
    "validate_rows": f"""WITH d AS (SELECT {trim_sql("coalesce(text, '')")} AS t, CASE WHEN doc_id % 9 <> 0 THEN {trim_sql("coalesce(source, '')")} ELSE '' END AS e FROM documents)
        SELECT count(*) AS n_read, count(*) FILTER (WHERE t <> '' AND e <> '') AS kept, count(*) FILTER (WHERE e = '') AS skipped FROM d""",
    "confusion_metrics": """WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn FROM labels),
        r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS q FROM c)
        SELECT tp, tn, fp, fn, round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) ELSE 0.0 END, 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1, tp + fp AS alerts FROM r""",
    "trimmed_mean": f"SELECT user_id, round({trimmed_sql('value')}, 6) AS trimmed, round(coalesce(avg(value), 0.0), 6) AS mean FROM events GROUP BY user_id",
    "stage_means": _STAGE_SQL,
    "best_config": f"SELECT workers, processing FROM ({_STAGE_SQL}) ORDER BY processing, workers LIMIT 1",
    "unmatched_rows": f"WITH {_MATCH_SQL} SELECT nro AS NRO_EXPEDIENTE, ori AS EXPEDIENTE_ORIGEN, CAST(y_pres AS INTEGER) AS año_pres FROM m WHERE src = 'none'",
    "null_profile": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id IS NULL) AS a, count(*) FILTER (WHERE text IS NULL OR doc_id % 10 = 0) AS b, count(*) FILTER (WHERE lang IS NULL OR lang = 'es') AS l, count(*) FILTER (WHERE source IS NULL) AS s, count(*) FILTER (WHERE n_chars IS NULL) AS k FROM documents)
        SELECT column_name, nulls, round(100.0 * nulls / n, 6) AS percent FROM (SELECT n, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name, unnest([a, b, l, s, k]) AS nulls FROM c)""",
    "rule_duplicates": "SELECT doc_id, count(*) OVER (PARTITION BY text) >= 3 AS fires FROM documents",
    "rule_night": "SELECT event_id, hour(ts) BETWEEN 0 AND 4 AS fires FROM events",
    "rule_entity": f"WITH {_RULES_SQL} SELECT event_id, ghost AS r_ghost FROM c",
    "rule_alerts": f"WITH {_RULES_SQL} SELECT count(*) FILTER (WHERE dup) AS r_duplicate, count(*) FILTER (WHERE dup) AS r_bombing, count(*) FILTER (WHERE night) AS r_night, count(*) FILTER (WHERE ghost) AS r_ghost, count(*) FILTER (WHERE dup OR night OR ghost) AS alert, count(*) AS n FROM c",
    "entity_frequency": f"WITH {_GHOST_SQL} SELECT entity, count(*) AS n FROM g GROUP BY entity",
    "clean_records": """SELECT 'N' || o_orderkey AS NRO_EXPEDIENTE, '' AS EXPEDIENTE_ORIGEN_pres, 'a b ' || o_orderstatus AS TIPO_EXPEDIENTE_pres, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS FECHA_PRESENTACION_pres,
        'COMPANIA N' || o_custkey || ' SA' AS DENUNCIADOS_pres, CAST(o_custkey AS VARCHAR) AS DOC_DENUNCIADO, trim(o_orderpriority) AS MATERIA_pres, '2017' AS año_pres, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS FECHA_RESOLUCION,
        'r' AS NRO_RESOLUCION, trim(o_orderstatus) AS FORMA_CONCLUSION, '' AS año_res, CASE WHEN o_orderkey % 5 = 4 THEN 'none' ELSE 'nro' END AS RES_MATCH_SOURCE FROM orders WHERE o_orderkey % 13 <> 0""",
    "clean_report": """SELECT count(*) AS n_read, count(*) FILTER (WHERE o_orderkey % 13 = 0) AS skipped, count(*) FILTER (WHERE o_orderkey % 13 <> 0) AS kept, count(*) FILTER (WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 = 4) AS unmatched,
        round(100.0 * count(*) FILTER (WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 = 4) / count(*) FILTER (WHERE o_orderkey % 13 <> 0), 6) AS unmatched_percent, count(*) FILTER (WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 > 2) AS bad_days FROM orders""",
}
