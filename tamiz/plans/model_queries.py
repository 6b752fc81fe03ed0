"""Queries over the classifier and the generator; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import logreg, metrics, synth
from tamiz.operators.features import Assembler, tfidf
from tamiz.operators.vocab import fit_vocabulary
from tamiz.plans import complaint_model as M
from tamiz.plans.text_queries import TOKENS_CTE, category_sql
from tamiz.sources.tables import table

EPOCHS, RATE, DECAY = 3, 0.5, 0.001


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as complaints: junk is spam, the event of the same number gives the time."""
    docs, labels, events = (table(spark, d, t) for t in ("documents", "labels", "events"))
    rows = docs.join(labels.select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id").join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("row_id"), "text", "label", "ts", F.col("source").alias("materia"), F.col("lang").alias("tipo"))


def _descended(spark: SparkSession, d: str, epochs: int) -> tuple[DataFrame, DataFrame, logreg.Linear]:
    """All labelled documents, their TF-IDF features, and weights after ``epochs`` full-batch steps. Tokens are made once and kept."""
    rows = labelled(spark, d).repartition("row_id").withColumn("tokens", T.tokens(F.col("text"), True)).select("row_id", "label", "tokens").cache()
    features = tfidf(rows, fit_vocabulary(rows))
    return rows, features, logreg.descend(rows, features, logreg.TrainConfig(epochs, RATE, DECAY, 0))


def _settled(result: DataFrame, *kept: DataFrame) -> DataFrame:
    """A result of a few rows, worked out before what it needs is given back."""
    rows = result.collect()
    for k in kept:
        k.unpersist()
    return result.sparkSession.createDataFrame(rows, result.schema)


def _weights(spark: SparkSession, d: str, epochs: int) -> DataFrame:
    rows, _, model = _descended(spark, d, epochs)
    frame = model.frame(rows).where("idx >= 0")
    rows.unpersist()
    return frame.union(spark.createDataFrame([(-1, model.bias)], "idx long, weight double")).select("idx", (F.round("weight", 6) + 0.0).alias("weight"))


def gd_one_step(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, 1)


def gd_k_epochs(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, EPOCHS)


def predict_evaluate(spark: SparkSession, d: str) -> DataFrame:
    rows, features, model = _descended(spark, d, EPOCHS)
    scored = logreg.predict(rows.select("row_id", "label"), features, model, 0.15)
    return _settled(metrics.confusion(scored, F.col("label"), F.col("prediction")), rows)


def _evaluated(spark: SparkSession, d: str, config: M.RunConfig) -> DataFrame:
    run = M.run_once(labelled(spark, d), config)
    result = _settled(M.evaluate(run))
    run.release()
    return result


def sgd_exact_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, M.RunConfig(batch=64, rate=0.5, threshold=0.3))


def mllib_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.evaluate(M.run_once(labelled(spark, d), M.RunConfig(trainer="library")))


#: Epochs and threshold of the whole run over a batch of all rows.
RUN_EPOCHS, RUN_THRESHOLD, ALL_ROWS = 10, 0.2, 1 << 62


def train_evaluate(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d, M.RunConfig(epochs=RUN_EPOCHS, rate=RATE, decay=DECAY, threshold=RUN_THRESHOLD, trainer="gd", batch=ALL_ROWS))


ANCHOR, SEED = "2026-01-01", 42
#: Complaints that the query draws: as many as the reference, and more where the source is so large that each record would be drawn less than so often.
DRAWS, DRAWS_PER_RECORD = 1_000_000, 5


def _source(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the cleaned records that the generator draws from, by position; some lack an entity or a day."""
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") - F.lit(o.agg(F.min("o_orderkey")).first()[0])).alias("position"), F.when(F.pmod("o_orderkey", F.lit(30)) != 0, F.concat(F.lit("Cliente "), F.col("o_custkey").cast("string"))).otherwise("").alias("entity"), F.col("o_orderpriority").alias("matter"),
        F.when(F.pmod("o_orderkey", F.lit(20)) != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("?").alias("day"),
    )


def synth_complaints(spark: SparkSession, d: str) -> DataFrame:
    draws = max(DRAWS, DRAWS_PER_RECORD * table(spark, d, "orders").count())
    made = synth.synthesise(_source(spark, d), draws, ANCHOR, SEED)
    return made.select("n", "entity", "matter", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "text", F.col("spam").cast("long").alias("spam"), F.array_join("tags", ";").alias("tags"), F.round("score", 6).alias("score"))


def synthetic_export(spark: SparkSession, d: str) -> DataFrame:
    """Whole synthetic rows as they are written, one draw for each source record on average."""
    o = _source(spark, d)
    records = o.select("position", F.concat(F.lit("N"), F.col("position").cast("string")).alias("NRO_EXPEDIENTE"), F.col("matter").alias(synth.MATTER), F.col("day").alias(synth.DAY), F.col("entity").alias(synth.ENTITY), F.lit("none").alias("RES_MATCH_SOURCE"))
    return synth.synthetic_rows(records, o.count(), ANCHOR, SEED)


def assembled_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of all labelled documents in the layout that the train part fits: words, time, two categories."""
    config = M.RunConfig()
    rows, _ = M.prepare(labelled(spark, d), config)
    rows = rows.cache()
    made = Assembler.fit(rows.where("part = 'train'"), config.max_features, config.min_df)
    pairs = made.vectors(rows, "part").select("row_id", "part", F.posexplode("features").alias("place", "f"))
    return pairs.select("row_id", "part", F.col("place").cast("long").alias("place"), "f.idx", (F.round("f.value", 6) + 0.0).alias("value"))


QUERIES = {f.__name__: f for f in (assembled_features, synthetic_export, gd_one_step, gd_k_epochs, predict_evaluate, sgd_exact_metrics, mllib_metrics, train_evaluate, synth_complaints)}

# Labelled documents, their vocabulary, and features in long form.
_FEATURES = f"""WITH {TOKENS_CTE}, rows AS (SELECT doc_id, 1 - quality AS label, t FROM toks JOIN labels USING (doc_id)), size AS (SELECT count(*) AS n FROM rows),
    freq AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM rows) GROUP BY token HAVING count(*) >= 2),
    vocabulary AS (SELECT idx, token, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT row_number() OVER (ORDER BY df DESC, token) - 1 AS idx, token, df FROM freq), size WHERE idx < 5000),
    x AS MATERIALIZED (SELECT doc_id, idx, count(*) / CAST(k AS DOUBLE) * idf AS value FROM (SELECT doc_id, len(t) AS k, unnest(t) AS token FROM rows) JOIN vocabulary USING (token) GROUP BY doc_id, idx, k, idf),
    w0 AS (SELECT DISTINCT idx, CAST(0 AS DOUBLE) AS weight FROM x), b0 AS (SELECT CAST(0 AS DOUBLE) AS bias)"""


def _step_sql(k: int, x: str = "x") -> str:
    """One epoch over the features ``x``: errors, then weights and bias."""
    score = f"""z{k} AS (SELECT doc_id, label, coalesce(sum(value * weight), 0) + any_value(bias) AS z FROM rows LEFT JOIN {x} USING (doc_id) LEFT JOIN w{k - 1} USING (idx), b{k - 1} GROUP BY doc_id, label),
    e{k} AS MATERIALIZED (SELECT doc_id, 1 / (1 + exp(-z)) - label AS error FROM z{k})"""
    weights = f"w{k} AS MATERIALIZED (SELECT idx, any_value(weight) - {RATE} * (sum(error * value) / any_value(n) + {DECAY} * any_value(weight)) AS weight FROM {x} JOIN e{k} USING (doc_id) JOIN w{k - 1} USING (idx), size GROUP BY idx)"
    return f", {score}, {weights}, b{k} AS MATERIALIZED (SELECT any_value(bias) - {RATE} * sum(error) / any_value(n) AS bias FROM e{k}, b{k - 1}, size)"


def _weights_sql(epochs: int) -> str:
    return f"{_FEATURES}{''.join(_step_sql(k + 1) for k in range(epochs))} SELECT idx, round(weight, 6) + 0.0 AS weight FROM w{epochs} UNION ALL SELECT -1, round(bias, 6) + 0.0 FROM b{epochs}"


def _list_sql(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _draw_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|{name}|' || n), 1, 8) AS BIGINT)"


def _hour_sql() -> str:
    total, out = 0, []
    for hour, weight in enumerate(synth.HOUR_WEIGHTS):
        total += weight
        out.append(f"WHEN {_draw_sql('hour')} % {sum(synth.HOUR_WEIGHTS)} < {total} THEN {hour}")
    return f"CASE {' '.join(out)} END"


def _pick_sql(options: tuple, name: str) -> str:
    return f"{_list_sql(options)}[{_draw_sql(name)} % {len(options)} + 1]"


def _turn_sql(k: int) -> str:
    """Round ``k`` of the anomalies over what the round before left."""
    hit = lambda a: f"strikes > {k} AND {_draw_sql(f'anomaly-{k}')} % 4 = {a}"
    fake = " || ' ' || ".join(_pick_sql(o, f"fake-{p}-{k}") for p, o in (("prefix", synth.PREFIXES), ("core", synth.CORES), ("suffix", synth.SUFFIXES)))
    variant = f"CASE {_draw_sql(f'variant-{k}')} % 4 WHEN 0 THEN upper(text) WHEN 1 THEN lower(text) WHEN 2 THEN text || ' urgente' ELSE replace(text, 'Solicito', 'Requiero') END"
    return f"""s{k + 1} AS (SELECT * REPLACE (CASE WHEN {hit(0)} THEN ts + to_seconds(second(ts) % 20) WHEN {hit(1)} THEN date_trunc('day', ts) + to_seconds(7800) ELSE ts END AS ts,
        CASE WHEN {hit(2)} THEN {fake} ELSE entity END AS entity, CASE WHEN {hit(3)} THEN {variant} ELSE text END AS text) FROM s{k})"""


_SHARE = lambda share: int(share * synth.RESOLUTION)
_TAGS = ", ".join(f"CASE WHEN strikes > {k} THEN {_list_sql(synth.TAGS)}[{_draw_sql(f'anomaly-{k}')} % 4 + 1] END" for k in range(synth.MOST_ANOMALIES))
_DRAWN = f"greatest({DRAWS}, {DRAWS_PER_RECORD} * (SELECT count(*) FROM orders))"
_SYNTH = f"""WITH o AS (SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS position, CASE WHEN o_orderkey % 30 <> 0 THEN 'Cliente ' || o_custkey ELSE '' END AS entity, o_orderpriority AS matter,
        CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
    drawn AS (SELECT n, {_draw_sql("sample")} % (SELECT count(*) FROM orders) AS position FROM (SELECT unnest(range({_DRAWN})) AS n)),
    t AS (SELECT n, position, day, entity, matter, CAST(coalesce(day, DATE '{ANCHOR}' - CAST({_draw_sql("back")} % 365 AS INTEGER)) AS TIMESTAMP) + to_seconds({_hour_sql()} * 3600 + {_draw_sql("minute")} % 60 * 60 + {_draw_sql("second")} % 60) AS ts,
        {_pick_sql(synth.OPENINGS, "opening")} || ' contra ' || CASE WHEN trim(entity) = '' THEN '{synth.NO_ENTITY}' ELSE trim(entity) END || ' por problemas relacionados con ' || trim(matter) || '. ' || {_pick_sql(synth.REQUESTS, "request")} AS text,
        CASE WHEN {_draw_sql("spam")} < {_SHARE(synth.ANOMALY_SHARE)} THEN {_draw_sql("strikes")} % 3 + 1 ELSE 0 END AS strikes FROM drawn JOIN o USING (position)),
    p AS (SELECT * REPLACE (CASE WHEN {_draw_sql("plain")} < {_SHARE(synth.PLAIN_WORD_SHARE)} THEN replace(text, 'ción', 'cion') ELSE text END AS text) FROM t),
    q AS (SELECT * REPLACE (CASE WHEN {_draw_sql("shout")} < {_SHARE(synth.SHOUT_SHARE)} THEN text || '!!' ELSE text END AS text) FROM p),
    s0 AS (SELECT * REPLACE (CASE WHEN {_draw_sql("capitals")} < {_SHARE(synth.CAPITALS_SHARE)} THEN upper(text) ELSE text END AS text) FROM q),
    {", ".join(_turn_sql(k) for k in range(synth.MOST_ANOMALIES))}
    SELECT n, entity, matter, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, text, CAST(strikes > 0 AS BIGINT) AS spam, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL), ';') AS tags,
        round({_draw_sql("score")} / {float(synth.RESOLUTION)} * 0.3 + CASE WHEN strikes > 0 THEN 0.7 ELSE 0 END, 6) AS score FROM s{synth.MOST_ANOMALIES} WHERE trim(text) <> '' AND trim(entity) <> ''"""

# The same draws, one for each record, as they are written.
_EXPORT = _SYNTH.rpartition("SELECT n, entity, matter,")[0].replace(_DRAWN, "(SELECT count(*) FROM orders)") + f"""SELECT 'N' || position AS NRO_EXPEDIENTE, matter AS MATERIA_pres, coalesce(strftime(day, '%Y-%m-%d'), '?') AS FECHA_PRESENTACION_pres, entity AS DENUNCIADOS_pres, 'none' AS RES_MATCH_SOURCE,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP, text AS DETALLE_QUEJA, CASE WHEN strikes > 0 THEN '1' ELSE '0' END AS ES_SPAM, array_to_string(list_filter([{_TAGS}], lambda x: x IS NOT NULL), ';') AS SPAM_TAGS,
        printf('%.2f', {_draw_sql("score")} / {float(synth.RESOLUTION)} * 0.3 + CASE WHEN strikes > 0 THEN 0.7 ELSE 0 END) AS SPAM_SCORE FROM s{synth.MOST_ANOMALIES} WHERE trim(text) <> '' AND trim(entity) <> ''"""

_CONFUSION = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND guess) AS tp, count(*) FILTER (WHERE label = 0 AND NOT guess) AS tn, count(*) FILTER (WHERE label = 0 AND guess) AS fp, count(*) FILTER (WHERE label = 1 AND NOT guess) AS fn FROM s),
    r AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS q FROM c)
    SELECT tp, tn, fp, fn, round(coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0), 6) AS accuracy, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, tp + fp AS alerts FROM r"""
_GUESS = f"""{_FEATURES}{"".join(_step_sql(k + 1) for k in range(EPOCHS))}, s AS (SELECT label, 1 / (1 + exp(-(coalesce(sum(value * weight), 0) + any_value(bias)))) >= 0.15 AS guess FROM rows LEFT JOIN x USING (doc_id) LEFT JOIN w{EPOCHS} USING (idx), b{EPOCHS} GROUP BY doc_id, label),
    {_CONFUSION}"""

# The whole run: split by time (or by hash, where a time is missing), features fitted on the train part, all epochs, metrics of the test part.
_TIMES = "hour(ts) / 23.0, dayofweek(ts) / 6.0, month(ts) / 12.0, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END, CASE WHEN dayofweek(ts) NOT IN (0, 6) AND hour(ts) >= 8 AND hour(ts) < 18 THEN 1.0 ELSE 0.0 END, CASE WHEN hour(ts) < 5 OR hour(ts) >= 22 THEN 1.0 ELSE 0.0 END, " + ", ".join(
    f"{f}(6.283185307179586 * {x})" for x in ("hour(ts) / 24.0", "dayofweek(ts) / 7.0") for f in ("sin", "cos")
)


def _levels_sql(name: str) -> str:
    return f"{name}_levels AS (SELECT value, level FROM (SELECT {name} AS value, row_number() OVER (ORDER BY count(*) DESC, {name}) AS level FROM train WHERE {name} <> '' GROUP BY {name}) WHERE level <= 100)"


_RUN = f"""WITH {TOKENS_CTE},
    labelled AS (SELECT doc_id, t, 1 - quality AS label, e.ts, {category_sql("source")} AS materia, {category_sql("lang")} AS tipo FROM toks JOIN labels USING (doc_id) LEFT JOIN events e ON e.event_id = doc_id),
    ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FILTER (WHERE ts IS NULL) FROM labelled) = 0 THEN epoch_us(ts) ELSE CAST('0x' || substr(md5('42|' || doc_id), 1, 13) AS BIGINT) END, doc_id) AS rn, count(*) OVER () AS total FROM labelled),
    parts AS (SELECT *, rn <= total - least(greatest(CAST(floor(total * 0.2 + 0.5) AS BIGINT), 1), total - 1) AS learns FROM ordered), train AS (SELECT * FROM parts WHERE learns), size AS (SELECT count(*) AS n FROM train),
    freq AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM train) GROUP BY token HAVING count(*) >= 2),
    vocabulary AS (SELECT token, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (SELECT row_number() OVER (ORDER BY df DESC, token) AS k, token, df FROM freq), size WHERE k <= 5000),
    {_levels_sql("materia")}, {_levels_sql("tipo")},
    x AS MATERIALIZED (SELECT doc_id, learns, 'w ' || token AS idx, count(*) / CAST(k AS DOUBLE) * idf AS value FROM (SELECT doc_id, learns, len(t) AS k, unnest(t) AS token FROM parts) JOIN vocabulary USING (token) GROUP BY doc_id, learns, token, k, idf
        UNION ALL SELECT doc_id, learns, 't ' || i, v FROM (SELECT doc_id, learns, unnest(range(10)) AS i, CAST(unnest([{_TIMES}]) AS DOUBLE) AS v FROM parts WHERE ts IS NOT NULL) WHERE v <> 0
        UNION ALL SELECT doc_id, learns, 'm ' || materia, 1.0 FROM parts JOIN materia_levels ON value = materia UNION ALL SELECT doc_id, learns, 'k ' || tipo, 1.0 FROM parts JOIN tipo_levels ON value = tipo),
    rows AS (SELECT doc_id, label FROM train), w0 AS (SELECT DISTINCT idx, CAST(0 AS DOUBLE) AS weight FROM x WHERE learns), b0 AS (SELECT CAST(0 AS DOUBLE) AS bias)"""

# The same features by number: words by frequency, ten of time, then the levels of both categories.
_ASSEMBLED = f"""{_RUN}, sizes AS (SELECT (SELECT count(*) FROM vocabulary) AS v, (SELECT count(*) FROM materia_levels) AS m),
    numbers AS (SELECT 'w ' || token AS idx, row_number() OVER (ORDER BY df DESC, token) - 1 AS k FROM vocabulary
        UNION ALL SELECT 't ' || i, v + i FROM (SELECT unnest(range(10)) AS i, v FROM sizes)
        UNION ALL SELECT 'm ' || value, v + 10 + level - 1 FROM materia_levels, sizes UNION ALL SELECT 'k ' || value, v + 10 + m + level - 1 FROM tipo_levels, sizes)
    SELECT doc_id AS row_id, CASE WHEN learns THEN 'train' ELSE 'test' END AS part, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, CAST(k AS BIGINT) AS idx, round(value, 6) + 0.0 AS value FROM x JOIN numbers USING (idx)"""

_EVALUATED = f"""{_RUN}{"".join(_step_sql(k + 1, "(SELECT * FROM x WHERE learns)") for k in range(RUN_EPOCHS))},
    s AS (SELECT label, 1 / (1 + exp(-(coalesce(sum(value * weight), 0) + any_value(bias)))) >= {RUN_THRESHOLD} AS guess FROM parts LEFT JOIN x USING (doc_id) LEFT JOIN w{RUN_EPOCHS} USING (idx), b{RUN_EPOCHS} WHERE NOT parts.learns GROUP BY doc_id, label),
    {_CONFUSION}"""

ORACLE_SQL = {"assembled_features": _ASSEMBLED, "synthetic_export": _EXPORT, "gd_one_step": _weights_sql(1), "gd_k_epochs": _weights_sql(EPOCHS), "predict_evaluate": _GUESS, "train_evaluate": _EVALUATED, "synth_complaints": _SYNTH}
