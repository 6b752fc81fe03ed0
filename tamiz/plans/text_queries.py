"""Queries over texts: normalisation, tokens, vocabulary, TF-IDF, categories; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import text as T
from tamiz.operators import features, vocab
from tamiz.sources.tables import table

SPACE_SQL = r"[\t\n\x0B\f\r \x{85}\p{Z}]"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(translate({c}, '{T.ACCENTED}', '{T.PLAIN}')), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split({norm_sql(c)}, ' '), lambda x: x <> '')"


def category_sql(c: str) -> str:
    trimmed = f"regexp_replace(coalesce({c}, ''), '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"
    return f"regexp_replace(translate(lower({trimmed}), '{T.ACCENTED}', '{T.PLAIN}'), '{SPACE_SQL}+', ' ', 'g')"


#: Documents with their tokens, words first and pairs of neighbours after.
TOKENS_CTE = f"""
    words AS (SELECT doc_id, lang, source, {tokens_sql("coalesce(text, '')")} AS w FROM documents),
    toks AS (SELECT doc_id, lang, source, CASE WHEN len(w) < 2 THEN w ELSE list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) END AS t FROM words)
"""


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


def _tokens(spark: SparkSession, d: str, bigrams: bool) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text"), bigrams).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def tokenize_unigram(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, False)


def tokenize_bigram(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d, True)


def tokenised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text"), True).alias("tokens"))


def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return vocab.document_frequency(tokenised(spark, d))


def vocabulary_idf(spark: SparkSession, d: str) -> DataFrame:
    return vocab.fit_vocabulary(tokenised(spark, d)).withColumn("idf", F.round("idf", 6))


def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = tokenised(spark, d)
    return features.tfidf(docs, vocab.fit_vocabulary(docs), "doc_id").withColumn("value", F.round("value", 6))


def category_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *[T.category(F.col(c)).alias(c) for c in ("p_name", "p_brand", "p_type")])


def category_encoder(spark: SparkSession, d: str) -> DataFrame:
    docs, part = table(spark, d, "documents"), table(spark, d, "part")
    parts = [vocab.fit_category(docs, T.category(F.col(c)), c) for c in ("lang", "source")] + [vocab.fit_category(part, T.category(F.col("p_type")), "p_type")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def category_onehot(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lang, source = (vocab.fit_category(docs, T.category(F.col(c)), c) for c in ("lang", "source"))
    first = features.one_hot(docs, lang, T.category(F.col("lang")), 0, "doc_id")
    return first.unionByName(features.one_hot(docs, source, T.category(F.col("source")), vocab.MAX_LEVELS, "doc_id"))


QUERIES = {f.__name__: f for f in (text_normalize, tokenize_unigram, tokenize_bigram, document_frequency, vocabulary_idf, tfidf_vectors, category_normalize, category_encoder, category_onehot)}

DF_CTE = f"{TOKENS_CTE}, freq AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM toks) GROUP BY token HAVING count(*) >= 2)"
VOCAB_CTE = f"{DF_CTE}, top AS (SELECT row_number() OVER (ORDER BY df DESC, token) - 1 AS idx, token, df FROM freq), vocabulary AS (SELECT idx, token, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM top WHERE idx < 5000)"


def _encoder_sql(field: str, table_name: str) -> str:
    return f"""SELECT field, value, count, idx FROM (SELECT '{field}' AS field, value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, value) - 1 AS idx
        FROM (SELECT {category_sql(field)} AS value FROM {table_name}) WHERE value <> '' GROUP BY value) WHERE idx < 100"""


ORACLE_SQL = {
    "text_normalize": f"SELECT doc_id, {norm_sql('text')} AS normalized FROM documents",
    "tokenize_unigram": f"WITH {TOKENS_CTE} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM words",
    "tokenize_bigram": f"WITH {TOKENS_CTE} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks",
    "document_frequency": f"WITH {DF_CTE} SELECT token, df FROM freq",
    "vocabulary_idf": f"WITH {VOCAB_CTE} SELECT idx, token, df, round(idf, 6) AS idf FROM vocabulary",
    "tfidf_vectors": f"""WITH {VOCAB_CTE}, flat AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM toks)
        SELECT doc_id, idx, round(count(*) / CAST(n AS DOUBLE) * idf, 6) AS value FROM flat JOIN vocabulary USING (token) GROUP BY doc_id, idx, n, idf""",
    "category_normalize": f"SELECT p_partkey, {category_sql('p_name')} AS p_name, {category_sql('p_brand')} AS p_brand, {category_sql('p_type')} AS p_type FROM part",
    "category_encoder": " UNION ALL ".join(_encoder_sql(*x) for x in (("lang", "documents"), ("source", "documents"), ("p_type", "part"))),
    "category_onehot": f"""WITH l AS ({_encoder_sql("lang", "documents")}), s AS ({_encoder_sql("source", "documents")})
        SELECT doc_id, idx, CAST(1 AS DOUBLE) AS value FROM documents JOIN l ON l.value = {category_sql("lang")}
        UNION ALL SELECT doc_id, idx + 100, CAST(1 AS DOUBLE) FROM documents JOIN s ON s.value = {category_sql("source")}""",
}
