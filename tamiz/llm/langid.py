"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the likelihood of the text under character
n-gram models, the language that the markup declares, the suffix of the address and the
host. How reliable declarations are, and what languages suffixes and hosts
publish, is learnt from the corpus itself: grouped sums of text-only posteriors, with
hosts smoothed towards their suffix and suffixes towards the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import id_in, id_out, materialise
from tamiz.llm.html import language_of, parse, visible

WORD = re.compile(r"[^\W\d_]+")
GRAMS = (1, 2, 3)
DIMENSION = 1 << 16
#: Documents that the model of each language label is fitted on, in hash order of their ids.
SAMPLE = 1500
#: Bounds of the words that are remembered, and of their values: one for each word and language.
CACHED_WORDS, CACHED_VALUES = 300_000, 16_000_000
#: Longer runs of letters are not remembered, and count as one word for every so many letters when evidence is tempered.
LONGEST_CACHED = 30
#: Words beyond so many add no certainty: n-grams of one text are not independent.
EFFECTIVE_WORDS = 40
#: Pseudo-counts: of n-grams, of declarations, and of the level above for suffixes and hosts.
GRAM_PRIOR, DECLARED_PRIOR, LEVEL_PRIOR = 0.05, 2.0, 5.0
#: The share of texts in no known language that is assumed, and the least posterior that is accepted.
UNKNOWN_SHARE, ACCEPT = 1e-4, 0.5
UNKNOWN = "und"


def word_grams(word: str) -> list[int]:
    """Hashed character n-grams of a lower-case word of any length with both ends marked."""
    w = f"^{word}$"
    return [crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % DIMENSION for n in GRAMS for i in range(len(w) - n + 1)]


def document_grams(text: str | None) -> np.ndarray:
    """The n-grams of a text's distinct words."""
    return np.array([g for w in set(WORD.findall((text or "").lower())) for g in word_grams(w)], np.int64)


@dataclass
class TextModel:
    """Languages in order, the last one UNKNOWN (every n-gram alike), and log probabilities of n-grams."""

    languages: list[str]
    logs: np.ndarray  # DIMENSION x languages, float32

    @staticmethod
    def fitted(texts: list[str | None], labels: list[str]) -> TextModel:
        names = sorted(set(labels))
        counts = np.zeros((DIMENSION, len(names)))
        for text, label in zip(texts, labels, strict=True):
            counts[:, names.index(label)] += np.bincount(document_grams(text), minlength=DIMENSION)
        return TextModel.counted(names, counts)

    @staticmethod
    def counted(names: list[str], counts: np.ndarray) -> TextModel:
        """From the n-gram counts of languages (a column for each)."""
        smooth = counts + GRAM_PRIOR
        logs = np.log(smooth / smooth.sum(axis=0))
        return TextModel([*names, UNKNOWN], np.column_stack([logs, np.full(DIMENSION, -np.log(DIMENSION))]).astype(np.float32))


class Scorer:
    """Log-likelihoods of whole texts; each distinct word is looked at about once."""

    def __init__(self, model: TextModel) -> None:
        self.model, self.places = model, {}
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def likelihood(self, word: str) -> np.ndarray:
        """Of a long word, in bounded pieces of its n-grams."""
        grams = word_grams(word)
        return sum(self.model.logs[grams[i : i + 4096]].sum(axis=0, dtype=np.float64) for i in range(0, len(grams), 4096))

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, int]:
        """Number of words, the sum of their log-likelihoods by language, and the words that they count as."""
        words = WORD.findall((text or "").lower())
        if not words:
            return 0, np.zeros(len(self.model.languages)), 0
        n, places = len(words), self.places
        long = [w for w in words if len(w) > LONGEST_CACHED]
        if long:
            words = [w for w in words if len(w) <= LONGEST_CACHED]
        if len(places) > min(CACHED_WORDS, CACHED_VALUES // len(self.model.languages)):
            places.clear()
        for w in set(words):
            if w not in places:
                k = places[w] = len(places)
                if k >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[k] = self.model.logs[word_grams(w)].sum(axis=0)
        total = self.table[np.fromiter(map(places.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        for w in long:
            total += self.likelihood(w)
        return n, total, len(words) + sum(-(-len(w) // LONGEST_CACHED) for w in long)


def language_sample(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and lang of at most ``sample`` documents of every label, the first in hash order.

    Labels are counted over all documents. A hash threshold by that count leaves about
    twice the sample of a frequent label, so that no task ranks all of its documents.
    """
    ids = materialise(labelled.select("doc_id", "lang"), "labels")
    counts = F.broadcast(materialise(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")), "label-counts"))  # a row for each label
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = ids.join(counts, "lang").where(place * F.col("_n") < F.lit(2 * (sample + 50) << 30)).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    return near.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample).select("doc_id", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Text models of all language labels, each from a bounded sample of its documents.

    However rare, every label gets a model. N-grams are counted where the texts are and the counts summed; a task
    holds the ``DIMENSION`` counts of one language, and they come back: the model grows with the number of languages only.
    Of rows that repeat an id and a label one takes part, the one whose text has the least hash.
    """
    labelled = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lower("lang").alias("lang"))
    ids = materialise(language_sample(labelled, sample), "sample")
    ids = F.broadcast(ids) if ids.count() <= 1_000_000 else ids
    rows = labelled.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                grams, n = np.unique(np.concatenate([document_grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    def logs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((DIMENSION, 1))
        found = pdf[pdf["gram"] >= 0]
        counts[found["gram"].to_numpy(), 0] = found["n"]
        return pd.DataFrame({"lang": [key[0]], "logs": [TextModel.counted([key[0]], counts).logs[:, 0].tobytes()]})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    every = ids.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("gram"), F.lit(0).cast("long").alias("n"))  # a label whose texts have no letters has a model too
    found = sorted(counts.unionByName(every).groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(logs, "lang string, logs binary").collect())
    return TextModel([*[r["lang"] for r in found], UNKNOWN], np.column_stack([*[np.frombuffer(r["logs"], np.float32) for r in found], np.full(DIMENSION, -np.log(DIMENSION), np.float32)]))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as records: kind, id, raw, declared (read from the markup later), host, suffix (after its last dot)."""
    host = host_of(pages["url"].cast("string"))
    return pages.select(F.lit("page").alias("kind"), id_in(pages["page_id"]).alias("id"), pages["html"].cast("string").alias("raw"), F.lit("").alias("declared"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix"))


def document_records(docs: DataFrame) -> DataFrame:
    """Documents as records: the language column is what they declare, the source is their host; they have no address."""
    declared, source = F.lower(F.trim(F.coalesce(docs["lang"].cast("string"), F.lit("")))), F.coalesce(docs["source"].cast("string"), F.lit(""))
    return docs.select(F.lit("document").alias("kind"), id_in(docs["doc_id"]).alias("id"), docs["text"].cast("string").alias("raw"), declared.alias("declared"), F.concat(F.lit("source:"), source).alias("host"), F.lit("").alias("suffix"))


def text_evidence(records: DataFrame, model: TextModel, *extra: str) -> DataFrame:
    """Records without their text: words, and tempered log-likelihoods by language (the last: unknown)."""
    others = [(f.name, f.dataType.simpleString()) for f in records.schema if f.name in extra]
    schema = "kind string, id long, declared string, host string, suffix string, words long, likelihood array<double>" + "".join(f", `{n}` {t}" for n, t in others)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(model)
        for pdf in frames:
            declared, found = [], []
            for x, kind, said in zip(pdf.pop("raw"), pdf["kind"], pdf["declared"], strict=True):
                if kind == "page":
                    tree = parse(x or "")
                    x, said = visible(tree), language_of(tree)
                declared.append(said)
                found.append(score(x))
            tempered = [ll * min(1.0, EFFECTIVE_WORDS / max(units, 1)) for _, ll, units in found]
            yield pdf.assign(declared=declared, words=[n for n, *_ in found], likelihood=[t - t.max() for t in tempered])

    return records.mapInPandas(batches, schema)


def _normal(df: DataFrame, logs: str, name: str) -> DataFrame:
    """Add ``name``: probabilities from the unnormalised logs in an array column.

    Arrays and one step per column keep the plan small, however many languages there are.
    """
    powers = df.withColumn("_pow", F.transform(logs, lambda x: F.exp(F.greatest(x - F.array_max(logs), F.lit(-700.0)))))
    total = F.aggregate("_pow", F.lit(0.0), lambda a, x: a + x)
    return powers.withColumn("_sum", total).withColumn(name, F.transform("_pow", lambda x: x / F.col("_sum"))).drop("_pow", "_sum")


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Evidence with lang, probability and text_lang.

    Text-only posteriors are summed by declaration, suffix and host within each kind; a
    record's own share is taken off again before its host speaks for it. Records of
    hosts and suffixes are joined with those sums, rows of a frequent host in splits.
    """
    k = range(len(languages))
    unknown = languages.index(UNKNOWN)
    start = F.array(*[F.lit(float(np.log(UNKNOWN_SHARE if i == unknown else (1 - UNKNOWN_SHARE) / max(1, len(languages) - 1)))) for i in k])
    begun = evidence.withColumn("_start", F.zip_with("likelihood", start, lambda x, y: x + y))
    base = _normal(begun, "_start", "_t").drop("_start")

    def sums(keys: list[str], mark: str) -> DataFrame:
        total = F.array(*[F.sum(F.get("_t", F.lit(i))) for i in k])
        return materialise(base.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{mark}"), total.alias(f"_{mark}")), f"languages-{mark}")

    joined = base.join(F.broadcast(sums(["kind"], "g")), "kind").join(sums(["kind", "suffix"], "s"), ["kind", "suffix"]).join(sums(["kind", "declared"], "d"), ["kind", "declared"]).join(sums(["kind", "host"], "h"), ["kind", "host"])

    def score(i: Column) -> Column:
        own = F.get("_t", i)
        top = (F.get("_g", i) + UNKNOWN_SHARE) / (F.col("_ng") + UNKNOWN_SHARE * len(languages))
        middle = (F.get("_s", i) - own + LEVEL_PRIOR * top) / (F.col("_ns") - 1 + LEVEL_PRIOR)
        prior = (F.greatest(F.get("_h", i) - own, F.lit(0.0)) + LEVEL_PRIOR * F.greatest(middle, F.lit(1e-9))) / (F.col("_nh") - 1 + LEVEL_PRIOR)
        rate = (F.greatest(F.get("_d", i) - own, F.lit(0.0)) + DECLARED_PRIOR * F.col("_nd") / F.col("_ng")) / (F.get("_g", i) + DECLARED_PRIOR)
        said = F.when(F.col("declared") == "", 0.0).otherwise(F.log(F.greatest(rate, F.lit(1e-12))))
        return F.get("likelihood", i) + F.log(F.greatest(prior, F.lit(1e-12))) + said

    scored = joined.withColumn("_score", F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), score))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    final = _normal(scored, "_score", "_p")
    return final.select(*evidence.columns, best("_p").alias("lang"), F.array_max("_p").alias("probability"), best("_t").alias("text_lang"))


def identify(records: DataFrame, model: TextModel, accept: float = ACCEPT) -> DataFrame:
    """kind, id, declared, host, words, lang, probability, text_lang, accepted: one row per record.

    Null and empty texts, and those without letters, have no words: they are UNKNOWN with
    probability 1 and not accepted. Accepted are known languages of at least ``accept``.
    Ties between languages go to the earlier name. Repeated records are judged alike.
    """
    fused = fuse(materialise(text_evidence(records, model), "evidence"), model.languages)
    none = F.col("words") == 0
    lang = F.when(none, UNKNOWN).otherwise(F.col("lang"))
    return fused.select(
        "kind", id_out(F.col("id")).alias("id"), "declared", "host", "words", lang.alias("lang"), F.when(none, 1.0).otherwise(F.col("probability")).alias("probability"), F.when(none, UNKNOWN).otherwise(F.col("text_lang")).alias("text_lang"), (~none & (F.col("lang") != UNKNOWN) & (F.col("probability") >= accept)).alias("accepted")
    )


def keep_identified(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted."""
    model = fit(docs)
    records = document_records(docs).withColumn("text_hash", F.xxhash64("raw"))
    fused = fuse(materialise(text_evidence(records, model, "text_hash"), "evidence"), model.languages)
    refused = fused.where((F.col("words") == 0) | (F.col("lang") == UNKNOWN) | (F.col("probability") < accept))
    refused = materialise(refused.select(id_out(F.col("id")).alias("_id"), "declared", "host", "text_hash").distinct(), "refused")
    own = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_own"), F.xxhash64(docs["text"].cast("string")).alias("_hash"))
    small = refused if refused.count() > 200_000 else F.broadcast(refused)
    return own.join(small, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left_anti").select("_row.*")
