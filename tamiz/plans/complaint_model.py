"""The whole classifier run: records, split, features, training, evaluation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions.text import tokens
from tamiz.operators import logreg, metrics, ranking
from tamiz.operators.features import Assembler


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; values that make no sense fall back to these defaults."""

    epochs: int = 10
    rate: float = 0.05
    decay: float = 0.001
    batch: int = 1024
    max_features: int = 5000
    min_df: int = 2
    threshold: float = 0.5
    ratio: float = 0.2
    seed: int = 42
    bigrams: bool = True
    trainer: str = "exact"  # exact (ordered mini-batches, blocks in turn), gd (a batch of all rows) or library
    runs: int = 1

    def normalised(self) -> RunConfig:
        plain, checked = RunConfig(), {}
        for name in ("epochs", "rate", "batch", "max_features", "min_df", "threshold", "runs"):
            value = getattr(self, name)
            checked[name] = value if value > 0 else getattr(plain, name)
        ratio = self.ratio if 0 < self.ratio < 1 else plain.ratio
        return RunConfig(**checked, ratio=ratio, decay=self.decay, seed=self.seed, bigrams=self.bigrams, trainer=self.trainer)

    def training(self) -> logreg.TrainConfig:
        return logreg.TrainConfig(self.epochs, self.rate, self.decay, self.batch, self.threshold)


@dataclass
class Run:
    """What a run leaves: the model, the assembler, the scored test rows, and seconds by stage."""

    model: logreg.Linear
    assembler: Assembler
    scored: DataFrame
    method: str
    seconds: dict[str, float] = field(default_factory=dict)
    rows: DataFrame | None = None

    def release(self) -> None:
        """Give back what the run cached; its scored rows are worked out anew after that."""
        self.assembler.release()
        if self.rows is not None:
            self.rows.unpersist()


def prepare(records: DataFrame, config: RunConfig) -> tuple[DataFrame, str]:
    """Records (row_id, text, label, ts, materia, tipo; row_id unique) with tokens, rank and part, dealt by row_id.

    Ranks are made from the narrow columns; texts move once, and what is worked out per row later finds them in place.
    """
    ranks, method = ranking.split_records(records.select("row_id", "ts"), "ts", "row_id", config.ratio, config.seed)
    dealt = records.repartition("row_id").join(ranks.drop("ts"), "row_id")
    return dealt.withColumn("tokens", tokens(F.col("text"), config.bigrams)).drop("text"), method


def run_once(records: DataFrame, config: RunConfig | None = None) -> Run:
    """Fit on the train part, score the test part. Stages are lazy: seconds are those of the actions they end in."""
    config = (config or RunConfig()).normalised()
    seconds, began = {}, time.perf_counter()

    def lap(stage: str) -> None:
        nonlocal began
        now = time.perf_counter()
        seconds[stage], began = now - began, now

    rows, method = prepare(records, config)
    rows = rows.cache()
    rows.count()
    lap("preprocess")
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    assembler = Assembler.fit(train, config.max_features, config.min_df)
    lap("vocabulary")
    if config.trainer == "gd":
        sparse = assembler.vectors(train, "label")
        model = logreg.descend_packed(sparse.select("label", F.col("features.idx").alias("idx"), F.col("features.value").alias("value")), config.training())
    else:
        learn = logreg.sgd_exact if config.trainer == "exact" else logreg.library
        model = learn(assembler.vectors(train, "rn", "label"), assembler.dimension, config.training())
    lap("training")
    long = assembler.vectors(test).select("row_id", F.explode("features").alias("f")).select("row_id", "f.idx", "f.value")
    scored = logreg.predict(test.select("row_id", "label"), long, model, config.threshold)
    return Run(model, assembler, scored, method, seconds, rows)


def evaluate(run: Run) -> DataFrame:
    return metrics.confusion(run.scored, F.col("label"), F.col("prediction"))


def compare(records: DataFrame, configs: dict[str, RunConfig]) -> list[dict]:
    """One report row per configuration: trimmed mean seconds over its runs, and the last run's metrics."""
    report = []
    for name, config in configs.items():
        config = config.normalised()
        totals = []
        for _ in range(config.runs):
            run = run_once(records, config)
            result = evaluate(run).first().asDict()
            totals.append(sum(run.seconds.values()))
            run.release()
        ordered = sorted(totals)
        kept = ordered[1:-1] if len(ordered) > 2 else ordered
        report.append({"config": name, "seconds": sum(kept) / len(kept), "split": run.method, **result})
    fastest = min(report, key=lambda r: r["seconds"])["seconds"] if report else 0.0
    return [{**r, "speedup": report[0]["seconds"] / r["seconds"] if r["seconds"] else 0.0, "best": r["seconds"] == fastest} for r in report]
