"""The command line.

``python -m tamiz INPUT.csv --mode compare --workers 1,2,4`` trains and evaluates; a command as the first word does one of the other steps:

``ingest SOURCE TARGET`` (sorts downloaded sheets), ``merge PRESENTED RESOLVED OUT`` (folders of yearly sheets), ``clean IN OUT``, ``synthesise IN OUT``,
``inspect IN...`` (schema, five rows, nulls), ``monitor OUT.json -- COMMAND`` (what a command uses).
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz import monitor
from tamiz.operators import clean, merge, synth
from tamiz.plans import complaint_model as M
from tamiz.sources import files

MODES = {"sequential": "sequential", "secuencial": "sequential", "concurrent": "concurrent", "concurrente": "concurrent", "compare": "compare", "comparar": "compare"}


def mode_name(value: str) -> str:
    """A mode under any of its spellings; else an error."""
    found = MODES.get(value.strip().lower())
    if found is None:
        raise ValueError(f"unknown mode {value!r}")
    return found


def worker_counts(value: str) -> list[int]:
    """Positive whole numbers in a comma list; blanks are skipped, none is an error."""
    counts = [int(x) for x in value.split(",") if x.strip()]
    if not counts or min(counts) < 1:
        raise ValueError(f"no worker counts in {value!r}")
    return counts


def clamp_workers(workers: int, rows: int) -> int:
    """As many workers as asked for, all cores if none are, and no more than rows; 1 for no rows."""
    if rows <= 0:
        return 1
    return min(workers if workers > 0 else os.cpu_count() or 1, rows)


def chunk_ranges(rows: int, workers: int) -> list[tuple[int, int]]:
    """Start and end of the stretches of rows that workers take: equal ones, the last may be shorter. Spark deals partitions itself; reports use this."""
    size = -(-rows // clamp_workers(workers, rows)) if rows > 0 else 1
    return [(start, min(start + size, rows)) for start in range(0, max(rows, 0), size)]


def run_with(path: str, workers: int, config: M.RunConfig) -> dict:
    """One configuration in a session of its own width."""
    spark = SparkSession.builder.master(f"local[{workers}]").config("spark.sql.shuffle.partitions", str(max(4, workers))).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        raw = spark.read.parquet(path) if path.endswith(".parquet") else files.read_csv(spark, path)
        return {"workers": workers, **M.compare(files.complaint_records(raw).cache(), {f"{workers} workers": config})[0]}
    finally:
        spark.stop()


def session(workers: str = "*") -> SparkSession:
    """The session that is there (as under spark-submit), else a local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.master(f"local[{workers}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def sheets(folder: str) -> list[str]:
    """The sheets of a folder, in order of their names."""
    return sorted(str(p) for p in Path(folder).iterdir() if p.suffix in (".csv", ".parquet", ".xlsx"))


def read(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else files.read_csv(spark, path, multiline=multiline)


def ingest(args: argparse.Namespace) -> int:
    """Sort downloaded sheets into the folders that ``merge`` reads."""
    print(files.write_json(files.ingest(args.source, args.target)))
    return 0


def merge_sheets(args: argparse.Namespace) -> int:
    """Merge yearly sheets and tell how records were matched."""
    spark = session()
    presented, resolved = (files.yearly_sheets(spark, sheets(folder), names) for folder, names in ((args.presented, merge.PRESENTED_NAMES), (args.resolved, merge.RESOLVED_NAMES)))
    files.write_csv(merge.merged_table(presented, resolved), args.out)
    by = {r["RES_MATCH_SOURCE"]: r["count"] for r in read(spark, args.out).groupBy("RES_MATCH_SOURCE").count().collect()}
    print(files.write_json({"rows": sum(by.values()), "matched_by_number": by.get("nro", 0), "matched_by_origin": by.get("origen", 0), "unmatched": by.get("none", 0)}))
    return 0


def clean_records(args: argparse.Namespace) -> int:
    """Clean merged records and print the report; rows whose field count does not fit the header are left out and counted."""
    spark = session()
    if args.input.rstrip("/").endswith(".parquet"):
        good, malformed = read(spark, args.input), 0
    else:
        good, bad = files.read_strict(spark, args.input, files.read_csv(spark, args.input, multiline=not args.single_lines).columns, not args.single_lines)
        malformed = bad.count()
    files.write_csv(clean.clean_frame(good), args.out)
    print(files.write_json({**clean.clean_report(good).first().asDict(), "malformed": malformed}, args.report))
    return 0


def synthesise(args: argparse.Namespace) -> int:
    """Draw labelled synthetic complaints from clean records."""
    spark = session()
    records = files.file_index(read(spark, args.input, not args.single_lines).na.fill(""), "position")
    if records.isEmpty():
        raise ValueError("the dataset is empty")
    files.write_csv(synth.synthetic_rows(records, args.rows, args.anchor or date.today().isoformat(), args.seed), args.out)
    if args.reduced:
        files.write_csv(files.reduce_synthetic(read(spark, args.out)), args.reduced)
    by = {r["ES_SPAM"]: r["count"] for r in read(spark, args.out).groupBy("ES_SPAM").count().collect()}
    print(files.write_json({"rows": sum(by.values()), "spam": by.get("1", 0)}))
    return 0


def inspect(args: argparse.Namespace) -> int:
    """Schema, five rows drawn by a seed, and missing values of data sets."""
    spark = session()
    for path in args.input:
        rows = read(spark, path)
        rows.printSchema()
        rows.orderBy(F.rand(args.seed)).limit(5).show(truncate=60)
        merge.null_profile(rows).show(len(rows.columns), truncate=False)
    return 0


def watch(args: argparse.Namespace) -> int:
    """What a command uses, as JSON."""
    print(files.write_json(monitor.monitored([x for x in args.command if x != "--"]), args.out))
    return 0


def steps() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tamiz")
    sub = parser.add_subparsers(required=True)

    def step(name: str, run: Callable[[argparse.Namespace], int], *places: str) -> argparse.ArgumentParser:
        made = sub.add_parser(name, help=run.__doc__)
        made.set_defaults(run=run)
        for p in places:
            made.add_argument(p)
        return made

    step("ingest", ingest, "source", "target")
    step("merge", merge_sheets, "presented", "resolved", "out")
    for made in (step("clean", clean_records, "input", "out"), step("synthesise", synthesise, "input", "out")):
        made.add_argument("--single-lines", action="store_true", help="no quoted line breaks: large files are split")
        made.add_argument("--report")
    made.add_argument("--rows", type=int, default=1_000_000)
    made.add_argument("--seed", type=int, default=42)
    made.add_argument("--anchor", help="day (yyyy-mm-dd) that undated complaints precede; today by default")
    made.add_argument("--reduced", help="where to write the rows without bookkeeping columns as well")
    made = step("inspect", inspect)
    made.add_argument("input", nargs="+")
    made.add_argument("--seed", type=int, default=42)
    step("monitor", watch, "out").add_argument("command", nargs=argparse.REMAINDER)
    return parser


STEPS = ("ingest", "merge", "clean", "synthesise", "inspect", "monitor")


def main(argv: list[str]) -> int:
    if argv and argv[0] in STEPS:
        args = steps().parse_args(argv)
        return args.run(args)
    parser = argparse.ArgumentParser(prog="tamiz")
    parser.add_argument("input")
    parser.add_argument("--mode", default="compare", type=mode_name)
    parser.add_argument("--workers", default="1,2,4", type=worker_counts)
    parser.add_argument("--out")
    for name, kind in (("epochs", int), ("runs", int), ("batch", int), ("max-features", int), ("min-df", int), ("rate", float), ("decay", float), ("threshold", float), ("ratio", float), ("seed", int)):
        parser.add_argument(f"--{name}", type=kind)
    parser.add_argument("--trainer", choices=("gd", "exact", "library"))
    args = vars(parser.parse_args(argv))
    path, mode, workers, out = (args.pop(k) for k in ("input", "mode", "workers", "out"))
    config = M.RunConfig(**{k: v for k, v in args.items() if v is not None})
    widths = {"sequential": [1], "concurrent": workers, "compare": [1, *(w for w in workers if w != 1)]}[mode]
    rows = [run_with(path, w, config) for w in widths]
    for r in rows:
        r["speedup"] = rows[0]["seconds"] / r["seconds"] if r["seconds"] else 0.0
        r["efficiency"] = r["speedup"] / r["workers"]
    best = min(rows, key=lambda r: (r["seconds"], r["workers"]))["workers"]
    print(files.write_json({"mode": mode, "best_workers": best, "results": rows}, out))
    if out:
        files.write_summary(rows, out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
