"""Command line: ``python -m glyphsift.cli COMMAND`` (or under spark-submit).

Exit code 2 of ``detect`` means that a text has a carrier of medium or high
severity; 1 of ``bleach`` that the gate refused the rewriting.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsift.functions.text import prose_tokens
from glyphsift.operators import carriers, keyless, ladder, partition
from glyphsift.plans import robustness
from glyphsift.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphsift")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("detect", "report"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default="-")
        c.add_argument("--json", action="store_true")
    c = sub.add_parser("bleach")
    c.add_argument("path", nargs="?", default="-")
    c.add_argument("--strength", type=int, choices=(1, 2, 3), default=1)
    c.add_argument("--model", help="for strength 3: module:function from column to column")
    c.add_argument("--json", action="store_true", help="a JSON line for each text; the texts go to stderr")
    c.add_argument("--language", default="en")
    c.add_argument("--roundtrip", action="store_true")
    for name in ("calibrate-prose", "calibrate-code"):
        c = sub.add_parser(name)
        c.add_argument("candidate", help="Parquet of the candidate's samples")
        c.add_argument("reference", nargs="+", help="Parquet of reference samples")
    c = sub.add_parser("benchmark")
    c.add_argument("--samples", type=int, default=24)
    c.add_argument("--length", type=int, default=400)
    sub.add_parser("hardware")
    return p


def _texts(spark: SparkSession, path: str) -> DataFrame:
    if path == "-":
        return files.text_frame(spark, sys.stdin.buffer.read().decode(errors="replace"))
    return files.read_texts(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), "text")


def detect(spark: SparkSession, args: argparse.Namespace) -> int:
    found = carriers.detect_carriers(_texts(spark, args.path))
    if args.json:
        for r in files.report_json(found).toLocalIterator():
            print(r.json)
    else:
        print(files.to_markdown(found))
    return 2 if args.command == "detect" and found.where("alarm").limit(1).count() else 0


def _model(name: str | None):
    """The function that ``module:function`` names."""
    if not name:
        raise SystemExit("strength 3 needs --model module:function, from column to column")
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def bleach(spark: SparkSession, args: argparse.Namespace) -> int:
    """0, or 1 if the gate refused the rewriting of a text (its normalised form is printed then)."""
    model = _model(args.model) if args.strength == ladder.PARAPHRASE else None
    strength = max(args.strength, ladder.EDIT) if args.roundtrip else args.strength
    texts = _texts(spark, args.path).withColumn("lang", F.lit(args.language))
    code = 0
    for r in ladder.rewritten(texts, strength, model, roundtrip=args.roundtrip).toLocalIterator():
        if args.json:
            print(json.dumps({"schema_version": files.SCHEMA_VERSION, "strength": r.strength, "accepted": r.accepted, "meaning_score": r.meaning_score, "message": r.message}))
        print(r.text, file=sys.stderr if args.json else sys.stdout)
        code = code if r.accepted else 1
    return code


def calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Prose: ``doc_id, text``; code: ``sample_id, slot, variant``."""
    if args.command == "calibrate-prose":
        gap = lambda path: keyless.prose_gap(keyless.bigrams_of(spark.read.parquet(path).select("doc_id", F.posexplode(prose_tokens(F.col("text"))).alias("pos", "tok"))), permutations=100).first()["gap"]
        gaps = spark.createDataFrame([(gap(p),) for p in args.reference], "gap double")
        candidate = gap(args.candidate)
    else:
        size = lambda c: c.agg(F.max("slot")).first()[0] + 1
        refs = [spark.read.parquet(p) for p in args.reference]
        gaps = partition.bootstrap_gaps(refs[0], 4, size(refs[0]), source="0")
        for i, r in enumerate(refs[1:], 1):
            gaps = gaps.unionByName(partition.bootstrap_gaps(r, 4, size(r), source=str(i)))
        c = spark.read.parquet(args.candidate)
        candidate = partition.steal_and_test(c, 4, size(c)).first()["gap"]
    print(files.calibration_json(partition.score_against_baseline(gaps, candidate).first().asDict()))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command in ("detect", "report"):
        return detect(spark, args)
    if args.command == "bleach":
        return bleach(spark, args)
    if args.command == "benchmark":
        print(files.benchmark_markdown(robustness.scheme_benchmark(spark, args.samples, args.length)))
        return 0
    if args.command == "hardware":
        sc = spark.sparkContext
        gpus = {name: sc._conf.get(f"spark.{name}.resource.gpu.amount", "0") for name in ("driver", "executor", "task")}
        print(json.dumps({"parallelism": sc.defaultParallelism, "master": sc.master, "driver_cpus": os.cpu_count(), "driver_memory": sc._conf.get("spark.driver.memory", "1g"), "executor_memory": sc._conf.get("spark.executor.memory", "1g"), "gpus": gpus}))
        return 0
    return calibrate(spark, args)


if __name__ == "__main__":
    sys.exit(main())
