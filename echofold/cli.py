"""Command line: mine recordings, evaluate a result, summarise it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import evaluate, report
from .plans.mine import mine
from .plans.options import MiningError, Options
from .sources import audio, results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echofold", description="Finds what repeats in recordings.")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("mine")
    source = m.add_mutually_exclusive_group(required=True)
    source.add_argument("--in", dest="folder", help="folder of recordings")
    source.add_argument("--manifest", help="JSON list of recordings and their times")
    m.add_argument("--out", required=True, help="folder for results")
    m.add_argument("--pattern", help="regular expression for times in names")
    m.add_argument("--tz", default="UTC")
    m.add_argument("--strict", action="store_true", help="fail where a name has no time")
    for name, default in (("min-repeat", 3.0), ("max-repeat", 300.0), ("min-lag", 300.0), ("seed-distance", 0.45), ("sim-high", 0.6), ("sim-low", 0.4), ("max-dip", 2.0), ("timeout", 900.0)):
        m.add_argument(f"--{name}", type=float, default=default)
    m.add_argument("--seed", type=int, default=1)
    m.add_argument("--no-representatives", action="store_true")
    m.add_argument("--dump-matches", action="store_true")
    m.add_argument("--json", action="store_true", help="print the result as JSON instead of a summary")
    e = sub.add_parser("evaluate")
    e.add_argument("result")
    e.add_argument("listed")
    e.add_argument("--tol", type=float, default=3.0)
    e.add_argument("--days", nargs="*")
    e.add_argument("--report", help="folder for a report")
    e.add_argument("--per-file", action="store_true")
    e.add_argument("--ad", help="profile of one ad")
    s = sub.add_parser("summarise")
    s.add_argument("result")
    return p


def run_mine(spark: SparkSession, a: argparse.Namespace) -> None:
    options = Options(a.min_repeat, a.max_repeat, a.min_lag, a.seed, a.seed_distance, a.sim_high, a.sim_low, a.max_dip, timeout=a.timeout, zone=a.tz, representatives=not a.no_representatives)
    if a.manifest:
        inputs = audio.manifest(spark, a.manifest, a.tz)
    else:
        inputs, bad = audio.scan(spark, a.folder, a.pattern, a.tz)
        for r in bad.toLocalIterator():
            print(f"{r.path}: {r.reason}", file=sys.stderr)
            if a.strict:
                raise MiningError(f"{r.path}: {r.reason}")
    mined = mine(spark, inputs, options)
    report.tables(mined, a.out)
    cuts = {}
    if options.representatives:
        for r in report.representatives(mined, f"{a.out}/representatives").toLocalIterator():
            if r.error:
                mined.stats.setdefault("warnings", []).append(f"cluster {r.cluster_id}: no representative ({r.error})")
            else:
                cuts[r.cluster_id] = r.file
    if a.dump_matches:
        report.dump_matches(mined, f"{a.out}/match_lines")
    whole = report.result(mined, cuts)
    report.save(f"{a.out}/clusters.json", json.dumps(whole, indent=2, ensure_ascii=False))
    report.save(f"{a.out}/report.txt", report.report(mined))
    print(json.dumps(whole, ensure_ascii=False) if a.json else report.summary(mined))


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    listed, mined = results.listed(spark, a.listed), results.result(spark, a.result)
    rows = evaluate.covered(listed, mined, a.tol, a.days)
    evaluate.totals(rows).show(truncate=False)
    evaluate.fragmentation(rows).orderBy(F.desc("clusters"), "name").show(40, truncate=False)
    found = evaluate.verdicts(listed, mined, a.tol)
    if a.report:
        evaluate.write_report(found, a.report)
    if a.per_file:
        files = evaluate.per_file(found)
        files.orderBy("share", "file_no").show(200, truncate=False)
        evaluate.levels(files).show()
    if a.ad:
        evaluate.profile(rows, a.ad).show(truncate=False)


def run_summarise(spark: SparkSession, a: argparse.Namespace) -> None:
    o = results.result(spark, a.result)
    clusters = o.groupBy("cluster_id").agg(F.max("duration").alias("duration"), F.max("is_spot").alias("is_spot"), F.max("reason").alias("reason"), F.count(F.lit(1)).alias("n"))
    evaluate.histogram(clusters.where("is_spot"), "duration", [0, 8, 12, 16, 22, 32, 47, 62, 90, 121]).orderBy("low").show()
    evaluate.histogram(clusters, "n", [2, 3, 5, 10, 20, 50, 100, 500]).orderBy("low").show()
    evaluate.per_day(o).orderBy("day").show(62)
    clusters.where("is_spot").orderBy(F.desc("n"), "cluster_id").limit(15).show(truncate=False)
    evaluate.near_lengths(o).orderBy("a", "b").show(20)
    evaluate.reasons(clusters).show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("echofold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        {"mine": run_mine, "evaluate": run_evaluate, "summarise": run_summarise}[a.command](spark, a)
    except MiningError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
