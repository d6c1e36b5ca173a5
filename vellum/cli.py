"""Command line: lint Markdown, convert contract tables, collect from an index."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators import collect, report
from .plans import convert
from .sources import readers, scratch, sinks


def main(args: list[str] | None = None) -> int:
    """Exit code: 1 with a failure or an error, 2 with --strict and anything but info, else 0. Shared scratch tables go at the end."""
    try:
        return _run(args)
    finally:
        if spark := SparkSession.getActiveSession():
            scratch.clear(spark)


def _run(args: list[str] | None) -> int:
    parser = argparse.ArgumentParser(prog="vellum")
    commands = parser.add_subparsers(dest="command", required=True)
    lint = commands.add_parser("lint", help="findings of Markdown files as JSON lines")
    lint.add_argument("path")
    run = commands.add_parser("convert", help="items, cells and pages (Parquet) to Markdown, findings and reports")
    run.add_argument("source", help="folder with items, cells and pages tables")
    run.add_argument("out")
    run.add_argument("--overwrite", action="store_true")
    get = commands.add_parser("collect", help="index files to a registry; --network downloads what is missing")
    get.add_argument("index")
    get.add_argument("registry", help="JSON lines")
    get.add_argument("folder", help="documents at hand, as year/number/file")
    get.add_argument("--families", nargs="*", default=list(P.ALL_FAMILIES))
    get.add_argument("--network", action="store_true")
    get.add_argument("--limit", type=int)
    get.add_argument("--out", help="where the new registry goes (default: beside the old one, with .new)")
    for p in (lint, run):
        p.add_argument("--strict", action="store_true")
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName("vellum").getOrCreate()
    if o.command == "lint":
        found = convert.lint_files(spark, o.path).orderBy("path", "seq").cache()
        for row in found.toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        worst = found.agg(report.exit_code(F.lit(False), report.severity_rank("severity"), F.lit(o.strict))).first()[0]
        return int(worst or 0)
    if o.command == "convert":
        read = lambda name: readers.contract(spark, name, spark.read.parquet(f"{o.source}/{name}"))
        done = convert.convert(read("items"), read("cells"), read("pages"))
        for name in ("findings", "gates", "measures", "rendered"):
            sinks.write_table(done[name], f"{o.out}/{name}", o.overwrite)
        gates, findings = spark.read.parquet(f"{o.out}/gates"), spark.read.parquet(f"{o.out}/findings")
        run_id = uuid.uuid4().hex
        report.write_reports(report.run_report(gates, findings, run_id), f"{o.out}/_auditoria", run_id)
        rank = F.array_position(F.array(*map(F.lit, P.GATES)), F.col("gate")).cast("int") - 1
        return int(gates.agg(report.exit_code(F.lit(False), rank, F.lit(o.strict))).first()[0] or 0)
    registry, rejected = collect.load_registry(readers.text_lines(spark, o.registry))
    done = convert.collect_run(spark, readers.index_rows(spark, o.index), registry, o.folder, collect.url_fetcher() if o.network else None, families=tuple(o.families), limit=o.limit)
    sinks.write_registry(done["registry"], o.out or f"{o.registry}.new")
    for row in done["downloads"].groupBy("estado").count().orderBy("estado").collect():
        print(row.estado, row["count"])
    return int(not (rejected.isEmpty() and done["rejected"].isEmpty()))


if __name__ == "__main__":
    sys.exit(main())
