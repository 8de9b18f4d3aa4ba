"""Command line: queries of the catalogue, analysis and compilation of workflow folders, reads and checks of a world.

A world is a folder with JSON lines in a folder for each object type. Exit codes: 0 done, 1 refused or blocked, 2 not
understood.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analyze, compile, ingest, semantic
from .operators.schemas import SCHEMAS
from .operators.world import MODES, AmbiguousEntity, BudgetTooSmall, World
from .plans import catalogue
from .sources import units


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrystone", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of the catalogue's queries")
    one = sub.add_parser("run", help="write a query's rows as Parquet")
    one.add_argument("name", choices=sorted(catalogue.QUERIES))
    one.add_argument("--tables", required=True)
    one.add_argument("--out", required=True)
    for name, text in (("analyze", "reports and a summary of a folder of workflows"), ("compile", "append a folder's compiled items to a store")):
        one = sub.add_parser(name, help=text)
        one.add_argument("folder")
        one.add_argument("--out", required=True)
        if name == "compile":
            one.add_argument("--repo", required=True)
            one.add_argument("--commit", required=True)
            one.add_argument("--analyzer-version", default="1.0")
            one.add_argument("--dry-run", action="store_true")
    one = sub.add_parser("check", help="faults of a world by type and code")
    one.add_argument("world")
    one.add_argument("--strict", action="store_true", help="any fault blocks, not only critical ones")
    one = sub.add_parser("pack", help="a cited context pack as JSON")
    one.add_argument("world")
    one.add_argument("objective")
    one.add_argument("--scope", required=True)
    one.add_argument("--entity")
    one.add_argument("--mode", choices=sorted(MODES), default="OPERATIONAL")
    one.add_argument("--budget", type=int, default=8000)
    return top


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's files by their path below it."""
    root = F.length(F.lit(f"{Path(folder).resolve().as_uri()[len('file://') :]}/"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return units.files(spark, folder).withColumn("path", F.substring(path, root + 1, F.length(path)))


def _world(spark: SparkSession, folder: str) -> World:
    return World.read(spark, folder, tuple(k for k in SCHEMAS if (Path(folder) / k).is_dir()))


def _print(rows: DataFrame) -> list[dict]:
    """Rows of a small aggregate, a JSON line each."""
    held = [r.asDict(recursive=True) for r in rows.collect()]
    for row in held:
        print(json.dumps(row, sort_keys=True, default=str))
    return held


def run(spark: SparkSession, given: argparse.Namespace) -> int:
    if given.command == "queries":
        print("\n".join(sorted(catalogue.QUERIES)))
    elif given.command == "run":
        catalogue.QUERIES[given.name](spark, given.tables).write.mode("errorifexists").parquet(given.out)
    elif given.command in ("analyze", "compile"):
        found = _found(spark, given.folder)
        nodes, leaves, edges = analyze.documents(found)
        hits = analyze.findings(nodes, leaves)
        if given.command == "analyze":
            report = analyze.reports(found, nodes, hits)
            summary = report.groupBy("risk_decision", "max_severity").agg(F.count("*").alias("n")).orderBy("risk_decision", "max_severity")
            ingest.write_reports(report, summary, given.out)
            _print(spark.read.schema(summary.schema).json(f"{given.out}/summary"))
        else:
            rows = compile.items(found.where("parse_error is null"), nodes, leaves, edges, hits, given.repo, given.commit)
            print(json.dumps({k: {"created": c, "reused": r} for k, (c, r) in compile.publish(rows, given.out, given.analyzer_version, given.dry_run).items()}))
    elif given.command == "check":
        world = _world(spark, given.world)
        structure = world.faults().groupBy("code").agg(F.count("*").alias("n")).select("code", F.lit("ERROR").alias("severity"), "n")
        found = _print(structure.unionByName(semantic.worst_first(semantic.faults(world.frames))).orderBy("severity", "code"))
        blocked = found if given.strict else [f for f in found if f["severity"] == "CRITICAL"]
        print("BLOCKED" if blocked else "LIMITS" if found else "READY")
        return 1 if blocked else 0
    else:
        mine = _world(spark, given.world).scoped(given.scope)
        entity = mine.require_one(given.entity) if given.entity else None
        print(json.dumps(mine.context_pack(given.objective, given.mode, given.budget, [entity] if entity else None), sort_keys=True, default=str))
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, given)
    except (ValueError, AmbiguousEntity, BudgetTooSmall) as error:
        print(f"refused: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
