"""spark-submit entry: the profile of annotation files as a JSON report.

    spark-submit paperproof/cli.py --output report.json data/*.parquet
    spark-submit paperproof/cli.py --output report.json --manifest manifest.json
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from paperproof.operators.landing import land, read_landed
from paperproof.operators.profile import profile_report, write_report
from paperproof.sources.annotations import manifest_paths, read_annotations, source_block
from paperproof.sources.shared import new_path


def manifest_report(spark: SparkSession, manifest: list[dict] | dict, *, column: str = "ground_truth", order: str | None = None, dataset: str | None = None, store: str | None = None) -> dict:
    """The profile of the files that a manifest names, and what they are; by ``order``, or as rows stand in the files, in the manifest's order.
    Texts are parsed once, into ``store``, an unused path that the executors share (by default one in the shared folder); counts and examples are read from there."""
    columns = [column, *([order] if order else [])]
    rows = read_annotations(spark, manifest_paths(manifest), *columns, order=None if order else "source_order")
    store = store or new_path(spark, "profiled")
    land(rows, store, text=column, mode="error")
    return profile_report(read_landed(spark, store), order=order or "source_order", text=column) | {"source": source_block(manifest, columns, dataset)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Profile receipt annotations.")
    p.add_argument("paths", nargs="*", help="Parquet files or folders with the annotation column")
    p.add_argument("--manifest", help="a JSON manifest, on the driver, whose entries name the files and their sizes")
    p.add_argument("--dataset", help="the data set's name in the report")
    p.add_argument("--order", help="a column by which examples and ties are in order; without it they stand as in the files, in the order given")
    p.add_argument("--output", required=True, help="the JSON report to write, on the driver")
    p.add_argument("--column", default="ground_truth")
    p.add_argument("--store", help="an unused path that the executors share, for the parsed annotations; without it they are in spark.checkpoint.dir until the end")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("paperproof-profile").getOrCreate()
    manifest = json.loads(Path(args.manifest).read_text(encoding="utf-8")) if args.manifest else [{"url": x} for x in args.paths]
    report = manifest_report(spark, manifest, column=args.column, order=args.order, dataset=args.dataset, store=args.store)
    write_report(report, args.output)
    counts = report.get("documents", {})
    print(f"{counts.get('total', 0)} documents profiled, {counts.get('adapter_successes', 0)} adapted, {report.get('line_items', {}).get('total', 0)} line items; report in {args.output}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
