"""Annotation files as a DataFrame, and their paths from a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_entries(manifest: list[dict] | dict, files: str = "parquet_files") -> list[dict]:
    """The entries of a manifest: a list of objects, or an object that holds one. One without entries is an error."""
    entries = manifest.get(files) if isinstance(manifest, dict) else manifest
    if not isinstance(entries, list) or not entries or not all(isinstance(e, dict) for e in entries):
        raise ValueError("a manifest must list an entry at least, each an object")
    return entries


def manifest_paths(manifest: list[dict] | dict, key: str = "url") -> list[str]:
    """The paths that a manifest names, in order; an entry without one is an error that says which."""
    entries = manifest_entries(manifest)
    if missing := [i for i, e in enumerate(entries) if not isinstance(e.get(key), str) or not e[key]]:
        raise ValueError(f"manifest entry {missing[0]} has no {key}")
    return [e[key] for e in entries]


def source_block(manifest: list[dict] | dict, columns: Sequence[str], dataset: str | None = None) -> dict:
    """What a report says of its source: data set, number of files, summed advertised bytes (entries without a size count as 0), columns."""
    entries = manifest_entries(manifest)
    return {"dataset": dataset or (manifest.get("dataset") if isinstance(manifest, dict) else None), "files": len(entries), "advertised_bytes": sum(int(e.get("size") or 0) for e in entries), "columns": list(columns)}


def _entry_of(spark: SparkSession, paths: Sequence[str], files: Sequence[str]) -> list[int]:
    """Of each file that a scan reads, the place among the paths of the first that names it: itself, its folder or a pattern."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    plain = lambda at: at.toUri().getPath()
    named: dict[str, int] = {}
    for i, p in enumerate(paths):
        at = jvm.org.apache.hadoop.fs.Path(p)
        for found in at.getFileSystem(hadoop).globStatus(at) or ():
            named.setdefault(plain(found.getPath()), i)
    out = []
    for f in files:
        whole = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        while whole is not None and plain(whole) not in named:
            whole = whole.getParent()
        out.append(named[plain(whole)] if whole is not None else len(paths))
    return out


def read_annotations(spark: SparkSession, paths: Sequence[str], *columns: str, order: str | None = None) -> DataFrame:
    """The annotation column (ground_truth, if none is named) of Parquet files that may hold images beside it; the scan reads nothing else.

    With order, a column of that name says where a row stands: struct<entry, file, row>, the place of its path among the paths, its file
    and its row in it. It is the same in every run, however the files are split, and sorts rows in the order of the paths."""
    if not paths:
        raise ValueError("no annotation files")
    found = spark.read.parquet(*paths)
    wanted = columns or ("ground_truth",)
    if not order:
        return found.select(*wanted)
    files = found.inputFiles()  # the driver holds this list for the scan anyway
    one = lambda f: F.regexp_replace(f, "^file:/+", "file:/")  # noqa: E731  local paths are written both ways
    entries = spark.createDataFrame(list(zip(files, _entry_of(spark, paths, files), strict=True)), "_file string, _entry int").withColumn("_file", one("_file"))
    rows = found.select(*wanted, one(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = F.struct(F.col("_entry").alias("entry"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    return rows.join(F.broadcast(entries), "_file", "left").select(*wanted, place.alias(order))
