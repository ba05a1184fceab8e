"""The folder that driver and executors share, and tables made once from files there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder (tests); a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="paperproof-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is there when the driver's JVM ends is deleted then."""
    path = f"{shared_dir(spark)}/paperproof-{name}-{uuid.uuid4().hex}"
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    return path


def file_states(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Path, length and time of change of each file under paths: what tells one state of them from another."""
    out = []
    for p in paths:
        files, at = _path(spark, p)
        listed = files.listFiles(at, True)
        while listed.hasNext():
            f = listed.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


_MADE: dict[tuple, str] = {}


def path_made_once(spark: SparkSession, name: str, sources: Sequence[str], make: Callable[[str], None]) -> str:
    """The path that ``make`` wrote to, made again only if the source files have changed since, or the application is another."""
    key = spark.sparkContext.applicationId, spark.sparkContext.startTime, name, file_states(spark, sources)
    files, at = _path(spark, _MADE[key]) if key in _MADE else (None, None)
    if files is None or not files.exists(at):
        path = new_path(spark, name)
        make(path)
        _MADE[key] = path
    return _MADE[key]


def made_once(spark: SparkSession, name: str, sources: Sequence[str], make: Callable[[str], None]) -> DataFrame:
    """The Parquet table at a path made once."""
    return spark.read.parquet(path_made_once(spark, name, sources, make))
