"""What the operators share: the cluster's shared folder, stored tables and ASCII word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the word definitions: A-Z fold to a-z, and [\x20\x09-\x0D] are the spaces that bytes.split() knows.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one (tests); a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="paperproof-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is still there when the driver's JVM ends is deleted then."""
    path = f"{shared_dir(spark)}/paperproof-{name}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so lost executors cost no recomputing.

    The write's shuffle files go as soon as it is done."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            files, at = _file_system(t.sparkSession, path)
            files.delete(at, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(sizes, most: int):
    """(start, stop) of consecutive rows whose sizes sum to at most most; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with at most ``most`` bytes of a string or binary column; a larger row stands alone. Only a run at a time becomes Python objects."""
    for b in batches:
        for p, q in slices(pc.binary_length(b[column]).to_pylist(), most):
            yield b.slice(p, q - p)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
