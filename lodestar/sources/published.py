"""Tables whose readers see a version whole or not at all: written aside, judged, and shown by one rename.

A table is a folder of numbered versions, each a folder of Parquet files.  A candidate is written to a staged folder
once; the gates read what was written; a rename to the next number shows it.  A job that dies before leaves what was
there, and readers of the version before go on, as that is deleted only with the second next one.  The file system
must rename a folder in one step and refuse a name that is taken, as HDFS and local disks do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

#: Milliseconds after which a staged folder belongs to a job that died.
STALE = 86_400_000


class NotPublished(PySparkException):
    """The table has no version yet."""


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v-{version:012d}"


def _children(spark: SparkSession, path: str) -> list:
    files, at = _open(spark, path)
    return list(files.listStatus(at)) if files.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are there, ascending."""
    names = (f.getPath().getName() for f in _children(spark, path))
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def delete(spark: SparkSession, path: str, numbers: Iterable[int]) -> None:
    for n in numbers:
        files, at = _open(spark, _folder(path, n))
        files.delete(at, True)


def read(spark: SparkSession, path: str, numbers: list[int] | None = None) -> DataFrame:
    """The newest version, or the rows of all the given ones."""
    numbers = versions(spark, path)[-1:] if numbers is None else numbers
    if not numbers:
        raise NotPublished(f"no version in {path}")
    return spark.read.parquet(*(_folder(path, n) for n in numbers))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(files.makeQualified(old), files.makeQualified(new), none)


def publish(
    candidate: DataFrame,
    path: str,
    gates: Callable[[DataFrame], DataFrame] | None = None,
    most_bytes: int | None = None,
    version: int | None = None,
    keep: int | None = 2,
) -> tuple[int | None, list[Row]]:
    """Show ``candidate`` as the next version, or as ``version``, if every gate holds: (number or None, the gates' rows).

    ``gates`` makes rows (gate, ok, detail) of the written candidate; no rows are a refusal, as nothing was judged.
    ``most_bytes`` is a gate on the size of the files.  The newest ``keep`` versions stay, all with None.
    """
    spark = candidate.sparkSession
    seen = versions(spark, path)
    number = (seen[-1] + 1 if seen else 0) if version is None else version
    staged = f"{path.rstrip('/')}/staged-{uuid.uuid4().hex}"
    files, at = _open(spark, staged)
    try:
        candidate.write.parquet(staged)
        judged = gates(spark.read.schema(candidate.schema).parquet(staged)).collect() if gates else []
        stands = all(r["ok"] for r in judged) and (gates is None or bool(judged))
        if most_bytes is not None:
            size = files.getContentSummary(at).getLength()
            judged.append(Row(gate="bytes", ok=size <= most_bytes, detail=float(size)))
            stands = stands and size <= most_bytes
        if not stands:
            return None, judged
        _rename(spark, staged, _folder(path, number))
    finally:
        files.delete(at, True)
    if keep is not None:
        delete(spark, path, versions(spark, path)[:-keep])
    _sweep(spark, path)
    return number, judged


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete what dead jobs left staged."""
    files, _ = _open(spark, path)
    for f in _children(spark, path):
        if f.getPath().getName().startswith("staged-") and f.getModificationTime() < time.time() * 1000 - STALE:
            files.delete(f.getPath(), True)
