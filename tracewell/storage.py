"""Tables in the cluster's shared folder, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_created: dict[str, SparkSession] = {}
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary folder on a local
    master, whose executors are this machine; any other cluster has to name one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracewell-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, suffix: str = "") -> str:
    """A fresh path in the shared folder, removed when its scratch or Python ends."""
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}{suffix}"
    _created[path] = spark
    if _scratch:
        _scratch[-1].append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back. Tables are removed by
    ``release``, at the end of the ``scratch`` they were made in, or when Python ends."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


@contextlib.contextmanager
def scratch() -> Iterator[callable]:
    """Tables made inside are removed at the end, but for those handed to the function that the
    context gives; these belong to the scratch around it, if there is one."""
    mine: list[str] = []
    _scratch.append(mine)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._tracewell_path)
        return df

    try:
        yield keep
    finally:
        _scratch.pop()
        if _scratch:
            _scratch[-1].extend(kept)
        for path in set(mine) - set(kept):
            _delete(path)


def release(df: DataFrame) -> None:
    path = getattr(df, "_tracewell_path", None)
    if path:
        _delete(path)


def _delete(path: str) -> None:
    spark = _created.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _cleanup() -> None:
    for path in list(_created):
        with contextlib.suppress(Exception):  # a session may be gone already; the others' tables still go
            _delete(path)
