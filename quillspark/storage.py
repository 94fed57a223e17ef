"""Cut lineage: tables written to the folder that driver and executors share, dropped when told and at the end at last."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_runs: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own in ``spark.checkpoint.dir``, or in a temporary folder where driver and executors
    are one process; an error elsewhere. It goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{_base(spark).rstrip('/')}/quillspark-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _runs[app])
    return _runs[app]


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillspark-"))


def _clean(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None:
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._qs_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Drop tables made by :func:`stored` that nothing reads any more."""
    for t in tables:
        drop(t.sparkSession, t._qs_path)
