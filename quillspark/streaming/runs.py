"""Running a stream to its end as a batch result: over the files at hand, or over arrivals that come in slices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_folder
from .state import keyed_state


@dataclass
class Replayed:
    """What a replay wrote, and how many rows came too late for the state that they would have changed."""

    rows: DataFrame
    late: int


def _run(spark: SparkSession, out: DataFrame, at: str) -> int:
    """One run until nothing is left, from the checkpoint on; the rows that the watermark had passed."""
    with keyed_state(spark):
        run = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


def drain(spark: SparkSession, sf_dir: str, table: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``flow`` over all files of a table, until nothing is left; results are appended, with exactly-once files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = flow(spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir))
    _run(spark, out, at)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def replay(spark: SparkSession, slices: Iterable[DataFrame], flow: Callable[[DataFrame], DataFrame]) -> Replayed:
    """``flow`` over slices that arrive one after the other; it is stopped after each and restarted from its checkpoint.

    After a slice the watermark is the largest event time so far less the allowed delay, and rows of later slices that
    it has passed are late.
    """
    at, late, out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", 0, None
    for rows in slices:
        rows.write.mode("append").parquet(f"{at}/in")
        out = flow(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        late += _run(spark, out, at)
    return Replayed(spark.read.schema(out.schema).parquet(f"{at}/out"), late)


def restarted(spark: SparkSession, source: Callable[[], DataFrame], steps: Iterable[Callable[[], None]]) -> DataFrame:
    """What a stream over ``source()`` appends when it is started anew, from its checkpoint, after each of ``steps``."""
    at, out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", None
    for step in steps:
        step()
        out = source()
        _run(spark, out, at)
    return spark.read.schema(out.schema).parquet(f"{at}/out")
