"""What the operators of this package share: the scratch folder, column naming and word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column, so that extra input columns never clash with one.
P = "__qs_"
_runs: dict[str, str] = {}
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session, or the context's own. Where neither is
    set, a temporary folder, if driver and executors are one process (as in tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillspark-"))
        else:
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _runs[app])
    return _runs[app]


def _clean(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qs_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Drop tables made by :func:`stored` once nothing reads them any more."""
    for t in tables:
        drop_table(t.sparkSession, t._qs_path)


def reclaim(spark: SparkSession) -> None:
    """Collect garbage on the driver: Spark then deletes the shuffle files of jobs whose results are stored and whose
    plans nothing holds any more, rather than at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside send at most so many rows at once to a Python worker: whole texts are long. Then as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Give memory that this worker no longer uses back to the system: workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker function that ends with :func:`release`."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


# ---------------------------------------------------------------- membership by a bitmap of fixed size


def position(bits: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmap_of(slots: DataFrame, slot: Column) -> DataFrame:
    """The positions in use, as one row of 4 KiB for each 32,768 of them; written once to the shared folder."""
    slots = slots.select(slot.alias(f"{P}slot"))
    bits = slots.groupBy(F.bitmap_bucket_number(f"{P}slot").alias(f"{P}bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(f"{P}slot")).alias(f"{P}bits"))
    return stored(bits, "bitmap")


def in_bitmap(rows: DataFrame, slot: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: is the row's position in use? The bitmap's size is bounded, so it is broadcast."""
    rows = rows.withColumn(f"{P}slot", slot).withColumn(f"{P}bucket", F.bitmap_bucket_number(f"{P}slot")).join(F.broadcast(bitmap), f"{P}bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring({P}bits, cast(bitmap_bit_position({P}slot) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({P}slot) % 8 as int))")) != 0
    return rows.withColumn(name, F.coalesce(bit, F.lit(False))).drop(f"{P}slot", f"{P}bucket", f"{P}bits")


#: Runs of anything but space, tab, LF, VT, FF and CR. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- the order of ids inside tasks

WHOLE = ("bigint", "int", "smallint", "tinyint")


def id_orders(ids: list[str | None], kind: str) -> list:
    """Values in the order in which Spark sorts ids of this type, from their text; null below all. Integers stay exact.
    Ids of other types than integers and strings have no known order: NaN."""
    if kind in WHOLE:
        return [-(1 << 63) - 1 if x is None else int(x) for x in ids]
    if kind == "string":
        return [b"" if x is None else b"+" + x.encode() for x in ids]
    return [float("nan")] * len(ids)


def sortable(col: str) -> Column:
    """A column whose least value is that of the smallest id, null below all (an aggregate alone would pass nulls over)."""
    return F.struct(F.col(col).isNotNull().alias("known"), F.col(col).alias("id"))


# ---------------------------------------------------------------- hashing in numpy

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; bounded by ``limit`` entries, after which it starts anew."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self._of, self._limit = xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        self[word] = h = self._of(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (empty when there are fewer words).

    Built by doubling, so a run of any length costs a logarithmic number of passes.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & _MASK | 1)
    power, size, out, done = mix(words + np.uint64(seed)), 1, None, 0
    left = k
    while True:
        if left & 1:
            if out is None:
                out, done = power[: len(words) - size + 1], size
            else:
                m = len(words) - done - size + 1
                out, done = mix(out[:m] * mul + power[done : done + m]), done + size
        left >>= 1
        if not left:
            return out[:n]
        m = len(power) - size
        power, size = mix(power[:m] * mul + power[size : size + m]), size * 2
