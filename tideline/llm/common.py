"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The largest table, in bytes of its values, that is sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Rows of an Arrow batch, where the session keeps Spark's own default: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1500"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary folder; on a cluster that is an error,
    since driver and executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="tideline-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is that of shared_folder(). What stands there goes with the session's own cleaning (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def one_thread(spark: SparkSession) -> Iterator[None]:
    """Python functions that are made into plans within get workers whose linear algebra has one thread: a task has one core, and more threads only wait."""
    env = spark.sparkContext.environment
    was = env.get("OPENBLAS_NUM_THREADS")
    env["OPENBLAS_NUM_THREADS"] = "1"
    try:
        yield
    finally:
        del env["OPENBLAS_NUM_THREADS"]
        if was is not None:
            env["OPENBLAS_NUM_THREADS"] = was


def tidied(fn: Callable) -> Callable:
    """fn, a generator, after which a worker gives the memory that it no longer uses back: workers live on between stages, beside each other."""

    def run(it: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from fn(it)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def gathered(it: Iterator, column: int, limit: int) -> Iterator:
    """Arrow batches put together until a column holds `limit` bytes."""
    import pyarrow as pa

    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield rows[0]


def map_batches(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(fn, schema) with workers of one thread, which are tidied afterwards, and batches of BATCH_ROWS rows.

    The size of batches is a setting of the session, which stays set, since plans run later; one that the session has changed itself is kept.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    with one_thread(spark):
        return df.mapInArrow(tidied(fn), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", row_bytes: int = 64, size: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join left with a durable right: broadcast if right, as measured, fits within `limit` bytes, else a shuffled join that adaptive execution may split.

    size: bytes of one row, where rows of right differ much.
    """
    total = right.agg(F.coalesce(F.sum(size.cast("double") if size is not None else F.lit(float(row_bytes))), F.lit(0.0))).first()[0]
    return left.join(F.broadcast(right) if total <= limit else right, on, how)


def text_hash(col: Column) -> Column:
    return F.xxhash64(F.coalesce(col, F.lit("")), col.isNull())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges(a, b) reaches, by alternating large-star and small-star rounds.

    Every round is made of joins on the node and partial aggregates; a hub's rows are split by adaptive execution. Each round is
    kept in the checkpoint folder. It ends when a round changes nothing. An empty table of edges gives an empty result.
    """

    def stars(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(stars(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = (
            large.join(stars(large), "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .filter("u <> v")
            .distinct()
        )
        e = durable(small)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
