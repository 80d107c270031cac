"""Micro-batch logs: idempotent batch folders behind a snapshot, merged when read.

A log is a folder with three kinds of content::

    manifest/                     one row per snapshot: generation, first batch after it
    snapshot=G/                   everything before that batch, merged
    generation=G/batch_id=N/      the batches since

Every micro-batch writes its own folder (an overwrite, so a repeated batch
changes nothing).  Once ``every`` batches lie behind the snapshot, the next
batch first folds them into a new one.  The manifest row is written last, as
one file, and readers look nowhere else for the live generation: after a crash
between the steps the old generation is still complete, and the repeated batch
folds again.  So a read opens one snapshot and a bounded number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

EVERY = 20
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in MISSING:
            return None
        raise


def live(spark: SparkSession, path: str) -> tuple[int, int]:
    """Generation that takes batches now, and its first batch."""
    rows = _read(spark, f"{path.rstrip('/')}/manifest")
    newest = None if rows is None else rows.agg(F.max(F.struct("generation", "first_batch")).alias("m")).first()["m"]
    return (newest.generation, newest.first_batch) if newest else (0, 0)


def write_batch(df: DataFrame, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame] | None = None,
                every: int = EVERY, by: Sequence[str] = ()) -> None:
    """Write one batch, by folders of ``by``; with ``merge`` the batches before it are folded from time to time."""
    spark = df.sparkSession
    if merge is not None:
        compact(spark, path, batch_id, merge, every, by)
    _write(df, batch_path(spark, path, batch_id), by)


def batch_path(spark: SparkSession, path: str, batch_id: int) -> str:
    """Folder of a batch that is written now."""
    return f"{path.rstrip('/')}/generation={live(spark, path)[0]}/batch_id={batch_id}"


def _write(df: DataFrame, path: str, by: Sequence[str]) -> None:
    writer = (df.repartition(*by) if by else df).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Snapshot and later batches (older than ``before``), or None when there are none."""
    root = path.rstrip("/")
    generation, first = live(spark, path)
    log = _read(spark, f"{root}/generation={generation}")
    folded = _read(spark, f"{root}/snapshot={generation}") if generation else None
    if folded is not None:
        folded = folded.withColumn("batch_id", F.lit(first - 1))
        log = folded if log is None else folded.unionByName(log)
    return log if log is None or before is None else log.filter(F.col("batch_id") < before)


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None,
          mode: str = "append"):
    """Run ``handle`` on every micro-batch; by default process what is there and stop."""
    return (stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def compact(spark: SparkSession, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame], every: int = EVERY,
            by: Sequence[str] = ()) -> None:
    """Fold all batches before ``batch_id`` if there are ``every`` since the last snapshot.

    ``merge`` keeps the columns of a batch and gives the same for a log as for its merged parts.
    """
    generation, first = live(spark, path)
    log = read_log(spark, path, batch_id) if batch_id - first >= every else None
    if log is None:
        return
    root = path.rstrip("/")
    _write(merge(log.drop("batch_id")), f"{root}/snapshot={generation + 1}", by)
    row = spark.range(1).select(F.lit(generation + 1).alias("generation"), F.lit(batch_id).alias("first_batch"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
