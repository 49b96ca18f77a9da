"""Stored artifacts in monthly partitions: sinks that read and rewrite only the partitions a batch touches, and expiry by dropping partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days that artifacts are kept, and those of windows under a minute.
KEPT_DAYS, KEPT_DAYS_SHORT = 90, 14
SHORT = ("250ms", "1s", "5s")
DAY_MS = 86_400_000
#: Rows of a file, and how often a batch is written: what a writer collects before it writes.
ROWS_PER_FILE, EVERY = 1_000_000, "10 seconds"


def month_of(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM")


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path in it, so that any store that Spark reads will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def written(spark: SparkSession, path: str) -> list[int]:
    """The batches that a table of batch=N folders has, in order."""
    files, at = _folder(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def months(spark: SparkSession, path: str) -> list[str]:
    """The months that a table has, in order."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(n.removeprefix("month=") for n in names if n.startswith("month="))


def _stored(spark: SparkSession, path: str, wanted: list[str], epoch: int) -> DataFrame | None:
    """What earlier batches wrote to some months; the scan reads no other partition."""
    if not set(wanted) & set(months(spark, path)):
        return None
    return spark.read.parquet(path).where(F.col("month").isin(wanted) & (F.col("batch") < epoch))


def _write(rows: DataFrame, path: str, epoch: int, rows_per_file: int) -> None:
    """Replace what this batch wrote to the months of rows, and nothing else."""
    dealt = rows.withColumn("batch", F.lit(epoch)).repartition("month").sortWithinPartitions("month")
    dealt.write.mode("overwrite").partitionBy("month", "batch").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).parquet(path)


def first_write_wins(path: str, key: list[str], order: str, time_col: str, rows_per_file: int = ROWS_PER_FILE) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: of each key the first row, by `order` within a batch and by batch over all, is kept.

    time_col (epoch ms) is part of the key, or fixed by it: rows of one key are of one month, so a batch is held against the months that it
    touches alone. A batch that is repeated after a failure replaces its own partitions. A null time goes to the month `none`.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            rest = [c for c in batch.columns if c not in key]
            fresh = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*batch.columns)
            fresh = fresh.withColumn("month", F.coalesce(month_of(F.col(time_col)), F.lit("none")))
            touched = [r[0] for r in fresh.select("month").distinct().collect()]
            old = _stored(batch.sparkSession, path, touched, epoch)
            if old is not None:
                fresh = fresh.join(old.select("month", *key), ["month", *key], "left_anti")
            _write(fresh, path, epoch, rows_per_file)
        finally:
            batch.unpersist()

    return write


def late_apart(path: str, late_path: str, time_col: str, ms: int, rows_per_file: int = ROWS_PER_FILE) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink with a side table: rows more than ms behind the latest time of earlier batches go to late_path, with how late they are.

    The latest time is kept in one row a batch beside the table (path/_latest), so the table itself is never read; a repeated batch finds the
    row of the batch before it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, notes = batch.sparkSession, f"{path}/_latest"
        batch = batch.persist()
        try:
            known = spark.read.parquet(notes).where(F.col("batch") < epoch).agg(F.max("top")).first()[0] if exists(spark, notes) else None
            late = F.lit(False) if known is None else F.coalesce(F.col(time_col) < known - ms, F.lit(False))
            month = F.coalesce(month_of(F.col(time_col)), F.lit("none"))
            _write(batch.where(~late).withColumn("month", month), path, epoch, rows_per_file)
            _write(batch.where(late).withColumns({"late_ms": F.lit(known).cast("long") - F.col(time_col), "month": month}), late_path, epoch, rows_per_file)
            top = batch.agg(F.greatest(F.max(time_col), F.lit(known)).cast("long").alias("top"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{notes}/batch={epoch}")
            files, at = _folder(spark, notes)
            for old in files.listStatus(at):  # one row is enough, and one more in case the batch is repeated
                n = old.getPath().getName().removeprefix("batch=")
                if n.isdigit() and int(n) < epoch - 1:
                    files.delete(old.getPath(), True)
        finally:
            batch.unpersist()

    return write


def expire(spark: SparkSession, path: str, now_ms: int, days: int = KEPT_DAYS) -> list[str]:
    """Drop the months all of whose rows are older than `days`, as folders, without reading any; their names. Rows of younger months stay."""
    first = spark.range(1).select(month_of(F.lit(now_ms - days * DAY_MS)).alias("m")).first()[0]
    files, at = _folder(spark, path)
    gone = [m for m in months(spark, path) if m < first and m != "none"]
    for m in gone:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"month={m}"), True)
    return gone


def unexpired(windows: DataFrame, now_ms: int, days: int = KEPT_DAYS, days_short: int = KEPT_DAYS_SHORT) -> DataFrame:
    """Windows that may still be shown: those of timeframes under a minute for a shorter time. Bounds of months reach the scan of a partitioned table."""
    start = now_ms - F.when(F.col("timeframe").isin(*SHORT), days_short).otherwise(days).cast("long") * DAY_MS
    out = windows.where(F.col("window_start") >= start)
    return out.where(F.col("month") >= month_of(F.lit(now_ms - max(days, days_short) * DAY_MS))) if "month" in windows.columns else out


def started(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = EVERY):
    """Start a stream into a sink, a batch every so often (None: one pass over what is there)."""
    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
