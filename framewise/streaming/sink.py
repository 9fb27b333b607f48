"""A sink that writes each batch once, and rows that replace one another by key when they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def exactly_once(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows go into a folder of its own, then its number into the ledger.

    A batch that is in the ledger is passed over when it runs again. One that broke off before that is not, and
    overwrites what it left. So a batch counts once, however often it runs.
    """

    def write(rows: DataFrame, batch: int) -> None:
        entry = f"{path}/ledger/batch={batch}"
        if _exists(rows.sparkSession, f"{entry}/_SUCCESS"):
            return
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        rows.sparkSession.range(1).select(F.current_timestamp().alias("written")).coalesce(1).write.mode("overwrite").parquet(entry)

    return write


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of batches in the ledger, with batch. schema: of the rows."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], f"{schema}, batch long")
    done = spark.read.parquet(f"{path}/ledger").select(F.col("batch").cast("long").alias("batch"))
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.join(done, "batch", "left_semi")


def current(rows: DataFrame, *keys: str, present: str) -> DataFrame:
    """rows (keys, finalized, batch, ...) as they stand: all final ones, and of a key's tentative ones those of its newest batch.

    A batch in which a key has nothing tentative any more says so by a row whose column `present` is null.
    """
    newest = rows.groupBy(*keys).agg(F.max("batch").alias("_newest"))
    stand = rows.join(newest, list(keys)).where(F.col("finalized") | (F.col("batch") == F.col("_newest")))
    return stand.where(F.col(present).isNotNull()).drop("_newest", "batch")
