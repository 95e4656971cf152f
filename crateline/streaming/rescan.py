"""Incremental upserts from a stream of scanned files (an extension: the batch operators don't need it).

Each micro-batch is reduced to the newest scan of each id and merged into a Parquet table of which every batch writes a new
version; nothing is held in the state store or on the driver, and a batch that is repeated writes its version again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Scans as they arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def arrivals(stream: DataFrame, time_col: str, every: str = "1 day", late: str = "30 days") -> DataFrame:
    """(from, format, n): scans per window of arrival and format; rows later than ``late`` are left out."""
    timed = stream.withColumn("at", F.timestamp_seconds(F.col(time_col))).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "format").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("from"), "format", "n")


def scan_order(order: list[str]) -> Column:
    return F.struct(*[F.coalesce(F.col(c).cast("bigint"), F.lit(-(1 << 62))) for c in order])


def newest_by_id(rows: DataFrame, order: list[str]) -> DataFrame:
    """The newest scan of each id; null ids have none."""
    cols = [c for c in rows.columns if c != "id"]
    return rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*cols), scan_order(order)).alias("t")).select("id", *[F.col(f"t.{c}").alias(c) for c in cols])


def version(folder: str, batch: int) -> str:
    return f"{folder}/v{batch:010d}"


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The versions that were written whole, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path)]
    return sorted(p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))


def upserted(stream: DataFrame, order: list[str], folder: str) -> DataFrame:
    """The table of newest scans after all that is there was merged; restarted, it goes on where it ended."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = version(f"{folder}/table", number)
        before = [v for v in versions(spark, f"{folder}/table") if v.rsplit("/", 1)[1] < own.rsplit("/", 1)[1]]
        rows = newest_by_id(batch, order)
        if before:
            rows = newest_by_id(spark.read.parquet(before[-1]).unionByName(rows), order)
        rows.write.mode("overwrite").parquet(own)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = versions(spark, f"{folder}/table")
    return spark.read.parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)


def counted(aggregate: DataFrame, folder: str) -> DataFrame:
    """A streaming aggregate run over all that is there, its last state as a table."""
    spark = aggregate.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(version(f"{folder}/table", number))

    aggregate.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = versions(spark, f"{folder}/table")
    return spark.read.parquet(done[-1]) if done else spark.createDataFrame([], aggregate.schema)
