"""Series and expert weights from event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_sums(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """(series_id, ds, value, n): sums of tumbling windows; rows later than the watermark are left out.

    The state is a decimal sum and a count for each open window and series, and goes when the watermark passes.
    For a backfill, whose files may come in any order, `late` is None: no row is late, and all state stays to the end.
    """
    own = events.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").alias("v"))
    timed = own if late is None else own.withWatermark("ts", late)
    sums = timed.groupBy("series_id", F.window("ts", width).alias("w")).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return sums.select("series_id", F.col("w.start").alias("ds"), F.col("v").cast("double").alias("value"), "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, keys: tuple[str, ...] = ("series_id", "ds")) -> DataFrame:
    """Runs a stream over what is there and returns its rows, complete windows and open ones.

    Each batch writes the windows that it touched to a folder beside the checkpoint, anew if it is repeated; the last
    state of a window is its row.
    """
    spark, out = stream.sparkSession, f"{checkpoint}-rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    write(spark.createDataFrame([], stream.schema), -1)  # no file, no batch
    query = stream.writeStream.outputMode("update").foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*").select(stream.columns)
