"""Epoch windows over event streams: an extension beside the batch operators.

The batch rules for epochs (fixed length, whole ones only) and noisy epochs (peak to peak) hold for event time: tumbling
windows with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "1 day", time: str = "ts", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """window_start, by, n, mean, ptp of each tumbling window; with a watermark if late is given."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("ptp"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "mean", "ptp")


def run_available(spark: SparkSession, folder: str, name: str, schema: str, out: str, checkpoint: str, late: str = "1 day", files: int | None = None, by: tuple[str, ...] = ("event_type",), **options) -> DataFrame:
    """All rows present in folder's files of that name, streamed through windowed() into Parquet; read back.

    The stream writes, for each batch, the windows that the batch has changed, into a folder of the batch's number, so a
    batch that is repeated replaces itself; a window is what its last batch says. Windows that the watermark has passed
    leave the state, and rows that come later than late behind are dropped then. files bounds a batch.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    result = windowed(stream, late=late, by=by, **options)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], result.schema)
    held = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    keys, values = ["window_start", *by], [c for c in result.columns if c not in ("window_start", *by)]
    last = held.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*result.columns)
