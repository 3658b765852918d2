"""Structured Streaming forms of the keyed tables: append logs, windows with a watermark, caches that expire, latest rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their values by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def once_each(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Repeats of a key are dropped, however late and in whatever batch they come: no watermark, the state is one key for each id."""
    return events.dropDuplicates([key])


#: State on disk, since that of once_each grows with the ids.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, then stop; a later call goes on from the checkpoint."""
    conf, (name, store) = stream.sparkSession.conf, STATE_STORE
    before = conf.get(name, None)
    conf.set(name, store)
    try:  # the stream takes its settings as it starts
        return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)
