"""The log as a stream: tumbling, sliding and session windows under an event watermark, and micro-batches merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from moraine.storage import fresh_path


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 4).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now: each trigger's complete result replaces the table in the shared folder."""
    path = fresh_path(stream.sparkSession, "stream")
    replace = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/result")
    query = stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(_source(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")), "complete")


def _generations(stream: DataFrame, mode: str) -> DataFrame:
    """What each trigger gives, with its number as `batch`: a replayed trigger overwrites its own generation."""
    path = fresh_path(stream.sparkSession, "generations")
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)


def window_counts(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """(start, *by, n) of a stream with an event time `at`: rows of each window, the newest count that a trigger gave.

    Update mode: the state of a window goes once the watermark has passed its end, and rows that come a trigger later are dropped.
    """
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width, slide).alias("w"), *by).agg(F.count("*").alias("n"))
    newest = _generations(counts.select(F.col("w.start").alias("start"), *by, "n"), "update")
    return newest.groupBy("start", *by).agg(F.max_by("n", "batch").alias("n"))


def session_counts(stream: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n) of every session that the watermark has closed; stop is the last row's time plus the gap.

    Append mode: a session is given once, when no row that may still come can lengthen it; younger ones stay in the state.
    """
    counts = stream.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return _generations(counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"), "append").drop("batch")


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A row for every distinct set of key values within the time that rows may be late; its state is bounded by the watermark."""
    return _generations(stream.withWatermark("at", late).dropDuplicatesWithinWatermark(keys).select(*keys), "append").drop("batch")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = window_counts(_source(spark, sf_dir), "1 hour", by=("event_type",))
    return counts.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = window_counts(_source(spark, sf_dir), "1 hour", "30 minutes")
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start_at"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = session_counts(_source(spark, sf_dir), "user_id", "6 hours", "2 days")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_at"), F.col("stop").cast("timestamp_ntz").alias("stop_at"), "n")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(_source(spark, sf_dir), ["event_id"])


def stream_apply_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """foreachBatch: each micro-batch is one atomic generation of the table, keyed by batch id, so a replayed batch changes nothing."""
    path = fresh_path(spark, "generations")

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = _source(spark, sf_dir).writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
