"""Value separation: large values live in value-log files, the log keeps pointers (file_id, offset, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.log import running_total

HEADER, THRESHOLD, FILE_BYTES = 12, 1024, 1 << 20


def assign_pointers(values: DataFrame, order: str = "doc_id", payload: str = "text", threshold: int = THRESHOLD, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Add n, is_external, file_id and log_offset: where each value stands in the value log, in the order of a numeric column.

    Values of equal order stand by their hash, so equal rows may change places but no offset is given twice; those without one stand last.
    """
    sized = values.withColumn("n", F.coalesce(F.octet_length(payload).cast("long"), F.lit(0)))
    placed = running_total(sized, order, F.col("n") + HEADER, "end_off", ties=(F.xxhash64(payload),))
    return placed.select("*", (F.col("n") >= threshold).alias("is_external"), F.floor(F.col("end_off") / file_bytes).cast("int").alias("file_id"), (F.col("end_off") - F.col("n") - HEADER).alias("log_offset")).drop("end_off")


def dereference(pointers: DataFrame, value_log: DataFrame) -> DataFrame:
    return pointers.join(value_log, ["file_id", "log_offset"])


def discard_ratios(value_log: DataFrame, live_pointers: DataFrame) -> DataFrame:
    """file_id, total, discarded, ratio: an entry without a live pointer is discarded."""
    alive = live_pointers.select("file_id", "log_offset").withColumn("alive", F.lit(1))
    size = F.col("n") + HEADER
    out = value_log.join(alive, ["file_id", "log_offset"], "left").groupBy("file_id").agg(F.sum(size).alias("total"), F.sum(F.when(F.col("alive").isNull(), size).otherwise(0)).alias("discarded"))
    return out.withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("discarded") / F.col("total")).otherwise(0.0), 6))


def live_entries(value_log: DataFrame, live_pointers: DataFrame, minimum_ratio: float = 0.5) -> DataFrame:
    """What a rewrite keeps of the files worth reclaiming."""
    files = discard_ratios(value_log, live_pointers).where(F.col("ratio") >= minimum_ratio).select("file_id")
    return value_log.join(files, "file_id", "left_semi").join(live_pointers.select("file_id", "log_offset"), ["file_id", "log_offset"], "left_semi")
