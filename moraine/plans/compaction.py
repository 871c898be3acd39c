"""Compaction planning over file metadata (file_id, level, smallest_key, size, key_count, tombstones, max_ts).

One row stands for a file, so a level's array holds as many entries as the level has files, whatever rows they hold. Choices
that depend on order are folds over the sorted array of a level; all else is plain expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    base_bytes: int = 40_000
    fanout: int = 10
    level_zero_files: int = 5
    tier_files: int = 4

    def budget(self, level: Column) -> Column:
        return (F.lit(self.base_bytes) * F.pow(F.lit(float(self.fanout)), level)).cast("long")


def level_jobs(files: DataFrame, limits: Limits | None = None, clock: int = 1_000_000) -> DataFrame:
    """One row a level that has files: level, needed, n_inputs, bytes, reason, priority.

    Level 0 gives all its files. Another level gives, by smallest key, every file that still fits the next level's budget; a
    file that does not fit is passed over and the ones after it are tried. A level where none fits has no job and no
    row. A file's age is counted from max_ts to `clock`; read amplification is the number of files. No files give no rows.
    """
    limits = limits or Limits()
    level, n = F.col("level"), F.col("n_files")
    room = limits.budget(level + 1)
    stats = files.groupBy("level").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_size"), (F.sum("tombstones") / F.sum("key_count")).alias("tombstone_ratio"),
        F.avg(F.lit(clock) - F.col("max_ts")).alias("age"), F.array_sort(F.collect_list(F.struct("smallest_key", "file_id", "size"))).alias("files"),
    )
    empty = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n"))
    take = lambda acc, f: F.when(acc["bytes"] + f["size"] <= F.col("room"), F.struct((acc["bytes"] + f["size"]).alias("bytes"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    first = level == 0
    stats = stats.withColumn("room", room).withColumn("greedy", F.aggregate("files", empty, take))
    stats = stats.withColumn("bytes", F.when(first, F.col("total_size")).otherwise(F.col("greedy.bytes"))).withColumn("n_inputs", F.when(first, n).otherwise(F.col("greedy.n")))
    ratio = F.col("tombstone_ratio")
    needed = F.when(first, n >= limits.level_zero_files).otherwise((F.col("total_size") >= limits.budget(level)) | (n > 10) | (ratio > 0.3))
    reason = F.when(first | (n >= limits.fanout), "level_full").when(ratio > 0.2, "tombstone_cleanup").when(n > 5, "read_amplification").otherwise("size_threshold")
    extra = F.element_at(F.create_map(*[F.lit(x) for x in ("level_full", 100.0, "tombstone_cleanup", 30.0, "read_amplification", 20.0, "size_threshold", 0.0)]), F.col("reason"))
    other = F.col("bytes") / F.col("room") * 50.0 + F.col("n_inputs") * 5.0 + n * 2.0 + F.col("age") / 1e6 + extra
    out = stats.where("n_inputs > 0").withColumn("reason", reason).withColumn("priority", F.round(F.when(first, n * 10.0).otherwise(other), 6))
    return out.select("level", F.coalesce(needed, F.lit(False)).alias("needed"), "n_inputs", "bytes", "reason", "priority")


def pick_level_job(jobs: DataFrame) -> DataFrame:
    """The needed job of the highest priority; of equal ones that of the lowest level."""
    return jobs.where("needed").orderBy(F.desc("priority"), "level").limit(1)


def estimated_seconds(jobs: DataFrame) -> DataFrame:
    """level and seconds: bytes over a throughput that falls with the level, the number of inputs and compression; 1 at least."""
    speed = F.when(F.col("level") == 0, 20.0).when(F.col("level") == 1, 15.0).when(F.col("level") <= 3, 12.0).otherwise(8.0)
    by_reason = F.when(F.col("reason") == "tombstone_cleanup", 0.9).when(F.col("reason") == "read_amplification", 1.2).otherwise(1.0)
    rate = speed * by_reason / (1 + (F.col("n_inputs") - 1) * 0.05) / 1.3 * 1048576
    return jobs.select("level", F.greatest(F.ceil(F.col("bytes") / rate), F.lit(1)).cast("long").alias("seconds"))


def explained(jobs: DataFrame) -> DataFrame:
    said = F.format_string("Level %d: %s, %d files, %.1f MB, priority %.1f", "level", "reason", "n_inputs", F.col("bytes") / 1048576, "priority")
    return jobs.select("level", said.alias("said"))


def throttled(jobs: DataFrame, active_workers: int = 0, most_workers: int = 4, most_pending: int = 32, delay_ms: int = 10) -> DataFrame:
    """level, priority, throttled (all workers are at work or so many levels wait), delay_ms: halved for a pressing job."""
    pending = jobs.where("needed").agg(((F.count("*") >= most_pending) | F.lit(active_workers >= most_workers)).alias("throttled"))
    return jobs.join(F.broadcast(pending), F.lit(True)).select("level", "priority", "throttled", F.when(F.col("priority") > 0.8, delay_ms // 2).otherwise(delay_ms).alias("delay_ms"))


def size_tier(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """level, file_id, size, priority of the files that are merged next because their sizes are alike; no rows if there are none.

    In a level sorted by size a group starts at its smallest file and takes files of up to twice that size, the next
    group starts after it. The first group of at least `tier_files` files in the lowest level that has one is picked.
    """
    least = (limits or Limits()).tier_files
    state = lambda base, n, done: F.struct(base.cast("long").alias("base"), n.cast("long").alias("n"), done.alias("done"))
    step = lambda acc, x: (
        F.when(acc["done"], acc)
        .when((acc["n"] > 0) & (x <= 2 * acc["base"]), state(acc["base"], acc["n"] + 1, acc["done"]))
        .when(acc["n"] >= least, state(acc["base"], acc["n"], F.lit(True)))
        .otherwise(state(x, F.lit(1), F.lit(False)))
    )
    levels = files.groupBy("level").agg(F.sort_array(F.collect_list(F.col("size").cast("long"))).alias("sizes"))
    group = F.aggregate("sizes", state(F.lit(0), F.lit(0), F.lit(False)), step)
    found = levels.select(F.col("level").alias("at_level"), group.alias("g")).where(F.col("g.n") >= least)
    picked = found.orderBy("at_level").limit(1).select("at_level", F.col("g.base").alias("base"), (F.col("g.n") * 10).alias("priority"))
    inside = (F.col("level") == F.col("at_level")) & (F.col("size") >= F.col("base")) & (F.col("size") <= 2 * F.col("base"))
    return files.join(F.broadcast(picked), inside).select("level", "file_id", "size", "priority")
