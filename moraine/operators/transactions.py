"""Optimistic transactions over rows: conflicts, sequential commit, watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.operators.log import prefix
from moraine.storage import shared_root


def conflicts(ops: DataFrame, mode: str = "read") -> DataFrame:
    """txn_ids of which a key read (mode="advanced": or written) was committed by another with read_ts < its commit_ts < own commit_ts."""
    mine = ops if mode == "advanced" else ops.where("op = 'r'")
    theirs = ops.where("op = 'w'").select(F.col("txn_id").alias("o_txn"), F.col("k").alias("o_k"), F.col("commit_ts").alias("o_commit"))
    cond = (F.col("k") == F.col("o_k")) & (F.col("o_commit") > F.col("read_ts")) & (F.col("o_commit") < F.col("commit_ts")) & (F.col("txn_id") != F.col("o_txn"))
    return mine.join(theirs, cond, "left_semi").select("txn_id").distinct()


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def replay(ops: DataFrame) -> DataFrame:
    """(txn_id, committed): validation in commit order, where an aborted transaction's keys count for nothing.

    A transaction is settled once all earlier ones that it might conflict with are: it aborts if one of them committed. Each round settles
    at least the earliest open one, so the rounds are the longest chain of possible conflicts, not the number of transactions.
    """
    reads = ops.where("op = 'r'").select("txn_id", "k", "read_ts", "commit_ts").distinct()
    writes = ops.where("op = 'w'").select(F.col("txn_id").alias("other"), F.col("k").alias("o_k"), F.col("commit_ts").alias("o_commit")).distinct()
    cond = (F.col("k") == F.col("o_k")) & (F.col("o_commit") > F.col("read_ts")) & (F.col("o_commit") < F.col("commit_ts")) & (F.col("txn_id") != F.col("other"))
    waits = _cut(reads.join(writes, cond).select("txn_id", "other").distinct())
    done = ops.select("txn_id").distinct().join(waits, "txn_id", "left_anti").select("txn_id", F.lit(True).alias("committed"))
    open_waits = waits
    while not open_waits.isEmpty():
        state = open_waits.join(done.select(F.col("txn_id").alias("other"), "committed"), "other", "left").groupBy("txn_id").agg(F.bool_or("committed").alias("hit"), F.count_if(F.col("committed").isNull()).alias("unknown"))
        settled = state.where(F.col("hit") | (F.col("unknown") == 0)).select("txn_id", (~F.coalesce("hit", F.lit(False))).alias("committed"))
        done = _cut(done.unionByName(settled))
        open_waits = _cut(open_waits.join(done, "txn_id", "left_anti"))
    return done


def apply_commits(ops: DataFrame) -> DataFrame:
    """Writes of committed transactions as log rows (k, v, ts = commit_ts, meta): the last write of a key in a transaction counts."""
    last = Window.partitionBy("txn_id", "k").orderBy(F.desc("op_seq"))
    writes = ops.where("op = 'w'").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return writes.join(replay(ops).where("committed"), "txn_id", "left_semi").select("k", "v", F.col("commit_ts").alias("ts"), F.lit(0).alias("meta"))


def low_watermark_timeline(txns: DataFrame) -> DataFrame:
    """(at_ts, low): after every begin or end, the least read_ts among open transactions (null: none is open).

    The least read_ts of those that end later is that of an open one, or none is open: so a running minimum from the latest end
    back gives it, however long a transaction stays open.
    """
    instants = txns.select(F.col("read_ts").alias("at_ts")).union(txns.select("commit_ts")).distinct()
    rows = instants.select("at_ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("read_ts")).union(txns.select("commit_ts", F.lit(1), F.col("read_ts").cast("long")))
    least = prefix(rows, "at_ts", F.col("read_ts"), "least", "min", ties=("kind",), descending=True).where("kind = 0")
    return least.select("at_ts", F.when(F.col("least") <= F.col("at_ts"), F.col("least")).alias("low"))


def cleaned(committed: DataFrame, read_mark: int | None, now: int, threshold: int = 1000, most: int = 10_000) -> DataFrame:
    """What a clean-up of committed transactions (txn_id, commit_ts) leaves.

    Of those that ended before the least open read timestamp and before now - threshold, a quarter of `most` go, the oldest first;
    if more than `most` are left, the newest half of `most` stays.
    """
    safe = max(0, now - threshold) if read_mark is None else min(read_mark, max(0, now - threshold))
    old = committed.where(F.col("commit_ts") < safe).orderBy("commit_ts", "txn_id").limit(most // 4)
    left = committed.join(old.select("txn_id"), "txn_id", "left_anti").select("txn_id", "commit_ts")
    return left if left.count() <= most else left.orderBy(F.desc("commit_ts"), F.desc("txn_id")).limit(most // 2)


def group_watermark(pending: DataFrame) -> DataFrame:
    """(low): the least pending ts of a group of marks (mark, ts); the largest long where nothing is pending."""
    return pending.groupBy("mark").agg(F.min("ts").alias("ts")).agg(F.coalesce(F.min("ts"), F.lit(2**63 - 1)).alias("low"))


def key_sets(ops: DataFrame) -> DataFrame:
    """txn_id, reads, writes: the sorted distinct keys that each transaction has read and written; writes are its conflict keys."""
    keys = lambda op: F.array_sort(F.collect_set(F.when(F.col("op") == op, F.col("k"))))
    return ops.groupBy("txn_id").agg(keys("r").alias("reads"), keys("w").alias("writes"))


class Oracle:
    """The one counter of read and commit timestamps, on the driver."""

    def __init__(self, start: int = 1):
        self.next, self.reading = start, {}

    def begin(self) -> int:
        ts, self.next = self.next, self.next + 1
        self.reading[ts] = self.reading.get(ts, 0) + 1
        return ts

    def done(self, read_ts: int) -> None:
        self.reading[read_ts] -= 1
        if not self.reading[read_ts]:
            del self.reading[read_ts]

    def commit_ts(self) -> int:
        ts, self.next = self.next, self.next + 1
        return ts

    def low_watermark(self) -> int | None:
        return min(self.reading, default=None)

    def safe_for_gc(self, ts: int) -> bool:
        low = self.low_watermark()
        return low is None or ts < low
