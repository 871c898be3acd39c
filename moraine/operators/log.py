"""Reads, scans, overlays and merges of a versioned change log (k, v, ts, meta)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETED, TOMBSTONE, COMPRESSED, EXTERNAL = 1, 2, 4, 8


def flagged(flag: int, meta: str = "meta") -> Column:
    return F.col(meta).bitwiseAND(flag) != 0


def latest(log: DataFrame) -> DataFrame:
    """The newest version of every key, tombstones included. The rank filter prunes before the shuffle."""
    newest = Window.partitionBy("k").orderBy(F.desc("ts"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def live(log: DataFrame) -> DataFrame:
    """The newest version of every key that is not deleted: a tombstone hides all that came before it."""
    return latest(log).where(~flagged(DELETED))


def as_of(log: DataFrame, read_ts: int) -> DataFrame:
    """The snapshot that a reader with this timestamp sees."""
    return live(log.where(F.col("ts") <= read_ts))


def point_get(log: DataFrame, key: str) -> DataFrame:
    return live(log.where(F.col("k") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v, ts) for every asked key, nulls where it is absent or deleted. The log is reduced to asked keys before it is sorted."""
    asked = keys.select("k").distinct()
    return asked.join(live(log.join(asked, "k", "left_semi")).select("k", "v", "ts"), "k", "left")


def existing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("k").distinct().join(live(log), "k", "left_semi")


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("k").distinct().join(live(log), "k", "left_anti")


def in_range(start: str | None, end: str | None) -> Column:
    """Half-open [start, end); an open side is None."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("k") >= start)
    if end is not None:
        cond = cond & (F.col("k") < end)
    return cond


def scan(log: DataFrame, start: str | None = None, end: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Live entries of a key range in key order."""
    found = live(log.where(in_range(start, end))).orderBy(F.desc("k") if reverse else F.asc("k"))
    return found if limit is None else found.limit(limit)


def after_prefix(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Live entries whose key starts with prefix; an empty prefix gives none. String prefixes reach the scan as a filter."""
    return live(log.where(F.col("k").startswith(prefix) if prefix else F.lit(False)))


def search_range(keys: DataFrame, first: str, last: str) -> DataFrame:
    """(start, stop, n) of the sorted distinct keys in the closed range: positions from counts, no global sort."""
    below = F.count_if(F.col("k") < first)
    inside = F.count_if((F.col("k") >= first) & (F.col("k") <= last))
    return keys.select("k").distinct().agg(below.alias("start_pos"), (below + inside).alias("stop_pos"), inside.alias("n"))


def overlay(snapshot: DataFrame, writes: DataFrame) -> DataFrame:
    """Read your writes: the write set (k, v, meta) wins over the snapshot (k, v), its deletes mask."""
    return snapshot.select("k", "v").join(writes, "k", "left_anti").unionByName(writes.where(~flagged(DELETED)).select("k", "v"))


def merge(*runs: DataFrame, bottom: bool = False) -> DataFrame:
    """k-way merge: the newest version of every key over all runs; tombstones go only at the bottom level."""
    union = runs[0]
    for r in runs[1:]:
        union = union.unionByName(r)
    return live(union) if bottom else latest(union)


def write_run(log: DataFrame, path: str, files: int) -> None:
    """A sorted run: key ranges to files, keys sorted inside, so that row-group bounds prune; Bloom filters on the key."""
    (latest(log).repartitionByRange(files, "k").sortWithinPartitions("k").write
        .option("parquet.bloom.filter.enabled#k", "true").parquet(path))


def ranged(df: DataFrame, order: str, buckets: int | None = None) -> Column:
    """Number of the range that a row's value of a numeric column falls in, ranges of about equal numbers of rows; null for null.

    The bounds are quantiles of the column, in a literal of two levels, so a row is held against the square root of them.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    x = F.col(order)
    if not bounds:
        return F.when(x.isNotNull(), 0)
    side = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + side] for k in range(0, len(bounds), side)]
    below = lambda held: F.size(F.filter(held, lambda b: b < x))
    first = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inside = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), first)
    return F.when(x.isNotNull(), first * side + F.when(first < len(groups), below(inside)).otherwise(0))


def prefix(df: DataFrame, order: str, value: Column, out: str, how: str = "sum", ties: tuple = (), descending: bool = False, peers: bool = False, buckets: int | None = None) -> DataFrame:
    """Running sum or minimum of value in the order of a numeric column and of `ties`, without one task that holds all rows.

    Ranges of the order column run on their own; what the ranges before amount to is added from a table of one row per range. Rows without
    a value of the order column come last. peers: rows equal in order and ties all get what their last one has.
    """
    agg = {"sum": F.sum, "min": F.min}[how]
    number = ranged(df, order, buckets)
    dealt = df.withColumn("_b", F.coalesce(-number if descending else number, F.lit(1 << 30))).withColumn("_v", value)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_b").agg(agg("_v").alias("_s")).select("_b", agg("_s").over(before).alias("_base"))
    own = Window.partitionBy("_b").orderBy(F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), *ties)
    own = (own.rangeBetween if peers else own.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    both = dealt.withColumn("_own", agg("_v").over(own)).join(F.broadcast(base), "_b")
    total = F.least("_base", "_own") if how == "min" else F.coalesce("_base", F.lit(0)) + F.coalesce("_own", F.lit(0))
    return both.withColumn(out, total).drop("_b", "_v", "_own", "_base")


def running_total(df: DataFrame, order: str, value: Column, out: str, buckets: int | None = None, ties: tuple = ()) -> DataFrame:
    """Running sum as a long; see prefix."""
    return prefix(df, order, value, out, ties=ties, buckets=buckets).withColumn(out, F.col(out).cast("long"))


def trailing_count(df: DataFrame, order: str, width: int, out: str) -> DataFrame:
    """Rows whose value of a numeric column is in [x - width, x] for each row's x. Rows without a value are left out.

    Ranges of 16 widths are counted each with the rows of the width before it, so no task holds all rows.
    """
    slot = lambda x: F.floor(x / (16 * width))
    each = df.withColumn("_slot", F.explode(F.sequence(slot(F.col(order)), slot(F.col(order) + width))))
    near = Window.partitionBy("_slot").orderBy(order).rangeBetween(-width, 0)
    return each.withColumn(out, F.count("*").over(near)).where(F.col("_slot") == slot(F.col(order))).drop("_slot")


def floor_lookup(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each (file_id, k) the last block whose first key is not above k: an as-of join by one sorted pass per file."""
    rows = blocks.select("file_id", F.col("first_key").alias("k"), "block_no", F.lit(0).alias("_q")).unionByName(keys.select("file_id", "k", F.lit(None).cast("int").alias("block_no"), F.lit(1).alias("_q")))
    at = Window.partitionBy("file_id").orderBy("k", "_q").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block_no", F.last("block_no", ignorenulls=True).over(at)).where("_q = 1").drop("_q")
