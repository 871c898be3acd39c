"""Binary records of the write-ahead log and sorted table files, as columns and as Spark data sources.

A record is a little-endian header (key length u32, value length u32, timestamp u64, flags u8) and key and value. A sorted
table file holds records in key order and a footer (record count u64, CRC32 of the records u32, magic u32). Damaged or zero-filled
tails end a replay; a table file whose records do not meet their checksum is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from moraine.storage import fresh_path

HEAD, FOOT = struct.Struct("<IIQB"), struct.Struct("<QII")
#: The magics of table files and of blocks; the bytes of entries that a block is filled to.
MAGIC, BLOCK_MAGIC, BLOCK_BYTES = 0xCAFEBABE, 0x424C4F43, 4096
SCHEMA = "k string, v string, ts long, meta int"


def encode(k: bytes, v: bytes, ts: int, meta: int) -> bytes:
    return HEAD.pack(len(k), len(v), ts, meta) + k + v


def decode(data: bytes) -> Iterator[tuple[bytes, bytes, int, int]]:
    """Records up to the end, a zero key length or a cut-off record."""
    at = 0
    while at + HEAD.size <= len(data):
        n, m, ts, meta = HEAD.unpack_from(data, at)
        at += HEAD.size
        if n == 0 or at + n + m > len(data):
            return
        yield data[at : at + n], data[at + n : at + n + m], ts, meta
        at += n + m


def little(number: Column, size: int) -> Column:
    """The hex of a little-endian field of `size` bytes."""
    h = F.lpad(F.hex(number), 2 * size, "0")
    return F.concat(*[F.substring(h, i, 2) for i in range(2 * size - 1, 0, -2)])


def encoded(log: DataFrame) -> DataFrame:
    """The record of every row, by built-in functions: little-endian fields are reversed hex."""
    sizes = [little(F.octet_length(c), 4) for c in ("k", "v")]
    return log.select("*", F.unhex(F.concat(*sizes, little(F.col("ts"), 8), little(F.col("meta"), 1), F.hex("k"), F.hex("v"))).alias("record"))


def block_entries(runs: DataFrame) -> DataFrame:
    """file_id, block_no and k, v, ts, meta of every entry: the files and blocks of the view `blocks`, entry by entry. A null value counts as empty."""
    files = runs.select((F.col("run_id") * 100 + F.floor(F.substring("k", 6, 6).cast("int") / 30.0)).cast("int").alias("file_id"), "k", F.coalesce("v", F.lit("")).alias("v"), "ts", "meta")
    before = Window.partitionBy("file_id").orderBy("k", "ts").rowsBetween(Window.unboundedPreceding, -1)
    size = HEAD.size + F.length("k") + F.length("v")
    return files.select("file_id", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / BLOCK_BYTES).cast("int").alias("block_no"), "k", "v", "ts", "meta")


def block_checksums(entries: DataFrame) -> DataFrame:
    """file_id, block_no, crc: the CRC32 of the block's header (magic, entries, least and largest ts) and its records by k and ts."""
    rows = encoded(entries).groupBy("file_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("k", "ts", "record"))).alias("rs"), F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    head = F.concat(little(F.lit(BLOCK_MAGIC), 4), little(F.col("n"), 4), little(F.col("low"), 8), little(F.col("high"), 8))
    return rows.select("file_id", "block_no", F.crc32(F.unhex(F.concat(head, F.array_join(F.transform("rs", lambda r: F.hex(r["record"])), "")))).alias("crc"))


def verify_checksums(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """file_id, block_no, stored, crc, intact of every block of either side; a block without entries or without a stored sum is not intact."""
    out = stored.select("file_id", "block_no", F.col("crc").alias("stored")).join(block_checksums(entries), ["file_id", "block_no"], "full")
    return out.select("file_id", "block_no", "stored", "crc", F.coalesce(F.col("stored") == F.col("crc"), F.lit(False)).alias("intact"))


def encode_log(log: DataFrame) -> DataFrame:
    return encoded(log).select("ts", F.lower(F.hex("record")).alias("record"))


def sealed(entries: list[bytes], footer: bool) -> bytes:
    """A table file of encoded records, or a log segment with a zero-filled tail."""
    data = b"".join(entries)
    return data + (FOOT.pack(len(entries), zlib.crc32(data), MAGIC) if footer else bytes(64))


def unsealed(content: bytes, name: str = "file") -> bytes:
    """The records of a table file; refuses a file without the magic or whose records do not meet the checksum."""
    _, crc, magic = FOOT.unpack(content[-FOOT.size :])
    data = content[: -FOOT.size]
    if magic != MAGIC:
        raise ValueError(f"{name} is no table file")
    if zlib.crc32(data) != crc:
        raise ValueError(f"{name} does not meet its checksum")
    return data


def replay(files: DataFrame, footer: bool = False) -> DataFrame:
    """Rows of binaryFile-like input (content), of log segments or (footer) of table files, whose checksums are verified."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                got = [(k.decode(), v.decode(), ts, meta) for k, v, ts, meta in decode(unsealed(content) if footer else content)]
                yield pd.DataFrame(got, columns=["k", "v", "ts", "meta"])

    return files.select("content").mapInPandas(rows, SCHEMA)


def read_files(spark: SparkSession, path: str, footer: bool) -> DataFrame:
    """Rows of the log or table files of a path or glob of any file system that Spark reads."""
    return replay(spark.read.format("binaryFile").load(path), footer)


def segments(log: DataFrame, order: str = "ts", footer: bool = False, size: int = 4 << 20) -> DataFrame:
    """The log as binary files (content) of about `size` bytes, each a run of rows in rising order: log segments with a zero-filled tail, or table files with a footer.

    Ranges of the order column are cut on their own, so no task holds more than its range and one file.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for record in b["record"]:
                held.append(record)
                n += len(record)
                if n >= size:
                    yield pd.DataFrame({"content": [sealed(held, footer)]})
                    held, n = [], 0
        if held:
            yield pd.DataFrame({"content": [sealed(held, footer)]})

    return encoded(log).repartitionByRange(F.col(order)).sortWithinPartitions(order).select("record").mapInPandas(cut, "content binary")


def replay_roundtrip(log: DataFrame) -> DataFrame:
    return replay(segments(log))


class Files(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, footer: bool):
        self.options, self.footer = options, footer

    def partitions(self) -> list[Files]:
        import glob

        return [Files(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: Files) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        if self.footer:
            data = unsealed(data, partition.path)
        for k, v, ts, meta in decode(data):
            yield k.decode(), v.decode(), ts, meta


class WalSource(DataSource):
    """spark.read.format("moraine_wal").load(glob): log files on a path that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "moraine_wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options, False)


class TableSource(WalSource):
    @classmethod
    def name(cls) -> str:
        return "moraine_table"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options, True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WalSource)
    spark.dataSource.register(TableSource)


def write_table_file(rows: list[tuple[str, str, int, int]], path: str) -> None:
    """A sorted table file of rows in strictly rising key order."""
    if any(a[0] >= b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("keys must rise")
    with open(path, "wb") as f:
        f.write(sealed([encode(k.encode(), v.encode(), ts, meta) for k, v, ts, meta in rows], True))


def table_roundtrip(log: DataFrame) -> DataFrame:
    """The newest versions through table files that a Spark writer has written and a binary reader verifies and reads."""
    from moraine.operators.log import latest

    spark, path = log.sparkSession, fresh_path(log.sparkSession, "tables")
    segments(latest(log), "k", footer=True).write.parquet(path)
    return replay(spark.read.parquet(path), footer=True)
