"""Every query against DuckDB on the smallest tables, and the operators against plain Python models."""

import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine import catalog, views
from moraine.config import PRESETS, Options
from moraine.functions import codecs
from moraine.operators import log, transactions
from moraine.plans import compaction
from moraine.sources import records

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, data):
    by = sorted(names)
    return sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in by]) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in views.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def events_of_many_users(path, n=4000, users=6100):
    """Key buckets beyond 100, so that files of several runs and levels share an id."""
    con = duckdb.connect()
    con.sql(f"""copy (select i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, (i * 37) % {users} as user_id, 'click' as event_type, i * 0.5 as value,
      format('{{{{"k": {{}}}}}}', i % 100) as props from range({n}) t(i)) to '{path}/events.parquet' (format parquet)""")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    return con


def test_manifest_fold_where_files_share_an_id(spark, tmp_path):
    con = events_of_many_users(tmp_path)
    assert con.sql(f"select count(*) - count(distinct file_id) from ({catalog.ORACLE_SQL['manifest_fold']})").fetchall()[0][0] > 50
    got, want = catalog.QUERIES["manifest_fold"](spark, str(tmp_path)), con.sql(catalog.ORACLE_SQL["manifest_fold"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
    changes = [(1, "add_table", 7, 0), (1, "add_table", 7, 2), (2, "add_table", 8, 0), (3, "delete_table", 8, 0), (4, "add_table", 8, 1), (5, "add_table", 9, 0), (5, "delete_table", 9, 0), (None, "add_table", None, 3)]
    live = catalog.fold_manifest(spark.createDataFrame(changes, "seq long, type string, file_id long, level int")).collect()
    assert sorted(map(repr, map(tuple, live))) == ["(7, 0)", "(7, 2)", "(8, 1)", "(None, 3)"]


def test_manifest_by_level_where_files_share_an_id(spark, tmp_path):
    con = events_of_many_users(tmp_path)
    want = dict(con.sql(catalog.ORACLE_SQL["manifest_by_level"]).fetchall())
    assert len(want) == 3 and {r.level: r.n for r in catalog.QUERIES["manifest_by_level"](spark, str(tmp_path)).collect()} == want


def random_log(n=400, keys=25, seed=5):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys):02d}", f"v{i}", i + 1, 3 if r.random() < 0.2 else 0) for i in range(n)]


def model(entries, ts=10**9):
    state = {}
    for k, v, t, m in entries:
        if t <= ts:
            state[k] = (v, m)
    return {k: v for k, (v, m) in state.items() if not m & 1}


def test_reads_equal_a_dict_of_versions(spark):
    entries = random_log()
    df = spark.createDataFrame(entries, records.SCHEMA)
    for ts in (0, 50, 200, 400):
        assert {r.k: r.v for r in log.as_of(df, ts).collect()} == model(entries, ts)
    want = model(entries)
    assert [r.k for r in log.scan(df, "k05", "k15").collect()] == sorted(k for k in want if "k05" <= k < "k15")
    assert [r.k for r in log.scan(df, reverse=True, limit=4).collect()] == sorted(want, reverse=True)[:4]
    keys = spark.createDataFrame([("k01",), ("zz",), ("k01",)], "k string")
    assert {r.k: r.v for r in log.multi_get(df, keys).collect()} == {"k01": want.get("k01"), "zz": None}
    assert log.prefix_scan(df, "").count() == 0
    merged = log.merge(df.where("ts % 3 = 0"), df.where("ts % 3 = 1"), df.where("ts % 3 = 2"), bottom=True)
    assert {r.k: r.v for r in merged.collect()} == want
    total = log.running_total(df, "ts", log.F.lit(2), "sum", 7).orderBy("ts").collect()
    assert [r["sum"] for r in total] == [2 * (i + 1) for i in range(len(entries))]


def test_literal_ranges(spark):
    keys = spark.createDataFrame([(k,) for k in ("apple", "banana", "cherry", "date", "elderberry")], "k string")
    assert tuple(log.search_range(keys, "banana", "date").first()) == (1, 4, 3)
    assert log.search_range(keys, "fig", "grape").first().n == 0
    assert log.search_range(keys, "a", "z").first().n == 5
    assert log.after_prefix(b"ab\xff") == b"ac" and log.after_prefix(b"\xff") is None


def test_replay_equals_sequential_validation(spark):
    r = random.Random(2)
    ops, txns = [], []
    for i in range(60):
        read_ts = 10 * i + 1
        commit = read_ts + r.choice([4, 24, 44]) + 1
        reads, writes = {f"k{r.randrange(12)}" for _ in range(3)}, {f"k{r.randrange(12)}" for _ in range(2)}
        txns.append((i, read_ts, commit, reads, writes))
        ops += [(i, n, "r", k, None, read_ts, commit) for n, k in enumerate(sorted(reads))] + [(i, 5 + n, "w", k, f"v{i}", read_ts, commit) for n, k in enumerate(sorted(writes))]
    done, want = [], {}
    for i, read_ts, commit, reads, writes in sorted(txns, key=lambda t: t[2]):
        want[i] = not any(read_ts < c < commit and reads & w for c, w in done)
        if want[i]:
            done.append((commit, writes))
    df = spark.createDataFrame(ops, "txn_id int, op_seq int, op string, k string, v string, read_ts int, commit_ts int")
    assert {x.txn_id: x.committed for x in transactions.replay(df).collect()} == want


FILES = "file_id int, level int, smallest_key string, size long, key_count long, tombstones long, max_ts long"


def test_level_jobs_equal_a_loop(spark):
    r = random.Random(3)
    files = [(i, r.choice([0, 1, 1, 2]), f"k{r.randrange(40):02d}", r.randrange(1, 900), 10, r.randrange(5), r.randrange(1000)) for i in range(60)]
    limits = compaction.Limits(base_bytes=10, fanout=10)
    got = {x.level: x for x in compaction.level_jobs(spark.createDataFrame(files, FILES).repartition(5), limits, 1000).collect()}
    for level in (1, 2):
        mine = sorted((f for f in files if f[1] == level), key=lambda f: (f[2], f[0]))
        room, used, n = 10 * 10 ** (level + 1), 0, 0
        for f in mine:
            if used + f[3] <= room:
                used, n = used + f[3], n + 1
        ratio = sum(f[5] for f in mine) / sum(f[4] for f in mine)
        reason, extra = ("level_full", 100) if len(mine) >= 10 else ("tombstone_cleanup", 30) if ratio > 0.2 else ("read_amplification", 20) if len(mine) > 5 else ("size_threshold", 0)
        want = used / room * 50 + n * 5 + len(mine) * 2 + sum(1000 - f[6] for f in mine) / len(mine) / 1e6 + extra
        assert (got[level].bytes, got[level].n_inputs, got[level].reason) == (used, n, reason) and abs(got[level].priority - want) < 1e-5
    assert got[0].n_inputs == sum(f[1] == 0 for f in files) and got[0].priority == 10.0 * got[0].n_inputs
    assert compaction.level_jobs(spark.createDataFrame([], FILES)).count() == 0


def test_size_tier_takes_the_first_group(spark):
    def pick(*sizes):
        files = spark.createDataFrame([(i, level, "k", n, 1, 0, 0) for i, (level, n) in enumerate(sizes)], FILES)
        return sorted((x.level, x.size, x.priority) for x in compaction.size_tier(files).collect())

    assert pick((0, 1), (0, 2), (0, 2), (0, 5), (0, 6), (0, 9), (0, 10), (0, 11), (1, 7)) == [(0, n, 40) for n in (5, 6, 9, 10)]
    assert pick(*[(0, n) for n in (1, 3, 9, 27)], *[(2, 8)] * 4, *[(3, 1)] * 9) == [(2, 8, 40)] * 4
    assert pick((0, 4), (0, 4), (0, 4)) == [] and pick() == []


def test_oracle_watermark():
    o = transactions.Oracle()
    a, b = o.begin(), o.begin()
    assert o.low_watermark() == a and o.safe_for_gc(a - 1) and not o.safe_for_gc(a)
    o.done(a)
    assert o.low_watermark() == b
    o.done(b)
    assert o.low_watermark() is None


def test_codecs():
    assert codecs.fnv1a(b"abc") == 0xE71FA2190541574B
    assert codecs.fnv1a_many([b"abc", b"", b"abcd"]).tolist() == [codecs.fnv1a(x) for x in (b"abc", b"", b"abcd")]
    bits, hashes = codecs.bloom_size(1000)
    assert (bits, hashes) == (9586, 7)
    odd = [b"", b"k", b"12345678", b"123456789", "\u00e9".encode() * 20, b"x" * 1000]
    assert codecs.seeded_hashes(odd, np.arange(5)).tolist() == [[codecs.seeded_hash(x, i) for i in range(5)] for x in odd]
    data = records.encode(b"k", b"v", 7, 3) + records.encode(b"kk", b"", 8, 0)
    assert list(records.decode(data + b"\0" * 40)) == [(b"k", b"v", 7, 3), (b"kk", b"", 8, 0)]
    assert list(records.decode(data[:-1])) == [(b"k", b"v", 7, 3)]


def test_no_false_negatives(spark):
    df = spark.createDataFrame([(i % 4, f"k{i}") for i in range(400)], "run_id int, k string")
    maybe = {(r.run_id, r.k): r.maybe for r in codecs.bloom_probe(df, df).collect()}
    assert all(maybe[i % 4, f"k{i}"] for i in range(400)) and sum(maybe.values()) < 460
    for r in codecs.bloom_filters(df).collect():
        held = np.unpackbits(np.frombuffer(bytes(r.filter), dtype=np.uint8), bitorder="little")
        want = {codecs.seeded_hash(f"k{i}".encode(), j) % r.bits for i in range(r.run_id, 400, 4) for j in range(r.hashes)}
        assert (r.bits, r.hashes) == codecs.bloom_size(100) and set(np.flatnonzero(held).tolist()) == want
    none = df.limit(0)
    assert codecs.bloom_filters(none).count() == 0 and codecs.bloom_probe(none, df).count() == 0
    nulls = spark.createDataFrame([(7, None), (7, "a"), (7, "a"), (9, None)], "run_id int, k string")
    assert [tuple(r) for r in codecs.bloom_probe(nulls, nulls).collect()] == [(7, "a", True)]


def test_record_sources(spark, tmp_path):
    records.register(spark)
    rows_ = [("apple", "10", 1, 0), ("banana", "20", 2, 0), ("cherry", "30", 3, 0)]
    records.write_table_file(rows_, str(tmp_path / "a.sst"))
    assert sorted(map(tuple, spark.read.format("moraine_table").load(str(tmp_path / "*.sst")).collect())) == rows_
    (tmp_path / "a.log").write_bytes(b"".join(records.encode(k.encode(), v.encode(), t, m) for k, v, t, m in rows_) + b"\0" * 64)
    assert sorted(map(tuple, spark.read.format("moraine_wal").load(str(tmp_path / "*.log")).collect())) == rows_
    with pytest.raises(ValueError):
        records.write_table_file(rows_ + rows_[:1], str(tmp_path / "b.sst"))


def test_block_checksums(spark, tmp_path):
    entries = records.block_entries(views.view(spark, SF, "kv_runs")).cache()
    blocks = {}
    for r in sorted(entries.collect(), key=lambda r: (r.file_id, r.block_no, r.k, r.ts)):
        blocks.setdefault((r.file_id, r.block_no), []).append(r)
    want = {}
    for at, rs in blocks.items():
        head = struct.pack("<IIQQ", records.BLOCK_MAGIC, len(rs), min(r.ts for r in rs), max(r.ts for r in rs))
        want[at] = zlib.crc32(head + b"".join(records.encode(r.k.encode(), r.v.encode(), r.ts, r.meta) for r in rs))
    stored = catalog.QUERIES["block_crc32"](spark, SF)
    assert {(r.file_id, r.block_no): r.crc for r in stored.collect()} == want
    layout = {(r.file_id, r.block_no): r.n for r in views.view(spark, SF, "blocks").collect()}
    assert layout == {at: len(rs) for at, rs in blocks.items()}
    assert records.verify_checksums(entries, stored).where("not intact").count() == 0
    hit = next(rs for rs in blocks.values() if len(rs) > 2)[1]
    inner = F.col("ts") == hit.ts
    for c, new in (("v", F.concat("v", F.lit("x"))), ("meta", F.col("meta") + 1), ("k", F.concat("k", F.lit("x"))), ("ts", F.col("ts") + 1000000)):
        bad = records.verify_checksums(entries.withColumn(c, F.when(inner, new).otherwise(F.col(c))), stored).where("not intact").collect()
        assert [(r.file_id, r.block_no) for r in bad] == [(hit.file_id, hit.block_no)]
    assert records.verify_checksums(entries.where(f"file_id <> {hit.file_id}"), stored).where("not intact and crc is null").count() > 0
    records.register(spark)
    records.write_table_file([("a", "10", 1, 0), ("b", "20", 2, 0), ("c", "30", 3, 0)], str(tmp_path / "a.sst"))
    data = (tmp_path / "a.sst").read_bytes()
    (tmp_path / "a.sst").write_bytes(data.replace(b"b20", b"b21"))
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("moraine_table").load(str(tmp_path / "*.sst")).collect()


def test_options():
    base = Options.preset()
    assert base.problems() == [] and base.compression == "zlib" and not base.sync_writes
    assert all(Options.preset(p).problems() == [] for p in PRESETS)
    assert Options.preset("production").num_compactors == 8 and not Options.preset("development").summary()["compressed"]
    assert len(base.replace(bloom_false_positive=2.0, level_size_multiplier=1, compression_level=0, num_memtables=0).problems()) == 4
    assert base.level_budget(0) == 2 << 20 and base.level_budget(2) == (2 << 20) * 100 and base.level_budget(60) == 2**63 - 1
    assert base.writer_options()["compression"] == "gzip"
