"""Running sums and counts over ranges, clean-up, groups of marks, encryption and file readers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from moraine.functions import codecs
from moraine.operators import log, transactions, values
from moraine.sources import records


def test_running_sums_with_nulls_ties_and_outliers(spark):
    order = [5, 1, 1, 3, 10**12, None, 2, 7, 7, None, 8]
    df = spark.createDataFrame([(i, o, i + 1) for i, o in enumerate(order)], "i int, o long, v long").repartition(3)
    want, total = {}, 0
    for i in sorted(range(len(order)), key=lambda i: (order[i] is None, order[i] or 0, i)):
        total += i + 1
        want[i] = total
    for buckets in (1, 2, 5, 40):
        got = log.running_total(df, "o", F.col("v"), "sum", buckets, ties=("i",)).collect()
        assert {r.i: r["sum"] for r in got} == want
    assert log.running_total(df.limit(0), "o", F.col("v"), "sum").count() == 0
    back = log.prefix(df, "o", F.col("v"), "low", "min", ties=("i",), descending=True, buckets=4).where("o is not null").collect()
    assert all(r.low <= r.v for r in back)
    near = {r.i: r.n for r in log.trailing_count(df.where("o < 100"), "o", 2, "n").collect()}
    assert near == {i: sum(p is not None and o - 2 <= p <= o for p in order) for i, o in enumerate(order) if o is not None and o < 100}
    placed = values.assign_pointers(spark.createDataFrame([(1, "a"), (1, "bb"), (None, "c"), (0, None)], "doc_id long, text string")).collect()
    assert sorted(r.log_offset for r in placed)[0] == 0 and len({r.log_offset for r in placed}) == 4


def test_clean_up_and_marks(spark):
    done = spark.createDataFrame([(i, 10 * i) for i in range(40)], "txn_id long, commit_ts long")
    ids = lambda d: sorted(r.txn_id for r in d.collect())
    assert ids(transactions.cleaned(done, 100, 5000, most=100)) == list(range(10, 40))
    assert ids(transactions.cleaned(done, None, 5000, most=100)) == list(range(25, 40))
    assert ids(transactions.cleaned(done, 0, 5000, most=20)) == list(range(30, 40))
    marks = spark.createDataFrame([("read", 7), ("read", 3), ("commit", 9)], "mark string, ts long")
    assert transactions.group_watermark(marks).first().low == 3 and transactions.group_watermark(marks.limit(0)).first().low == 2**63 - 1


def test_encryption_and_entropy(spark):
    key = codecs.derive_key("password", b"salt", 1000)
    assert key == hashlib.pbkdf2_hmac("sha256", b"password", b"salt", 1000, 32)
    df = spark.createDataFrame([("some text",), ("",)], "text string").withColumn("c", codecs.encrypted(F.col("text"), key, "a"))
    got = df.select("text", codecs.decrypted(F.col("c"), key, "a").cast("string").alias("same"), codecs.decrypted(F.col("c"), key, "b").alias("other"), F.octet_length("c").alias("n")).collect()
    assert all(r.same == r.text and r.other is None and r.n == len(r.text) + 28 for r in got)
    worth = spark.createDataFrame([("hi",), ("a" * 64,), (None,), ("abcdefghijklmnopqrstuvwxyz0123456789",)], "text string")
    assert [r.worth for r in codecs.worth_compressing(worth).collect()] == [False, True, None, False]
    assert codecs.fnv1a_many([b"x" * 5000, b"", b"ab"]).tolist() == [codecs.fnv1a(x) for x in (b"x" * 5000, b"", b"ab")]


def test_files_through_spark(spark, tmp_path):
    rows = [(f"k{i:03d}", f"v{i}", i + 1, 0) for i in range(50)]
    records.write_table_file(rows, str(tmp_path / "a.sst"))
    assert sorted(map(tuple, records.read_files(spark, str(tmp_path / "*.sst"), True).collect())) == rows
    (tmp_path / "b.sst").write_bytes((tmp_path / "a.sst").read_bytes().replace(b"v7", b"w7"))
    with pytest.raises(Exception, match="checksum"):
        records.read_files(spark, str(tmp_path / "b.sst"), True).collect()
    df = spark.createDataFrame(rows, records.SCHEMA)
    cut = records.segments(df, size=200)
    assert cut.count() > 4 and sorted(map(tuple, records.replay(cut).collect())) == rows
