"""Transaction sessions against a dict of versions, opening after a crash, and windows over several triggers."""

import datetime

import pytest

from moraine.operators import log, session
from moraine.streaming import feeds


def live(table):
    return {r.k: r.v for r in log.live(table.log()).collect()}


def test_sessions_read_a_snapshot_and_their_own_writes(spark, tmp_path):
    table = session.LogTable(spark, f"file://{tmp_path}/t")
    assert live(table) == {}
    rows = [("a", "1", 0), ("b", "2", 0), ("c", None, 3), ("b", "1", 0)]
    assert table.append(spark.createDataFrame(rows, "k string, v string, meta int")) == 1
    one, two, reader = table.begin(), table.begin(), table.begin(read_only=True)
    assert table.open == 3 and one.get("a") == "1" and one.get("c") is None
    one.set("a", "9")
    one.delete("b")
    one.set("d", "4")
    assert one.get("a") == "9" and one.get("b") is None
    assert {r.k: r.v for r in one.scan("a", "d").collect()} == {"a": "9"}
    assert two.get("a") == "1"
    two.set("z", "0")
    assert one.commit() > one.read_ts and one.state == "committed"
    assert reader.get("a") == "1" and live(table) == {"a": "9", "d": "4"}
    with pytest.raises(session.Conflict):
        two.commit()
    assert two.state == "aborted" and "z" not in live(table)
    for call in (lambda: reader.set("a", "1"), lambda: two.get("a"), lambda: two.commit()):
        with pytest.raises(session.TxnError):
            call()
    assert reader.commit() is None and table.open == 0 and table.oracle.low_watermark() is None


def test_ranges_limits_retries_and_crashes(spark, tmp_path):
    table = session.LogTable(spark, f"file://{tmp_path}/t")
    ranged, blind, strict = table.begin(), table.begin(), table.begin(check_writes=True)
    assert ranged.scan("a", "c").count() == 0
    for t in (ranged, blind, strict):
        t.set("b", "x")
    with pytest.raises(session.TxnError):
        small = table.begin(max_write_keys=1)
        small.set("p", "1")
        small.set("p", "2")
        small.set("q", "3")
    small.discard()
    assert blind.commit() == 5
    for t in (ranged, strict):
        with pytest.raises(session.Conflict):
            t.commit()
    tries = []

    def body(txn):
        tries.append(txn.get("b"))
        if len(tries) < 3:
            table.append(spark.createDataFrame([("b", f"y{len(tries)}", 0)], "k string, v string, meta int"))
        txn.set("b", tries[-1] + "!")

    table.run(body, delay=0.01)
    assert tries == ["x", "y1", "y2"] and live(table) == {"b": "y2!"}
    (tmp_path / "t" / "_staged-half").mkdir()
    again = session.LogTable(spark, f"file://{tmp_path}/t")
    assert live(again) == {"b": "y2!"} and not (tmp_path / "t" / "_staged-half").exists()
    assert again.oracle.next > max(r.ts for r in again.log().collect())


def test_windows_over_several_triggers(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    minutes = [[0, 10, 40], [70, 75, 200], [195, 400], [5, 410]]  # 5 comes a trigger after the watermark has passed its window
    stamp = lambda m: t0 + datetime.timedelta(minutes=m)
    for n, batch in enumerate(minutes):
        rows = [(1, stamp(m)) for m in batch]
        spark.createDataFrame(rows, "u long, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = lambda: spark.readStream.schema("u long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    start = lambda r: round((r.start - t0).total_seconds() / 60)
    hours = {start(r): r.n for r in feeds.window_counts(source(), "1 hour", late="30 minutes").collect()}
    assert hours == {0: 3, 60: 2, 180: 2, 360: 2}
    slid = {start(r): r.n for r in feeds.window_counts(source(), "1 hour", "30 minutes", late="30 minutes").collect()}
    assert slid[0] == 3 and slid[30] == 3 and slid[180] == 2
    found = feeds.session_counts(source(), "u", "35 minutes", "30 minutes").collect()
    assert sorted((start(r), r.n) for r in found) == [(0, 5), (195, 2)]
    assert feeds.first_seen(source(), ["u"], "1 day").count() == 1
