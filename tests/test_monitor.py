"""The monitor's state, and exact medians of large groups."""

import statistics
import time

import pytest

from wiretide.operators import anomaly
from wiretide.streaming import live, monitor


def until(what, seconds=60):
    for _ in range(seconds * 5):
        if what():
            return True
        time.sleep(0.2)
    return False


def test_state_is_folded_and_bounded(tmp_path):
    now = [1000.0]
    m = monitor.Monitor(None, str(tmp_path), 10, lambda name, batch: [f"t{batch}"], lambda: now[0])
    for batch in range(30):
        now[0] += 10
        m.record("q", batch, 5)
    m.record("q", 29, 7)  # reported again
    s = monitor.Store(str(tmp_path), "q").load()
    assert (s["windows"], s["rows"], s["findings"], s["heartbeat"]) == (30, 150, 30, 1300.0)
    assert [r["batch"] for r in s["recent"]] == list(range(10, 30))
    assert [f["title"] for f in s["newest"]] == [f"t{b}" for b in range(29, 21, -1)]
    s |= {"running": True, "every": 10}
    assert not monitor.is_stale(s, 1330.0)
    assert monitor.is_stale(s, 1330.1)
    assert not monitor.is_stale(s | {"running": False}, 9999.0)
    assert [monitor.window_seconds(x) for x in (None, 1, 60, 900)] == [30, 5, 60, 300]


def test_a_running_query_reports_and_obeys(spark, tmp_path):
    m = monitor.Monitor(spark, str(tmp_path / "state"), 5)
    store = monitor.Store(str(tmp_path / "state"), "watched")
    spark.streams.addListener(m)
    try:
        rows = [(1, 1, 1.0, "a", "b", "TCP", 1, 2, 16, 60, 0, bytearray())]
        spark.createDataFrame(rows, live.PACKETS).coalesce(1).write.parquet(str(tmp_path / "in"))
        q = live.packet_stream(spark, str(tmp_path / "in")).writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        assert until(lambda: store.load()["rows"] == 1)
        assert store.load()["running"]
        store.ask_to_stop()
        assert until(lambda: not q.isActive and not store.load()["running"])
        assert store.load()["error"] == ""
        bad = live.packet_stream(spark, str(tmp_path / "in")).selectExpr("raise_error('broken')").writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
        assert until(lambda: not bad.isActive and "broken" in store.load()["error"])
        assert not store.stop_asked()
    finally:
        spark.streams.removeListener(m)


@pytest.mark.parametrize("accuracy", [10_000, 8])
def test_medians_are_exact(spark, accuracy):
    groups = {1: [float(i * i % 97) for i in range(400)], 2: [5.0] * 300 + [7.0] * 300, 3: [1.0], 4: [1.0, 2.0], 5: [float(i) for i in range(999)], 6: [-1e300, 1e300, 3.0]}
    rows = [(g, x, -x, None) for g, xs in groups.items() for x in xs] + [(5, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(5)
    got = {r.g: (r.m_a, r.m_b, r.m_c) for r in anomaly.medians(df, ["a", "b", "c"], "g", accuracy).collect()}
    assert got == {g: (statistics.median(xs), statistics.median([-x for x in xs]), None) for g, xs in groups.items()}
