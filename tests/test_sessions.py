"""Flows of a stream are those of the batch, across restarts and late packets."""

import datetime
import json
import random
import types

from wiretide.operators import flows
from wiretide.plans.stream import ROCKSDB
from wiretide.streaming import live, sessions

DRAIN = (9, 10**9, 10.0**7, "192.0.2.1", "192.0.2.2", "TCP", 1, 2, 16, 60, 0, bytearray())


def traffic(n, seed=3):
    """Three hosts' packets with handshakes, idle gaps, times that run backwards a little, and arrival out of order."""
    draw, rows, t = random.Random(seed), [], 1000.0
    for i in range(n):
        t += draw.choice([0.1, 1, 5, 20, 40, 40])
        a, b = (f"10.0.0.{draw.randrange(3)}", 50000), ("203.0.113.8", 443)
        if draw.random() < 0.4:
            a, b = b, a
        proto = draw.choice(["TCP", "UDP", "ICMP"])
        rows.append((1, i, t - draw.choice([0, 0, 0, 50]), a[0], b[0], proto, a[1], b[1], draw.choice([2, 16, 18, 24, None]), draw.choice([60, 1000]), draw.randrange(3), bytearray(b"xyz"[: draw.randrange(4)])))
    return sorted(rows, key=lambda r: r[1] + draw.randrange(12))


def drain(spark, tmp_path, packets, per_run, **options):
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    for k in range(0, len(packets), per_run):
        spark.createDataFrame(packets[k : k + per_run], live.PACKETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sessions.stream_flows(live.packet_stream(spark, str(tmp_path / "in"), 1), **options)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    packets = [*traffic(900), (1, None, 1.0, "a", "b", "TCP", 1, 2, 16, 60, 0, None), (1, 5, None, "a", "b", "TCP", 1, 2, 16, 60, 0, None), DRAIN]
    got = drain(spark, tmp_path, packets, 452)
    placed = spark.createDataFrame(packets, live.PACKETS).where("ts IS NOT NULL AND packet_no IS NOT NULL AND session_id = 1")
    want = flows.build_flows(placed).select(got.columns)
    assert want.count() > 250
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).isEmpty()


def test_open_flows_wait_and_late_packets_go(spark, tmp_path):
    packet = lambda n, ts: (1, n, float(ts), "10.0.0.1", "203.0.113.8", "UDP", 5, 6, 0, 100, 9, bytearray(b"x"))
    got = drain(spark, tmp_path, [packet(1, 1000), packet(2, 1010), packet(3, 6000), packet(4, 1020)], 3, delay="100 seconds", margin=100.0)
    assert [(r.flow_id, r.packets_sent) for r in got.collect()] == [(1, 2)]  # 3 is still open, 4 came after the watermark


def test_odd_ends_and_null_fields(spark, tmp_path):
    ends = [("10.0.0.1", "x\n,\"y\"", "UDP", 5, 6), (None, "10.0.0.2", "TCP", None, 80), ("10.0.0.3", "10.0.0.3", "TCP", 7, 7), ("10.0.0.4", "10.0.0.5", None, 9, 9)]
    packets = [(1, 10 * i + k, 1000.0 + 20 * i + 1e-6 * k, *((e[1], e[0], e[2], e[4], e[3]) if i % 3 == 1 else e), None if k == 1 else 2, None if k != 2 and i % 5 == 0 else 60, None if k == 2 else i % 3, None) for i in range(12) for k, e in enumerate(ends)]
    got = drain(spark, tmp_path, [*packets, DRAIN], 49)
    want = flows.build_flows(spark.createDataFrame(packets, live.PACKETS)).select(got.columns)
    assert want.count() > 10
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).isEmpty()


class Held:
    """A value or list state that counts what goes through it."""

    def __init__(self):
        self.held, self.through = [], 0

    def get(self):
        self.through += len(self.held)
        return iter(self.held)

    def appendList(self, values):
        self.through += len(values)
        self.held += values

    put = appendList


def test_waiting_packets_go_unread_in_few_values():
    waiting, timers = Held(), set()
    handle = types.SimpleNamespace(getValueState=lambda *_: None, getListState=lambda name, _: waiting if name == "waiting" else None, listTimers=lambda: list(timers), registerTimer=timers.add, deleteTimer=timers.remove)
    c = sessions.Conversation(300.0, {})
    c.init(handle)
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC)
    for batch in (5000, 4000):
        rows = [types.SimpleNamespace(at=at(batch + i % 50), packet=json.dumps({"no": i})) for i in range(2_000)]
        assert not list(c.handleInputRows(("{}",), iter(rows), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_000_000)))
    assert waiting.through == 2 and sum(p.count("\n") + 1 for (p,) in waiting.held) == 4_000
    assert timers == {4_300_001}
