"""Flows from a stream of packets: arbitrary state for each conversation, with event-time timers.

Batch flows follow the order of packet_no; a stream brings packets late and out of order.  A packet waits in the state
until the watermark has passed its time by ``margin``, so that every earlier packet of its conversation has come: then it
joins the conversation's open flow or, being a new handshake or after an idle gap, closes it and opens the next.  A flow
also closes once the watermark is beyond its idle timeout (and beyond the margin too while packets wait).  For packets that come within ``delay`` of the latest time, and
whose time never runs backwards by more than ``margin`` within a conversation, the stream's flows are those of
``build_flows``; later packets are dropped, as in any stream with a watermark.

State of a conversation: the sums of its one open flow, the packets that wait (of a span of delay and margin) without their
payloads, and the times at which the flow's initiator sent, appended and read only when the flow closes.  Each value of a
state and each column of a row goes between Spark and Python by itself, so conversations and packets travel as texts, wait
PIECE to a value, and become fields only when their turn comes; packets that only have to wait are appended unread.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import flows

# Fixed value: packets in one value of the state.
PIECE = 4096
OPEN = "flow_id long, forth boolean, confirmed boolean, sent int, received int, bytes_sent long, bytes_received long, first_seen double, last_seen double, flags int, entropy double, samples int, app string"
CLOSED = "session_id long, flow_id long, proto string, src string, dst string, sport int, dport int, initiator_confirmed boolean, packets_sent int, packets_received int, bytes_sent long, bytes_received long, first_seen double, last_seen double, times array<double>, unique_dst_ports int, entropy double, entropy_sample_count int, tcp_flags_seen string, app string"
NAMES, CLOSED_NAMES = ([c.split()[0] for c in kind.split(", ")] for kind in (OPEN, CLOSED))
CLOSED_ROW = Row(*CLOSED_NAMES)


class Conversation(StatefulProcessor):
    """One conversation's open flow and waiting packets.  It has one timer at most."""

    def __init__(self, margin: float, idle: dict[str, float]) -> None:
        self.margin, self.idle = margin, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.times = handle.getListState("times", "sent array<double>")
        self.waiting = handle.getListState("waiting", "packets string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        fresh, mark = [(r.at, r.packet) for r in rows], timerValues.getCurrentWatermarkInMs() / 1000
        texts, due = [text for _, text in fresh], min(fresh)[0].timestamp() + self.margin
        if due > mark:  # what waits already has its timer
            self.waiting.appendList(pieces(texts))
            self.wake(due, mark, list(self.handle.listTimers()))
        else:
            yield from self.advance(key, texts, mark, list(self.handle.listTimers()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs() / 1000, [])  # Spark deletes the expired timer

    def wake(self, due: float, mark: float, timers: list[int]) -> None:
        """Set the timer for what is due, unless one comes before it."""
        at = max(math.floor(due * 1000), math.floor(mark * 1000)) + 1
        if all(at < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def advance(self, key, fresh: list[str], mark: float, timers: list[int]) -> Iterator:
        """Take the packets whose turn has come, close what is over, and set the timer for what is next."""
        waited = [text for (piece,) in self.waiting.get() for text in piece.split("\n")]
        packets = sorted(((p["no"], p["ts"], text, p) for text in waited + fresh for p in (json.loads(text),)), key=itemgetter(0, 1, 2))
        ends = json.loads(key[0])
        proto = ends.get("proto")
        timeout = self.idle.get(proto, flows.DEFAULT_IDLE)
        kept = self.open.get()
        flow = dict(zip(NAMES, kept, strict=True)) if kept else None
        known, taken, sent = bool(kept), 0, []  # known: the flow at hand may have times in the state
        while taken < len(packets) and packets[taken][1] + self.margin <= mark:
            p = packets[taken][3]
            if flow and (p["syn"] or p["ts"] - flow["last_seen"] > timeout):
                yield self.close_flow(ends, flow, sent, known)
                flow, known, sent = None, False, []
            flow = self.joined(flow, p)
            if p["forth"] == flow["forth"] and (proto not in (None, "TCP") or p.get("data", 0) > 1):
                sent.append(p["ts"])
            taken += 1
        rest = packets[taken:]
        if flow and mark - flow["last_seen"] > timeout + (self.margin if rest else 0):
            yield self.close_flow(ends, flow, sent, known)
            flow, sent = None, []
        if sent:
            self.times.appendValue((sent,))
        if flow:
            self.open.update(tuple(flow[n] for n in NAMES))
        elif kept:
            self.open.clear()
        if rest:
            self.waiting.put(pieces([p[2] for p in rest]))
        elif waited:
            self.waiting.clear()
        due = [rest[0][1] + self.margin] if rest else []
        if flow:
            due.append(flow["last_seen"] + timeout + (self.margin if rest else 0))
        for t in timers:
            self.handle.deleteTimer(t)
        if due:
            self.wake(min(due), mark, [])

    def joined(self, flow: dict | None, p: dict) -> dict:
        """The open flow with one packet more."""
        ts, forth = p["ts"], p["forth"]
        if flow is None:
            flow = dict.fromkeys(NAMES, 0) | {"flow_id": p["no"], "forth": forth, "confirmed": p["syn"], "first_seen": ts, "last_seen": ts, "entropy": 0.0, "app": None}
        out = forth == flow["forth"]
        flow["sent" if out else "received"] += 1
        flow["bytes_sent" if out else "bytes_received"] += p.get("size", 0)
        flow["first_seen"], flow["last_seen"] = min(flow["first_seen"], ts), max(flow["last_seen"], ts)
        flow["flags"] |= p.get("flags", 0)
        if "sample" in p and flow["samples"] < flows.ENTROPY_SAMPLES:
            flow["entropy"], flow["samples"] = flow["entropy"] + p["sample"], flow["samples"] + 1
        flow["app"] = flow["app"] or p.get("app")
        return flow

    def close_flow(self, ends: dict, f: dict, sent: list[float], known: bool):
        if known:
            sent = [t for (some,) in self.times.get() for t in some] + sent
            self.times.clear()
        seen = "".join(letter for letter, bit in flows.FLAGS.items() if f["flags"] & bit)
        entropy = f["entropy"] / f["samples"] if f["samples"] else None
        src, dst = (ends["a"], ends["b"]) if f["forth"] else (ends["b"], ends["a"])
        places = (src.get("ip"), dst.get("ip"), src.get("port"), dst.get("port"))
        ports = {dst.get("port"), src.get("port") if f["received"] else None} - {None}  # a conversation has two ends
        return CLOSED_ROW(ends.get("session_id"), f["flow_id"], ends.get("proto"), *places, f["confirmed"], f["sent"], f["received"], f["bytes_sent"], f["bytes_received"], f["first_seen"], f["last_seen"], sorted(sent), len(ports), entropy, f["samples"], seen, f["app"])

    def close(self) -> None:
        pass


def pieces(texts: list[str]) -> list[tuple[str]]:
    """Texts of packets, PIECE of them in a line each to a value of the state."""
    return [("\n".join(texts[k : k + PIECE]),) for k in range(0, len(texts), PIECE)]


def stream_flows(packets: DataFrame, idle: dict[str, float] | None = None, delay: str = "300 seconds", margin: float = 300.0) -> DataFrame:
    """The flows of a packet stream, each once it can no longer change.  The session needs the RocksDB state store.

    Packets without a time or a number cannot be placed and are left out.  An open flow stays in the state of the query
    and comes when a later run of it moves the watermark on."""
    p = packets.where("ts IS NOT NULL AND packet_no IS NOT NULL")
    p = flows.conversations(p, idle).withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("at", delay)
    forth = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")).eqNullSafe(F.col("a"))
    parts = {"no": "packet_no", "ts": "ts", "forth": forth, "syn": "syn", "flags": "tcp_flags", "size": "frame_len", "data": "data_len", "sample": flows.payload_sample(), "app": flows.suggested()}
    text = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    packet = text(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in parts.items()])
    p = p.select(text(*flows.KEY).alias("conversation"), "at", packet.alias("packet"))
    idle = {k: float(v) for k, v in (flows.IDLE_SECONDS if idle is None else idle).items()}
    closed = p.groupBy("conversation").transformWithState(Conversation(margin, idle), CLOSED, "append", "EventTime")
    return flows.describe(closed.withColumn("first", F.struct("src", "dst", "sport", "dport")))
