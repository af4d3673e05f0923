"""Captures read in ranges give the rows of one reader, wherever the cuts fall."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wiretide.sources import captures

from .test_sources import ETH, ip4, pcap, tcp, udp


def rows(df):
    return sorted((r.packet_no, r.ts, r.src, r.dport, r.data_len, bytes(r.payload)) for r in df.collect())


def whole(data, without=()):
    """The rows that reading the file from its start gives; packets without an interface have a number, but no row."""
    out = []
    numbers = (n for n in range(1, 10**6) if n not in without)
    for n, (frame, ts, link, _) in zip(numbers, captures.frames(data), strict=False):
        d = captures.decode(frame, link)
        if d:
            out.append((n, ts, d[0], d[4], d[6], d[8]))
    return out


def frames(n, seed=1):
    draw = random.Random(seed)
    inner = pcap([(9.0 + i, ETH + ip4(17, udp(7, 7, b"inner" * i))) for i in range(30)])  # a capture within a packet
    out = []
    for i in range(n):
        data = draw.choice([b"", draw.randbytes(draw.randrange(200)), b"\0" * 900, inner, inner[24:]])
        out.append((1000 + i / 4, draw.choice([ETH + ip4(6, tcp(i % 65536, 443, 24, data)), ETH + ip4(17, udp(i % 65536, 9, data)), b"\0" * 20])))
    return out


def block(kind, body, end="<"):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(end + "I", len(body) + 12)
    return struct.pack(end + "I", kind) + size + body + size


def pcapng(packets, end="<", seed=2):
    """Two sections; interfaces appear between packets; one counts nanoseconds, one powers of two; one packet names none."""
    draw, out = random.Random(seed), b""
    for part, order in ((packets[: len(packets) // 2], end), (packets[len(packets) // 2 :], "<" if end == ">" else ">")):
        out += block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
        units = []
        for i, (ts, frame) in enumerate(part):
            if i in (0, 40, 90):
                option = {0: b"", 40: struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0), 90: struct.pack(order + "HHB3xHH", 9, 1, 0x80 | 10, 0, 0)}[i]
                units.append({0: 10**6, 40: 10**9, 90: 2**10}[i])
                out += block(1, struct.pack(order + "HHI", 1, 0, 0) + option, order)
            number = draw.randrange(len(units))
            ticks = round(ts * units[number])
            out += block(6, struct.pack(order + "5I", 77 if i == 5 else number, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame, order)
            if draw.random() < 0.1:
                out += block(5, b"statistics", order)
    return out


@pytest.mark.parametrize("name", ["little", "big", "nanoseconds", "pcapng", "pcapng big", "cut", "cut pcapng"])
def test_every_range_size_gives_the_same_rows(spark, tmp_path, name):
    packets = frames(260)
    data = {"little": pcap(packets), "big": pcap(packets, end=">"), "pcapng": pcapng(packets), "pcapng big": pcapng(packets, ">")}.get(name)
    if name == "nanoseconds":
        data = b"\x4d\x3c\xb2\xa1" + pcap(packets)[4:]
    if name.startswith("cut"):
        data = (pcapng(packets) if "ng" in name else pcap(packets))[:-100]
    (tmp_path / "a.cap").write_bytes(data)
    want = whole(data, (6, 136) if "ng" in name else ())
    assert len(want) > 100
    for size in (1 << 30, 20_011, 999):
        assert rows(captures.read_captures(spark, str(tmp_path), size)) == want


def test_guesses_within_a_captured_capture_are_walked_again(spark, tmp_path):
    inner = pcap([(9.0 + i, b"x" * 40) for i in range(1000)])[24:]
    data = pcap([(1.0, ETH + ip4(17, udp(1, 1, b"a"))), (2.0, inner), (3.0, ETH + ip4(17, udp(2, 2, b"b")))] * 3)
    (tmp_path / "a.pcap").write_bytes(data)
    assert rows(captures.read_captures(spark, str(tmp_path), 5000)) == whole(data)


def test_bad_files_among_ranges(spark, tmp_path):
    good = pcap(frames(50))
    (tmp_path / "good.pcap").write_bytes(good)
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "short.pcap").write_bytes(good[:20])
    (tmp_path / "head.pcap").write_bytes(good[:24])
    (tmp_path / "text.pcap").write_bytes(b"no capture " * 2000)
    (tmp_path / "radio.pcapng").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(6, struct.pack("<5I", 0, 0, 5, 4, 4) + b"abcd") * 300 + block(1, struct.pack("<HHI", 127, 0, 0)))
    plan = captures.plan_ranges(spark, str(tmp_path), 2000)
    assert rows(captures.read_captures(spark, str(tmp_path), plan=plan)) == whole(good)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in captures.refusals(spark, str(tmp_path), plan).collect()} == {"text.pcap": "not a capture file", "radio.pcapng": "link type 127 is not supported"}


def test_each_range_is_a_task(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(frames(260)))
    size = (tmp_path / "a.pcap").stat().st_size
    assert captures.read_captures(spark, str(tmp_path), size // 9).rdd.getNumPartitions() >= 9


def test_written_captures_come_back(spark, tmp_path):
    made = [("one", 2, 5.25, "10.0.0.1", "10.0.0.2", "TCP", 1, 2, 24, 7, b"abc"), ("one", 1, 6.5, "2001:db8::1", "2001:db8::2", "UDP", 3, 4, None, None, b""), ("two", 1, 1.0, "10.0.0.1", "10.0.0.2", "ICMP", None, 2048, None, None, b"ping"), ("two", 3, 2.0, "10.0.0.1", "10.0.0.2", "OTHER", None, None, None, None, None)]
    df = spark.createDataFrame(made, "capture string, packet_no long, ts double, src string, dst string, proto string, sport int, dport int, tcp_flags int, seq long, payload binary")
    done = captures.write_captures(df.withColumn("extra", F.lit(1)), str(tmp_path))
    assert sorted(map(tuple, done.collect())) == [("one", 2), ("two", 2)]
    got = {(r.packet_no, r.ts, r.src, r.proto, r.sport, r.dport, r.tcp_flags, bytes(r.payload)) for r in captures.read_captures(spark, str(tmp_path)).collect()}
    assert got == {(1, 6.5, "2001:db8::1", "UDP", 3, 4, 0, b""), (2, 5.25, "10.0.0.1", "TCP", 1, 2, 24, b"abc"), (1, 1.0, "10.0.0.1", "ICMP", 0, 2048, 0, b"ping"), (2, 2.0, "10.0.0.1", "OTHER", 0, 0, 0, b"")}
