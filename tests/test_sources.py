import struct

import pytest

from wiretide.operators import flows, transport
from wiretide.sources import captures, feeds, messages


def ip4(proto, body, src=(10, 0, 0, 1), dst=(8, 8, 8, 8)):
    return struct.pack("!BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, *src, *dst) + body


def tcp(sport, dport, flags, data=b"", seq=1):
    return struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data


def pcap(frames, link=1, end="<"):
    out = struct.pack(end + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    for ts, f in frames:
        out += struct.pack(end + "4I", int(ts), round(ts % 1 * 1e6), len(f), len(f)) + f
    return out


ETH = b"\0" * 12 + b"\x08\x00"
QUERY = struct.pack("!6H", 7, 0x0100, 1, 0, 0, 0) + b"\x03www\x07example\x03com\0" + struct.pack("!HH", 1, 1)
REPLY = struct.pack("!6H", 7, 0x8180, 1, 1, 0, 0) + b"\x03www\x07example\x03com\0" + struct.pack("!HH", 1, 1) + b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes([9, 9, 9, 9])


@pytest.mark.parametrize("end", ["<", ">"])
def test_capture_to_flows(spark, tmp_path, end):
    frames = [(1.5, ETH + ip4(6, tcp(50000, 443, 2))), (2.0, ETH[:12] + b"\x81\x00\x00\x05\x08\x00" + ip4(6, tcp(50000, 443, 24, b"hello"))), (3.0, ETH + ip4(17, udp(5353, 53, QUERY))), (3.1, ETH + ip4(17, udp(53, 5353, REPLY), (8, 8, 8, 8), (10, 0, 0, 1))), (4, b"\0" * 20)]
    (tmp_path / "a.pcap").write_bytes(pcap(frames, end=end))
    p = captures.read_captures(spark, str(tmp_path)).cache()
    assert [(r["packet_no"], r["ts"], r["proto"], r["data_len"]) for r in p.orderBy("packet_no").collect()] == [(1, 1.5, "TCP", 0), (2, 2.0, "TCP", 5), (3, 3.0, "UDP", len(QUERY)), (4, 3.1, "UDP", len(REPLY))]
    f = {r["protocol"]: r for r in flows.build_flows(p).collect()}
    assert f["TCP"]["initiator_confirmed"] and f["TCP"]["packets_sent"] == 2 and f["UDP"]["packets_received"] == 1
    m = messages.dns_messages(p).collect()
    assert [(r["is_reply"], r["client_ip"], r["qname"], r["answers"]) for r in sorted(m, key=lambda r: r["packet_no"])] == [(False, "10.0.0.1", "www.example.com", []), (True, "10.0.0.1", "www.example.com", ["9.9.9.9"])]


def test_odd_frames():
    assert captures.decode(b"\x45" + b"\0" * 5, 101) is None
    assert captures.decode(ip4(47, b"abc"), 12)[2] == "OTHER"
    assert captures.decode(b"\x02\0\0\0" + ip4(1, b"\x08\x00" + b"\0" * 6 + b"data"), 0)[2:5] == ("ICMP", 0, 2048)
    with pytest.raises(ValueError):
        list(captures.frames(b"x" * 40))


def test_a_bad_file_is_refused_alone(spark, tmp_path):
    (tmp_path / "good.pcap").write_bytes(pcap([(1.0, ETH + ip4(6, tcp(50000, 443, 2)))]))
    (tmp_path / "radio.pcap").write_bytes(pcap([(1.0, b"x" * 40)], link=127))
    (tmp_path / "text.pcap").write_bytes(b"this is no capture at all, but text")
    assert captures.read_captures(spark, str(tmp_path)).count() == 1
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in captures.refusals(spark, str(tmp_path)).collect()}
    assert why == {"radio.pcap": "link type 127 is not supported", "text.pcap": "not a capture file"}


def test_dns_names():
    name = b"\x03www\x07example\x03com\0"
    assert messages.read_name(b"xx" + name, 2) == ("www.example.com.", 2 + len(name))
    assert messages.read_name(name + b"\x01a\xc0\x04", len(name)) == ("a.example.com.", len(name) + 4)  # labels, then a pointer
    assert messages.read_name(name + b"\x40\x04", len(name))[0] == "example.com."  # one high bit is a pointer too
    assert messages.read_name(b"\xc0\x02\xc0\x00", 0) == (".", 2)  # two pointers at each other
    assert messages.read_name(b"\x05ab", 0) == ("ab.", 6) and messages.read_name(b"\xc0", 0) == (".", 2)
    chain = b"".join(struct.pack("!H", 0xC000 | 2 * (i + 1)) for i in range(40)) + b"\x01a\0"
    assert messages.read_name(chain, 0) == (".", 2)  # more pointers than a name may follow
    many = struct.pack("!6H", 7, 0x8180, 1, 65535, 0, 0) + name + struct.pack("!HH", 1, 1) + (b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + bytes([9, 9, 9, 9])) * 70
    assert len(messages.parse_dns(many)["answers"]) == messages.MAX_ANSWERS
    assert messages.parse_dns(many[:-2])["answers"] and messages.parse_dns(many[: 12 + len(name) + 3]) is None
    assert messages.parse_dns(b"\0\0" + many, True)["qname"] == "www.example.com." and messages.parse_dns(struct.pack("!6H", 1, 0, 0, 0, 0, 0)) is None


def test_feed_names(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate(["bad.xn--p1ai", "c2.example.c0m", "host_1.example.com", "-x.example.com", "single"])), "line_no long, value string")
    assert {r["value"] for r in feeds.parse_feed(lines, "PLAIN_DOMAIN").collect()} == {"bad.xn--p1ai", "c2.example.c0m"}
    (tmp_path / "f.txt").write_text("# Generated: 2024-05-01 10:00:00\na.example\nb.example\n")
    import hashlib

    got = feeds.describe_feed(spark, str(tmp_path / "f.txt"), "PLAIN_DOMAIN").first()
    assert got["file_sha256"] == hashlib.sha256((tmp_path / "f.txt").read_bytes()).hexdigest()
    assert (got["lines"], got["domain"], got["url"], str(got["published_on"])) == (3, 2, 0, "2024-05-01 10:00:00")


def test_dns_loops():
    assert messages.read_name(b"\xc0\x00", 0) == (".", 2)
    assert messages.parse_dns(b"\0" * 11) is None


def hello(ciphers, extensions):
    ext = b"".join(struct.pack("!HH", k, len(v)) + v for k, v in extensions)
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack("!H", 2 * len(ciphers)) + struct.pack(f"!{len(ciphers)}H", *ciphers) + b"\x01\0" + struct.pack("!H", len(ext)) + ext
    return b"\x16\x03\x01" + struct.pack("!H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def test_fingerprint(spark):
    # The published example of the fingerprint's description.
    ciphers = [0x0A0A, 0x1301, 0x1302, 0x1303, 0xC02B, 0xC02F, 0xC02C, 0xC030, 0xCCA9, 0xCCA8, 0xC013, 0xC014, 0x009C, 0x009D, 0x002F, 0x0035]
    algs = [0x0403, 0x0804, 0x0401, 0x0503, 0x0805, 0x0501, 0x0806, 0x0601]
    sig = struct.pack("!H8H", 16, *algs)
    name = b"a.example"
    ext = [(0x1A1A, b""), (0x001B, b""), (0, struct.pack("!HBH", len(name) + 3, 0, len(name)) + name), (0x0033, b""), (0x0010, b"\x00\x03\x02h2"), (0x4469, b""), (0x0017, b""), (0x002D, b""), (0x000D, sig), (0x0005, b""), (0x0023, b""), (0x0012, b""), (0x002B, b"\x04\x03\x04\x03\x03"), (0xFF01, b""), (0x000B, b""), (0x000A, b""), (0x0015, b"")]
    df = spark.createDataFrame([(bytearray(hello(ciphers, ext)),), (bytearray(b"\x16\x03"),)], "p binary")
    df = df.select(messages.client_hello("p").alias("h"))
    got = df.select("h.sni", messages.ja4(df["h"]).alias("j")).collect()
    assert got[0]["sni"] == "a.example" and got[0]["j"]["ja4"] == "t13d1516h2_8daaf6152771_e5627efa2ab1"
    assert got[1]["j"] is None


def test_feeds(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no long, value string")
    f = feeds.parse_feed(lines("# last updated: 2024-05-01 10:00:00", '"2024-01-01 00:00:00","203.0.113.9","443","online","2024-01-02","Emo"', "2024,203.0.113.9,80,x,y,z", "bad,row,1"), "FEODO_IP").collect()
    assert [(r["kind"], r["value"], r["context"]) for r in f] == [("ipv4", "203.0.113.9", "Emo · port 443")]
    u = feeds.parse_feed(lines("1,2024,http://evil.example/x,online,2024,malware,tag,l,r"), "URLHAUS").collect()
    assert {(r["kind"], r["value"]) for r in u} == {("url", "http://evil.example/x"), ("domain", "evil.example")}
    d = feeds.parse_feed(lines("Evil.Example extra", "not_a_domain", "evil.example"), "PLAIN_DOMAIN").collect()
    assert [(r["value"], r["line_no"]) for r in d] == [("evil.example", 0)]
    assert str(feeds.published_on(lines("# Generated: 2024-05-01 10:00:00", "x")).first()[0]) == "2024-05-01 10:00:00"


def test_streams(spark):
    s = lambda n, seq, p, syn=False: (1, "client", n, seq, syn, len(p), bytearray(p))
    rows = [s(1, 99, b"", True), s(2, 100, b"abcd"), s(4, 108, b"ijkl"), s(3, 104, b"efgh"), s(5, 104, b"efgh"), s(6, 106, b"XXij"), s(7, 120, b"zz")]
    df = spark.createDataFrame(rows, "flow_id long, direction string, packet_no long, seq long, syn boolean, length long, payload binary")
    r = transport.reassemble(df).first()
    assert [(x["offset"], bytes(x["bytes"])) for x in r["runs"]] == [(0, b"abcdefghijkl"), (20, b"zz")]
    assert [(g["offset"], g["length"]) for g in r["gaps"]] == [(12, 8)] and r["retransmissions"] >= 1 and not r["mid_stream"]
    assert [c["contradicted_by"] for c in r["conflicts"]] == [6]
    assert [(g["offset"], g["length"]) for g in transport.stream_gaps(df).collect()] == [(12, 8)]


def test_transcripts(spark):
    ftp = spark.createDataFrame([(1, "client", "USER bob\r\nPASS secret\r\nRETR f.txt\r\n"), (1, "server", "331 go on\r\n230 in\r\n")], "flow_id long, direction string, text string")
    got = {(r["verb"], r["rest"], r["sensitive"]) for r in transport.transcript(ftp, "ftp").collect()}
    assert {("USER", "bob", False), ("PASS", "secret", True), ("331", "go on", False)} <= got
    http = spark.createDataFrame([(1, "client", "GET / HTTP/1.1\r\nHost: x\r\nAuthorization: Basic a\r\n\r\nHidden: body\r\n")], ftp.schema)
    assert {(r["verb"], r["sensitive"]) for r in transport.transcript(http, "http").collect()} == {("GET", False), ("HOST", False), ("AUTHORIZATION", True)}


def test_one_conversation(spark):
    p = lambda n, src, dst, flags, seq, data: (n, src[0], dst[0], "TCP", src[1], dst[1], flags, seq, bytearray(data))
    a, b, c = ("10.0.0.1", 5000), ("8.8.8.8", 80), ("8.8.4.4", 80)
    rows = [p(1, a, b, 2, 99, b""), p(2, b, a, 18, 499, b""), p(3, a, b, 24, 100, b"GET"), p(4, a, c, 24, 100, b"other"), p(5, b, a, 24, 500, b"early"), p(6, b, a, 24, 515, b"late")]
    df = spark.createDataFrame(rows, "packet_no long, src string, dst string, proto string, sport int, dport int, tcp_flags int, seq long, payload binary")
    s = transport.conversation(df, a, b)
    assert sorted((r["packet_no"], r["direction"], r["syn"]) for r in s.collect()) == [(1, "client", True), (2, "server", True), (3, "client", False), (5, "server", False), (6, "server", False)]
    streams = transport.reassemble(s)
    assert {r["direction"]: [bytes(x["bytes"]) for x in r["runs"]] for r in streams.collect()} == {"client": [b"GET"], "server": [b"early", b"late"]}
    assert [(r["direction"], r["caveat"]) for r in transport.caveats(streams).collect()] == [("server", "10 bytes in 1 gap(s) were not captured")]


def test_uploads_and_errors(spark):
    files = [("a", 100, bytes.fromhex("d4c3b2a1ff")), ("b", 100, b"PK"), ("c", 600 << 20, bytes.fromhex("0a0d0d0a")), ("d", 0, b"")]
    df = spark.createDataFrame([(n, k, bytearray(h)) for n, k, h in files], "path string, length long, head binary")
    assert {r["path"]: r["problem"] for r in captures.upload_problems(df).collect()} == {"a": None, "b": "not a capture file", "c": "too large", "d": "not a capture file"}
    quoted = lambda kind, n: captures.decode(ip4(1, bytes([kind, 0]) + b"\0" * 6 + b"q" * (n - 8)), 12)[8]
    assert [len(quoted(3, n)) for n in (143, 144, 300)] == [135, 128, 128] and len(quoted(4, 300)) == len(quoted(8, 300)) == 292


def test_small_texts(spark):
    from wiretide.functions import expressions as E

    df = spark.createDataFrame([("AB:cd 0F",), (None,)], "f string")
    assert [r[0] for r in df.select(E.fingerprint("f")).collect()] == ["abcd0f", ""]
    assert E.describe_nets(["10.0.0.5/8", "fd00::/8"]) == "10.0.0.0/8, fd00::/8"
