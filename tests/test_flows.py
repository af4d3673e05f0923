from pyspark.sql import functions as F

from wiretide.operators import flows

SCHEMA = "session_id long, packet_no long, ts double, src string, dst string, proto string, sport int, dport int, tcp_flags int, frame_len int, data_len int, payload binary"


def packet(n, ts, out=True, flags=16, proto="TCP", size=100, data=40, port=443):
    a, b = ("10.0.0.1", 50000), ("8.8.8.8", port)
    s, d = (a, b) if out else (b, a)
    return (1, n, float(ts), s[0], d[0], proto, s[1], d[1], flags, size, data, bytearray(b"x" * data))


def build(spark, rows):
    return flows.build_flows(spark.createDataFrame(rows, SCHEMA)).orderBy("flow_id").collect()


def test_handshake_opens_a_flow(spark):
    f = build(spark, [packet(1, 0, flags=2), packet(2, 1), packet(3, 2, flags=2), packet(4, 3, out=False)])
    assert [(x["packets_sent"], x["packets_received"], x["initiator_confirmed"]) for x in f] == [(2, 0, True), (1, 1, True)]


def test_idle_gap(spark):
    assert len(build(spark, [packet(1, 0), packet(2, 300), packet(3, 600.5)])) == 2
    assert len(build(spark, [packet(1, 0, proto="UDP"), packet(2, 60, proto="UDP"), packet(3, 121, proto="UDP")])) == 2
    assert len(build(spark, [packet(1, 500), packet(2, 0), packet(3, 700)])) == 1  # backwards never splits, and the latest counts


def test_keep_alives_are_no_sends(spark):
    f = build(spark, [packet(i, 30 * i, data=1) for i in range(5)])[0]
    assert f["interval_count"] == 0
    f = build(spark, [packet(i, 30 * i) for i in range(5)])[0]
    assert (f["interval_count"], f["interval_median"], f["interval_mad"]) == (4, 30.0, 0.0)


def test_direction_and_fields(spark):
    f = build(spark, [packet(1, 0, flags=2), packet(2, 1, out=False, flags=18, size=60), packet(3, 5, size=200)])[0]
    assert (f["src_ip"], f["dst_port"], f["bytes_sent"], f["bytes_received"], f["duration_seconds"], f["tcp_flags_seen"], f["app_protocol"]) == ("10.0.0.1", 443, 300, 60, 5.0, "AS", "TLS")
    assert f["bytes_ratio"] == round(300 / 360, 4)


def test_partitioning_does_not_matter(spark):
    rows = [packet(i, i * 7 % 900, out=i % 3 > 0, flags=2 if i % 11 == 0 else 16) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = (flows.build_flows(df.repartition(n)).select(F.struct("flow_id", "packets_sent", "interval_mad")).collect() for n in (1, 7))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_dns_answers(spark):
    m = spark.createDataFrame(
        [(1, 1, 1, 0.0, "10.0.0.1", 7, False, "a.b.example.com", "A", None), (1, 2, 1, 0.1, "10.0.0.1", 7, True, "A.b.example.com", "A", ["1.1.1.1", "2.2.2.2"]), (1, 3, 1, 0.2, "10.0.0.1", 7, True, "a.b.example.com", "A", ["2.2.2.2", "3.3.3.3"]), (1, 4, 2, 0.3, "10.0.0.1", 8, False, "z.example.com", "A", None)],
        "session_id long, packet_no long, flow_id long, ts double, client_ip string, txid int, is_reply boolean, qname string, qtype string, answers array<string>",
    )
    got = {r["query_name"]: r["response_ip"] for r in flows.dns_rows(m).collect()}
    assert got == {"a.b.example.com": "1.1.1.1, 2.2.2.2, 3.3.3.3", "z.example.com": ""}
