"""Planted traffic must raise its rule, and ordinary traffic none."""

import pytest

from wiretide.operators import aggregates, custody, exports, rules

FLOW = "session_id long, flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, initiator_ip string, packets_sent int, packets_received int, bytes_sent long, bytes_received long, first_seen double, last_seen double, duration_seconds double, interval_count int, interval_median double, interval_mad double, interval_dispersion double, avg_packet_size double, payload_entropy double, tcp_flags_seen string, app_protocol string, app_protocol_source string, tls_sni string, http_host string"
DNS = "session_id long, flow_id long, src_ip string, query_name string, query_type string, response_ips array<string>, response_ip string, subdomain_length int, query_entropy double, timestamp double"
CTX = rules.Context(home=("10.45.57.0/24",))


def flow(i, src="10.45.57.9", dst="203.0.113.5", port=443, proto="TCP", sent=10, got=10, out=2000, back=3000, at=0.0, dur=1.0, n=0, med=0.0, mad=0.0, avg=80.0, ent=5.0, flags="AS", app="TLS", sni=""):
    return (1, i, src, dst, 50000 + i % 1000, port, proto, src, sent, got, out, back, at, at + dur, dur, n, med, mad, 0.0, avg, ent, flags, app, "observed", sni, "")


@pytest.fixture()
def table(spark):
    return lambda rows: spark.createDataFrame(rows, FLOW)


@pytest.fixture()
def no_dns(spark):
    return spark.createDataFrame([], DNS)


@pytest.fixture()
def rates(spark):
    return spark.createDataFrame([("IOC_FEED_MATCH", 0, 22, 0, 8), ("C2_BEACON_PERIODIC", 4, 22, 0, 8)], "rule_id string, benign_fired int, benign_captures int, malicious_fired int, malicious_captures int")


def ids(df):
    return {r["rule_id"] for r in df.collect()}


def test_ordinary_traffic_is_quiet(table, no_dns, rates):
    rows = [flow(i, dst=f"203.0.113.{i % 40}", at=i * 97.0 % 5000, out=2000 + i * 37 % 900) for i in range(60)]
    assert ids(rules.analyse(table(rows), no_dns, CTX, rates)) == set()


def test_beacon(table):
    rows = [flow(i, at=45.0 * i + i % 3, out=512) for i in range(40)]
    found = rules.beaconing(table(rows), CTX).collect()
    assert len(found) == 1 and found[0]["severity"] == "high" and found[0]["flow_id"] == 0
    assert not rules.beaconing(table([flow(i, src="203.0.113.5", dst="10.45.57.9", at=45.0 * i) for i in range(40)]), CTX).collect()  # inbound
    assert not rules.beaconing(table([flow(i, at=0.01 * i) for i in range(40)]), CTX).collect()  # a burst


def test_keepalive_once_for_each_peer(table):
    found = rules.keepalive(table([flow(i, n=30, med=30.0, mad=1.0 + i) for i in range(3)]), CTX).collect()
    assert len(found) == 1 and '"connections_with_this_pattern":3' in found[0]["evidence"] and found[0]["flow_id"] == 0


def test_scan(table):
    rows = [flow(i, dst="203.0.113.5", port=i + 1, got=0, flags="S", at=float(i), app="") for i in range(400)]
    found = rules.port_scan(table(rows), CTX).collect()
    assert len(found) == 1 and found[0]["severity"] == "high" and '"failures":400' in found[0]["evidence"]
    assert not rules.port_scan(table(rows[:249]), CTX).collect()  # inside, the bar is 250
    assert len(rules.port_scan(table([flow(i, src="198.51.100.1", dst="10.45.57.9", port=i + 1, got=0, flags="S") for i in range(25)]), CTX).collect()) == 1


def test_icmp_covert_exfil(table):
    assert len(rules.icmp_tunnel(table([flow(1, proto="ICMP", port=8 * 256, avg=1100.0, sent=120)]), CTX).collect()) == 1
    assert not rules.icmp_tunnel(table([flow(1, proto="ICMP", port=3 * 256, avg=1100.0, sent=120), flow(2, proto="ICMP", port=8 * 256, avg=1100.0, sent=1, got=1)]), CTX).collect()
    assert len(rules.covert_channel(table([flow(1, port=3232, dur=200.0, app="")]), CTX).collect()) == 1
    assert not rules.covert_channel(table([flow(1, port=3389, dur=200.0, app=""), flow(2, port=3232, dur=200.0, app="", back=0)]), CTX).collect()
    found = rules.exfiltration(table([flow(1, port=8443, out=350_000, back=1500, app="")] + [flow(i, out=100) for i in range(2, 30)]), CTX).collect()
    assert [f["flow_id"] for f in found] == [1] and found[0]["severity"] == "medium"


def query(i, name, ips=(), src="10.45.57.9", entropy=4.0):
    return (1, i, src, name, "A", list(ips), ",".join(ips), max(map(len, name.split(".")[:-2] or [""])), entropy, float(i))


def test_dns_used_and_unused(spark, table):
    names = [query(i, f"n{i}.example.com", [f"198.51.100.{i}"]) for i in range(80)]
    unused = rules.dns_subdomain_volume(spark.createDataFrame(names, DNS), table([flow(1)]), CTX).collect()
    assert len(unused) == 1 and '"observed_unused_subdomains":80' in unused[0]["evidence"]
    used = table([flow(i, dst=f"198.51.100.{i}") for i in range(80)])
    assert not rules.dns_subdomain_volume(spark.createDataFrame(names, DNS), used, CTX).collect()
    long = spark.createDataFrame([query(i, "a1b2c3d4" * 7 + f".t{i}.example.com") for i in range(3)], DNS)
    assert ids(rules.dns_long_label(long, table([flow(1)]), CTX)) == {"DNS_TUNNEL_LONG_LABEL"}


def test_indicators(spark, table):
    feeds = spark.createDataFrame([(1, "list", None, 86400.0 * 200)], "feed_id long, name string, published_on double, retrieved_on double")
    ind = spark.createDataFrame([(1, "domain", "evil.example", "x"), (1, "ipv4", "203.0.113.5", "y"), (1, "ipv4", "10.45.57.9", "z")], "feed_id long, kind string, value string, context string")
    dns = spark.createDataFrame([query(1, "a.evil.example"), query(2, "notevil.example")], DNS)
    found = rules.ioc_matches(table([flow(1)]), dns, ind, feeds, CTX).collect()
    assert {(f["title"].split()[0], f["severity"]) for f in found} == {("a.evil.example", "medium"), ("203.0.113.5", "medium")} or {f["title"].split()[0] for f in found} == {"evil.example", "203.0.113.5"}


def test_corroboration_and_cap(spark, rates):
    f = [(1, r, f"t{r}", "c", s, "rule", 0.5, "10.45.57.9", 1, "", "{}") for r, s in (("A", "high"), ("B", "low"), ("C", "medium"))]
    df = spark.createDataFrame(f, "session_id long, rule_id string, title string, category string, severity string, method string, confidence double, subject_ip string, flow_id long, rationale string, evidence string")
    quiet = spark.createDataFrame([(r, 0, 22, 1, 8) for r in "ABC"], rates.schema)
    assert rules.corroborate(df, quiet, CTX).first()["severity"] == "critical"
    assert rules.corroborate(df, quiet.where("rule_id <> 'C'"), CTX).isEmpty()
    capped = rules.annotate(df.withColumn("rule_id", rules.F.lit("C2_BEACON_PERIODIC")), rates).first()
    assert (capped["severity"], capped["severity_as_written"]) == ("low", "high")


def test_techniques(spark):
    rows = [(1, "10.0.0.1", "C2_BEACON_PERIODIC", "high", 2.0), (1, "10.0.0.1", "EXFIL_VOLUME_ASYMMETRY", "high", 1.0), (1, "10.0.0.2", "EXFIL_VOLUME_ASYMMETRY", "low", 1.0), (1, "10.0.0.2", "IOC_FEED_MATCH", "low", 1.0)]
    df = spark.createDataFrame(rows, "session_id long, subject_ip string, rule_id string, severity string, first_seen double")
    got = {(r["subject_ip"], r["rule_id"]): r["techniques"] for r in aggregates.techniques(df).collect()}
    assert got["10.0.0.1", "EXFIL_VOLUME_ASYMMETRY"] == ["T1041"] and got["10.0.0.2", "EXFIL_VOLUME_ASYMMETRY"] == ["T1048"] and got["10.0.0.2", "IOC_FEED_MATCH"] == []
    late = {r["stage"]: r["next_earlier"] for r in aggregates.scenario(df.where("subject_ip = '10.0.0.1'")).collect()}
    assert late == {12: True, 13: False}


def test_custody(spark):
    e = spark.createDataFrame([(1, i, "VIEWED", "B1", "10.0.0.1", f"d{i}|x", str(i)) for i in range(1, 5)], "exhibit_id long, sequence int, action string, actor_badge string, actor_ip string, detail string, timestamp string")
    c = custody.append(e)
    assert custody.problems(c).isEmpty()
    F = rules.F
    tests = {"content altered": c.withColumn("detail", F.when(F.col("sequence") == 3, "no").otherwise(F.col("detail"))), "numbered out of order": c.where("sequence <> 2"), "not linked to the entry before": c.where("sequence <> 2"), "actor_badge holds a separator": c.withColumn("actor_badge", F.lit("B|"))}
    for problem, df in tests.items():
        assert problem in {r["problem"] for r in custody.problems(df).collect()}, problem
    head = spark.createDataFrame([(1, 5, "0" * 64)], "exhibit_id long, entry_count int, head_hash string")
    assert {r["problem"] for r in custody.problems(c, head).collect()} == {"recorded count differs", "recorded end differs"}


def test_cef_escapes(spark):
    df = spark.createDataFrame([(1, 7, "R|1", "a|b\\c", "cat", "high", "rule", "10.0.0.1", "x=y\nz", 0.0)], "session_id long, finding_id long, rule_id string, title string, category string, severity string, method string, subject_ip string, rationale string, created double")
    line = exports.export(df, "cef").first()["record"]
    assert "|R\\|1|a\\|b\\\\c|8|" in line and "msg=x\\=y z" in line and "\n" not in line
