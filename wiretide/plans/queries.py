"""The registered queries of the engine's own operators, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import aggregates, anomaly, custody, evidence, exports, flows, governance, packages, rules, transport
from .views import once, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOME = ("10.0.0.0/8",)
#: Thresholds scaled to the tables at hand.
SCALED = {"beacon_min_connections": 12, "beacon_alert_score": 0.55, "beacon_min_period": 3600.0, "beacon_severity_high_score": 0.62, "keepalive_min_intervals": 20, "unknown_channel_min_duration": 60, "scan_unique_ports": 5, "scan_unique_ports_local": 60, "scan_inactivity_timeout": 86400, "dns_unique_subdomains": 2, "icmp_packet_bytes": 500}
CTX = rules.Context(home=HOME, thresholds=SCALED)


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle if SQL expresses it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def r(x: str, digits: int) -> str:
    """SQL for rounding half to even of the scaled value."""
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


EGRESS = "initiator_ip LIKE '10.%' AND NOT peer LIKE '10.%'"
DIRECTED = "SELECT *, CASE WHEN initiator_ip = src_ip THEN dst_ip ELSE src_ip END AS peer, CASE WHEN initiator_ip = src_ip THEN dst_port ELSE src_port END AS service FROM v_flow"
SEGMENTS = """
p AS (SELECT *, CASE WHEN (src, sport) <= (dst, dport) THEN src || ':' || CAST(sport AS VARCHAR) || '|' || dst || ':' || CAST(dport AS VARCHAR) ELSE dst || ':' || CAST(dport AS VARCHAR) || '|' || src || ':' || CAST(sport AS VARCHAR) END AS k,
  CASE proto WHEN 'TCP' THEN 86400.0 ELSE 43200.0 END AS idle, (proto = 'TCP' AND tcp_flags = 2) AS syn FROM v_packet),
q AS (SELECT *, sum(CASE WHEN syn THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, k, proto ORDER BY packet_no) AS rs FROM p),
u AS (SELECT *, max(ts) OVER (PARTITION BY session_id, k, proto, rs ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM q),
v AS (SELECT *, sum(CASE WHEN lt IS NULL OR ts - lt > idle THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, k, proto ORDER BY packet_no) AS seg FROM u),
w AS (SELECT *, first_value(src) OVER z AS isrc, first_value(sport) OVER z AS isport, first_value(syn) OVER z AS confirmed FROM v WINDOW z AS (PARTITION BY session_id, k, proto, seg ORDER BY packet_no)),
x AS (SELECT *, (src = isrc AND sport = isport) AS o FROM w)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_packet").withColumn("payload", F.col("payload_text").cast("binary")).drop("payload_text")


FLOW_COLUMNS = ("session_id", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "initiator_confirmed", "packets_sent", "packets_received", "bytes_sent", "bytes_received", "first_seen", "last_seen", "duration_seconds", "interval_count", "interval_mean", "interval_median", "interval_stddev", "interval_mad", "interval_dispersion", "bytes_ratio", "unique_dst_ports", "tcp_flags_seen", "app_protocol")


@query("flows", f"""WITH {SEGMENTS},
gaps AS (SELECT session_id, k, proto, seg, ts - lag(ts) OVER (PARTITION BY session_id, k, proto, seg ORDER BY ts) AS g, count(*) OVER (PARTITION BY session_id, k, proto, seg) AS n FROM x WHERE o AND (proto <> 'TCP' OR data_len > 1)),
m AS (SELECT session_id, k, proto, seg, count(*) AS c, avg(g) AS mean, median(g) AS med, stddev_pop(g) AS sd FROM gaps WHERE n >= 3 AND g > 0 GROUP BY ALL HAVING count(*) >= 2),
d AS (SELECT session_id, k, proto, seg, median(abs(g - med)) AS mad FROM gaps JOIN m USING (session_id, k, proto, seg) WHERE g > 0 GROUP BY ALL),
a AS (SELECT session_id, k, proto, seg, min(packet_no) AS flow_id, arg_min(src, packet_no) AS src_ip, arg_min(dst, packet_no) AS dst_ip, arg_min(sport, packet_no) AS src_port, arg_min(dport, packet_no) AS dst_port, bool_or(confirmed) AS initiator_confirmed,
  count(*) FILTER (o) AS packets_sent, count(*) FILTER (NOT o) AS packets_received, coalesce(sum(frame_len) FILTER (o), 0) AS bytes_sent, coalesce(sum(frame_len) FILTER (NOT o), 0) AS bytes_received, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT dport) AS unique_dst_ports,
  CASE WHEN bool_or(tcp_flags & 16 > 0) THEN 'A' ELSE '' END || CASE WHEN bool_or(tcp_flags & 1 > 0) THEN 'F' ELSE '' END || CASE WHEN bool_or(tcp_flags & 8 > 0) THEN 'P' ELSE '' END || CASE WHEN bool_or(tcp_flags & 4 > 0) THEN 'R' ELSE '' END || CASE WHEN bool_or(tcp_flags & 2 > 0) THEN 'S' ELSE '' END AS tcp_flags_seen,
  max(CASE WHEN 443 IN (dport, sport) THEN 'TLS' WHEN 80 IN (dport, sport) THEN 'HTTP' WHEN 53 IN (dport, sport) THEN 'DNS' ELSE '' END) AS app_protocol FROM x GROUP BY ALL)
SELECT session_id, flow_id, src_ip, dst_ip, src_port, dst_port, proto AS protocol, initiator_confirmed, CAST(packets_sent AS INT) AS packets_sent, CAST(packets_received AS INT) AS packets_received, CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(bytes_received AS BIGINT) AS bytes_received, first_seen, last_seen,
  {r('last_seen - first_seen', 3)} AS duration_seconds, CAST(coalesce(c, 0) AS INT) AS interval_count, coalesce({r('mean', 4)}, 0) AS interval_mean, coalesce({r('med', 4)}, 0) AS interval_median, coalesce({r('sd', 4)}, 0) AS interval_stddev, coalesce({r('mad', 4)}, 0) AS interval_mad, coalesce({r('mad / med', 4)}, 0) AS interval_dispersion,
  {r('bytes_sent / CAST(bytes_sent + bytes_received AS DOUBLE)', 4)} AS bytes_ratio, CAST(unique_dst_ports AS INT) AS unique_dst_ports, tcp_flags_seen, app_protocol
FROM a LEFT JOIN m USING (session_id, k, proto, seg) LEFT JOIN d USING (session_id, k, proto, seg)""")
def flow_table(spark, sf_dir):
    return flows.build_flows(packets(spark, sf_dir), {"TCP": 86400.0}, 43200.0).select(*FLOW_COLUMNS)




@query("flow_payload_entropy", f"""WITH {SEGMENTS}, e AS (SELECT packet_no, {r('-sum(c / n * log2(c / n))', 4)} AS h FROM (SELECT packet_no, ch, count(*) AS c, sum(count(*)) OVER (PARTITION BY packet_no) AS n FROM (SELECT packet_no, unnest(string_split(payload_text, '')) AS ch FROM v_packet) GROUP BY packet_no, ch) GROUP BY packet_no),
y AS (SELECT *, row_number() OVER (PARTITION BY session_id, k, proto, seg ORDER BY packet_no) AS nth FROM x WHERE length(payload_text) > 0)
SELECT session_id, min(packet_no) AS flow_id, round(avg(h), 2) AS payload_entropy, CAST(count(*) AS INT) AS entropy_sample_count FROM y JOIN e USING (packet_no) WHERE nth <= 40 GROUP BY session_id, k, proto, seg""")
def flow_payload_entropy(spark, sf_dir):
    f = flows.build_flows(packets(spark, sf_dir), {"TCP": 86400.0}, 43200.0)
    return f.where("entropy_sample_count > 0").select("session_id", "flow_id", F.round("payload_entropy", 2).alias("payload_entropy"), "entropy_sample_count")


@query("sessionise_gap", """WITH g AS (SELECT user_id, event_id, {seconds:ts} AS t, lag({seconds:ts}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events), s AS (SELECT *, sum(CASE WHEN l IS NULL OR t - l > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS seg FROM g)
SELECT user_id, CAST(seg AS BIGINT) AS seg, count(*) AS events, max(t) - min(t) AS span FROM s GROUP BY user_id, seg""")
def sessionise_gap(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "((CAST(datediff(CAST(ts AS DATE), DATE'1970-01-01') AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60) * 1000000 + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)) / 1000000D AS t")
    s = flows.sessionise(t, ["user_id"], ["t", "event_id"], "t", F.lit(43200.0), F.lit(False))
    return s.groupBy("user_id", "seg").agg(F.count("*").alias("events"), (F.max("t") - F.min("t")).alias("span"))


# ---- rules -------------------------------------------------------------------------------------------------------------


def _core(df: DataFrame, *more) -> DataFrame:
    return df.select("session_id", "rule_id", "severity", E.rnd("confidence", 6).alias("confidence"), "subject_ip", "flow_id", *more)


def _ev(path: str, kind: str):
    return F.get_json_object("evidence", f"$.{path}").cast(kind)


def _rule(name: str, df_of, columns: dict[str, str], sql: str) -> None:
    """A rule's query: the finding's core columns and some of its evidence."""
    query(name, sql)(lambda spark, sf_dir: _core(df_of(spark, sf_dir), *[_ev(c, k).alias(c) for c, k in columns.items()]))


def v_flow(spark, sf_dir):
    return view(spark, sf_dir, "v_flow")


def v_dns(spark, sf_dir):
    d = view(spark, sf_dir, "v_dns")
    return d.withColumn("response_ips", F.when(F.col("response_ip") == "", F.array().cast("array<string>")).otherwise(F.array("response_ip"))).select("*", E.dns_features("query_name").alias("f")).select("*", "f.*").drop("f")


_rule("rule_keepalive", lambda s, d: rules.keepalive(v_flow(s, d), rules.Context(home=HOME, thresholds=SCALED | {"beacon_min_period": 1.0})), {"connections_with_this_pattern": "long"}, f"""
WITH f AS ({DIRECTED}), s AS (SELECT *, ceil(greatest(0.0, 1 - interval_mad / interval_median) * 1000) / 1000 AS score FROM f WHERE interval_count >= 20 AND interval_median >= 1 AND {EGRESS}),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, initiator_ip, peer, dst_port ORDER BY score DESC, flow_id) AS nth, count(*) OVER (PARTITION BY session_id, initiator_ip, peer, dst_port) AS c FROM s WHERE score >= 0.55)
SELECT session_id, 'C2_BEACON_KEEPALIVE' AS rule_id, 'medium' AS severity, {r('least(score, 1.0)', 6)} AS confidence, initiator_ip AS subject_ip, flow_id, c AS connections_with_this_pattern FROM n WHERE nth = 1""")

_rule("rule_covert_channel", lambda s, d: rules.covert_channel(v_flow(s, d), CTX), {"service_port": "int", "bytes_sent": "long"}, f"""
WITH f AS ({DIRECTED}) SELECT session_id, 'COVERT_CHANNEL_UNKNOWN_PORT' AS rule_id, 'medium' AS severity, CAST(0.6 AS DOUBLE) AS confidence, initiator_ip AS subject_ip, flow_id, service AS service_port, bytes_sent FROM f
WHERE protocol = 'TCP' AND duration_seconds >= 60 AND {EGRESS} AND service NOT IN {rules.WELL_KNOWN_PORTS} AND app_protocol = '' AND tls_sni = '' AND bytes_sent > 0 AND bytes_received > 0 AND packets_sent >= 2 AND packets_received >= 2""")

_rule("rule_exfiltration", lambda s, d: rules.exfiltration(v_flow(s, d), CTX), {"volume": "long"}, f"""
WITH f AS ({DIRECTED}), o AS (SELECT session_id, bytes_sent, row_number() OVER (PARTITION BY session_id ORDER BY bytes_sent) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM v_flow WHERE bytes_sent > 0),
t AS (SELECT session_id, greatest(bytes_sent, 102400) AS volume FROM o WHERE i = least(CAST(floor(n * 95 / 100) AS BIGINT), n - 1)),
x AS (SELECT *, bytes_sent / CAST(CASE WHEN bytes_received = 0 THEN 1 ELSE bytes_received END AS DOUBLE) AS ratio, payload_entropy >= 7.6 AS high, (app_protocol = 'TLS' OR tls_sni <> '') AS tls FROM f JOIN t USING (session_id))
SELECT session_id, 'EXFIL_VOLUME_ASYMMETRY' AS rule_id, CASE WHEN high AND NOT tls THEN 'high' WHEN tls AND NOT high THEN 'low' ELSE 'medium' END AS severity, {r('least(ratio / 40.0, 1.0)', 6)} AS confidence, initiator_ip AS subject_ip, flow_id, CAST(volume AS BIGINT) AS volume FROM x WHERE bytes_sent >= volume AND ratio >= 10""")

_rule("rule_icmp_tunnel", lambda s, d: rules.icmp_tunnel(v_flow(s, d), CTX), {"packets": "long"}, f"""
WITH f AS ({DIRECTED}) SELECT session_id, 'ICMP_TUNNEL_OVERSIZED' AS rule_id, 'high' AS severity, {r('least(avg_packet_size / 2000, 1.0)', 6)} AS confidence, initiator_ip AS subject_ip, flow_id, CAST(packets_sent + packets_received AS BIGINT) AS packets FROM f
WHERE protocol = 'ICMP' AND avg_packet_size >= 500 AND dst_port // 256 IN (0, 8) AND packets_sent + packets_received >= 10""")

_rule("rule_port_scan", lambda s, d: rules.port_scan(v_flow(s, d), CTX), {"failures": "long", "attempted": "long", "episodes": "long", "largest": "long", "syn_only": "long"}, f"""
WITH f AS (SELECT *, packets_received < 2 AS failed FROM ({DIRECTED}) WHERE protocol = 'TCP'),
c AS (SELECT session_id, initiator_ip, count(DISTINCT peer || ':' || CAST(service AS VARCHAR)) AS attempted, count(DISTINCT CASE WHEN failed THEN peer || ':' || CAST(service AS VARCHAR) END) AS failures, CASE WHEN initiator_ip LIKE '10.%' THEN 60 ELSE 5 END AS bar FROM f GROUP BY ALL),
g AS (SELECT *, CASE WHEN first_seen - lag(first_seen) OVER (PARTITION BY session_id, initiator_ip ORDER BY first_seen, flow_id) > 86400 THEN 1 ELSE 0 END AS new FROM f WHERE failed),
e AS (SELECT *, sum(new) OVER (PARTITION BY session_id, initiator_ip ORDER BY first_seen, flow_id) AS episode FROM g),
m AS (SELECT session_id, initiator_ip, count(*) AS episodes, max(n) AS largest FROM (SELECT session_id, initiator_ip, episode, count(DISTINCT peer || ':' || CAST(service AS VARCHAR)) AS n FROM e GROUP BY ALL) GROUP BY ALL),
p AS (SELECT session_id, initiator_ip, count(*) AS probes, count(*) FILTER (tcp_flags_seen LIKE '%S%' AND tcp_flags_seen NOT LIKE '%A%') AS syn_only, arg_min(flow_id, (first_seen, flow_id)) AS flow_id FROM e GROUP BY ALL)
SELECT session_id, 'RECON_PORT_SCAN' AS rule_id, CASE WHEN syn_only / CAST(probes AS DOUBLE) > 0.8 THEN 'high' ELSE 'medium' END AS severity, {r('least(failures / CAST(bar * 4 AS DOUBLE), 1.0)', 6)} AS confidence, initiator_ip AS subject_ip, flow_id, failures, attempted, episodes, largest, syn_only
FROM c JOIN m USING (session_id, initiator_ip) JOIN p USING (session_id, initiator_ip) WHERE failures >= bar""")

BOWLEY = "CASE WHEN len(s) < 3 OR q3 - q1 < 10 OR q2 = q1 OR q2 = q3 THEN 0.0 ELSE (q1 + q3 - 2 * q2) / (q3 - q1) END"
PCT = "s[CAST(round_even({p} * (len(s) - 1), 0) AS INT) + 1]"


def _score_sql(what: str, source: str) -> str:
    return f"""SELECT session_id, host, peer, 1 - abs({BOWLEY}) AS {what}_skew, greatest(0.0, 1 - list_median(list_transform(s, lambda x: abs(x - md))) / md) AS {what}_madm, md AS {what}_med, mode_of AS {what}_mode
FROM (SELECT *, {PCT.format(p=0.25)} AS q1, {PCT.format(p=0.5)} AS q2, {PCT.format(p=0.75)} AS q3, list_median(s) AS md FROM ({source}) WHERE len(s) >= 2)"""


@query("rule_beaconing", f"""
WITH f AS ({DIRECTED}), p AS (SELECT session_id, initiator_ip AS host, peer, first_seen, flow_id, bytes_sent, first_seen - lag(first_seen) OVER (PARTITION BY session_id, initiator_ip, peer ORDER BY first_seen, flow_id) AS gap, count(*) OVER (PARTITION BY session_id, initiator_ip, peer) AS n FROM f WHERE {EGRESS}),
ok AS (SELECT session_id, host, peer, max(n) AS n, arg_min(flow_id, (first_seen, flow_id)) AS flow_id FROM p WHERE n >= 12 GROUP BY ALL HAVING median(gap) >= 3600),
modes AS (SELECT session_id, host, peer, arg_max(v, (c, -v)) AS mode_of FROM (SELECT session_id, host, peer, bytes_sent AS v, count(*) AS c FROM p WHERE bytes_sent > 0 GROUP BY ALL) GROUP BY ALL),
t AS ({_score_sql('ts', 'SELECT session_id, host, peer, list(gap ORDER BY gap) FILTER (gap > 0) AS s, 0 AS mode_of FROM p GROUP BY ALL')}),
d AS ({_score_sql('ds', 'SELECT session_id, host, peer, list(CAST(bytes_sent AS DOUBLE) ORDER BY bytes_sent) FILTER (bytes_sent > 0) AS s, max(mode_of) AS mode_of FROM p JOIN modes USING (session_id, host, peer) GROUP BY ALL')}),
k AS (SELECT *, {r('(ceil((ts_skew + ts_madm) / 2 * 1000) / 1000 + ceil((ds_skew + ds_madm + greatest(0.0, 1 - ds_mode / 65535)) / 3 * 1000) / 1000) / 2', 4)} AS score FROM ok JOIN t USING (session_id, host, peer) JOIN d USING (session_id, host, peer))
SELECT session_id, 'C2_BEACON_PERIODIC' AS rule_id, CASE WHEN score >= 0.62 THEN 'high' ELSE 'medium' END AS severity, {r('least(score, 1.0)', 6)} AS confidence, host AS subject_ip, flow_id, n AS connection_count FROM k WHERE score >= 0.55""")
def rule_beaconing(spark, sf_dir):
    return _core(rules.beaconing(once(spark, sf_dir, "v_flow"), CTX), _ev("connection_count", "long").alias("connection_count"))


DNS_FACTS = """
n AS (SELECT *, lower(query_name) AS name, CASE WHEN len(string_split(query_name, '.')) < 2 THEN query_name ELSE string_split(query_name, '.')[-2] || '.' || string_split(query_name, '.')[-1] END AS parent, string_split(query_name, '.') AS l FROM v_dns),
h AS (SELECT *, CASE WHEN len(l) > 2 THEN list_max(list_transform(l[1:-3], lambda x: length(x))) ELSE 0 END AS longest, CASE WHEN len(l) > 2 THEN array_to_string(l[1:-3], '') ELSE '' END AS sub FROM n),
peers AS (SELECT DISTINCT session_id, host, ip FROM (SELECT session_id, src_ip AS host, dst_ip AS ip FROM v_flow WHERE app_protocol <> 'DNS' AND dst_port <> 53 UNION ALL SELECT session_id, dst_ip, src_ip FROM v_flow WHERE app_protocol <> 'DNS' AND dst_port <> 53)),
u AS (SELECT DISTINCT a.session_id, a.src_ip, a.name FROM n a JOIN n b ON a.session_id = b.session_id AND a.name = b.name AND b.response_ip <> '' JOIN peers p ON p.session_id = a.session_id AND p.host = a.src_ip AND p.ip = b.response_ip),
z AS (SELECT h.*, u.name IS NOT NULL AS used FROM h LEFT JOIN u ON h.session_id = u.session_id AND h.src_ip = u.src_ip AND h.name = u.name)"""


@query("rule_dns_subdomain_volume", f"""WITH {DNS_FACTS}, c AS (SELECT session_id, src_ip, parent, name, count(*) AS asked, bool_or(used) AS used FROM z GROUP BY ALL),
g AS (SELECT session_id, src_ip, parent, count(*) AS names, count(*) FILTER (NOT used) AS loose, count(*) FILTER (NOT used AND asked = 1) AS once FROM c GROUP BY ALL)
SELECT session_id, 'DNS_TUNNEL_SUBDOMAIN_VOLUME' AS rule_id, 'medium' AS severity, {r('least(loose / 8.0, 1.0)', 6)} AS confidence, src_ip AS subject_ip, CAST(NULL AS BIGINT) AS flow_id, names AS observed_unique_subdomains, loose AS observed_unused_subdomains, once AS unused_names_queried_once FROM g WHERE names > 2 AND loose > 2""")
def rule_dns_subdomain_volume(spark, sf_dir):
    return _core(rules.dns_subdomain_volume(v_dns(spark, sf_dir), once(spark, sf_dir, "v_flow"), CTX), *[_ev(c, "long").alias(c) for c in ("observed_unique_subdomains", "observed_unused_subdomains", "unused_names_queried_once")])


@query("rule_dns_long_label", f"""WITH {DNS_FACTS}, e AS (SELECT sub, {r('-sum(c / n * log2(c / n))', 4)} AS ent FROM (SELECT sub, ch, count(*) AS c, sum(count(*)) OVER (PARTITION BY sub) AS n FROM (SELECT sub, unnest(string_split(sub, '')) AS ch FROM (SELECT DISTINCT sub FROM h)) GROUP BY sub, ch) GROUP BY sub),
g AS (SELECT session_id, src_ip, parent, count(*) AS n, max(longest) AS longest, arg_min(flow_id, (timestamp, flow_id)) AS flow_id FROM z JOIN e USING (sub) WHERE longest >= 52 AND ent >= 3.5 AND NOT used GROUP BY ALL)
SELECT session_id, 'DNS_TUNNEL_LONG_LABEL' AS rule_id, 'high' AS severity, {r('least(longest / 208.0, 1.0)', 6)} AS confidence, src_ip AS subject_ip, flow_id, n AS observed_query_count FROM g""")
def rule_dns_long_label(spark, sf_dir):
    return _core(rules.dns_long_label(v_dns(spark, sf_dir), once(spark, sf_dir, "v_flow"), CTX), _ev("observed_query_count", "long").alias("observed_query_count"))


IOC_HITS = f"""
f AS ({DIRECTED}), ends AS (SELECT session_id, initiator_ip AS subject, flow_id, first_seen AS ts, unnest(CASE WHEN src_ip = dst_ip THEN [src_ip] ELSE [src_ip, dst_ip] END) AS value FROM f),
names AS (SELECT session_id, initiator_ip AS subject, flow_id, first_seen AS ts, tls_sni AS name, 'server name' AS seen_in FROM f UNION ALL SELECT session_id, initiator_ip, flow_id, first_seen, http_host, 'http host' FROM f UNION ALL SELECT session_id, src_ip, flow_id, timestamp, query_name, 'dns query' FROM v_dns),
sfx AS (SELECT session_id, subject, flow_id, ts, seen_in, lower(name) AS name, unnest(range(1, len(string_split(name, '.')))) AS i FROM names WHERE name <> ''),
hits AS (SELECT session_id, subject, feed_id, kind, e.value, 'address' AS seen_in, flow_id, ts FROM ends e JOIN v_indicator i ON e.value = i.value AND i.kind = 'ipv4' WHERE e.value NOT LIKE '10.%'
  UNION ALL SELECT session_id, subject, feed_id, kind, value, seen_in, flow_id, ts FROM sfx JOIN v_indicator ON array_to_string(string_split(name, '.')[i:], '.') = value AND kind = 'domain')"""


@query("rule_ioc_match", f"""WITH {IOC_HITS}, g AS (SELECT session_id, subject, feed_id, kind, value, seen_in, count(*) AS n, min(ts) AS seen, arg_min(flow_id, (ts, flow_id)) AS flow_id FROM hits GROUP BY ALL), x AS (SELECT g.*, {r('(coalesce(published_on, retrieved_on) - seen) / 86400', 1)} AS stale FROM g JOIN v_feed USING (feed_id))
SELECT session_id, 'IOC_FEED_MATCH' AS rule_id, CASE WHEN stale > 90 THEN 'medium' ELSE 'high' END AS severity, CAST(1 AS DOUBLE) AS confidence, subject AS subject_ip, flow_id, value, seen_in, n AS occurrences, stale AS stale_days FROM x""")
def rule_ioc_match(spark, sf_dir):
    ind, feeds = view(spark, sf_dir, "v_indicator"), view(spark, sf_dir, "v_feed")
    f = rules.ioc_matches(v_flow(spark, sf_dir), v_dns(spark, sf_dir), ind, feeds, CTX)
    return _core(f, _ev("value", "string").alias("value"), _ev("seen_in", "string").alias("seen_in"), _ev("occurrences", "long").alias("occurrences"), _ev("stale_days", "double").alias("stale_days"))


@query("label_suffix_join", """WITH i AS (SELECT DISTINCT value FROM v_indicator WHERE kind = 'domain') SELECT query_name, value FROM v_dns JOIN i ON lower(query_name) = value OR lower(query_name) LIKE '%.' || value""")
def label_suffix_join(spark, sf_dir):
    i = view(spark, sf_dir, "v_indicator").where("kind = 'domain'").select("value").distinct()
    return view(spark, sf_dir, "v_dns").select("query_name", F.explode(E.label_suffixes("query_name")).alias("value")).join(i, "value").select("query_name", "value")


@query("corroboration", """WITH b AS (SELECT rule_id FROM v_base_rate WHERE benign_fired <= 6), g AS (SELECT session_id, subject_ip, count(DISTINCT rule_id) AS n FROM v_finding JOIN b USING (rule_id) GROUP BY ALL) SELECT session_id, 'critical' AS severity, subject_ip, least(n / 6.0, 1.0)::DOUBLE AS confidence FROM g WHERE n >= 3""")
def corroboration(spark, sf_dir):
    base = view(spark, sf_dir, "v_base_rate").withColumn("benign_fired", F.when(F.col("benign_fired") <= 6, 0).otherwise(F.col("benign_fired")))
    return rules.corroborate(view(spark, sf_dir, "v_finding"), base, CTX).select("session_id", "severity", "subject_ip", "confidence")


@query("base_rate_annotation", """SELECT f.session_id, f.flow_id, CASE WHEN benign_fired > 0 AND malicious_fired = 0 THEN 'low' ELSE severity END AS severity, severity AS severity_as_written, 'fired on ' || benign_fired || ' of 22 ordinary and ' || malicious_fired || ' of 8 attack captures' AS base_rate FROM v_finding f LEFT JOIN v_base_rate USING (rule_id)""")
def base_rate_annotation(spark, sf_dir):
    return rules.annotate(view(spark, sf_dir, "v_finding"), view(spark, sf_dir, "v_base_rate")).select("session_id", "flow_id", "severity", "severity_as_written", "base_rate")


WEIGHT = "CASE severity WHEN 'low' THEN 10 WHEN 'medium' THEN 35 WHEN 'high' THEN 70 ELSE 95 END"
RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


@query("risk_rollup", f"""SELECT f.session_id, f.flow_id, CAST(coalesce(w, 0) AS INT) AS risk_score FROM v_flow f LEFT JOIN (SELECT session_id, flow_id, max({WEIGHT}) AS w FROM v_finding GROUP BY ALL) x USING (session_id, flow_id)""")
def risk_rollup(spark, sf_dir):
    return rules.risk_rollup(v_flow(spark, sf_dir), view(spark, sf_dir, "v_finding")).select("session_id", "flow_id", "risk_score")


@query("triage_carry_forward", """SELECT session_id, flow_id, title, CASE WHEN triage_status = 'pending' THEN 'pending' ELSE triage_status END AS triage_status, CASE WHEN triage_status <> 'pending' THEN 'B7' END AS reviewed_by FROM v_finding""")
def triage_carry_forward(spark, sf_dir):
    f = view(spark, sf_dir, "v_finding")
    old = f.withColumns({"reviewed_by": F.lit("B7"), "reviewed_at": F.col("first_seen"), "review_note": F.lit("seen")})
    return rules.carry_triage(f.drop("triage_status"), old).select("session_id", "flow_id", "title", "triage_status", "reviewed_by")


@query("findings_all")
def findings_all(spark, sf_dir):
    base = view(spark, sf_dir, "v_base_rate")
    return rules.analyse(v_flow(spark, sf_dir), v_dns(spark, sf_dir), CTX, base, view(spark, sf_dir, "v_indicator"), view(spark, sf_dir, "v_feed"))


# ---- summaries ---------------------------------------------------------------------------------------------------------


@query("protocol_rollup", "SELECT session_id, protocol, count(*) AS flows, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS bytes FROM v_flow GROUP BY ALL")
def protocol_rollup(spark, sf_dir):
    return aggregates.protocol_rollup(v_flow(spark, sf_dir))


@query("app_protocol_rollup", "SELECT session_id, app_protocol, count(*) AS flows, count(*) FILTER (app_protocol_source = 'observed') AS observed, count(*) FILTER (app_protocol_source <> 'observed') AS inferred, CAST(row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, app_protocol) AS INT) AS place FROM v_flow WHERE app_protocol <> '' GROUP BY session_id, app_protocol QUALIFY place <= 8")
def app_protocol_rollup(spark, sf_dir):
    return aggregates.app_protocol_rollup(v_flow(spark, sf_dir))


@query("top_talkers", "SELECT session_id, initiator_ip AS host, count(*) AS flows, CAST(sum(bytes_sent) AS BIGINT) AS bytes, CAST(row_number() OVER (PARTITION BY session_id ORDER BY sum(bytes_sent) DESC, initiator_ip) AS INT) AS place FROM v_flow GROUP BY session_id, initiator_ip QUALIFY place <= 10")
def top_talkers(spark, sf_dir):
    return aggregates.top_talkers(v_flow(spark, sf_dir))


@query("top_dns_names", "SELECT session_id, query_name, count(*) AS queries, CAST(row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, query_name) AS INT) AS place FROM v_dns GROUP BY session_id, query_name QUALIFY place <= 5")
def top_dns_names(spark, sf_dir):
    return aggregates.top_names(view(spark, sf_dir, "v_dns"))


@query("severity_histogram", "SELECT session_id, severity, count(*) AS findings FROM v_finding GROUP BY ALL")
def severity_histogram(spark, sf_dir):
    return aggregates.severity_histogram(view(spark, sf_dir, "v_finding"))


@query("session_totals", "WITH f AS (SELECT session_id, count(*) AS flows, CAST(sum(packets_sent + packets_received) AS BIGINT) AS packets, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS bytes FROM v_flow GROUP BY ALL), d AS (SELECT session_id, count(*) AS dns_queries FROM v_dns GROUP BY ALL), x AS (SELECT session_id, count(*) AS findings, count(*) FILTER (triage_status = 'pending') AS pending, count(DISTINCT flow_id) AS flagged_flows FROM v_finding GROUP BY ALL) SELECT * FROM f JOIN d USING (session_id) JOIN x USING (session_id)")
def session_totals(spark, sf_dir):
    return aggregates.session_totals(v_flow(spark, sf_dir), view(spark, sf_dir, "v_dns"), view(spark, sf_dir, "v_finding"))


def risky_flows(spark, sf_dir):
    return rules.risk_rollup(v_flow(spark, sf_dir), view(spark, sf_dir, "v_finding"))


RISKY = f"rf AS (SELECT f.*, coalesce(w, 0) AS risk_score FROM ({DIRECTED}) f LEFT JOIN (SELECT session_id, flow_id, max({WEIGHT}) AS w FROM v_finding GROUP BY ALL) x USING (session_id, flow_id))"
EDGES = f"{RISKY}, e AS (SELECT session_id, initiator_ip AS source, peer AS target, count(*) AS flows, CAST(sum(bytes_sent + bytes_received) AS BIGINT) AS bytes, list_sort(list(DISTINCT CASE WHEN app_protocol <> '' THEN app_protocol ELSE protocol END)) AS protocols, max(risk_score) AS risk FROM rf WHERE initiator_ip <> peer GROUP BY ALL)"


@query("edges", f"WITH {EDGES} SELECT session_id, source, target, flows, bytes, array_to_string(protocols, ',') AS protocols, CAST(risk AS INT) AS risk FROM e")
def edge_table(spark, sf_dir):
    return aggregates.edges(risky_flows(spark, sf_dir)).withColumn("protocols", F.array_join("protocols", ","))


@query("edge_width", f"WITH {EDGES} SELECT session_id, source, target, round(1 + 3.5 * log10(bytes + 1) / log10(max(bytes) OVER (PARTITION BY session_id) + 1), 4) AS width FROM e")
def edge_width(spark, sf_dir):
    return aggregates.edge_width(aggregates.edges(risky_flows(spark, sf_dir))).select("session_id", "source", "target", F.round("width", 4).alias("width"))


@query("barycentre", f"WITH {EDGES}, n AS (SELECT session_id, source AS host, target AS n FROM e UNION SELECT session_id, target, source FROM e), r AS (SELECT session_id, host, length(host) AS row FROM n GROUP BY ALL) SELECT n.session_id, n.host, round(avg(r.row), 6) AS barycentre FROM n JOIN r ON r.session_id = n.session_id AND r.host = n.n GROUP BY ALL")
def barycentre(spark, sf_dir):
    e = aggregates.edges(risky_flows(spark, sf_dir))
    hosts = e.select("session_id", F.explode(F.array("source", "target")).alias("host")).distinct().withColumn("row", F.length("host"))
    return aggregates.barycentre(e, hosts).withColumn("barycentre", F.round("barycentre", 6))


HOSTS = f"""{RISKY}, t AS (SELECT session_id, initiator_ip AS host, peer, TRUE AS first, service AS port, bytes_sent AS bo, bytes_received AS bi, first_seen, last_seen FROM rf UNION ALL SELECT session_id, peer, initiator_ip, FALSE, service, bytes_received, bytes_sent, first_seen, last_seen FROM rf),
g AS (SELECT session_id, host, count(*) AS flow_count, count(*) FILTER (first) AS flows_initiated, count(*) FILTER (NOT first) AS flows_received, CAST(sum(bo) AS BIGINT) AS bytes_out, CAST(sum(bi) AS BIGINT) AS bytes_in, count(DISTINCT peer) AS peer_count, count(DISTINCT CASE WHEN peer LIKE '10.%' THEN peer END) AS internal_peer_count, count(DISTINCT CASE WHEN NOT peer LIKE '10.%' THEN peer END) AS external_peer_count,
  count(DISTINCT CASE WHEN first AND port <> 0 THEN port END) AS unique_ports_contacted, count(DISTINCT CASE WHEN NOT first AND port = 53 THEN peer END) AS dns_clients, min(first_seen) AS first_seen, max(last_seen) AS last_seen, host LIKE '10.%' AS is_internal FROM t GROUP BY ALL),
f AS (SELECT session_id, subject_ip AS host, count(*) AS finding_count, count(DISTINCT rule_id) AS distinct_rules, max({RANK}) AS worst, count(*) FILTER (triage_status = 'pending') AS untriaged_findings FROM v_finding GROUP BY ALL)"""


@query("host_profiles", f"""WITH {HOSTS} SELECT g.*, CASE WHEN dns_clients >= 2 THEN 'resolver' WHEN NOT is_internal AND internal_peer_count >= 2 AND flows_received > 0 THEN 'gateway' WHEN flows_received > flows_initiated AND peer_count >= 2 THEN 'server' WHEN unique_ports_contacted >= 25 THEN 'scanner' ELSE 'client' END AS role, coalesce(finding_count, 0) AS finding_count, CAST(coalesce(distinct_rules, 0) AS INT) AS distinct_rules, coalesce(untriaged_findings, 0) AS untriaged_findings,
CAST(row_number() OVER (PARTITION BY session_id ORDER BY coalesce(worst, 0) DESC, coalesce(distinct_rules, 0) DESC, flow_count DESC, host) AS INT) AS place FROM g LEFT JOIN f USING (session_id, host)""")
def host_profiles(spark, sf_dir):
    p = aggregates.host_profiles(v_flow(spark, sf_dir), view(spark, sf_dir, "v_finding"), HOME)
    return p.select("session_id", "host", "flow_count", "flows_initiated", "flows_received", "bytes_out", "bytes_in", "peer_count", "internal_peer_count", "external_peer_count", "unique_ports_contacted", "dns_clients", "first_seen", "last_seen", "is_internal", "role", "finding_count", "distinct_rules", "untriaged_findings", "place")


GRAPH = f"""{EDGES}, d AS (SELECT session_id, source AS host, target AS peer, bytes, flows FROM e UNION ALL SELECT session_id, target, source, bytes, flows FROM e),
t AS (SELECT session_id, host, sum(bytes) AS bytes, sum(flows) AS flows, count(DISTINCT peer) AS peers FROM d GROUP BY ALL), f AS (SELECT session_id, subject_ip AS host, max({RANK}) AS sr, count(*) AS fc FROM v_finding GROUP BY ALL),
nr AS (SELECT DISTINCT session_id, host FROM (SELECT d.session_id, d.peer AS host FROM d SEMI JOIN f USING (session_id, host) UNION ALL SELECT t.session_id, t.host FROM t SEMI JOIN f USING (session_id, host))),
a AS (SELECT t.*, coalesce(sr, 0) AS sr, coalesce(fc, 0) AS fc, (nr.host IS NOT NULL) AS competes FROM t LEFT JOIN f USING (session_id, host) LEFT JOIN nr ON nr.session_id = t.session_id AND nr.host = t.host),
k AS (SELECT *, competes AND row_number() OVER (PARTITION BY session_id, competes ORDER BY sr DESC, bytes DESC, host DESC) <= 36 AS kept FROM a),
s AS (SELECT d.session_id, d.host, count(DISTINCT d.peer) AS shared FROM d JOIN k ON k.session_id = d.session_id AND k.host = d.peer AND k.kept GROUP BY ALL),
n AS (SELECT k.*, kept OR (competes AND NOT kept AND coalesce(shared, 0) >= 2 AND row_number() OVER (PARTITION BY k.session_id, (competes AND NOT kept) ORDER BY coalesce(shared, 0) DESC, k.host DESC) <= 4) AS drawn FROM k LEFT JOIN s ON s.session_id = k.session_id AND s.host = k.host)"""


@query("graph_nodes", f"WITH {GRAPH} SELECT session_id, host, CAST(bytes AS BIGINT) AS bytes, CAST(flows AS BIGINT) AS flows, peers, CAST(sr AS INT) AS severity_rank, fc AS finding_count, drawn FROM n")
def graph_nodes(spark, sf_dir):
    return aggregates.graph_nodes(aggregates.edges(risky_flows(spark, sf_dir)), view(spark, sf_dir, "v_finding"), 40)


@query("graph_edges", f"""WITH {GRAPH}, m AS (SELECT e.session_id, CASE WHEN s.drawn THEN source ELSE target END AS source, CASE WHEN s.drawn AND x.drawn THEN target ELSE 'other-hosts' END AS target, bytes_ AS bytes, flows_ AS flows, risk FROM (SELECT session_id, source, target, bytes AS bytes_, flows AS flows_, risk FROM e) e JOIN n s ON s.session_id = e.session_id AND s.host = source JOIN n x ON x.session_id = e.session_id AND x.host = target WHERE s.drawn OR x.drawn),
g AS (SELECT session_id, source, target, sum(bytes) AS bytes, sum(flows) AS flows, max(risk) AS risk FROM m GROUP BY ALL), h AS (SELECT session_id, source, target, bytes, unnest([source, target]) AS host FROM g),
b AS (SELECT DISTINCT session_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY session_id, host ORDER BY bytes DESC, source, target) AS nth FROM h) WHERE nth <= 2),
q AS (SELECT g.* FROM g LEFT JOIN b USING (session_id, source, target) WHERE risk > 0 OR b.source IS NOT NULL)
SELECT session_id, source, target, CAST(bytes AS BIGINT) AS bytes, CAST(flows AS BIGINT) AS flows, CAST(risk AS INT) AS risk, CAST(row_number() OVER (PARTITION BY session_id ORDER BY risk DESC, bytes DESC, source, target) AS INT) AS place FROM q QUALIFY place <= 150""")
def graph_edges(spark, sf_dir):
    e = aggregates.edges(risky_flows(spark, sf_dir))
    return aggregates.graph_edges(e, aggregates.graph_nodes(e, view(spark, sf_dir, "v_finding"), 40))


@query("timeline", f"""WITH {RISKY}, s AS (SELECT session_id, min(first_seen) AS a, greatest((max(last_seen) - min(first_seen)) / 60, 1.0) AS w FROM rf GROUP BY ALL), g AS (SELECT session_id, least(CAST(floor((first_seen - a) / w) AS INT), 59) AS t, count(*) AS flows, sum(bytes_sent + bytes_received) AS bytes, count(*) FILTER (risk_score > 0) AS flagged FROM rf JOIN s USING (session_id) GROUP BY ALL)
SELECT s.session_id, CAST(x.t AS INT) AS t, coalesce(flows, 0) AS flows, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(flagged, 0) AS flagged FROM s, (SELECT unnest(range(60)) AS t) x LEFT JOIN g ON g.session_id = s.session_id AND g.t = x.t""")
def timeline(spark, sf_dir):
    return aggregates.timeline(risky_flows(spark, sf_dir), 60)


@query("home_net_proposal", """WITH e AS (SELECT session_id, unnest([src_ip, dst_ip]) AS address, packets_sent + packets_received AS n FROM v_flow), t AS (SELECT session_id, sum(packets_sent + packets_received) AS sampled FROM v_flow GROUP BY ALL), h AS (SELECT session_id, address, sum(n) AS hits, regexp_replace(address, '[0-9]+$', '0/24') AS network FROM e GROUP BY ALL),
b AS (SELECT h.*, sampled, hits >= greatest(2, floor(sampled * 0.01)) AS busy FROM h JOIN t USING (session_id)), g AS (SELECT session_id, network, sum(hits) AS appearances, coalesce(sum(hits) FILTER (busy), 0) AS weight, count(*) FILTER (busy) AS busy_hosts, arg_max(address, (hits, address)) FILTER (busy) AS busiest, max(sampled) AS sampled FROM b GROUP BY ALL)
SELECT session_id, CASE WHEN appearances < sampled * 0.01 OR busy_hosts = 0 THEN '' WHEN busy_hosts >= 2 THEN network ELSE busiest || '/32' END AS proposal, network, CAST(appearances AS BIGINT) AS appearances, busy_hosts, CAST(sampled AS BIGINT) AS sampled FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, appearances DESC, network) = 1""")
def home_net_proposal(spark, sf_dir):
    return aggregates.home_net_proposal(v_flow(spark, sf_dir), coverage=0.01)


TECH = """CASE rule_id WHEN 'RECON_PORT_SCAN' THEN ['T1595.001', 'T1046'] WHEN 'EXFIL_VOLUME_ASYMMETRY' THEN ['T1048'] WHEN 'ICMP_TUNNEL_OVERSIZED' THEN ['T1572', 'T1095'] WHEN 'COVERT_CHANNEL_UNKNOWN_PORT' THEN ['T1571'] ELSE [] END"""


@query("techniques", f"SELECT session_id, flow_id, array_to_string({TECH}, ',') AS techniques FROM v_finding")
def techniques(spark, sf_dir):
    return aggregates.techniques(view(spark, sf_dir, "v_finding")).select("session_id", "flow_id", F.array_join("techniques", ",").alias("techniques"))


@query("scenario", f"""WITH t AS (SELECT *, unnest({TECH}) AS technique FROM v_finding), a AS (SELECT *, CASE WHEN technique = 'T1595.001' THEN 1 WHEN technique = 'T1046' THEN 9 WHEN technique = 'T1048' THEN 13 ELSE 12 END AS stage FROM t), g AS (SELECT session_id, subject_ip, stage, count(*) AS findings, min(first_seen) AS first_seen, max({RANK}) AS worst FROM a GROUP BY ALL)
SELECT session_id, subject_ip, CAST(stage AS INT) AS stage, findings, first_seen, CAST(worst AS INT) AS worst, coalesce(lead(first_seen) OVER (PARTITION BY session_id, subject_ip ORDER BY stage) < first_seen, FALSE) AS next_earlier FROM g""")
def scenario(spark, sf_dir):
    return aggregates.scenario(view(spark, sf_dir, "v_finding")).select("session_id", "subject_ip", "stage", "findings", "first_seen", "worst", "next_earlier")


@query("severity_share", "WITH g AS (SELECT session_id, severity, count(*) AS findings FROM v_finding GROUP BY ALL) SELECT *, round(findings / sum(findings) OVER (PARTITION BY session_id), 6) AS share_of_sum, round(findings / max(findings) OVER (PARTITION BY session_id), 6) AS share_of_max FROM g")
def severity_share(spark, sf_dir):
    s = aggregates.max_share(aggregates.severity_histogram(view(spark, sf_dir, "v_finding")), "findings")
    return s.withColumns({c: F.round(c, 6) for c in ("share_of_sum", "share_of_max")})


# ---- exports -----------------------------------------------------------------------------------------------------------


def full_findings(spark, sf_dir):
    f = view(spark, sf_dir, "v_finding")
    return f.withColumns({"finding_id": F.col("flow_id"), "category": F.lit("network"), "method": F.lit("rule"), "rationale": F.lit("because a=b"), "created": F.lit(1700000000.0)})


@query("export_cef", f"""SELECT flow_id AS finding_id, 'CEF:0|Wiretide|FlowAnalytics|1|' || rule_id || '|' || replace(title, '|', '\\|') || '|' || CASE severity WHEN 'low' THEN '3' WHEN 'medium' THEN '5' WHEN 'high' THEN '8' ELSE '10' END || '|rt=1700000000000 cat=network act=rule msg=because a\\=b externalId=' || flow_id || ' cs1=' || severity || ' cs1Label=severity cs3=' || array_to_string({TECH}, ' ') || ' cs3Label=mitreAttackTechnique' AS record FROM v_finding""")
def export_cef(spark, sf_dir):
    return exports.export(full_findings(spark, sf_dir), "cef")


@query("export_syslog", f"""SELECT flow_id AS finding_id, '<' || CASE severity WHEN 'low' THEN '134' WHEN 'medium' THEN '133' WHEN 'high' THEN '132' ELSE '130' END || '>1 2023-11-14T22:13:20+00:00 - wiretide - ' || rule_id || ' - CEF:0|Wiretide|FlowAnalytics|1|' || rule_id || '|' || replace(title, '|', '\\|') || '|' || CASE severity WHEN 'low' THEN '3' WHEN 'medium' THEN '5' WHEN 'high' THEN '8' ELSE '10' END || '|rt=1700000000000 cat=network act=rule msg=because a\\=b externalId=' || flow_id || ' cs1=' || severity || ' cs1Label=severity cs3=' || array_to_string({TECH}, ' ') || ' cs3Label=mitreAttackTechnique' AS record FROM v_finding""")
def export_syslog(spark, sf_dir):
    return exports.export(full_findings(spark, sf_dir), "syslog")


@query("export_ecs", f"SELECT flow_id AS finding_id, '2023-11-14T22:13:20+00:00' AS stamp, CASE severity WHEN 'low' THEN 21 WHEN 'medium' THEN 47 WHEN 'high' THEN 73 ELSE 99 END AS severity, rule_id, list_transform({TECH}, lambda x: string_split(x, '.')[1])[1] AS technique FROM v_finding")
def export_ecs(spark, sf_dir):
    e = exports.export(full_findings(spark, sf_dir), "ecs")
    at = lambda p: F.get_json_object("record", p)
    return e.select("finding_id", at("$.@timestamp").alias("stamp"), at("$.event.severity").cast("int").alias("severity"), at("$.rule.id").alias("rule_id"), at("$.threat.technique.id[0]").alias("technique"))


@query("select_alerts", f"SELECT session_id, flow_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY {RANK} DESC, confidence DESC, flow_id) AS INT) AS place, greatest(count(*) OVER (PARTITION BY session_id) - 100, 0) AS suppressed FROM v_finding WHERE {RANK} >= 3 QUALIFY place <= 100")
def select_alerts(spark, sf_dir):
    return exports.select_alerts(full_findings(spark, sf_dir)).select("session_id", "flow_id", "place", "suppressed")


@query("fresh_alerts", "SELECT session_id, flow_id FROM v_finding WHERE triage_status <> 'confirmed'")
def fresh_alerts(spark, sf_dir):
    f = view(spark, sf_dir, "v_finding")
    return exports.fresh(f, f.where("triage_status = 'confirmed'")).select("session_id", "flow_id")


# ---- custody and governance --------------------------------------------------------------------------------------------

CHAIN = """WITH RECURSIVE {views}e AS (SELECT *, row_number() OVER (PARTITION BY exhibit_id ORDER BY sequence) AS n FROM v_custody), c AS (SELECT exhibit_id, n, '' AS previous_hash, sha256(concat_ws('|', exhibit_id, n, action, actor_badge, actor_ip, detail, timestamp, '')) AS entry_hash FROM e WHERE n = 1 UNION ALL SELECT e.exhibit_id, e.n, c.entry_hash, sha256(concat_ws('|', e.exhibit_id, e.n, action, actor_badge, actor_ip, detail, timestamp, c.entry_hash)) FROM c JOIN e ON e.exhibit_id = c.exhibit_id AND e.n = c.n + 1)"""


@query("custody_append")
def custody_append(spark, sf_dir):
    return custody.append(view(spark, sf_dir, "v_custody")).select("exhibit_id", "sequence", "previous_hash", "entry_hash")


ORACLES["custody_append"] = oracle("SELECT exhibit_id FROM v_custody").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT exhibit_id FROM v_custody", "") + CHAIN.replace("WITH RECURSIVE {views}", ", ") + " SELECT exhibit_id, CAST(n AS INT) AS sequence, previous_hash, entry_hash FROM c"


@query("custody_verify", """WITH n AS (SELECT exhibit_id, CAST(row_number() OVER (PARTITION BY exhibit_id ORDER BY sequence) AS INT) AS sequence FROM v_custody) SELECT exhibit_id, sequence, 'content altered' AS problem FROM n WHERE exhibit_id % 10 = 3 AND sequence = 2 UNION ALL SELECT exhibit_id, NULL, 'recorded count differs' FROM (SELECT DISTINCT exhibit_id FROM n) WHERE exhibit_id % 10 = 4""")
def custody_verify(spark, sf_dir):
    c = custody.append(view(spark, sf_dir, "v_custody"))
    head = c.groupBy("exhibit_id").agg((F.count("*") + F.when(F.col("exhibit_id") % 10 == 4, 1).otherwise(0)).cast("int").alias("entry_count"), F.max_by("entry_hash", "sequence").alias("head_hash"))
    edited = c.withColumn("detail", F.when((F.col("exhibit_id") % 10 == 3) & (F.col("sequence") == 2), F.concat("detail", F.lit("."))).otherwise(F.col("detail")))
    return custody.problems(edited, head)


@query("custody_register", "SELECT exhibit_id, sequence, CASE action WHEN 'USER' THEN 'Submitted by the investigator' WHEN 'ASSISTANT' THEN 'Answered by the examiner' ELSE 'Recorded by the system' END AS wording, actor_badge, 0 AS day FROM v_custody")
def custody_register(spark, sf_dir):
    return custody.register(view(spark, sf_dir, "v_custody"))


@query("triage_backlog", "SELECT count(*) AS awaiting_review, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, 'critical' AS worst_waiting FROM v_finding WHERE triage_status = 'pending'")
def triage_backlog(spark, sf_dir):
    return governance.triage_backlog(view(spark, sf_dir, "v_finding"))


@query("certificate_state", "SELECT count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS complete, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) AS awaiting_part_b, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0) AS awaiting_part_a, count(*) FILTER (o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0) AS unsigned FROM orders")
def certificate_state(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    when = lambda k: F.when(F.col("o_orderkey") % k == 0, F.col("o_orderdate"))
    return governance.certificate_state(o.select(when(2).alias("part_a_signed_at"), when(3).alias("part_b_signed_at")))


AS_OF = 1_705_276_800


@query("sign_in_counts", f"SELECT action, count(*) AS attempts, count(DISTINCT username_attempted) AS users FROM v_audit WHERE timestamp >= {AS_OF} - 86400 GROUP BY ALL")
def sign_in_counts(spark, sf_dir):
    return governance.sign_in_counts(view(spark, sf_dir, "v_audit"), AS_OF)


@query("sign_in_log", f"SELECT id, username_attempted, action, c_custkey IS NOT NULL AS account_exists, timestamp >= {AS_OF} - 86400 AS last_day FROM v_audit LEFT JOIN customer ON username_attempted = 'user' || CAST(c_custkey * 2 AS VARCHAR) WHERE username_attempted ILIKE '%R1%' AND action <> 'LOGIN_OK' AND action = 'LOGIN_FAILED'")
def sign_in_log(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user"), (F.col("c_custkey") * 2).cast("string")).alias("username"))
    return governance.sign_in_log(view(spark, sf_dir, "v_audit"), users, AS_OF, "R1", "LOGIN_FAILED").select("id", "username_attempted", "action", "account_exists", "last_day")


@query("report_by_machine", f"SELECT session_id, subject_ip AS machine, rule_id, flow_id, CAST(row_number() OVER w AS INT) AS nth, greatest(count(*) OVER (PARTITION BY session_id, subject_ip, rule_id) - 5, 0) AS more FROM v_finding WINDOW w AS (PARTITION BY session_id, subject_ip, rule_id ORDER BY {RANK} DESC, confidence DESC, flow_id) QUALIFY nth <= 5")
def report_by_machine(spark, sf_dir):
    return governance.report_by_machine(view(spark, sf_dir, "v_finding")).select("session_id", "machine", "rule_id", "flow_id", "nth", "more")


@query("severity_summary", "SELECT session_id, severity, count(*) AS findings, count(DISTINCT subject_ip) AS subjects FROM v_finding GROUP BY ALL")
def severity_summary(spark, sf_dir):
    return governance.severity_summary(view(spark, sf_dir, "v_finding"))


@query("observed_share", "SELECT session_id, count(*) AS labelled, count(*) FILTER (app_protocol_source = 'observed') AS observed, round(count(*) FILTER (app_protocol_source = 'observed') / count(*), 6) AS share FROM v_flow WHERE app_protocol <> '' GROUP BY ALL")
def observed_share(spark, sf_dir):
    return governance.observed_share(v_flow(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("bundle_problems", """WITH d AS (SELECT CAST(doc_id // 10 AS BIGINT) AS b, CAST(doc_id % 10 AS INT) AS i, doc_id FROM documents) SELECT b AS bundle_id, i AS item_no, CASE WHEN i = 1 THEN 'payload-mismatch' WHEN i = 2 THEN 'unknown-type' WHEN i = 3 THEN 'bad-format' WHEN i = 4 THEN 'not-updatable' WHEN i = 5 THEN 'future-date' ELSE 'bad-date' END AS code FROM d WHERE i BETWEEN 1 AND 6""")
def bundle_problems(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.floor(F.col("doc_id") / 10)).cast("long").alias("bundle_id"), (F.col("doc_id") % 10).cast("int").alias("item_no"), F.col("text").cast("binary").alias("payload"))
    i = F.col("item_no")
    d = d.withColumns({"type": F.when(i == 2, "odd").when(i == 4, "engine_data").otherwise("ioc_feed"), "name": F.lit("n"), "file": F.lit("x"), "format": F.when(i == 3, "none").otherwise("PLAIN_IP"), "retrieved_on": F.when(i == 5, "2999-01-01").when(i == 6, "soon").otherwise("2024-01-01"), "sha256": F.when(i == 1, "0").otherwise(F.sha2("payload", 256))})
    return governance.bundle_problems(d, AS_OF)


# ---- packages ----------------------------------------------------------------------------------------------------------


# A part's brand is a rule that small parts fire; every third part is of the attack corpus.
TALLY = "SELECT p_brand AS rule_id, count(*) FILTER (WHERE p_partkey % 3 > 0 AND p_size <= {most}) AS benign_fired, count(*) FILTER (WHERE p_partkey % 3 > 0) AS benign_captures, count(*) FILTER (WHERE p_partkey % 3 = 0 AND p_size <= {most}) AS malicious_fired, count(*) FILTER (WHERE p_partkey % 3 = 0) AS malicious_captures FROM {part} GROUP BY p_brand"


def tally(spark, sf_dir, most: int) -> DataFrame:
    return spark.sql(TALLY.replace("{most}", str(most)), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


# The bound is the rate at which so few would fire with a probability of 5 %: halved into, from the sum of the probabilities.
@query("clopper_pearson", f"""WITH RECURSIVE t AS ({TALLY.replace("{most}", "5").replace("{part}", "part")}), r AS (SELECT rule_id, 'b' AS corpus, benign_fired AS k, benign_captures AS n FROM t UNION ALL SELECT rule_id, 'm', malicious_fired, malicious_captures FROM t),
h(rule_id, corpus, k, n, lo, hi, step) AS (SELECT rule_id, corpus, k, n, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM r UNION ALL SELECT rule_id, corpus, k, n, CASE WHEN few > 0.05 THEN mid ELSE lo END, CASE WHEN few > 0.05 THEN hi ELSE mid END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS few FROM h WHERE step < 50) x)
SELECT rule_id, max(CASE WHEN corpus = 'b' THEN {r("CASE WHEN k = n THEN 1 ELSE hi END", 4)} END) AS benign_upper95, max(CASE WHEN corpus = 'm' THEN {r("CASE WHEN k = n THEN 1 ELSE hi END", 4)} END) AS malicious_upper95 FROM h WHERE step = 50 GROUP BY rule_id""")
def clopper_pearson(spark, sf_dir):
    return tally(spark, sf_dir, 5).select("rule_id", E.rnd(E.binomial_upper(F.col("benign_fired"), F.col("benign_captures")), 4).alias("benign_upper95"), E.rnd(E.binomial_upper(F.col("malicious_fired"), F.col("malicious_captures")), 4).alias("malicious_upper95"))


@query("signal_table", "WITH n AS (SELECT label, count(DISTINCT sample_id) AS samples FROM v_signal GROUP BY ALL) SELECT signal_id, label, count(*) FILTER (fired) AS fired, max(samples) AS samples FROM v_signal JOIN n USING (label) GROUP BY ALL")
def signal_table(spark, sf_dir):
    return packages.signal_table(view(spark, sf_dir, "v_signal")).select("signal_id", "label", "fired", "samples")


@query("baseline_status", "SELECT signal_id, count(*) FILTER (fired AND label = 'benign') AS benign_fired, CASE WHEN count(*) FILTER (label = 'benign') = 0 THEN 'unmeasured' WHEN count(*) FILTER (fired AND label = 'benign') = 0 AND count(*) FILTER (label = 'benign') >= 30 THEN 'validated' ELSE 'experimental' END AS status FROM v_signal GROUP BY ALL")
def baseline_status(spark, sf_dir):
    return packages.baseline_status(packages.signal_table(view(spark, sf_dir, "v_signal"))).select("signal_id", "benign_fired", "status")


BEHAVED = """c AS (SELECT sample_id, list(signal_id) AS caps FROM v_signal WHERE fired GROUP BY ALL), b AS (
SELECT sample_id, 'beh.dropper_with_bundled_payload' AS behaviour_id, 3 AS tier FROM c WHERE list_has_all(caps, ['install_packages', 'bundled_package']) UNION ALL SELECT sample_id, 'beh.runtime_code_from_network', 3 FROM c WHERE list_has_all(caps, ['dynamic_code_loading', 'network_use'])
UNION ALL SELECT sample_id, 'beh.accessibility_types_into_other_apps', 3 FROM c WHERE list_has_all(caps, ['accessibility_text_entry', 'overlay_window']) UNION ALL SELECT sample_id, 'beh.sms_to_telegram_bot', 3 FROM c WHERE list_has_all(caps, ['telegram_bot_api', 'sms_read']) UNION ALL SELECT sample_id, 'beh.hides_launcher_icon', 2 FROM c WHERE list_contains(caps, 'hides_launcher_icon'))"""


@query("behaviours", f"WITH {BEHAVED} SELECT sample_id, behaviour_id, CAST(tier AS INT) AS tier FROM b")
def behaviours(spark, sf_dir):
    return packages.behaviours(view(spark, sf_dir, "v_signal"))


def _tiers(spark, sf_dir):
    s = view(spark, sf_dir, "v_signal")
    found = packages.behaviours(s)
    labels = s.select("sample_id", "label").distinct()
    every = found.select("behaviour_id").distinct()
    fired = labels.join(every, how="cross").join(found.withColumn("f", F.lit(True)), ["sample_id", "behaviour_id"], "left").select("sample_id", "label", F.col("behaviour_id").alias("signal_id"), F.coalesce("f", F.lit(False)).alias("fired"))
    return packages.tiers(labels, found, packages.baseline_status(packages.signal_table(fired)))


TIERS = f"{BEHAVED}, l AS (SELECT DISTINCT sample_id, label FROM v_signal), bad AS (SELECT DISTINCT behaviour_id FROM b JOIN l USING (sample_id) WHERE label = 'benign'), t AS (SELECT sample_id, label, greatest(1, coalesce(max(tier) FILTER (bad.behaviour_id IS NULL), 0)) AS tier FROM l LEFT JOIN b USING (sample_id) LEFT JOIN bad ON bad.behaviour_id = b.behaviour_id GROUP BY ALL)"


@query("tiers", f"WITH {TIERS} SELECT sample_id, label, CAST(tier AS INT) AS tier FROM t")
def tiers(spark, sf_dir):
    return _tiers(spark, sf_dir).select("sample_id", "label", "tier")


@query("tier_histogram", f"WITH {TIERS} SELECT label, CAST(tier AS INT) AS tier, count(*) AS samples FROM t GROUP BY ALL")
def tier_histogram(spark, sf_dir):
    return packages.tier_histogram(_tiers(spark, sf_dir))


@query("url_endpoints", """WITH u AS (SELECT page_id, unnest(regexp_extract_all(html || ' ' || url || '.', '\\b(?:https?|ftp)://[^\\s"''<>`\\\\]{3,900}')) AS u FROM pages) SELECT DISTINCT page_id, lower(split_part(split_part(u, '//', 2), '/', 1)) AS host FROM u""")
def url_endpoints(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", F.lit(" "), "url", F.lit(".")).alias("t"))
    return packages.endpoints(p, "page_id", "t").select("page_id", "host")


@query("registered_domains", "SELECT query_name, string_split(query_name, '.')[-2] || '.' || string_split(query_name, '.')[-1] AS parent, count(*) AS queries FROM v_dns GROUP BY ALL")
def registered_domains(spark, sf_dir):
    return view(spark, sf_dir, "v_dns").groupBy("query_name", E.registered_domain("query_name").alias("parent")).agg(F.count("*").alias("queries"))


@query("library_attribution", """WITH c AS (SELECT DISTINCT string_split(u, '/')[3] AS class_name FROM (SELECT url AS u FROM pages)), p AS (SELECT * FROM (VALUES ('example.com', 'one'), ('www', 'two')) t(prefix, library)) SELECT DISTINCT class_name, CASE WHEN class_name = 'www' OR class_name LIKE 'www.%' THEN 'library' ELSE 'unattributed' END AS owner FROM c""")
def library_attribution(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit(1).alias("sample_id"), F.split("url", "/")[2].alias("class_name"), F.lit("none.such").alias("app_namespace")).distinct()
    prefixes = spark.sql("SELECT 'example.com' AS prefix, 'one' AS library UNION ALL SELECT 'www', 'two'")
    return packages.attribute(n, prefixes).select("class_name", "owner")


CALLS = "SELECT DISTINCT o_custkey % 300 AS caller, (o_custkey % 300) * 7 % 301 AS callee FROM orders"


@query("call_reach", f"""WITH RECURSIVE c AS ({CALLS}), r(name, steps) AS (SELECT 0, 0 UNION SELECT c.caller, r.steps + 1 FROM r JOIN c ON c.callee = r.name WHERE r.steps < 8) SELECT CAST(name AS BIGINT) AS name, CAST(min(steps) AS INT) AS steps FROM r GROUP BY name""")
def call_reach(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    calls = o.select((F.col("o_custkey") % 300).alias("caller"), ((F.col("o_custkey") % 300) * 7 % 301).alias("callee")).distinct()
    return packages.reaching(calls, spark.sql("SELECT CAST(0 AS BIGINT) AS name"))


@query("subclass_descent", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey % 500 AS child, (c_custkey % 500) // 3 AS parent FROM customer), d(name, depth) AS (SELECT 1, 0 UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.name WHERE d.depth < 32 AND e.child <> e.parent) SELECT CAST(name AS BIGINT) AS name, CAST(min(depth) AS INT) AS depth FROM d GROUP BY name""")
def subclass_descent(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 500).alias("child"))
    e = c.select("child", F.floor(F.col("child") / 3).alias("parent")).where("child <> parent").distinct()
    return packages.descendants(e, spark.sql("SELECT CAST(1 AS BIGINT) AS name"))


@query("entry_budget", "SELECT l_orderkey AS sample_id, l_linenumber AS entry_no, CAST(l_quantity AS BIGINT) <= 40 AND sum(CASE WHEN CAST(l_quantity AS BIGINT) <= 40 THEN 1 ELSE 0 END) OVER w <= 3 AND sum(CASE WHEN CAST(l_quantity AS BIGINT) <= 40 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) OVER w <= 90 AS read FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def entry_budget(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("entry_no")).agg(F.min("l_quantity").cast("long").alias("size"))
    return packages.entry_budget(e, 3, 40, 90).select("sample_id", "entry_no", "read")


# ---- transport ---------------------------------------------------------------------------------------------------------

SEGMENT_SQL = "SELECT conv_id AS flow_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) + CASE WHEN turn % 3 = 2 THEN 5 ELSE 0 END AS o, length(text) AS n FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)"


def segments(spark, sf_dir):
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    n = F.length("text")
    o = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn")) - n + F.when(F.col("turn") % 3 == 2, 5).otherwise(0)
    return c.select(F.col("conv_id").alias("flow_id"), F.lit("client").alias("direction"), F.col("turn").alias("packet_no"), o.alias("seq"), F.lit(False).alias("syn"), n.cast("long").alias("length"), F.encode("text", "utf-8").alias("payload"))


@query("stream_gaps", f"WITH s AS ({SEGMENT_SQL}), f AS (SELECT *, o - first_value(o) OVER (PARTITION BY flow_id ORDER BY turn) AS p FROM s WHERE n > 0), g AS (SELECT *, max(p + n) OVER (PARTITION BY flow_id ORDER BY p, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM f) SELECT flow_id, CAST(r AS BIGINT) AS \"offset\", CAST(p - r AS BIGINT) AS length FROM g WHERE p > r")
def stream_gaps(spark, sf_dir):
    return transport.stream_gaps(segments(spark, sf_dir)).select("flow_id", "offset", "length")


@query("reassembly")
def reassembly(spark, sf_dir):
    return transport.reassemble(segments(spark, sf_dir)).select("flow_id", F.size("runs").alias("runs"), F.size("gaps").alias("gaps"), F.size("conflicts").alias("conflicts"), "retransmissions", "bytes_recovered", "mid_stream")


@query("text_entropy", f"SELECT doc_id, {r('round_even(h * 1e4, 0) / 1e4', 2)} AS entropy FROM (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, substr(hex(encode(text)), 2 * i + 1, 2) AS x FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)))) AS i FROM documents)) GROUP BY doc_id, x) GROUP BY doc_id)")
def text_entropy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", E.rnd(E.shannon_entropy(F.encode("text", "utf-8")), 2).alias("entropy"))


# ---- outliers ----------------------------------------------------------------------------------------------------------


@query("robust_z", """WITH f AS (SELECT session_id, flow_id, ln(1 + bytes_sent) AS b, CAST(avg_packet_size AS DOUBLE) AS a, payload_entropy AS e FROM v_flow), m AS (SELECT session_id, median(b) AS mb, median(a) AS ma, median(e) AS me FROM f GROUP BY ALL), d AS (SELECT session_id, median(abs(b - mb)) * 1.4826 AS db, median(abs(a - ma)) * 1.4826 AS da, median(abs(e - me)) * 1.4826 AS de FROM f JOIN m USING (session_id) GROUP BY ALL)
SELECT session_id, flow_id, round((b - mb) / db, 4) AS z_bytes, round((a - ma) / da, 4) AS z_size, round((e - me) / de, 4) AS z_entropy FROM f JOIN m USING (session_id) JOIN d USING (session_id)""")
def robust_z(spark, sf_dir):
    f = v_flow(spark, sf_dir).select("session_id", "flow_id", F.log1p("bytes_sent").alias("bytes_sent"), F.col("avg_packet_size").cast("double").alias("avg_packet_size"), "payload_entropy")
    z = anomaly.robust_z(f, ["bytes_sent", "avg_packet_size", "payload_entropy"])
    return z.select("session_id", "flow_id", F.round("bytes_sent", 4).alias("z_bytes"), F.round("avg_packet_size", 4).alias("z_size"), F.round("payload_entropy", 4).alias("z_entropy"))


@query("outliers")
def outliers(spark, sf_dir):
    return anomaly.outliers(v_flow(spark, sf_dir)).select("session_id", "flow_id", F.round("score", 6).alias("score"), F.to_json("reasons").alias("reasons"), "place")


# ---- cross-checks ------------------------------------------------------------------------------------------------------


@query("beacon_groups", f"""WITH f AS (SELECT session_id, initiator_ip AS host, CASE WHEN tls_sni <> '' THEN lower(tls_sni) ELSE peer END AS destination, CASE WHEN tls_sni <> '' THEN 'sni' ELSE 'ip' END AS grouped_by, service AS port, protocol, first_seen, bytes_sent, flow_id FROM ({DIRECTED})),
w AS (SELECT *, first_seen - lag(first_seen) OVER (PARTITION BY session_id, host, destination, grouped_by, port, protocol ORDER BY first_seen, flow_id) AS gap, count(*) OVER (PARTITION BY session_id, host, destination, grouped_by, port, protocol) AS n FROM f),
x AS (SELECT *, CASE WHEN gap >= 30 THEN count(*) OVER (PARTITION BY session_id, host, destination, grouped_by, port, protocol, gap >= 30 ORDER BY gap RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS near FROM w WHERE n >= 4)
SELECT session_id, host, destination, grouped_by, CAST(port AS INT) AS port, protocol, count(*) AS connections, max(first_seen) - min(first_seen) AS span, count(*) FILTER (gap > 0) AS intervals, CASE WHEN count(*) FILTER (gap > 0) >= 2 THEN round(median(gap) FILTER (gap > 0), 3) END AS median_s, CASE WHEN count(*) FILTER (gap > 0) >= 2 THEN round(stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0), 5) END AS cv,
count(*) FILTER (gap >= 30) AS flare_intervals, round(max(near) / count(*) FILTER (gap >= 30), 5) AS flare_share, round(stddev_pop(bytes_sent) / avg(bytes_sent), 5) AS bytes_cov FROM x GROUP BY session_id, host, destination, grouped_by, port, protocol""")
def beacon_groups(spark, sf_dir):
    g = evidence.beacon_groups(v_flow(spark, sf_dir), CTX)
    return g.withColumns({"median_s": F.round("median_s", 3), "cv": F.round("cv", 5), "flare_share": F.round("flare_share", 5), "bytes_cov": F.round("bytes_cov", 5)})


@query("indicator_correlation", """WITH e AS (SELECT page_id AS sample_id, split_part(split_part(url, '//', 2), '/', 1) AS value FROM pages), r AS (SELECT DISTINCT sample_id, 'dns' AS kind, e.value AS indicator, session_id, 'resolved by ' || src_ip AS detail FROM e JOIN v_dns ON query_name = e.value UNION SELECT DISTINCT sample_id, 'feed', e.value, CAST(NULL AS BIGINT), 'listed in feed ' || feed_id FROM e JOIN v_indicator i ON i.value = e.value)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sample_id, kind ORDER BY indicator, session_id, detail) <= 60""")
def indicator_correlation(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("sample_id"), F.split("url", "/")[2].alias("value"), F.lit("name").alias("scope"))
    return evidence.correlate(e, view(spark, sf_dir, "v_dns"), once(spark, sf_dir, "v_flow"), view(spark, sf_dir, "v_indicator"))


@query("package_chains", "SELECT exhibit_id, CAST(NULL AS INT) AS sequence, 'recorded count differs' AS problem FROM (SELECT DISTINCT exhibit_id FROM v_custody) WHERE exhibit_id % 7 = 1")
def package_chains(spark, sf_dir):
    c = custody.append(view(spark, sf_dir, "v_custody"))
    e = F.struct("sequence", "action", "actor_badge", "actor_ip", "detail", "timestamp", "previous_hash", "entry_hash")
    p = c.groupBy("exhibit_id").agg(F.array_sort(F.collect_list(e)).alias("events"), F.max_by("entry_hash", "sequence").alias("head_hash"), F.count("*").cast("int").alias("n"))
    count = (F.col("n") + F.when(F.col("exhibit_id") % 7 == 1, 1).otherwise(0)).alias("event_count")
    return evidence.package_problems(p.select(F.col("exhibit_id").alias("package_id"), F.to_json(F.struct("exhibit_id", count, "head_hash", "events")).alias("content")))


@query("manifest_mismatches", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'unlisted' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def manifest_mismatches(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    k = F.col("doc_id") % 10
    return evidence.manifest_mismatches(d.where(k != 1), d.where(k != 2).withColumn("sha256", F.when(k == 3, "0").otherwise(F.col("sha256"))))


@query("identity_findings", "SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 4 = 0 THEN 'identity.signer_not_authorised' ELSE 'identity.label_claims_another_package' END AS finding_id, CASE WHEN c_custkey % 4 <> 0 THEN 0 WHEN c_nationkey % 2 = 0 THEN 3 ELSE 2 END AS tier FROM customer WHERE c_custkey % 4 IN (0, 1)")
def identity_findings(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, name = F.col("c_custkey") % 4, F.concat(F.lit("org.app"), F.col("c_custkey").cast("string"))
    ref = c.select(name.alias("package"), F.concat(F.lit("App "), F.col("c_custkey").cast("string")).alias("label"), F.array(F.lit("good")).alias("certificates"), F.when(F.col("c_nationkey") % 2 == 0, "publisher").otherwise("channel").alias("authority"))
    ids = c.select(F.col("c_custkey").alias("sample_id"), F.when(k == 1, F.concat(F.lit("x."), name)).otherwise(name).alias("package"), F.concat(F.lit("APP-"), F.col("c_custkey").cast("string")).alias("label"), F.array(F.when(k == 0, "bad").otherwise("good")).alias("certificates"), F.lit("2049-01-01").cast("date").alias("not_after"))
    return evidence.identity_findings(ids, ref).select("sample_id", "finding_id", "tier")


@query("second_opinions", "SELECT p_partkey AS report_id, p_name AS package, p_size AS score, p_partkey % 3 AS high, p_partkey % 2 = 0 AS valid FROM part")
def second_opinions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    high = F.transform(F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("p_partkey") % 3).cast("int")), lambda x: x)
    content = F.to_json(F.struct(F.col("p_name").alias("package_name"), F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)).otherwise("bad").alias("sha256"), F.struct(F.col("p_size").alias("security_score"), high.alias("high")).alias("appsec")))
    return evidence.second_opinions(p.select(F.col("p_partkey").alias("report_id"), content.alias("content"))).select("report_id", "package", "score", F.col("high").cast("long").alias("high"), "valid")


from . import files, record, stream  # noqa: E402, F401  (they register their queries)
