"""The domain's tables derived from the driver tables, as one SQL text for Spark and for the oracle.

``{seconds:x}`` stands for epoch seconds of a timestamp, which the two dialects write differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import storage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # One event is one packet: a user talks to one server; errors are replies, sign-ups handshakes.
    "v_packet": """
SELECT CAST(user_id % 3 AS BIGINT) AS session_id, event_id AS packet_no, {seconds:ts} AS ts,
  CASE WHEN event_type = 'error' THEN server ELSE client END AS src, CASE WHEN event_type = 'error' THEN client ELSE server END AS dst,
  proto, CASE WHEN event_type = 'error' THEN port ELSE cport END AS sport, CASE WHEN event_type = 'error' THEN cport ELSE port END AS dport,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 WHEN 'click' THEN 24 WHEN 'purchase' THEN 17 ELSE 20 END AS tcp_flags,
  CAST(60 + floor(value) AS INT) AS frame_len, CAST(floor(value) AS INT) AS data_len, props AS payload_text
FROM (SELECT *, '10.0.' || CAST(CAST(floor(user_id / 250) AS BIGINT) AS VARCHAR(20)) || '.' || CAST(user_id % 250 + 1 AS VARCHAR(20)) AS client, '198.51.100.' || CAST(user_id % 7 + 1 AS VARCHAR(20)) AS server,
  CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS proto, CAST(40000 + user_id % 1000 AS INT) AS cport,
  CASE user_id % 5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 8443 ELSE 3232 END AS port FROM events) e""",
    # One order line is one flow; line 7 is inbound.  Nations are hosts inside, suppliers peers outside (every tenth inside).
    "v_flow": """
SELECT session_id, flow_id, CASE WHEN inbound THEN far ELSE near END AS src_ip, CASE WHEN inbound THEN near ELSE far END AS dst_ip,
  CASE WHEN inbound THEN port ELSE cport END AS src_port, CASE WHEN inbound THEN cport ELSE port END AS dst_port, protocol, CASE WHEN inbound AND flow_id % 2 = 0 THEN near WHEN inbound THEN far ELSE near END AS initiator_ip,
  packets_sent, packets_received, bytes_sent, bytes_received, first_seen, first_seen + duration_seconds AS last_seen, duration_seconds,
  packets_sent - 1 AS interval_count, interval_median, interval_mad, CASE WHEN interval_median > 0 THEN interval_mad / interval_median ELSE CAST(0 AS DOUBLE) END AS interval_dispersion,
  floor((bytes_sent + bytes_received) / CAST(packets_sent + packets_received AS DOUBLE) * 100.0) / CAST(100 AS DOUBLE) AS avg_packet_size, payload_entropy, 1 AS entropy_sample_count, flags AS tcp_flags_seen,
  CASE WHEN port IN (443, 80, 53) THEN CASE port WHEN 443 THEN 'TLS' WHEN 80 THEN 'HTTP' ELSE 'DNS' END ELSE '' END AS app_protocol,
  CASE WHEN port IN (443, 80, 53) THEN CASE WHEN l_linestatus = 'O' THEN 'observed' ELSE 'port' END ELSE '' END AS app_protocol_source,
  CASE WHEN port = 443 AND l_linestatus = 'O' THEN 'h' || CAST(l_suppkey % 50 AS VARCHAR(20)) || '.svc.example.com' ELSE '' END AS tls_sni,
  CASE WHEN port = 80 THEN 'www' || CAST(l_suppkey % 20 AS VARCHAR(20)) || '.example.net' ELSE '' END AS http_host
FROM (SELECT l.*, CAST(l_orderkey % 2 AS BIGINT) AS session_id, l_orderkey * 10 + l_linenumber AS flow_id, l_linenumber = 7 AS inbound,
    '10.0.' || CAST(c_nationkey AS VARCHAR(20)) || '.7' AS near,
    CASE WHEN l_suppkey % 10 = 0 THEN '10.1.0.' || CAST(l_suppkey % 250 + 1 AS VARCHAR(20)) ELSE '198.51.' || CAST(l_suppkey % 100 AS VARCHAR(20)) || '.' || CAST(l_suppkey % 250 + 1 AS VARCHAR(20)) END AS far,
    CAST(40000 + l_orderkey % 20000 AS INT) AS cport, CASE l_partkey % 8 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 8443 WHEN 5 THEN 3232 WHEN 6 THEN 2048 ELSE CAST(6000 + l_partkey % 500 AS INT) END AS port,
    CASE l_partkey % 8 WHEN 6 THEN 'ICMP' WHEN 2 THEN 'UDP' ELSE 'TCP' END AS protocol,
    CAST(l_quantity AS INT) AS packets_sent, l_linenumber - 1 AS packets_received, CAST(floor(l_extendedprice) AS BIGINT) AS bytes_sent, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bytes_received,
    {seconds:l_shipdate} + CAST((l_partkey * 37 + l_linenumber * 13) % 86400 AS DOUBLE) AS first_seen, CAST(floor(l_tax * 1000) * 3 + l_linenumber AS DOUBLE) AS duration_seconds,
    CAST(1 + floor(l_tax * 100 + 0.5) AS DOUBLE) AS interval_median, CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) / CAST(10 AS DOUBLE) AS interval_mad, CAST(4 AS DOUBLE) + CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) * CAST(0.4 AS DOUBLE) AS payload_entropy,
    CASE WHEN l_returnflag = 'A' THEN 'S' WHEN l_returnflag = 'N' THEN 'AS' ELSE 'APS' END AS flags
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey) f""",
    # One page is one query for its host, from one of 25 hosts; some names carry a long label; two of three have an answer.
    "v_dns": """
SELECT CAST(page_id % 2 AS BIGINT) AS session_id, page_id * 10 + 1 AS flow_id, '10.0.' || CAST(page_id % 25 AS VARCHAR(20)) || '.7' AS src_ip,
  CASE WHEN page_id % 7 = 0 THEN md5(url) || substr(md5(CAST(page_id AS VARCHAR(20))), 1, 24) || '.' || host ELSE host END AS query_name,
  CASE WHEN page_id % 5 = 0 THEN 'TXT' ELSE 'A' END AS query_type,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE '198.51.' || CAST(page_id % 100 AS VARCHAR(20)) || '.' || CAST(page_id % 250 + 1 AS VARCHAR(20)) END AS response_ip, CAST(1700000000 + page_id * 60 AS DOUBLE) AS timestamp
FROM (SELECT page_id, url, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages) p""",
    "v_feed": "SELECT CAST(1 AS BIGINT) AS feed_id, 'list one' AS name, CAST(NULL AS DOUBLE) AS published_on, CAST(900000000 AS DOUBLE) AS retrieved_on UNION ALL SELECT CAST(2 AS BIGINT), 'list two', CAST(1700003600 AS DOUBLE), CAST(1700003600 AS DOUBLE)",
    "v_indicator": """
SELECT CAST(1 AS BIGINT) AS feed_id, 'ipv4' AS kind, '198.51.' || CAST(s_suppkey % 100 AS VARCHAR(20)) || '.' || CAST(s_suppkey % 250 + 1 AS VARCHAR(20)) AS value, s_name AS context FROM supplier WHERE s_suppkey % 9 = 1 AND s_suppkey % 10 <> 0
UNION ALL SELECT CAST(2 AS BIGINT), 'domain', value, 'family' FROM (SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) AS value FROM pages WHERE page_id % 11 = 0) d
UNION ALL SELECT CAST(2 AS BIGINT), 'url', url, 'family' FROM pages WHERE page_id % 13 = 0
UNION ALL SELECT CAST(2 AS BIGINT), 'domain', 'svc.example.com', 'parent'""",
    # Measured fire rates of the rules: 22 ordinary and 8 attack captures.
    "v_base_rate": """
SELECT * FROM (VALUES ('C2_BEACON_KEEPALIVE', 10, 22, 0, 8), ('C2_BEACON_PERIODIC', 4, 22, 0, 8), ('COVERT_CHANNEL_UNKNOWN_PORT', 6, 22, 3, 8), ('DNS_TUNNEL_LONG_LABEL', 1, 22, 2, 8), ('DNS_TUNNEL_SUBDOMAIN_VOLUME', 2, 22, 1, 8),
  ('EXFIL_VOLUME_ASYMMETRY', 8, 22, 1, 8), ('ICMP_TUNNEL_OVERSIZED', 2, 22, 1, 8), ('IOC_FEED_MATCH', 0, 22, 0, 8), ('RECON_PORT_SCAN', 2, 22, 4, 8)) AS t(rule_id, benign_fired, benign_captures, malicious_fired, malicious_captures)""",
    "v_custody": """
SELECT conv_id AS exhibit_id, CAST(turn AS INT) AS sequence, upper(role) AS action, 'B' || CAST(conv_id % 9 AS VARCHAR(20)) AS actor_badge, '10.0.0.' || CAST(turn AS VARCHAR(20)) AS actor_ip, substr(text, 1, 80) AS detail, CAST(1700000000 + conv_id * 100 + turn AS VARCHAR(20)) AS timestamp FROM conversations""",
    # A flow is a finding by its port or its bytes.
    "v_finding": """
SELECT session_id, flow_id, src_ip AS subject_ip, CASE WHEN port = 22 THEN 'RECON_PORT_SCAN' WHEN port = 3232 THEN 'COVERT_CHANNEL_UNKNOWN_PORT' WHEN port = 2048 THEN 'ICMP_TUNNEL_OVERSIZED' ELSE 'EXFIL_VOLUME_ASYMMETRY' END AS rule_id,
  CASE WHEN bytes_sent > 80000 THEN 'critical' WHEN bytes_sent > 60000 THEN 'high' WHEN bytes_sent > 30000 THEN 'medium' ELSE 'low' END AS severity, CAST(packets_sent AS DOUBLE) / CAST(50 AS DOUBLE) AS confidence,
  'finding ' || CAST(flow_id AS VARCHAR(20)) || ' |= on ' || dst_ip AS title, CASE WHEN flow_id % 5 = 0 THEN 'confirmed' WHEN flow_id % 5 = 1 THEN 'dismissed' ELSE 'pending' END AS triage_status, first_seen, app_protocol
FROM (SELECT *, CASE WHEN src_ip = initiator_ip THEN dst_port ELSE src_port END AS port FROM v_flow) f WHERE port IN (22, 3232, 2048) OR bytes_sent > 60000""",
    # Archive entries over pages: two headers of each entry, some of them forged; runtimes' and other entries of packages.
    "v_header": """
SELECT CAST(floor(page_id / 20) AS BIGINT) AS sample_id, side, CASE page_id % 9 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b/' || CAST(page_id % 20 AS VARCHAR(20)) WHEN 2 THEN '' WHEN 3 THEN 'a/b' ELSE 'f' || CAST(page_id % 20 AS VARCHAR(20)) || CASE WHEN page_id % 31 = 0 THEN repeat('x', 300) ELSE '' END END AS name,
  CASE WHEN page_id % 19 = 0 AND side = 'central' THEN 99 WHEN page_id % 2 = 0 THEN 8 ELSE 0 END AS method, CASE WHEN page_id % 23 = 0 THEN 9 ELSE 8 END AS flags, page_id * 7 + CASE WHEN page_id % 29 = 0 AND side = 'local' THEN 1 ELSE 0 END AS crc, length(html) AS size
FROM (SELECT *, 'central' AS side FROM pages UNION ALL SELECT *, 'local' FROM pages) h WHERE NOT (side = 'central' AND page_id % 13 = 0) AND NOT (side = 'local' AND page_id % 17 = 0)""",
    "v_entry": """
SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, page_id AS entry_no, CASE page_id % 12 WHEN 0 THEN 'lib/arm64/libflutter.so' WHEN 1 THEN 'assets/index.android.bundle' WHEN 2 THEN 'lib/x86/libreactnativejni.so' WHEN 3 THEN 'assemblies/a.dll' WHEN 4 THEN 'lib/x/libunity.so' WHEN 5 THEN 'assets/www/index.html' WHEN 6 THEN 'res/next.APK' ELSE 'res/' || CAST(page_id AS VARCHAR(20)) END AS name,
  length(html) AS size, page_id % 10 = 7 AS opaque FROM pages""",
    "v_package": "SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, max(page_id * 7919 % 1000000) AS dex_bytes FROM pages GROUP BY CAST(floor(page_id / 5) AS BIGINT)",
    "v_audit": """
SELECT event_id AS id, 'user' || CAST(user_id AS VARCHAR(20)) AS username_attempted, CASE WHEN event_type = 'error' THEN 'LOGIN_FAILED' WHEN event_type = 'signup' THEN 'LOGIN_LOCKED' ELSE 'LOGIN_OK' END AS action, '10.0.0.' || CAST(user_id % 250 AS VARCHAR(20)) AS ip_address, {seconds:ts} AS timestamp FROM events""",
    # Labelled samples and boolean signals over their texts.
    "v_sample": """
SELECT d.doc_id AS sample_id, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 'malicious' ELSE 'benign' END AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_signal": """
SELECT sample_id, label, signal_id, fired FROM (
  SELECT sample_id, label, 'install_packages' AS signal_id, text LIKE '%!!%' AS fired FROM v_sample UNION ALL SELECT sample_id, label, 'network_use', text LIKE '%@%' FROM v_sample
  UNION ALL SELECT sample_id, label, 'bundled_package', text LIKE '%|%' FROM v_sample UNION ALL SELECT sample_id, label, 'dynamic_code_loading', text LIKE '%token%' FROM v_sample
  UNION ALL SELECT sample_id, label, 'overlay_window', text LIKE '%$$$%' FROM v_sample UNION ALL SELECT sample_id, label, 'accessibility_text_entry', length(text) > 4000 FROM v_sample
  UNION ALL SELECT sample_id, label, 'telegram_bot_api', text LIKE '%stupid%' FROM v_sample UNION ALL SELECT sample_id, label, 'sms_read', text LIKE '%the the%' FROM v_sample
  UNION ALL SELECT sample_id, label, 'hides_launcher_icon', text LIKE '%icense%' FROM v_sample) s""",
}

_SPARK_SECONDS = "((CAST(datediff(CAST({0} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400 + hour({0}) * 3600 + minute({0}) * 60) * 1000000 + CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT)) / 1000000D"


def dialect(sql: str, spark: bool) -> str:
    return re.sub(r"\{seconds:(\w+)\}", lambda m: _SPARK_SECONDS.format(m[1]) if spark else f"(epoch_us({m[1]}) / 1000000.0)", sql)


def needed(sql: str) -> list[str]:
    """Views that a text mentions, in order of dependence."""
    out: list[str] = []
    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            out += [x for x in [*needed(VIEWS[v]), v] if x not in out]
    return out


def oracle(sql: str) -> str:
    """An oracle query with the views it needs as common table expressions."""
    views = needed(sql)
    head = ", ".join(f"{v} AS ({dialect(VIEWS[v], False)})" for v in views)
    body = dialect(sql, False).strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


#: For Spark, orders meet customers before the many lines meet them, which are then dealt out once; the rows are the same.
_LINES = "FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey"
_LINES_ONCE = "FROM lineitem l JOIN (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey"


#: Stands for the stored table of flows, which every rule reads: written once for each session and folder of tables.
STORED = ("v_flow",)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of a folder."""
    if name not in STORED:
        return _view(spark, sf_dir, name)
    made = _made(spark)
    if (sf_dir, name) not in made:
        made[sf_dir, name] = storage.stored(_view(spark, sf_dir, name), name)
    return made[sf_dir, name]


def _made(spark: SparkSession) -> dict:
    if not hasattr(spark, "_wiretide_tables"):
        spark._wiretide_tables = {}
    return spark._wiretide_tables


def once(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view within another: a stored table if it has been written, else the rows themselves, of which the outer view
    takes a few columns; it is not worth a table of all."""
    return view(spark, sf_dir, name) if name not in STORED or (sf_dir, name) in _made(spark) else _view(spark, sf_dir, name)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = dialect(VIEWS[name], True).replace(_LINES, _LINES_ONCE)
    parts = {v: once(spark, sf_dir, v) for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    parts |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", sql)}
    for p in parts:
        sql = re.sub(rf"(FROM|JOIN) {p}\b", rf"\1 {{{p}}}", sql)
    return spark.sql(sql, **parts)
