"""Registered queries of the live path: streams over the given tables, drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import storage
from ..streaming import live, monitor, sessions
from .queries import SEGMENTS, packets, query, v_flow
from .views import VIEWS, dialect

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


# The flows that the watermark has closed: all their packets are past it by the margin, and so is a silence or the next flow's first packet.
@query("stream_flows", f"""WITH {SEGMENTS},
f AS (SELECT session_id, k, proto, min(packet_no) AS flow_id, bool_or(confirmed) AS initiator_confirmed, count(*) FILTER (o) AS packets_sent, count(*) FILTER (NOT o) AS packets_received, coalesce(sum(frame_len) FILTER (o), 0) AS bytes_sent, coalesce(sum(frame_len) FILTER (NOT o), 0) AS bytes_received,
  min(ts) AS first_seen, max(ts) AS last_seen, max(idle) AS idle, count(DISTINCT dport) AS unique_dst_ports FROM x GROUP BY session_id, k, proto, seg),
n AS (SELECT *, lead(first_seen) OVER (PARTITION BY session_id, k, proto ORDER BY flow_id) AS next_seen FROM f), m AS (SELECT floor(max(ts) * 1000) / 1000 - 7200 AS mark FROM v_packet)
SELECT session_id, flow_id, proto AS protocol, initiator_confirmed, CAST(packets_sent AS INT) AS packets_sent, CAST(packets_received AS INT) AS packets_received, CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(bytes_received AS BIGINT) AS bytes_received, first_seen, last_seen, CAST(unique_dst_ports AS INT) AS unique_dst_ports
FROM n, m WHERE last_seen + 600 <= mark AND CASE WHEN next_seen IS NULL THEN mark - last_seen > idle ELSE next_seen + 600 <= mark OR mark - 600 - last_seen > idle END""")
def stream_flows(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")  # a pattern, as a stream takes no single file
    arriving = spark.sql(dialect(VIEWS["v_packet"], True).replace("FROM events", "FROM {events}"), events=events)
    arriving = arriving.withColumn("payload", F.col("payload_text").cast("binary")).drop("payload_text")
    closed = sessions.stream_flows(arriving, {"TCP": 86400.0, "UDP": 43200.0, "ICMP": 43200.0}, "7200 seconds", 600.0)
    return storage.drained(closed.select("session_id", "flow_id", "protocol", "initiator_confirmed", "packets_sent", "packets_received", "bytes_sent", "bytes_received", "first_seen", "last_seen", "unique_dst_ports"), "stream-flows", **ROCKSDB)


# Flows in the order of their numbers, whose times run back and forth.
@query("time_reordering", "SELECT session_id, greatest(0.0, max(latest - first_seen)) AS max_reordering FROM (SELECT session_id, first_seen, max(first_seen) OVER (PARTITION BY session_id ORDER BY flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM v_flow) f GROUP BY session_id")
def time_reordering(spark, sf_dir):
    f = v_flow(spark, sf_dir).select("session_id", F.col("flow_id").alias("packet_no"), F.col("first_seen").alias("ts"))
    return live.reordering(f, 5_000)


@query("monitor_activity", """WITH w AS (SELECT session_id, floor(ts / 3600) * 3600 AS "window", count(*) AS packets, sum(frame_len) AS bytes FROM v_packet GROUP BY ALL)
SELECT session_id, CAST("window" AS DOUBLE) AS "window", packets, CAST(bytes AS BIGINT) AS bytes, CAST(coalesce(round(("window" - lag("window") OVER (PARTITION BY session_id ORDER BY "window")) / 3600 - 1), 0) AS BIGINT) AS silent FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY "window" DESC) <= 20""")
def monitor_activity(spark, sf_dir):
    return monitor.activity(packets(spark, sf_dir), 3600)
