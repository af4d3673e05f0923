"""Packets to bidirectional flows: segmentation by handshake and idle gap, then one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

# Idle seconds after which a conversation's next packet opens a new flow.
IDLE_SECONDS = {"TCP": 300.0, "UDP": 60.0, "ICMP": 60.0}
DEFAULT_IDLE = 60.0
# What a port suggests where nothing was observed.
PORT_PROTOCOLS = {20: "FTP", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 443: "TLS", 445: "SMB", 993: "IMAPS", 995: "POP3S", 3389: "RDP", 8080: "HTTP"}
ENTROPY_SAMPLES, ENTROPY_BYTES = 40, 512
# Bits of the TCP flags, in the order of their letters.
FLAGS = {"A": 16, "F": 1, "P": 8, "R": 4, "S": 2, "U": 32}
KEY = ("session_id", "a", "b", "proto")


def sessionise(df: DataFrame, keys: list[str], order: list[str], ts: str, gap: Column, reset: Column, name: str = "seg") -> DataFrame:
    """Number the sessions of each key: a row opens one if it is the first, is a reset, or comes more than gap after the
    session's latest time.  Times may run backwards: the latest so far counts, and each reset forgets it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__reset", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "__reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__last", F.max(ts).over(inner))
    new = F.col("__last").isNull() | (F.col(ts) - F.col("__last") > gap)
    return df.withColumn(name, F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__reset", "__last")


def interval_stats(times: Column) -> Column:
    """Struct of count, mean, median, population deviation, MAD and dispersion of the positive gaps of sorted times."""
    gaps = F.filter(F.transform(times, lambda t, i: F.when(i > 0, t - F.get(times, i - 1))), lambda g: g > 0)
    names = ("interval_count", "interval_mean", "interval_median", "interval_stddev", "interval_mad", "interval_dispersion")
    zero = F.struct(F.lit(0).alias(names[0]), *[F.lit(0.0).alias(n) for n in names[1:]])

    def of(g):
        n = F.size(g)
        mean = F.aggregate(g, F.lit(0.0), lambda s, x: s + x) / n
        s = F.array_sort(g)
        med = E.median_of(s)

        def rest(v):
            sd = F.sqrt(F.aggregate(g, F.lit(0.0), lambda a, x: a + (x - v.mean) * (x - v.mean)) / n)
            mad = E.mad_of(g, v.med)
            r = lambda c: E.rnd(c, 4)
            return F.struct(n.alias(names[0]), r(v.mean).alias(names[1]), r(v.med).alias(names[2]), r(sd).alias(names[3]), r(mad).alias(names[4]), F.when(v.med > 0, r(mad / v.med)).otherwise(F.lit(0.0)).alias(names[5]))

        return F.when(n >= 2, E.let(F.struct(mean.alias("mean"), med.alias("med")), rest)).otherwise(zero)

    return F.when(F.size(times) >= 3, E.let(gaps, of)).otherwise(zero)


def conversations(packets: DataFrame, idle: dict[str, float] | None = None, default_idle: float = DEFAULT_IDLE) -> DataFrame:
    """Packets with the ends of their conversation (a before b), its idle timeout and whether they open a handshake."""
    src, dst = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    timeout = F.lit(float(default_idle))
    for proto, seconds in (IDLE_SECONDS if idle is None else idle).items():
        timeout = F.when(F.col("proto") == proto, F.lit(float(seconds))).otherwise(timeout)
    syn = (F.col("proto") == "TCP") & (F.col("tcp_flags").bitwiseAND(2) > 0) & (F.col("tcp_flags").bitwiseAND(16) == 0)
    return packets.withColumns({"a": F.least(src, dst), "b": F.greatest(src, dst), "timeout": timeout, "syn": F.coalesce(syn, F.lit(False))})


def suggested() -> Column:
    """The protocol that a packet's ports suggest, or null."""
    return F.coalesce(E._case("dport", PORT_PROTOCOLS, None), E._case("sport", PORT_PROTOCOLS, None))


def payload_sample() -> Column:
    """Entropy of the first bytes of a payload; null without one."""
    return F.when(F.length("payload") > 0, E.shannon_entropy(F.substring("payload", 1, ENTROPY_BYTES)))


def build_flows(packets: DataFrame, idle: dict[str, float] | None = None, default_idle: float = DEFAULT_IDLE) -> DataFrame:
    """One row for each flow.  Order within a conversation is that of packet_no, never of time alone."""
    p = sessionise(conversations(packets, idle, default_idle), list(KEY), ["packet_no"], "ts", F.col("timeout"), F.col("syn"))
    src = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    flow = Window.partitionBy(*KEY, "seg").orderBy("packet_no")
    filled = F.length("payload") > 0
    p = p.withColumns({
        "init": F.first(src).over(flow),
        "confirmed": F.first("syn").over(flow),
        "nth": F.sum(F.when(filled, 1).otherwise(0)).over(flow.rowsBetween(Window.unboundedPreceding, 0)),
    })
    out = src == F.col("init")
    sends = out & ((F.col("proto") != "TCP") | (F.col("data_len") > 1))
    sample = F.when(F.col("nth") <= ENTROPY_SAMPLES, payload_sample())
    n = lambda c: F.count(F.when(c, 1))
    size = lambda c: F.sum(F.when(c, F.col("frame_len").cast("long")).otherwise(F.lit(0).cast("long")))
    flags = [F.when(F.max(F.when(F.col("tcp_flags").bitwiseAND(b) > 0, 1).otherwise(0)) == 1, F.lit(k)).otherwise(F.lit("")) for k, b in FLAGS.items()]
    port = suggested()
    return describe(p.groupBy(*KEY, "seg").agg(
        F.min("packet_no").alias("flow_id"),
        F.min_by(F.struct("src", "dst", "sport", "dport"), "packet_no").alias("first"),
        F.first("confirmed").alias("initiator_confirmed"),
        n(out).cast("int").alias("packets_sent"), n(~out).cast("int").alias("packets_received"),
        size(out).alias("bytes_sent"), size(~out).alias("bytes_received"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_list(F.when(sends, F.col("ts")))).alias("times"),
        F.countDistinct("dport").cast("int").alias("unique_dst_ports"),
        F.avg(sample).alias("entropy"), F.count(sample).cast("int").alias("entropy_sample_count"),
        F.concat(*flags).alias("tcp_flags_seen"),
        F.min_by(port, F.when(port.isNotNull(), F.col("packet_no"))).alias("app"),
    ))


def describe(g: DataFrame) -> DataFrame:
    """Flow rows from their sums, first packets and send times."""
    duration = F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0.0))
    total_p, total_b = F.col("packets_sent") + F.col("packets_received"), F.col("bytes_sent") + F.col("bytes_received")
    return g.withColumn("i", interval_stats(F.col("times"))).select(
        "session_id", "flow_id",
        F.col("first.src").alias("src_ip"), F.col("first.dst").alias("dst_ip"), F.col("first.sport").alias("src_port"), F.col("first.dport").alias("dst_port"),
        F.col("proto").alias("protocol"),
        F.col("first.src").alias("initiator_ip"), F.col("first.sport").alias("initiator_port"), "initiator_confirmed",
        "packets_sent", "packets_received", "bytes_sent", "bytes_received", "first_seen", "last_seen",
        E.rnd(duration, 3).alias("duration_seconds"), "i.*",
        E.rnd(total_b / total_p, 2).alias("avg_packet_size"),
        F.when(duration > 0.1, E.rnd(total_p / duration, 3)).otherwise(F.lit(0.0)).alias("packets_per_second"),
        F.when(total_b > 0, E.rnd(F.col("bytes_sent") / total_b, 4)).otherwise(F.lit(0.0)).alias("bytes_ratio"),
        "unique_dst_ports", E.rnd(F.coalesce("entropy", F.lit(0.0)), 4).alias("payload_entropy"), "entropy_sample_count", "tcp_flags_seen",
        F.coalesce("app", F.lit("")).alias("app_protocol"), F.when(F.col("app").isNotNull(), F.lit("port")).otherwise(F.lit("")).alias("app_protocol_source"),
    )


def dns_rows(messages: DataFrame) -> DataFrame:
    """DNS queries with the addresses that answered them anywhere in the session.

    messages: session_id, packet_no, flow_id, ts, client_ip, txid, is_reply, qname, qtype, answers (array).  A reply never
    becomes a row; answers of all replies to one (client, id, name) are distinct, in order of arrival."""
    key = ["session_id", "client_ip", "txid", F.lower("qname").alias("name")]
    a = messages.where("is_reply").select(*key, "packet_no", F.posexplode("answers").alias("pos", "answer"))
    firsts = a.groupBy("session_id", "client_ip", "txid", "name", "answer").agg(F.min(F.struct("packet_no", "pos")).alias("at"))
    lists = firsts.groupBy("session_id", "client_ip", "txid", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "answer"))), lambda x: x.answer).alias("response_ips"))
    q = messages.where(~F.col("is_reply")).withColumn("name", F.lower("qname"))
    joined = q.join(lists, ["session_id", "client_ip", "txid", "name"], "left")
    ips = F.coalesce("response_ips", F.array().cast("array<string>"))
    return joined.select("session_id", "flow_id", F.col("client_ip").alias("src_ip"), F.col("qname").alias("query_name"), F.col("qtype").alias("query_type"), ips.alias("response_ips"), F.substring(F.array_join(ips, ", "), 1, 255).alias("response_ip"), E.dns_features("qname").alias("f"), F.col("ts").alias("timestamp")).select("*", "f.*").drop("f")
