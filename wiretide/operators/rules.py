"""Detection rules: each takes flows (and DNS rows, indicators) and gives findings of one schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources import storage
from . import anomaly

# Ports that carry sustained sessions.
WELL_KNOWN_PORTS = (
    20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 110, 119, 123, 135, 137, 138, 139, 143, 161, 162, 179, 389, 443, 445, 465, 514, 515, 587, 631, 636, 873, 989,
    990, 993, 995, 1194, 1433, 1521, 1723, 3128, 3306, 3389, 5060, 5061, 5222, 5432, 5900, 5985, 5986, 6379, 8000, 8080, 8443, 8888, 9200, 27017,
)
# Thresholds of the rules, by name.
THRESHOLDS = {
    "beacon_min_connections": 23, "beacon_alert_score": 0.80, "beacon_skew_iqr_floor": 10, "beacon_ds_smallness_norm": 65535,
    "dns_label_length": 52, "dns_label_entropy": 3.5, "dns_entropy_min_label_len": 20, "dns_unique_subdomains": 50,
    "scan_unique_ports": 25, "scan_unique_ports_local": 250, "scan_inactivity_timeout": 900,
    "exfil_entropy_high": 7.6, "exfil_ratio": 10.0, "exfil_volume_percentile": 95, "exfil_absolute_floor": 102400,
    "icmp_packet_bytes": 100, "icmp_min_packets": 10, "keepalive_min_intervals": 20, "beacon_min_period": 1.0,
    "beacon_severity_high_score": 0.90, "scan_syn_ratio_high": 0.80, "unknown_channel_confidence": 0.60, "confidence_scale_multiplier": 4,
    "corroboration_distinct_rules": 3, "unknown_channel_min_duration": 60, "ioc_stale_days": 90,
}
SAMPLES, SAMPLE_CHARS = 5, 120
COLUMNS = ("session_id", "rule_id", "title", "category", "severity", "method", "confidence", "subject_ip", "flow_id", "rationale", "evidence")


@dataclass
class Context:
    """What rules need besides rows: home networks, thresholds (overridable), public suffix rules."""

    home: tuple[str, ...] = E.DEFAULT_HOME
    thresholds: dict = field(default_factory=dict)
    suffixes: dict[str, str] | None = None

    def t(self, name: str):
        return self.thresholds.get(name, THRESHOLDS[name])


def finding(df: DataFrame, rule_id: str, category: str, severity: Column, confidence: Column, subject: Column, flow: Column, title: Column, rationale: Column, evidence: Column, method: str = "rule") -> DataFrame:
    return df.select(
        "session_id", F.lit(rule_id).alias("rule_id"), title.alias("title"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(method).alias("method"),
        confidence.cast("double").alias("confidence"), subject.alias("subject_ip"), flow.cast("long").alias("flow_id"), rationale.alias("rationale"), F.to_json(evidence).alias("evidence"),
    )


def beacon_score(intervals: Column, sizes: Column, ctx: Context) -> Column:
    """Struct of score and its parts, from all gaps and sizes of a host pair's connections."""
    floor = ctx.t("beacon_skew_iqr_floor")
    gaps = F.array_sort(F.filter(intervals, lambda x: x > 0))
    vols = F.array_sort(F.filter(sizes, lambda x: x > 0))
    mode = lambda s: F.aggregate(s, F.struct(s[0].alias("best"), F.lit(0).alias("n"), s[0].alias("cur"), F.lit(0).alias("run")), lambda a, x: _run(a, x), lambda a: a.best)

    def _run(a, x):
        run = F.when(x == a.cur, a.run + 1).otherwise(F.lit(1))
        return F.struct(F.when(run > a.n, x).otherwise(a.best).alias("best"), F.greatest(run, a.n).alias("n"), x.alias("cur"), run.alias("run"))

    def ts(s):
        skew, m = 1 - F.abs(E.bowley(s, floor)), E.madm(s)
        return F.when(F.size(s) >= 2, F.struct(E.ceil3((skew + m) / 2).alias("score"), E.rnd(skew, 4).alias("skew"), E.rnd(m, 4).alias("madm"), E.rnd(E.median_of(s), 4).alias("median")))

    def ds(s):
        skew, m = 1 - F.abs(E.bowley(s, floor)), E.madm(s)
        small = F.greatest(F.lit(0.0), 1 - mode(s) / ctx.t("beacon_ds_smallness_norm"))
        return F.when(F.size(s) >= 2, F.struct(E.ceil3((skew + m + small) / 3).alias("score"), E.rnd(skew, 4).alias("skew"), E.rnd(m, 4).alias("madm"), E.rnd(small, 4).alias("smallness")))

    a, b = E.let(gaps, ts), E.let(vols, ds)
    mean = lambda x: E.rnd(F.when(x.ts.isNotNull() & x.ds.isNotNull(), (x.ts.score + x.ds.score) / 2).otherwise(F.coalesce(x.ts.score, x.ds.score, F.lit(0.0))), 4)
    return E.let(F.struct(a.alias("ts"), b.alias("ds")), lambda x: F.struct(mean(x).alias("score"), x.ts.alias("ts"), x.ds.alias("ds")))


def beacon_pairs(flows: DataFrame, ctx: Context) -> DataFrame:
    """Host pairs with enough connections, their score, ports and first flow."""
    g = flows.select("session_id", "flow_id", "first_seen", "bytes_sent", "dst_port", E.ends()).where(E.egress(ctx.home, "host", "peer"))
    g = g.groupBy("session_id", "host", "peer").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct("first_seen", "flow_id", F.coalesce("bytes_sent", F.lit(0)).alias("sent")))).alias("c"),
        F.array_sort(F.collect_set(F.when(F.col("dst_port") != 0, F.col("dst_port")))).alias("ports"),
    ).where(F.col("n") >= ctx.t("beacon_min_connections"))
    gaps = F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x, i: x.first_seen - F.col("c")[i].first_seen)
    g = g.withColumn("gaps", gaps).where((F.size("gaps") >= 2) & (E.let(F.array_sort("gaps"), E.median_of) >= ctx.t("beacon_min_period")))
    return g.withColumn("s", beacon_score(F.col("gaps"), F.transform("c", lambda x: x.sent.cast("double")), ctx))


def beaconing(flows: DataFrame, ctx: Context) -> DataFrame:
    g = beacon_pairs(flows, ctx).where(F.col("s.score") >= ctx.t("beacon_alert_score"))
    period = F.coalesce("s.ts.median", F.lit(0.0))
    return finding(
        g, "C2_BEACON_PERIODIC", "command_and_control",
        F.when(F.col("s.score") >= ctx.t("beacon_severity_high_score"), "high").otherwise("medium"), F.least("s.score", F.lit(1.0)), F.col("host"), F.col("c")[0].flow_id,
        F.format_string("Periodic callback to %s every ~%.0fs", "peer", period),
        F.format_string("%s connected to %s %d times, median gap %.2fs, score %.3f. Polling software looks the same and must be ruled out.", "host", "peer", "n", period, "s.score"),
        F.struct(F.col("s.score").alias("observed_score"), F.col("n").alias("connection_count"), F.lit(ctx.t("beacon_alert_score")).alias("threshold"), "ports", "s.ts", "s.ds"),
    )


def keepalive(flows: DataFrame, ctx: Context) -> DataFrame:
    f = flows.where((F.col("interval_count") >= ctx.t("keepalive_min_intervals")) & (F.col("interval_median") >= ctx.t("beacon_min_period")) & E.egress(ctx.home))
    f = f.withColumns({"host": E.initiator(), "peer": E.peer(), "score": E.ceil3(F.greatest(F.lit(0.0), 1 - F.col("interval_mad") / F.col("interval_median")))}).where(F.col("score") >= ctx.t("beacon_alert_score"))
    key = Window.partitionBy("session_id", "host", "peer", "dst_port")
    f = f.withColumns({"nth": F.row_number().over(key.orderBy(F.desc("score"), "flow_id")), "repeats": F.count("*").over(key)}).where("nth = 1")
    several = F.when(F.col("repeats") > 1, F.format_string(" (%d connections)", "repeats")).otherwise("")
    return finding(
        f, "C2_BEACON_KEEPALIVE", "command_and_control", F.lit("medium"), F.least("score", F.lit(1.0)), F.col("host"), F.col("flow_id"),
        F.concat(F.format_string("Regular keepalive to %s:%d every ~%.1fs", "peer", "dst_port", "interval_median"), several),
        F.format_string("One connection to %s:%d sent at a median interval of %.2fs (MAD %.2fs) for %.0fs. An application heartbeat looks the same.", "peer", "dst_port", "interval_median", "interval_mad", "duration_seconds"),
        F.struct(F.col("score").alias("observed_score"), F.lit(ctx.t("beacon_alert_score")).alias("threshold"), "interval_median", "interval_mad", "interval_dispersion", F.col("interval_count").alias("sample_count"), F.col("repeats").alias("connections_with_this_pattern")),
    )


def covert_channel(flows: DataFrame, ctx: Context) -> DataFrame:
    """Long unidentified TCP exchanges.  Link-scoped peers are not excluded here."""
    f = flows.where((F.col("protocol") == "TCP") & (F.col("duration_seconds") >= ctx.t("unknown_channel_min_duration"))).where(E.in_nets(E.initiator(), ctx.home) & ~E.in_nets(E.peer(), ctx.home))
    f = f.withColumns({"host": E.initiator(), "peer": E.peer(), "service": E.service_port()}).where(~F.col("service").isin(*WELL_KNOWN_PORTS))
    f = f.where((F.coalesce("app_protocol", F.lit("")) == "") & (F.coalesce("tls_sni", F.lit("")) == "") & (F.col("bytes_sent") > 0) & (F.col("bytes_received") > 0) & (F.col("packets_sent") >= 2) & (F.col("packets_received") >= 2))
    return finding(
        f, "COVERT_CHANNEL_UNKNOWN_PORT", "command_and_control", F.lit("medium"), F.lit(ctx.t("unknown_channel_confidence")), F.col("host"), F.col("flow_id"),
        F.format_string("Unidentified %.0fs channel to %s:%d", "duration_seconds", "peer", "service"),
        F.format_string("A connection to %s:%d stayed open %.0fs with %d bytes out and %d in, on a port of no listed service and with nothing identified in it.", "peer", "service", "duration_seconds", "bytes_sent", "bytes_received"),
        F.struct("duration_seconds", F.col("service").alias("service_port"), "payload_entropy", "bytes_sent", "bytes_received"),
    )


def exfil_volume(flows: DataFrame, ctx: Context) -> DataFrame:
    """session_id, volume: the floored percentile of positive outbound bytes, by index min(int(n * p / 100), n - 1).

    In two steps, so that no task sorts a session: counts by sixteenths of powers of two find the step that holds the
    rank, and only the values of that step are ranked."""
    s = flows.where("bytes_sent > 0").select("session_id", "bytes_sent", F.floor(F.log2("bytes_sent") * 16).cast("int").alias("step"))
    steps = s.groupBy("session_id", "step").agg(F.count("*").alias("k"))
    w = Window.partitionBy("session_id")
    at = F.least((F.col("n") * ctx.t("exfil_volume_percentile") / 100).cast("long"), F.col("n") - 1)
    steps = steps.withColumns({"upto": F.sum("k").over(w.orderBy("step")), "n": F.sum("k").over(w)}).withColumn("at", at - (F.col("upto") - F.col("k")))
    held = storage.stored(steps.where((F.col("at") >= 0) & (F.col("at") < F.col("k"))).select("session_id", "step", "at"), "steps")
    values = s.join(held, ["session_id", "step"]).groupBy("session_id", "at", "bytes_sent").agg(F.count("*").alias("k"))
    value = values.withColumn("upto", F.sum("k").over(Window.partitionBy("session_id").orderBy("bytes_sent"))).where(F.col("upto") > F.col("at")).groupBy("session_id").agg(F.min("bytes_sent").alias("v"))
    return value.select("session_id", F.greatest("v", F.lit(ctx.t("exfil_absolute_floor")).cast("long")).alias("volume"))


def exfiltration(flows: DataFrame, ctx: Context) -> DataFrame:
    """Large one-sided uploads; peers inside count too.

    The volumes, a row for each session, are stored: the flows join them where they are, not dealt out by session."""
    f = flows.join(storage.stored(exfil_volume(flows, ctx), "volumes"), "session_id").withColumns({"host": E.initiator(), "peer": E.peer()})
    f = f.where(~E.is_link_scoped("peer") & ~E.is_link_scoped("dst_ip"))
    received = F.when(F.coalesce("bytes_received", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("bytes_received"))
    f = f.withColumn("ratio", F.col("bytes_sent") / received).where((F.col("bytes_sent") >= F.col("volume")) & (F.col("ratio") >= ctx.t("exfil_ratio")))
    high, tls = F.col("payload_entropy") >= ctx.t("exfil_entropy_high"), (F.col("app_protocol") == "TLS") | (F.coalesce("tls_sni", F.lit("")) != "")
    return finding(
        f, "EXFIL_VOLUME_ASYMMETRY", "exfiltration", F.when(high & ~tls, "high").when(tls & ~high, "low").otherwise("medium"),
        F.least(F.col("ratio") / (ctx.t("exfil_ratio") * ctx.t("confidence_scale_multiplier")), F.lit(1.0)), F.col("host"), F.col("flow_id"),
        F.concat(F.lit("Asymmetric upload of "), E.human_bytes("bytes_sent"), F.lit(" to "), F.col("peer")),
        F.format_string("%d bytes out against %d in (%.1f to 1), in the top of this capture's outbound volume.", "bytes_sent", "bytes_received", "ratio"),
        F.struct("bytes_sent", "bytes_received", E.rnd("ratio", 2).alias("ratio"), "volume", "payload_entropy"),
    )


def icmp_tunnel(flows: DataFrame, ctx: Context) -> DataFrame:
    f = flows.where((F.col("protocol") == "ICMP") & (F.col("avg_packet_size") >= ctx.t("icmp_packet_bytes")) & F.shiftright(F.col("dst_port"), 8).isin(0, 8))
    f = f.withColumn("packets", F.col("packets_sent") + F.col("packets_received")).where(F.col("packets") >= ctx.t("icmp_min_packets")).withColumns({"host": E.initiator(), "peer": E.peer()})
    return finding(
        f, "ICMP_TUNNEL_OVERSIZED", "exfiltration", F.lit("high"), F.least(F.col("avg_packet_size") / (ctx.t("icmp_packet_bytes") * ctx.t("confidence_scale_multiplier")), F.lit(1.0)), F.col("host"), F.col("flow_id"),
        F.format_string("Oversized ICMP echo stream to %s (%.0f B average)", "peer", "avg_packet_size"),
        F.format_string("%d echo packets averaging %.1f bytes between %s and %s; ordinary echoes are smaller.", "packets", "avg_packet_size", "host", "peer"),
        F.struct("avg_packet_size", "packets", F.lit(ctx.t("icmp_packet_bytes")).alias("threshold")),
    )


def port_scan(flows: DataFrame, ctx: Context) -> DataFrame:
    """Failed connections to many host and port combinations, counted over the whole capture; episodes describe its shape."""
    f = flows.where("protocol = 'TCP'").select("session_id", "flow_id", "first_seen", E.initiator().alias("host"), E.peer().alias("peer"), E.service_port().alias("port"), F.coalesce("tcp_flags_seen", F.lit("")).alias("flags"), (F.col("packets_received") < 2).alias("failed"))
    combo = F.struct("peer", "port")
    totals = f.groupBy("session_id", "host").agg(F.countDistinct(combo).alias("attempted"), F.countDistinct(F.when(F.col("failed"), combo)).alias("failures"))
    inside = E.in_nets("host", ctx.home)
    bar = F.when(inside, F.lit(ctx.t("scan_unique_ports_local"))).otherwise(F.lit(ctx.t("scan_unique_ports")))
    totals = totals.withColumns({"inside": inside, "bar": bar}).where(F.col("failures") >= F.col("bar"))
    w = Window.partitionBy("session_id", "host").orderBy("first_seen", "flow_id")
    p = f.where("failed").join(totals, ["session_id", "host"], "left_semi")
    p = p.withColumn("new", F.when(F.col("first_seen") - F.lag("first_seen").over(w) > ctx.t("scan_inactivity_timeout"), 1).otherwise(0)).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    largest = p.groupBy("session_id", "host", "episode").agg(F.countDistinct(combo).alias("n")).groupBy("session_id", "host").agg(F.count("*").alias("episodes"), F.max("n").alias("largest"))
    shape = p.groupBy("session_id", "host").agg(F.countDistinct("peer").alias("targets"), F.count("*").alias("probes"), F.count(F.when(F.contains("flags", F.lit("S")) & ~F.contains("flags", F.lit("A")), 1)).alias("syn_only"), E.rnd(F.max("first_seen") - F.min("first_seen"), 1).alias("span"), F.min_by("flow_id", F.struct("first_seen", "flow_id")).alias("flow_id"), F.min("peer").alias("one"))
    g = totals.join(largest, ["session_id", "host"]).join(shape, ["session_id", "host"]).withColumn("ratio", F.col("syn_only") / F.col("probes"))
    where = F.when(F.col("targets") == 1, F.col("one")).otherwise(F.format_string("%d hosts", "targets"))
    return finding(
        g, "RECON_PORT_SCAN", "reconnaissance", F.when(F.col("ratio") > ctx.t("scan_syn_ratio_high"), "high").otherwise("medium"),
        F.least(F.col("failures") / (F.col("bar") * ctx.t("confidence_scale_multiplier")), F.lit(1.0)), F.col("host"), F.col("flow_id"),
        F.concat(F.format_string("Port scan: %s failed to connect to %d host+port combinations on ", "host", "failures"), where),
        F.format_string("%s failed on %d combinations across %d host(s) in %d episode(s), the largest of %d; %d of %d attempts were bare SYN.", "host", "failures", "targets", "episodes", "largest", "syn_only", "probes"),
        F.struct("failures", "attempted", "targets", "episodes", "largest", ((F.col("episodes") > 1) & (F.col("largest") < F.col("bar"))).alias("spread_below_streaming_threshold"), "span", "syn_only", "probes", "inside", F.col("bar").alias("threshold_applied")),
    )


def dns_usage(dns: DataFrame, flows: DataFrame) -> DataFrame:
    """dns plus used: whether the asking host exchanged traffic with an address that any client got for the name; and
    evidence: whether the session has anything but DNS to judge by."""
    f = flows.where((F.coalesce("app_protocol", F.lit("")) != "DNS") & (F.col("dst_port") != 53))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("host"), F.col(y).alias("ip")) for x, y in (("src_ip", "dst_ip"), ("dst_ip", "src_ip"))]))
    peers = storage.stored(f.select("session_id", ways.alias("way")).select("session_id", "way.*").distinct(), "peers")  # read twice: the flows once
    answers = dns.select("session_id", F.lower("query_name").alias("name"), F.explode("response_ips").alias("ip")).distinct()
    asked = dns.select("session_id", F.col("src_ip").alias("host"), F.lower("query_name").alias("name")).distinct()
    used = asked.join(answers, ["session_id", "name"]).join(peers, ["session_id", "host", "ip"], "left_semi").select("session_id", "host", "name", F.lit(True).alias("used")).distinct()
    evidence = peers.select("session_id").distinct().withColumn("evidence", F.lit(True))
    d = dns.withColumns({"host": F.col("src_ip"), "name": F.lower("query_name")}).join(used, ["session_id", "host", "name"], "left").join(evidence, "session_id", "left")
    return d.withColumns({"used": F.coalesce("used", F.lit(False)), "evidence": F.coalesce("evidence", F.lit(False))})


def dns_long_label(dns: DataFrame, flows: DataFrame, ctx: Context) -> DataFrame:
    bar = max(ctx.t("dns_label_length"), ctx.t("dns_entropy_min_label_len"))
    d = dns_usage(dns, flows).where((F.col("subdomain_length") >= bar) & (F.col("query_entropy") >= ctx.t("dns_label_entropy"))).withColumn("parent", E.registered_domain("query_name", ctx.suffixes))
    loose = ~(F.col("evidence") & F.col("used"))
    g = d.groupBy("session_id", "host", "parent").agg(
        F.count(F.when(loose, 1)).alias("n"), F.count(F.when(~loose, 1)).alias("used_names"),
        F.max(F.when(loose, F.col("subdomain_length"))).alias("longest"), F.max(F.when(loose, F.col("query_entropy"))).alias("peak"),
        F.min_by("flow_id", F.when(loose & F.col("flow_id").isNotNull(), F.struct("timestamp", "flow_id"))).alias("flow_id"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(loose, F.struct("timestamp", "query_name")))), 1, SAMPLES), lambda x: F.substring(x.query_name, 1, SAMPLE_CHARS)).alias("samples"),
    ).where("n > 0")
    return finding(
        g, "DNS_TUNNEL_LONG_LABEL", "exfiltration", F.lit("high"), F.least(F.col("longest") / (ctx.t("dns_label_length") * ctx.t("confidence_scale_multiplier")), F.lit(1.0)), F.col("host"), F.col("flow_id"),
        F.format_string("%d oversized DNS labels under %s from %s", "n", "parent", "host"),
        F.format_string("%s asked %d names under %s with labels of up to %d characters (entropy %.2f) and connected to none of the answers.", "host", "n", "parent", "longest", "peak"),
        F.struct(F.col("n").alias("observed_query_count"), "used_names", "longest", "peak", "parent", "samples"),
    )


def dns_subdomain_volume(dns: DataFrame, flows: DataFrame, ctx: Context) -> DataFrame:
    d = dns_usage(dns, flows).withColumn("parent", E.registered_domain("query_name", ctx.suffixes))
    names = d.groupBy("session_id", "host", "parent", "name").agg(F.count("*").alias("asked"), F.max((F.col("evidence") & F.col("used")).cast("int")).alias("used"))
    loose = F.col("used") == 0
    g = names.groupBy("session_id", "host", "parent").agg(F.count("*").alias("names"), F.count(F.when(loose, 1)).alias("loose"), F.sum("asked").alias("total"), F.count(F.when(loose & (F.col("asked") == 1), 1)).alias("once"), F.slice(F.array_sort(F.collect_set(F.when(loose, F.col("name")))), 1, SAMPLES).alias("sample"))
    bar = ctx.t("dns_unique_subdomains")
    g = g.where((F.col("names") > bar) & (F.col("loose") > bar))
    return finding(
        g, "DNS_TUNNEL_SUBDOMAIN_VOLUME", "exfiltration", F.lit("medium"), F.least(F.col("loose") / (bar * ctx.t("confidence_scale_multiplier")), F.lit(1.0)), F.col("host"), F.lit(None),
        F.format_string("%d unused subdomains of %s from %s", "loose", "parent", "host"),
        F.format_string("%s resolved %d names under %s and used the answers of all but %d, of which %d were asked once.", "host", "names", "parent", "loose", "once"),
        F.struct(F.col("loose").alias("observed_unused_subdomains"), F.col("names").alias("observed_unique_subdomains"), F.col("once").alias("unused_names_queried_once"), F.col("total").alias("total_queries"), E.rnd(F.col("names") / F.col("total"), 3).alias("unique_to_total_ratio"), F.col("parent").alias("registered_domain"), "sample"),
    )


def ioc_hits(flows: DataFrame, dns: DataFrame, indicators: DataFrame, ctx: Context) -> DataFrame:
    """session_id, subject, feed_id, kind, value, seen_in, n, seen (first time), flow_id (of the first), context: where a listed address or
    name appears, how often and when first.

    Addresses match an external end of a flow; names match a label suffix of a server name, HTTP host or query.  Listed
    URLs never match traffic.  Both sides are counted by value before they meet: a value that n rows hold and that a feed
    lists m times is seen n * m times, without its pairs."""
    f = flows.withColumn("host", E.initiator())
    at = F.struct(F.col("first_seen").alias("ts"), "flow_id").alias("at")
    ends = f.select("session_id", "host", at, F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("value")).where(~E.in_nets("value", ctx.home)).withColumn("seen_in", F.lit("address"))
    named = [f.select("session_id", "host", at, F.col(c).alias("name"), F.lit(w).alias("seen_in")) for c, w in (("tls_sni", "server name"), ("http_host", "http host")) if c in flows.columns]
    named.append(dns.select("session_id", F.col("src_ip").alias("host"), F.struct(F.col("timestamp").alias("ts"), "flow_id").alias("at"), F.col("query_name").alias("name"), F.lit("dns query").alias("seen_in")))
    n = named[0]
    for other in named[1:]:
        n = n.unionByName(other)
    key = ["session_id", "host", "seen_in"]
    count = [F.count("*").alias("times"), F.min("at.ts").alias("seen"), F.min("at").alias("first")]
    n = n.where("name <> ''").groupBy(*key, "name").agg(*count)
    n = n.withColumn("value", F.explode(E.label_suffixes("name"))).groupBy(*key, "value").agg(F.sum("times").alias("times"), F.min("seen").alias("seen"), F.min("first").alias("first"))
    listed = indicators.groupBy("feed_id", "kind", "value").agg(F.count("*").alias("listed"), F.min("context").alias("context"))
    a = ends.groupBy(*key, "value").agg(*count).join(listed.where(F.col("kind").isin("ipv4", "ipv6")), "value")
    n = n.join(listed.where("kind = 'domain'"), "value")
    cols = ["session_id", F.col("host").alias("subject"), "feed_id", "kind", "value", "seen_in", (F.col("times") * F.col("listed")).alias("n"), "seen", F.col("first.flow_id").alias("flow_id"), "context"]
    return a.select(*cols).unionByName(n.select(*cols))


def ioc_matches(flows: DataFrame, dns: DataFrame, indicators: DataFrame, feeds: DataFrame, ctx: Context) -> DataFrame:
    """feeds: feed_id, name, published_on and retrieved_on in epoch seconds (either may be NULL)."""
    g = ioc_hits(flows, dns, indicators, ctx)
    g = g.join(feeds, "feed_id").withColumn("stale_days", E.rnd((F.coalesce("published_on", "retrieved_on") - F.col("seen")) / 86400, 1))
    return finding(
        g, "IOC_FEED_MATCH", "indicator", F.when(F.col("stale_days") > ctx.t("ioc_stale_days"), "medium").otherwise("high"), F.lit(1.0), F.col("subject"), F.col("flow_id"),
        F.format_string("%s is on the indicator list %s", "value", "name"),
        F.format_string("%s was seen with %s (%s) %d time(s); the list is %.1f days younger than the traffic.", "subject", "value", "seen_in", "n", F.coalesce("stale_days", F.lit(0.0))),
        F.struct("kind", "value", "seen_in", F.col("n").alias("occurrences"), "context", "stale_days"),
    )


def corroborate(findings: DataFrame, base_rates: DataFrame, ctx: Context) -> DataFrame:
    """Subjects that several rules, none of which fires on ordinary traffic, point at."""
    quiet = base_rates.where("benign_fired = 0").select("rule_id")
    f = findings.where("subject_ip IS NOT NULL").join(quiet, "rule_id", "left_semi")
    g = f.groupBy("session_id", "subject_ip").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.max_by("title", F.struct(E.severity_weight(), "confidence", "title")).alias("worst"), F.min("flow_id").alias("flow_id")).withColumn("n", F.size("rules")).where(F.col("n") >= ctx.t("corroboration_distinct_rules"))
    return finding(
        g, "HOST_CORROBORATED", "corroboration", F.lit("critical"), F.least(F.col("n") / 6.0, F.lit(1.0)), F.col("subject_ip"), F.col("flow_id"),
        F.format_string("%d independent rules implicate %s", "n", "subject_ip"),
        F.concat(F.lit("Rules: "), F.array_join("rules", ", "), F.lit(". Most severe: "), F.col("worst")),
        F.struct("rules", "n", "worst"),
    )


def annotate(findings: DataFrame, base_rates: DataFrame) -> DataFrame:
    """Attach measured base rates; a rule seen on ordinary traffic and never on attacks is capped at low."""
    f = findings.join(base_rates, "rule_id", "left")
    unproven = F.coalesce((F.col("benign_fired") > 0) & (F.col("malicious_fired") == 0), F.lit(False))
    statement = F.when(F.col("benign_captures").isNull(), "not measured").otherwise(F.format_string("fired on %d of %d ordinary and %d of %d attack captures", "benign_fired", "benign_captures", "malicious_fired", "malicious_captures"))
    return f.select(*[c for c in findings.columns if c != "severity"], F.when(unproven, "low").otherwise(F.col("severity")).alias("severity"), F.col("severity").alias("severity_as_written"), statement.alias("base_rate"))


def carry_triage(findings: DataFrame, previous: DataFrame) -> DataFrame:
    """Decisions of an earlier analysis survive for the same rule, subject and title."""
    key = ["session_id", "rule_id", "subject_ip", "title"]
    old = previous.where("triage_status <> 'pending'").groupBy(*key).agg(F.max_by(F.struct("triage_status", "reviewed_by", "review_note"), "reviewed_at").alias("o"), F.max("reviewed_at").alias("reviewed_at"))
    old = old.select(*[F.col(k).alias(f"o_{k}") for k in key], "o", "reviewed_at")
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in key]
    return findings.join(old, same, "left").select(*findings.columns, F.coalesce("o.triage_status", F.lit("pending")).alias("triage_status"), F.col("o.reviewed_by").alias("reviewed_by"), "reviewed_at", F.col("o.review_note").alias("review_note"))


def risk_rollup(flows: DataFrame, findings: DataFrame) -> DataFrame:
    """Each flow's risk: the greatest weight of its findings, else 0."""
    worst = findings.where("flow_id IS NOT NULL").groupBy("session_id", "flow_id").agg(F.max(E.severity_weight()).alias("risk"))
    return flows.drop("risk_score").join(worst, ["session_id", "flow_id"], "left").withColumn("risk_score", F.coalesce("risk", F.lit(0))).drop("risk")


def analyse(flows: DataFrame, dns: DataFrame, ctx: Context, base_rates: DataFrame, indicators: DataFrame | None = None, feeds: DataFrame | None = None, outliers: bool = True) -> DataFrame:
    """All rules, then corroboration of what they found, then statistical outliers, then base rates."""
    parts = [beaconing(flows, ctx), keepalive(flows, ctx), covert_channel(flows, ctx), dns_long_label(dns, flows, ctx), dns_subdomain_volume(dns, flows, ctx), port_scan(flows, ctx), exfiltration(flows, ctx), icmp_tunnel(flows, ctx)]
    if indicators is not None and feeds is not None:
        parts.append(ioc_matches(flows, dns, indicators, feeds, ctx))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = storage.stored(found, "found")  # read twice: the rules run once
    found = found.unionByName(corroborate(found, base_rates, ctx))
    if outliers:
        found = found.unionByName(anomaly.findings(flows))
    return annotate(found, base_rates)
