"""Summaries of flows and findings: rollups, hosts, edges, graph, timeline, vantage point, scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

OTHERS = "other-hosts"
MIN_PEERS_FOR_SERVICE = 2


def _moved() -> Column:
    return F.coalesce("bytes_sent", F.lit(0)) + F.coalesce("bytes_received", F.lit(0))


def protocol_rollup(flows: DataFrame) -> DataFrame:
    return flows.groupBy("session_id", "protocol").agg(F.count("*").alias("flows"), F.sum(_moved()).alias("bytes"))


def app_protocol_rollup(flows: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent application protocols with how many were observed and how many inferred from a port."""
    g = flows.where("app_protocol <> ''").groupBy("session_id", "app_protocol").agg(F.count("*").alias("flows"), F.count_if(F.col("app_protocol_source") == "observed").alias("observed"))
    g = g.withColumn("inferred", F.col("flows") - F.col("observed"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("flows"), "app_protocol"))).where(F.col("place") <= top)


def top_talkers(flows: DataFrame, top: int = 10) -> DataFrame:
    g = flows.groupBy("session_id", E.initiator().alias("host")).agg(F.count("*").alias("flows"), F.sum("bytes_sent").alias("bytes"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("bytes"), "host"))).where(F.col("place") <= top)


def top_names(dns: DataFrame, top: int = 5) -> DataFrame:
    g = dns.groupBy("session_id", "query_name").agg(F.count("*").alias("queries"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("queries"), "query_name"))).where(F.col("place") <= top)


def severity_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id", "severity").agg(F.count("*").alias("findings"))


def session_totals(flows: DataFrame, dns: DataFrame, findings: DataFrame) -> DataFrame:
    f = flows.groupBy("session_id").agg(F.count("*").alias("flows"), F.sum((F.col("packets_sent") + F.col("packets_received")).cast("long")).alias("packets"), F.sum(_moved()).alias("bytes"))
    d = dns.groupBy("session_id").agg(F.count("*").alias("dns_queries"))
    x = findings.groupBy("session_id").agg(F.count("*").alias("findings"), F.count_if(F.col("triage_status") == "pending").alias("pending"), F.countDistinct("flow_id").alias("flagged_flows"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dns_queries", "findings", "pending", "flagged_flows")]
    return f.join(d, "session_id", "left").join(x, "session_id", "left").select("session_id", "flows", "packets", "bytes", *zero)


def edges(flows: DataFrame) -> DataFrame:
    f = flows.select("session_id", E.initiator().alias("source"), E.peer().alias("target"), _moved().alias("moved"), F.when(F.coalesce("app_protocol", F.lit("")) != "", F.col("app_protocol")).otherwise(F.col("protocol")).alias("p"), F.coalesce("risk_score", F.lit(0)).alias("risk"))
    f = f.where("source <> target")
    return f.groupBy("session_id", "source", "target").agg(F.count("*").alias("flows"), F.sum("moved").alias("bytes"), F.array_sort(F.collect_set("p")).alias("protocols"), F.max("risk").alias("risk"))


def host_profiles(flows: DataFrame, findings: DataFrame, home, scan_ports: int = 25) -> DataFrame:
    """One row for each machine: its traffic from its own side, proposed role with its reason, and findings."""
    i, r, port = E.initiator(), E.peer(), E.service_port()
    side = lambda host, peer, first: F.struct(host.alias("host"), peer.alias("peer"), F.lit(first).alias("first"))
    names = F.array_compact(F.array(*[F.when(F.col(c) != "", F.col(c)) for c in ("tls_sni", "http_host") if c in flows.columns]))
    two = flows.select("session_id", F.explode(F.array(side(i, r, True), side(r, i, False))).alias("s"), F.when(port != 0, port).alias("port"), "bytes_sent", "bytes_received", "first_seen", "last_seen", "protocol", F.when(F.col("app_protocol") != "", F.col("app_protocol")).alias("app"), names.alias("names"))
    two = two.select("session_id", "s.host", "s.peer", "s.first", "port", "bytes_sent", "bytes_received", "first_seen", "last_seen", "protocol", "app", "names").withColumn("peer_inside", E.in_nets("peer", home))
    first = F.col("first")
    n = lambda c: F.count(F.when(c, 1))
    listed = lambda c, v, k: F.slice(F.array_sort(F.collect_set(F.when(c, F.col(v)))), 1, k)
    g = two.groupBy("session_id", "host").agg(
        F.count("*").alias("flow_count"), n(first).alias("flows_initiated"), n(~first).alias("flows_received"),
        F.sum(F.when(first, F.col("bytes_sent")).otherwise(F.col("bytes_received"))).alias("bytes_out"), F.sum(F.when(first, F.col("bytes_received")).otherwise(F.col("bytes_sent"))).alias("bytes_in"),
        listed(~first, "port", 8).alias("listening_ports"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.collect_set("protocol")).alias("protocols"), F.array_sort(F.collect_set("app")).alias("app_protocols"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(first, F.col("names")))))), 1, 8).alias("server_names"),
    ).withColumn("is_internal", E.in_nets("host", home))
    # Distinct counts go by two groupings each, so that no host's peers meet in one task.
    key = ["session_id", "host"]
    peers = two.groupBy(*key, "peer").agg(F.max("peer_inside").alias("inside"), F.max(~first & F.coalesce(F.col("port") == 53, F.lit(False))).alias("asks"))
    peers = peers.groupBy(*key).agg(F.count("*").alias("peer_count"), F.count_if("inside").alias("internal_peer_count"), F.count_if(~F.col("inside")).alias("external_peer_count"), F.count_if("asks").alias("dns_clients"))
    ports = two.where(first & F.col("port").isNotNull()).groupBy(*key, "port").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("unique_ports_contacted"))
    g = g.join(peers, key).join(ports, key, "left").withColumn("unique_ports_contacted", F.coalesce("unique_ports_contacted", F.lit(0)))
    role = (
        F.when(F.col("dns_clients") >= MIN_PEERS_FOR_SERVICE, "resolver")
        .when(~F.col("is_internal") & (F.col("internal_peer_count") >= MIN_PEERS_FOR_SERVICE) & (F.col("flows_received") > 0), "gateway")
        .when((F.col("flows_received") > F.col("flows_initiated")) & (F.col("peer_count") >= MIN_PEERS_FOR_SERVICE), "server")
        .when(F.col("unique_ports_contacted") >= scan_ports, "scanner")
        .otherwise("client")
    )
    why = (
        F.when(role == "resolver", F.format_string("answered DNS for %d machines", "dns_clients"))
        .when(role == "gateway", F.format_string("carried traffic of %d machines inside", "internal_peer_count"))
        .when(role == "server", F.format_string("accepted %d connections from %d machines", "flows_received", "peer_count"))
        .when(role == "scanner", F.format_string("contacted %d distinct ports", "unique_ports_contacted"))
        .otherwise(F.format_string("opened %d conversations and accepted %d", "flows_initiated", "flows_received"))
    )
    f = findings.where("subject_ip IS NOT NULL").groupBy("session_id", F.col("subject_ip").alias("host")).agg(F.count("*").alias("finding_count"), F.size(F.collect_set("rule_id")).alias("distinct_rules"), F.max_by("severity", E.severity_rank()).alias("worst_severity"), F.count_if(F.col("triage_status") == "pending").alias("untriaged_findings"))
    out = g.withColumns({"role": role, "role_evidence": why}).join(f, ["session_id", "host"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("finding_count", "distinct_rules", "untriaged_findings")})
    w = Window.partitionBy("session_id").orderBy(F.desc(F.coalesce(E.severity_rank("worst_severity"), F.lit(0))), F.desc("distinct_rules"), F.desc("flow_count"), "host")
    return out.withColumn("place", F.row_number().over(w))


def timeline(flows: DataFrame, buckets: int = 60) -> DataFrame:
    """Activity in equal buckets over each session's span, with empty ones; a bucket lasts a second at least."""
    span = flows.groupBy("session_id").agg(F.min("first_seen").alias("start"), F.max("last_seen").alias("end"))
    span = span.withColumn("width", F.greatest((F.col("end") - F.col("start")) / buckets, F.lit(1.0)))
    f = flows.join(span, "session_id").withColumn("t", F.least(((F.col("first_seen") - F.col("start")) / F.col("width")).cast("int"), F.lit(buckets - 1)))
    g = f.groupBy("session_id", "t").agg(F.count("*").alias("flows"), F.sum(_moved()).alias("bytes"), F.count_if(F.col("risk_score") > 0).alias("flagged"))
    grid = span.select("session_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("t"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("flows", "bytes", "flagged")]
    return grid.join(g, ["session_id", "t"], "left").select("session_id", "t", *zero)


def home_net_proposal(flows: DataFrame, busy_share: float = 0.01, min_busy: int = 2, coverage: float = 0.5) -> DataFrame:
    """For each session the network that the capture seems to be taken in, or none, from packet counts of endpoints."""
    ends = flows.select("session_id", F.explode(F.array("src_ip", "dst_ip")).alias("address"), (F.col("packets_sent") + F.col("packets_received")).cast("long").alias("n"))
    total = flows.groupBy("session_id").agg(F.sum((F.col("packets_sent") + F.col("packets_received")).cast("long")).alias("sampled"))
    hits = ends.groupBy("session_id", "address").agg(F.sum("n").alias("hits")).withColumn("network", E.group_key("address")).where("network IS NOT NULL").join(total, "session_id")
    busy = F.col("hits") >= F.greatest(F.lit(min_busy), F.floor(F.col("sampled") * busy_share))
    g = hits.groupBy("session_id", "network").agg(F.sum("hits").alias("appearances"), F.sum(F.when(busy, F.col("hits")).otherwise(0)).alias("weight"), F.count_if(busy).alias("busy_hosts"), F.max_by("address", F.when(busy, F.struct("hits", "address"))).alias("busiest"), F.max("sampled").alias("sampled"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("weight"), F.desc("appearances"), "network"))).where("place = 1")
    proposal = F.when((F.col("appearances") < F.col("sampled") * coverage) | (F.col("busy_hosts") == 0), F.lit(""))
    host = F.concat("busiest", F.when(F.contains("busiest", F.lit(":")), F.lit("/128")).otherwise(F.lit("/32")))
    return g.select("session_id", proposal.when(F.col("busy_hosts") >= 2, F.col("network")).otherwise(host).alias("proposal"), "network", "appearances", "busy_hosts", "sampled")


def graph_nodes(flow_edges: DataFrame, findings: DataFrame, limit: int = 60, focus: bool = True) -> DataFrame:
    """Each host's traffic, and whether the diagram draws it.

    With a focus, only machines with findings and those they talked to compete; the rest fold.  Nine tenths of the places
    go by severity and bytes, the last tenth to hosts that most drawn machines share (two at least)."""
    ends = flow_edges.select("session_id", F.explode(F.array(F.struct(F.col("source").alias("host"), F.col("target").alias("peer")), F.struct(F.col("target").alias("host"), F.col("source").alias("peer")))).alias("e"), "bytes", "flows").select("session_id", "e.host", "e.peer", "bytes", "flows")
    t = ends.groupBy("session_id", "host").agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"), F.countDistinct("peer").alias("peers"))
    f = findings.where("subject_ip IS NOT NULL").groupBy("session_id", F.col("subject_ip").alias("host")).agg(F.max(E.severity_rank()).alias("severity_rank"), F.count("*").alias("finding_count"))
    t = t.join(f, ["session_id", "host"], "left").withColumns({"severity_rank": F.coalesce("severity_rank", F.lit(0)), "finding_count": F.coalesce("finding_count", F.lit(0))})
    marked = t.where("finding_count > 0").select("session_id", "host")
    near = ends.join(marked, ["session_id", "host"], "left_semi").select("session_id", F.col("peer").alias("host")).unionByName(marked).distinct().withColumn("near", F.lit(True))
    any_marked = marked.select("session_id").distinct().withColumn("focused", F.lit(True))
    t = t.join(near, ["session_id", "host"], "left").join(any_marked, "session_id", "left")
    t = t.withColumn("competes", ~(F.coalesce("focused", F.lit(False)) & F.lit(focus)) | F.coalesce("near", F.lit(False)))
    w = Window.partitionBy("session_id", "competes").orderBy(F.desc("severity_rank"), F.desc("bytes"), F.desc("host"))
    reserved = max(1, limit // 10)
    t = t.withColumn("kept", F.col("competes") & (F.row_number().over(w) <= max(limit - reserved, 1)))
    kept = t.where("kept").select("session_id", F.col("host").alias("peer"))
    shared = ends.select("session_id", "host", "peer").distinct().join(kept, ["session_id", "peer"], "left_semi").groupBy("session_id", "host").agg(F.count("*").alias("shared"))
    t = t.join(shared, ["session_id", "host"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    hub = Window.partitionBy("session_id", F.col("competes") & ~F.col("kept")).orderBy(F.desc("shared"), F.desc("host"))
    return t.withColumn("drawn", F.col("kept") | (F.col("competes") & ~F.col("kept") & (F.col("shared") >= 2) & (F.row_number().over(hub) <= reserved))).select("session_id", "host", "bytes", "flows", "peers", "severity_rank", "finding_count", "drawn")


def graph_edges(flow_edges: DataFrame, nodes: DataFrame, per_host: int = 2, limit: int = 150) -> DataFrame:
    """Edges of the diagram: folded hosts become one; flagged edges and each host's busiest stay, at most limit."""
    drawn = nodes.where("drawn").select("session_id", F.col("host").alias("h"))
    e = flow_edges.join(drawn.withColumnRenamed("h", "source").withColumn("s", F.lit(True)), ["session_id", "source"], "left").join(drawn.withColumnRenamed("h", "target").withColumn("d", F.lit(True)), ["session_id", "target"], "left").where("s OR d")
    seen = F.when(F.col("s"), F.col("source")).otherwise(F.col("target"))
    both = F.coalesce(F.col("s") & F.col("d"), F.lit(False))
    e = e.select("session_id", F.when(both, F.col("source")).otherwise(seen).alias("source"), F.when(both, F.col("target")).otherwise(F.lit(OTHERS)).alias("target"), "bytes", "flows", "risk")
    e = e.groupBy("session_id", "source", "target").agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"), F.max("risk").alias("risk"))
    ends = e.select("session_id", F.explode(F.array("source", "target")).alias("host"), "source", "target", "bytes")
    busy = ends.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "host").orderBy(F.desc("bytes"), "source", "target"))).where(F.col("nth") <= per_host).select("session_id", "source", "target").distinct().withColumn("busy", F.lit(True))
    e = e.join(busy, ["session_id", "source", "target"], "left").where("risk > 0 OR busy").drop("busy")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("risk"), F.desc("bytes"), "source", "target"))).where(F.col("place") <= limit)


# Techniques with their tactic, the tactics' names and their order in an intrusion.
TECHNIQUES = {"T1071": ("Application Layer Protocol", "TA0011"), "T1071.004": ("Application Layer Protocol: DNS", "TA0011"), "T1572": ("Protocol Tunneling", "TA0011"), "T1095": ("Non-Application Layer Protocol", "TA0011"), "T1571": ("Non-Standard Port", "TA0011"), "T1046": ("Network Service Discovery", "TA0007"), "T1595.001": ("Active Scanning: Scanning IP Blocks", "TA0043"), "T1048": ("Exfiltration Over Alternative Protocol", "TA0010"), "T1048.003": ("Exfiltration Over Unencrypted Non-C2 Protocol", "TA0010"), "T1041": ("Exfiltration Over C2 Channel", "TA0010")}
CALLS_BACK = ("C2_BEACON_PERIODIC", "C2_BEACON_KEEPALIVE")
RULE_TECHNIQUES = {**dict.fromkeys(CALLS_BACK, ("T1071",)), **dict.fromkeys(("DNS_TUNNEL_LONG_LABEL", "DNS_TUNNEL_SUBDOMAIN_VOLUME"), ("T1071.004", "T1572")), "ICMP_TUNNEL_OVERSIZED": ("T1572", "T1095"), "COVERT_CHANNEL_UNKNOWN_PORT": ("T1571",)}
TACTICS = {"TA0043": "Reconnaissance", "TA0042": "Resource Development", "TA0001": "Initial Access", "TA0002": "Execution", "TA0003": "Persistence", "TA0004": "Privilege Escalation", "TA0005": "Defense Evasion", "TA0006": "Credential Access", "TA0007": "Discovery", "TA0008": "Lateral Movement", "TA0009": "Collection", "TA0011": "Command and Control", "TA0010": "Exfiltration", "TA0040": "Impact"}


def techniques(findings: DataFrame) -> DataFrame:
    """findings with their techniques: an empty array where none describes the rule.  An upload by a host that also calls
    back leaves over that channel.  Optional columns source_is_internal and is_tls (booleans) refine two rules."""
    f = findings
    for c in ("source_is_internal", "is_tls"):
        if c not in f.columns:
            f = f.withColumn(c, F.lit(None).cast("boolean"))
    hosts = f.where(F.col("rule_id").isin(*CALLS_BACK) & F.col("subject_ip").isNotNull()).select("session_id", "subject_ip").distinct().withColumn("calls_back", F.lit(True))
    f = f.join(hosts, ["session_id", "subject_ip"], "left")
    ids = lambda *x: F.array(*map(F.lit, x))
    rule = F.col("rule_id")
    scan = F.when(F.col("source_is_internal"), ids("T1046")).when(~F.col("source_is_internal"), ids("T1595.001")).otherwise(ids("T1595.001", "T1046"))
    exfil = F.when(F.col("calls_back"), ids("T1041")).when(~F.col("is_tls"), ids("T1048.003")).otherwise(ids("T1048"))
    # One lookup instead of a chain of tests: a derived rule column would be written out for each.
    plain = F.element_at(F.create_map(*[x for k, v in RULE_TECHNIQUES.items() for x in (F.lit(k), ids(*v))]), rule)
    out = F.when(rule == "RECON_PORT_SCAN", scan).when(rule == "EXFIL_VOLUME_ASYMMETRY", exfil).otherwise(plain)
    return f.withColumn("techniques", F.coalesce(out, F.array().cast("array<string>"))).drop("calls_back", "source_is_internal", "is_tls")


def scenario(findings: DataFrame, first_seen: str = "first_seen") -> DataFrame:
    """Each host's tactics in the order of an intrusion, with the first time of each, and whether the next stage was seen
    before it."""
    t = techniques(findings).where("subject_ip IS NOT NULL").withColumn("technique", F.explode("techniques"))
    tactic = E._case("technique", {k: v[1] for k, v in TECHNIQUES.items()}, None)
    order = {k: i + 1 for i, k in enumerate(TACTICS)}
    g = t.withColumn("tactic_id", tactic).groupBy("session_id", "subject_ip", "tactic_id").agg(F.count("*").alias("findings"), F.min(first_seen).alias("first_seen"), F.array_sort(F.collect_set("technique")).alias("techniques"), F.max(E.severity_rank()).alias("worst"))
    g = g.withColumns({"stage": E._case("tactic_id", order, 0), "tactic": E._case("tactic_id", TACTICS, "")})
    w = Window.partitionBy("session_id", "subject_ip").orderBy("stage")
    return g.withColumn("next_earlier", F.coalesce(F.lead("first_seen").over(w) < F.col("first_seen"), F.lit(False)))


def max_share(df: DataFrame, value: str, by: str = "session_id") -> DataFrame:
    """Each row's share of its group's sum and of its greatest value, for charts."""
    w = Window.partitionBy(by)
    return df.withColumns({"share_of_sum": F.col(value) / F.sum(value).over(w), "share_of_max": F.col(value) / F.max(value).over(w)})


def edge_width(flow_edges: DataFrame) -> DataFrame:
    """Line widths: 1 to 4.5 by the logarithm of bytes."""
    return flow_edges.withColumn("width", 1 + 3.5 * F.log10(F.col("bytes") + 1) / F.log10(F.max("bytes").over(Window.partitionBy("session_id")) + 1))


def barycentre(flow_edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean row of each host's neighbours; rows: session_id, host, row."""
    e = flow_edges.select("session_id", F.col("source").alias("host"), F.col("target").alias("n")).unionByName(flow_edges.select("session_id", F.col("target").alias("host"), F.col("source").alias("n"))).distinct()
    return e.join(rows.select("session_id", F.col("host").alias("n"), "row"), ["session_id", "n"]).groupBy("session_id", "host").agg(F.avg("row").alias("barycentre"))
