"""Findings as records for other systems: ECS documents, CEF and syslog lines; and the choice of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import aggregates

# Severities in each format, and event types by rule.
CEF_SEVERITY = {"low": 3, "medium": 5, "high": 8, "critical": 10}
ECS_SEVERITY = {"low": 21, "medium": 47, "high": 73, "critical": 99}
SYSLOG_SEVERITY = {"low": 6, "medium": 5, "high": 4, "critical": 2}
SYSLOG_FACILITY, ECS_VERSION, CEF_VERSION = 16, "8.11.0", 0
EVENT_TYPES = {"RECON_PORT_SCAN": "connection,start", "C2_BEACON_PERIODIC": "connection,protocol", "C2_BEACON_KEEPALIVE": "connection,protocol", "DNS_TUNNEL_LONG_LABEL": "protocol", "DNS_TUNNEL_SUBDOMAIN_VOLUME": "protocol", "ICMP_TUNNEL_OVERSIZED": "protocol", "COVERT_CHANNEL_UNKNOWN_PORT": "connection,protocol", "EXFIL_VOLUME_ASYMMETRY": "connection", "IOC_FEED_MATCH": "indicator"}
VENDOR, PRODUCT, VERSION = "Wiretide", "FlowAnalytics", "1"


def cef_header(c: Column) -> Column:
    c = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(c, r"[\r\n]+", " ")


def cef_extension(c: Column) -> Column:
    c = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    return F.regexp_replace(c, r"[\r\n]+", " ")


def _iso(seconds: Column) -> Column:
    """UTC time text of epoch seconds, whatever the session's zone."""
    return F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cef(findings: DataFrame) -> Column:
    """The CEF 0 record of each row; needs techniques, created (epoch seconds), and may have the flow's ends."""
    head = F.concat_ws("|", F.lit(f"CEF:{CEF_VERSION}"), F.lit(VENDOR), F.lit(PRODUCT), F.lit(VERSION), cef_header(F.col("rule_id")), cef_header(F.col("title")), E._case("severity", CEF_SEVERITY, 0).cast("string"))
    has = set(findings.columns)
    pairs = {"rt": (F.col("created") * 1000).cast("long"), "cat": F.col("category"), "act": F.col("method"), "msg": F.coalesce(F.when(F.col("rationale") != "", F.col("rationale")), F.col("title")), "externalId": F.col("finding_id"), "cs1": F.col("severity"), "cs1Label": F.lit("severity")}
    if "techniques" in has:
        pairs |= {"cs3": F.array_join("techniques", " "), "cs3Label": F.when(F.size("techniques") > 0, F.lit("mitreAttackTechnique"))}
    for key, column in {"src": "src_ip", "spt": "src_port", "dst": "dst_ip", "dpt": "dst_port", "proto": "protocol", "in": "bytes_received", "out": "bytes_sent"}.items():
        if column in has:
            pairs[key] = F.col(column)
    body = F.array(*[F.when(v.cast("string") != "", F.concat(F.lit(f"{k}="), cef_extension(v))) for k, v in pairs.items()])
    return F.concat(head, F.lit("|"), F.array_join(F.array_compact(body), " "))


def syslog(findings: DataFrame, host: str = "-") -> Column:
    return F.concat(F.lit("<"), (SYSLOG_FACILITY * 8 + E._case("severity", SYSLOG_SEVERITY, 6)).cast("string"), F.lit(">1 "), _iso(F.col("created")), F.lit(f" {host} wiretide - "), F.col("rule_id"), F.lit(" - "), cef(findings))


def ecs(findings: DataFrame, host: str = "-") -> Column:
    """The ECS document of each row as JSON; sub-techniques stand under their parents."""
    t = F.col("techniques")
    parent = F.array_distinct(F.transform(t, lambda x: F.substring_index(x, ".", 1)))
    subs = F.filter(t, lambda x: F.contains(x, F.lit(".")))
    name = lambda x: F.substring_index(E._case(x, {k: v[0] for k, v in aggregates.TECHNIQUES.items()}, ""), ":", 1)
    tactic = F.array_sort(F.array_distinct(F.transform(t, lambda x: E._case(x, {k: v[1] for k, v in aggregates.TECHNIQUES.items()}, None))))
    threat = F.struct(F.lit("MITRE ATT&CK").alias("framework"), F.struct(parent.alias("id"), F.transform(parent, name).alias("name")).alias("technique"), F.struct(subs.alias("id")).alias("subtechnique"), F.struct(tactic.alias("id")).alias("tactic"))
    types = F.split(E._case("rule_id", EVENT_TYPES, "info"), ",")
    event = F.struct(F.lit("alert").alias("kind"), F.array(F.lit("intrusion_detection"), F.lit("network")).alias("category"), types.alias("type"), E._case("severity", ECS_SEVERITY, 0).alias("severity"), F.col("finding_id").cast("string").alias("id"), F.col("method").alias("action"), F.col("title").alias("reason"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"), F.col("category"), F.col("rationale").alias("description"))
    return F.to_json(F.struct(_iso(F.col("created")).alias("@timestamp"), F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"), event.alias("event"), rule.alias("rule"), F.struct(F.lit(VENDOR).alias("vendor"), F.lit(PRODUCT).alias("product"), F.lit(host).alias("hostname")).alias("observer"), F.col("title").alias("message"), F.when(F.size("techniques") > 0, threat).alias("threat")))


FORMATS = {"ecs": ecs, "cef": cef, "syslog": syslog}


def export(findings: DataFrame, fmt: str = "ecs") -> DataFrame:
    """finding_id and one record for each finding; write it with ``write.text``."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(sorted(FORMATS))}")
    f = aggregates.techniques(findings)
    return f.select("finding_id", FORMATS[fmt](f).alias("record"))


def select_alerts(findings: DataFrame, floor: str = "high", limit: int = 100) -> DataFrame:
    """The gravest findings at or above the floor, at most limit for each session; suppressed says how many were left out."""
    f = findings.withColumn("rank", E.severity_rank()).where(F.col("rank") >= E.SEVERITY_RANK[floor])
    # The place alone is a window, so that each task passes on no more than limit rows of a session; counts are added up.
    first = f.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("rank"), F.desc("confidence"), "finding_id"))).where(F.col("place") <= limit)
    counts = f.groupBy(F.col("session_id").alias("of_session")).agg(F.count("*").alias("n"))
    return first.join(counts, F.col("session_id").eqNullSafe(F.col("of_session"))).withColumn("suppressed", F.greatest(F.col("n") - limit, F.lit(0))).drop("rank", "n", "of_session")


def fresh(findings: DataFrame, alerted: DataFrame) -> DataFrame:
    """Findings not alerted before, by rule, subject and title; kept for good, not within a watermark."""
    key = ["rule_id", "subject_ip", "title"]
    a = alerted.select(*[F.col(k).alias(f"a_{k}") for k in key]).distinct()
    return findings.join(a, [F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in key], "left_anti")
