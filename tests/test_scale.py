"""Faults that showed on larger tables only, made small."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from wiretide.functions import expressions as E
from wiretide.operators import anomaly, evidence, exports, rules
from wiretide.plans import views
from wiretide.plans.queries import CTX, ORACLES, QUERIES
from wiretide.sources import captures, storage

from .test_oracle import rows


def strategy(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def against_sql(spark, name, at, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    r = db.execute(ORACLES[name])
    names, want = [d[0] for d in r.description], r.fetchall()
    df = QUERIES[name](spark, str(at))
    assert rows(df.columns, df.collect()) == rows(names, want)
    return want


def test_entropy_of_a_long_text(spark):
    text = "".join(f"{i} é " for i in range(40_000))
    data = text.encode()
    began = time.monotonic()
    got = spark.createDataFrame([(data,)], "b binary").select(E.shannon_entropy("b")).first()[0]
    shares = [data.count(bytes([b])) / len(data) for b in set(data)]
    assert got == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-4)
    assert time.monotonic() - began < 20


def test_upper_bound_of_many(spark):
    cases = [(1, 3), (7, 8), (99, 100), (60, 1_000), (6_000, 60_000), (59_990, 60_000)]

    def bound(k, n, lo=0.0, hi=1.0):
        c = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
        for _ in range(30):
            p = (lo + hi) / 2
            few = math.fsum(math.exp(c[i] + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
            lo, hi = (p, hi) if few > 0.05 else (lo, p)
        return hi

    began = time.monotonic()
    got = [r[0] for r in spark.createDataFrame(cases, "k long, n long").select(E.binomial_upper(F.col("k"), F.col("n"))).collect()]
    assert time.monotonic() - began < 20
    assert got == pytest.approx([bound(k, n) for k, n in cases], abs=1e-7)
    with pytest.raises(ValueError):
        E.binomial_upper(F.lit(1), F.lit(2), 0.5)


def test_limits_without_a_rule(spark, tmp_path):
    parts = [(i, f"Brand#{i % 2}", 1) for i in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").coalesce(1).toPandas().to_parquet(tmp_path / "part.parquet")
    assert against_sql(spark, "rate_limits", tmp_path, "part") == [("Brand#0|Brand#1", None, None)]


def test_addresses_beyond_four_octets_travel(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas()
    e["user_id"] = e["user_id"] + e["event_id"] % 3 * 64_000
    e.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    want = against_sql(spark, "capture_round_trip", tmp_path, "events")
    assert any(".0.256." in r[3] for r in want) and len(want) == len(e)


def test_many_ranges_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(captures.storage, "rows", lambda plan: [{"n": i, "problem": None} for i in range(2_500)])
    found = captures.CaptureReader("").partitions()
    assert len(found) <= captures.MOST_TASKS and [r["n"] for p in found for r in p.rows] == list(range(2_500))


def test_a_value_seen_and_listed_often(spark):
    flows = spark.range(600).selectExpr("1L AS session_id", "id AS flow_id", "'10.0.0.1' AS src_ip", "'10.0.0.1' AS initiator_ip", "'198.51.0.1' AS dst_ip", "100D - id AS first_seen", "'a.evil.com' AS tls_sni")
    dns = spark.createDataFrame([], "session_id long, src_ip string, flow_id long, timestamp double, query_name string")
    listed = spark.range(500).selectExpr("1L AS feed_id", "IF(id % 2 = 0, 'ipv4', 'domain') AS kind", "IF(id % 2 = 0, '198.51.0.1', 'evil.com') AS value", "'c' || id AS context")
    got = {r.seen_in: (r.value, r.n, r.seen, r.flow_id, r.context) for r in rules.ioc_hits(flows, dns, listed, CTX).collect()}
    assert got == {"address": ("198.51.0.1", 150_000, -499.0, 599, "c0"), "server name": ("evil.com", 150_000, -499.0, 599, "c1")}


def test_a_host_of_many_samples_and_queries(spark):
    n = 30_000
    endpoints = spark.range(n).selectExpr("id AS sample_id", "'h' AS value", "'name' AS scope")
    dns = spark.range(n).selectExpr("'H' AS query_name", "id % 7 AS session_id", "'10.0.' || id AS src_ip")
    flows = spark.createDataFrame([], "session_id long, src_ip string, dst_ip string, dst_port int")
    listed = spark.createDataFrame([(1, "h"), (1, "h"), (2, "h")], "feed_id long, value string")
    began = time.monotonic()
    got = evidence.correlate(endpoints, dns, flows, listed).groupBy("kind").agg(F.count("*").alias("n"), F.max("session_id").alias("s"), F.max("detail").alias("d")).collect()
    assert time.monotonic() - began < 60
    last = sorted(f"resolved by 10.0.{i}" for i in range(0, n, 7))[59]
    assert {r.kind: (r.n, r.s, r.d) for r in got} == {"dns": (n * 60, 0, last), "feed": (n * 2, None, "listed in feed 2")}


def test_sessions_do_not_deal_out_their_flows(spark, sf_dir):
    flows = views.view(spark, sf_dir, "v_flow")
    for df in (QUERIES["robust_z"](spark, sf_dir), rules.exfiltration(flows, CTX)):
        assert "SortMergeJoin" not in strategy(df)


def test_alerts_pass_on_few_rows(spark):
    f = spark.range(1_000).selectExpr("id % 2 AS session_id", "id AS finding_id", "'high' AS severity", "1D AS confidence")
    chosen = exports.select_alerts(f, limit=3)
    assert "WindowGroupLimit" in strategy(chosen)
    assert sorted((r.session_id, r.finding_id, r.place, r.suppressed) for r in chosen.collect()) == [(s, s + 2 * k, k + 1, 497) for s in (0, 1) for k in range(3)]


def test_findings_read_once_write_no_flows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(spark, "_wiretide_tables", {}, raising=False)
    for name in ("severity_share", "base_rate_annotation"):
        QUERIES[name](spark, sf_dir).count()
    assert not spark._wiretide_tables


def test_dns_rules_read_flows_once(spark, sf_dir, monkeypatch):
    written = []
    keep = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, label, *by: written.append(label) or keep(df, label, *by))
    monkeypatch.setattr(spark, "_wiretide_tables", {}, raising=False)
    for name in ("rule_dns_subdomain_volume", "rule_dns_long_label"):
        df = QUERIES[name](spark, sf_dir)
        df.count()
        assert "l_orderkey" not in strategy(df)
    assert written == ["peers", "peers"] and not spark._wiretide_tables


def test_beaconing_reads_flows_once_and_tests_ends_found(spark, sf_dir, monkeypatch):
    """No table of flows; the join of lines and orders carries no copies of how a host or its peer is found."""
    monkeypatch.setattr(spark, "_wiretide_tables", {}, raising=False)
    df = QUERIES["rule_beaconing"](spark, sf_dir)
    plan = strategy(df)
    assert "RLIKE" in plan and not any("RLIKE" in line for line in plan.splitlines() if "Join" in line)
    assert all(line.count("RLIKE") <= 3 for line in plan.splitlines())
    df.count()
    assert not spark._wiretide_tables


def test_lines_meet_orders_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = strategy(views._view(spark, sf_dir, "v_flow"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    inner, outer = sorted((line for line in plan.splitlines() if "SortMergeJoin" in line), key=len)[::-1]
    assert "o_custkey" in inner and "l_orderkey" in outer and plan.index(outer) < plan.index(inner)


def test_flat_trees_give_the_same_paths():
    import numpy as np

    def depth(node, row, level=0):
        if "c" not in node:
            return level + anomaly._average(node["n"])
        return depth(node["l"] if row[node["c"]] < node["cut"] else node["r"], row, level + 1)

    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 4)), 1)
    trees = [anomaly._grow(x[rng.choice(300, 64, replace=False)], rng) for _ in range(9)] + [anomaly._grow(x[:1], rng)]
    x[3, 2] = np.nan
    got = anomaly._mean_depth(x, *anomaly._flattened(trees, 4))
    assert got.tolist() == pytest.approx([np.mean([depth(t, row) for t in trees]) for row in x], abs=1e-12)


def test_rules_and_scores_run_once(spark, sf_dir, monkeypatch):
    written = []
    keep = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, label, *by: written.append(label) or keep(df, label, *by))
    plan = strategy(QUERIES["findings_all"](spark, sf_dir))
    assert {"found", "scored", "outliers"} <= set(written) and "MapInPandas" not in plan and "Window" not in plan
