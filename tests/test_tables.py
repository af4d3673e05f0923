"""Stored tables: pruned scans, joins without an exchange, and updates that touch no other session."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wiretide.operators import flows, tables

from .test_flows import SCHEMA, packet


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(s, *packet(i, 400 * (i % 9 > 7) + 500 * (i // 9), out=i % 3 > 0)[1:]) for s in (1, 2, 3) for i in range(1, 60)]
    p = spark.createDataFrame(rows, SCHEMA)
    name = f"t{abs(hash(str(tmp_path)))}"
    tables.save(p.where("packet_no % 5 = 0").drop("payload").withColumn("flow_id", F.lit(None).cast("long")), f"{name}_m", str(tmp_path / "m"), 4)
    tables.save(flows.build_flows(p), f"{name}_f", str(tmp_path / "f"), 4)
    yield p, name, tmp_path
    for t in "mf":
        spark.sql(f"DROP TABLE {name}_{t}")


def files(at, session):
    return {f.name for f in Path(at, "m", f"session_id={session}").glob("*.parquet")}


def test_only_the_sessions_asked_for_are_rewritten(spark, stored):
    p, name, at = stored
    before = {s: files(at, s) for s in (1, 2, 3)}
    tables.link(spark, f"{name}_m", f"{name}_f", [2])
    assert {s for s in (1, 2, 3) if files(at, s) == before[s]} == {1, 3}
    got = {(r.session_id, r.packet_no, r.flow_id) for r in spark.table(f"{name}_m").collect()}
    began = sorted(r.flow_id for r in flows.build_flows(p).where("session_id = 2").collect())
    want = {(s, n, max(b for b in began if b <= n) if s == 2 else None) for s in (1, 2, 3) for n in range(5, 60, 5)}
    assert len(began) > 3
    assert got == want
    tables.link(spark, f"{name}_m", f"{name}_f", [2])  # again, with flows known already
    assert {(r.session_id, r.packet_no, r.flow_id) for r in spark.table(f"{name}_m").collect()} == want


def test_join_is_pruned_and_without_exchange(spark, stored):
    _, name, _ = stored
    tables.link(spark, f"{name}_m", f"{name}_f", [1, 2, 3])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tables.with_flows(spark, f"{name}_m", f"{name}_f", 3)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("packets_sent IS NULL").isEmpty()
        assert joined.count() == 11
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan
    assert plan.count("session_id#") >= 2 and plan.count("PartitionFilters: [(session_id#") + plan.count("PartitionFilters: [isnotnull(session_id#") == 2


def test_packets_without_a_flow_have_none(spark):
    p = spark.createDataFrame([packet(1, 0), packet(5, 1), packet(9, 2, port=80)], SCHEMA)
    known = flows.build_flows(p.where("packet_no = 5"))
    assert sorted((r.packet_no, r.f) for r in tables.flow_of(p, known, "f").collect()) == [(1, None), (5, 5), (9, None)]


def test_a_plan_names_so_many_sessions(spark):
    with pytest.raises(ValueError, match="more than"):
        tables.of_sessions(spark, "x", list(range(tables.SESSIONS + 1)))
