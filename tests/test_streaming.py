from pyspark.sql import functions as F

from wiretide.operators import flows, rules
from wiretide.streaming import live


def rows(n):
    return [(1, i, 1000.0 + 30 * i, "10.0.0.1", "203.0.113.5", "TCP", 50000, 443, 16, 100, 40, bytearray(b"x")) for i in range(n)]


def test_recompute_and_alert_once(spark, tmp_path):
    landing, alerts = tmp_path / "in", []
    schema = live.PACKETS
    ctx = rules.Context(home=("10.0.0.0/8",))

    def run():
        q = live.recompute(spark, live.packet_stream(spark, str(landing)), str(tmp_path / "store"), str(tmp_path / "out"), lambda f: rules.keepalive(f.withColumn("tls_sni", F.lit("")), ctx).withColumn("title", F.lit("keepalive")), str(tmp_path / "ckpt"), lambda df: alerts.append(df.count()), once=True)
        q.awaitTermination(120)

    all_rows = rows(60)
    spark.createDataFrame(all_rows[:40], schema).coalesce(1).write.mode("append").parquet(str(landing))
    run()
    spark.createDataFrame(all_rows[40:], schema).coalesce(1).write.mode("append").parquet(str(landing))
    run()
    assert alerts == [1, 0]
    whole = flows.build_flows(spark.createDataFrame(all_rows, schema)).first()
    assert whole["interval_count"] == 59
    assert '"sample_count":59' in live.current(spark, str(tmp_path / "out")).first()["evidence"]


def test_a_session_that_lost_its_findings_keeps_none(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    least = [1]

    def analyse(f):
        found = f.select("session_id", F.lit("R").alias("rule_id"), F.col("src_ip").alias("subject_ip"), F.lit("t").alias("title"), "packets_sent")
        return found.where(F.col("packets_sent") <= least[0])

    for n, want in ((1, 1), (9, 0)):
        spark.createDataFrame(rows(n), live.PACKETS).coalesce(1).write.mode("append").parquet(str(landing))
        live.recompute(spark, live.packet_stream(spark, str(landing)), str(tmp_path / "store"), out, analyse, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
        assert live.current(spark, out).count() == want
    assert spark.read.parquet(str(tmp_path / "store")).count() == 10


def test_gap_sessions(spark, tmp_path):
    p = spark.createDataFrame(rows(3) + [(1, 9, 5000.0, "10.0.0.1", "203.0.113.5", "TCP", 50000, 443, 16, 100, 40, bytearray(b"x"))], live.PACKETS)
    assert sorted(r["packets"] for r in live.gap_sessions(p).collect()) == [1, 3]
    assert live.reordering(p).first()["max_reordering"] == 0


def test_reordering_across_stretches(spark):
    times = [5.0, 9.0, 8.0, 20.0, 3.0, 21.0, 4.0, 30.0]
    p = spark.createDataFrame([(s, 10 * i if s == 1 else i, t if s == 1 else float(i)) for s in (1, 2) for i, t in enumerate(times)] + [(3, 1, 7.0), (3, None, 1.0)], "session_id long, packet_no long, ts double")
    for stretch in (1, 15, 1000):
        assert {r[0]: r[1] for r in live.reordering(p, stretch).collect()} == {1: 17.0, 2: 0.0, 3: 0.0}


def test_a_batch_reads_only_the_folders_it_touched(spark, tmp_path):
    spark.range(100).selectExpr("id % 10 AS session_id", "id AS packet_no").write.partitionBy("session_id").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    read = live.only(stored, spark.createDataFrame([(3,), (7,)], "session_id long"))
    assert read.count() == 20
    scan = [line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert "PartitionFilters: [cast(session_id" in scan[0] or "PartitionFilters: [session_id" in scan[0]
    assert "IN (3,7)" in scan[0]
