"""Stored tables of flows and DNS messages, and the late link between them.

Both tables are partitioned by session and bucketed by flow: a reader of some sessions opens their folders alone, and a
session's messages meet its flows bucket by bucket, without an exchange.  Messages are stored as they are parsed; the flow
of one may be known only later, as a flow has its number from its first packet and may still be open.  Linking then rewrites
the partitions of the sessions it is asked for, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flows

BUCKETS, SESSIONS = 64, 10_000
DYNAMIC = "spark.sql.sources.partitionOverwriteMode"


def save(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Write rows with session_id and flow_id as a new table.  Rows are dealt to the buckets first, so that a bucket of a
    session is one file; a session with most of the rows is ``buckets`` tasks' work."""
    dealt = rows.repartition(buckets, F.col("flow_id"))
    dealt.write.partitionBy("session_id").bucketBy(buckets, "flow_id").sortBy("flow_id").option("path", path).saveAsTable(name)


def of_sessions(spark: SparkSession, name: str, sessions: list[int]) -> DataFrame:
    """The rows of some sessions: the literal list prunes partitions when the plan is made."""
    if len(sessions) > SESSIONS:
        raise ValueError(f"{len(sessions)} sessions are more than the {SESSIONS} that one plan names")
    return spark.table(name).where(F.col("session_id").isin(sessions))


def replace(rows: DataFrame, name: str) -> None:
    """Replace the partitions that rows has, of a table made by ``save``; the others stay as they are."""
    spark = rows.sparkSession
    before = spark.conf.get(DYNAMIC)
    spark.conf.set(DYNAMIC, "dynamic")
    try:
        rows.select(spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(DYNAMIC, before)


def flow_of(packets: DataFrame, known: DataFrame, name: str = "flow_id") -> DataFrame:
    """Packet rows with the flow they belong to: the last one of their conversation that began with them or before.

    known: session_id, flow_id, src_ip, dst_ip, src_port, dst_port, protocol.  Both sides meet in one pass over each
    conversation, in order of packet_no; a packet before every flow of its conversation has none."""
    p = flows.conversations(packets.drop(name)).drop("timeout", "syn").withColumn("began", F.lit(None).cast("long"))
    ends = known.select("session_id", F.col("protocol").alias("proto"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("src_port").alias("sport"), F.col("dst_port").alias("dport"), "flow_id")
    e = flows.conversations(ends.withColumn("tcp_flags", F.lit(0))).select(*flows.KEY, F.col("flow_id").alias("packet_no"), F.col("flow_id").alias("began"))
    so_far = Window.partitionBy(*flows.KEY).orderBy("packet_no", F.col("began").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = p.withColumn("asked", F.lit(True)).unionByName(e, allowMissingColumns=True)
    both = both.withColumn(name, F.last("began", ignorenulls=True).over(so_far))
    return both.where("asked").drop("asked", "began", "a", "b")


def link(spark: SparkSession, messages: str, flow_table: str, sessions: list[int]) -> None:
    """Give the stored messages of some sessions the flows that are known by now."""
    found = flow_of(of_sessions(spark, messages, sessions), of_sessions(spark, flow_table, sessions))
    kept = [f.name for f in spark.table(messages).schema]
    buckets = spark.sql(f"DESCRIBE EXTENDED {messages}").where("col_name = 'Num Buckets'").first()
    replace(found.select(*kept).repartition(int(buckets.data_type), F.col("flow_id")), messages)


def with_flows(spark: SparkSession, messages: str, flow_table: str, session: int) -> DataFrame:
    """A session's messages and their flows."""
    m = of_sessions(spark, messages, [session])
    f = of_sessions(spark, flow_table, [session]).drop("session_id")
    return m.join(f, "flow_id", "left")
