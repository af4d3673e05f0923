"""The live path: packets as they arrive, sessions by event time, windows recomputed whole, alerts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import exports, flows

#: Sessions that a plan names.
SESSIONS = 10_000
PACKETS = "session_id long, packet_no long, ts double, src string, dst string, proto string, sport int, dport int, tcp_flags int, frame_len int, data_len int, payload binary"


def packet_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A landing folder of packet files."""
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gap_sessions(packets: DataFrame, gap: str = "300 seconds", delay: str = "300 seconds") -> DataFrame:
    """Conversations by idle gap alone, in event time; state goes once the watermark has passed them."""
    ends = [F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))]
    p = packets.withColumns({"at": F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "a": F.least(*ends), "b": F.greatest(*ends)}).withWatermark("at", delay)
    return p.groupBy("session_id", "a", "b", "proto", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))


def recompute(spark: SparkSession, packets: DataFrame, store: str, results: str, analyse: Callable[[DataFrame], DataFrame], checkpoint: str, alert: Callable[[DataFrame], None] | None = None, every: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Each batch adds its packets to the store and recomputes the flows and findings of the sessions it touched.

    The store is laid out by session and the plan names the sessions of the batch (``only``), so that a batch reads just
    their folders; a batch that runs again replaces its own.  Results replace their sessions' partitions: a session without findings keeps a row without a rule, which
    ``current`` leaves out.  Findings that no earlier batch alerted are passed on, once for each claim."""

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "batch").parquet(store)
        touched = batch.select("session_id").distinct()
        whole = only(spark.read.option("basePath", store).schema(f"{PACKETS}, batch long").parquet(store).drop("batch"), touched)
        findings = analyse(flows.build_flows(whole))
        empty = touched.select(*[F.col("session_id") if f.name == "session_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in findings.schema.fields])
        findings.unionByName(empty).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(results)
        if alert:
            now = only(current(spark, results), touched)
            sent = f"{results}-alerted"
            try:
                known = spark.read.option("basePath", sent).parquet(sent).where(F.col("batch") < number)
            except Exception as e:  # nothing has been alerted yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                known = now.limit(0)
            fresh = exports.fresh(now, known)
            fresh.select("rule_id", "subject_ip", "title").write.mode("overwrite").parquet(f"{sent}/batch={number}")
            alert(fresh)

    writer = packets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def current(spark: SparkSession, results: str) -> DataFrame:
    """The findings that the live path has written."""
    return spark.read.parquet(results).where("rule_id IS NOT NULL")


def only(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of the touched sessions.  Up to SESSIONS of them are named in the plan, which prunes the folders; more are
    joined, as then most of the store is read anyway."""
    ids = [r[0] for r in touched.limit(SESSIONS + 1).collect()]
    if len(ids) > SESSIONS:
        return stored.join(touched, "session_id", "left_semi")
    return stored.where(F.col("session_id").isin(ids))


def reordering(packets: DataFrame, stretch: int = 100_000) -> DataFrame:
    """How far time runs backwards in each session, to set the watermark by; for stored packets.

    A session is cut into stretches of packet numbers.  The latest time before a packet is that of its own stretch so far,
    or of any earlier stretch; the latter come from a window over one row for each stretch.  So no task holds a session.
    Packets without a number or a time are left out; a session of one packet has 0."""
    p = packets.where("packet_no IS NOT NULL AND ts IS NOT NULL").select("session_id", "packet_no", "ts", F.floor(F.col("packet_no") / stretch).alias("part"))
    within = Window.partitionBy("session_id", "part").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = p.withColumn("back", F.max("ts").over(within) - F.col("ts")).groupBy("session_id", "part").agg(F.max("back").alias("back"), F.max("ts").alias("latest"), F.min("ts").alias("earliest"))
    before = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = F.max("latest").over(before) - F.col("earliest")
    return parts.withColumn("across", across).groupBy("session_id").agg(F.greatest(F.lit(0.0), F.max("back"), F.max("across")).alias("max_reordering"))
