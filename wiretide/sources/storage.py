"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir.  Only a local session, whose executors are the driver's own threads, may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wiretide_dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = spark._wiretide_dir = tempfile.mkdtemp(prefix="wiretide-")
    return at


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/wiretide/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df written to the shared folder, partitioned by the columns named, and read back."""
    at = fresh_dir(df.sparkSession, label)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._wiretide_at = at
    return out


def folder_of(table: DataFrame) -> str:
    """Where ``stored`` has put a table."""
    return table._wiretide_at


def store(path: str):
    """Arrow's file system for a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path.replace("s3a://", "s3://", 1)))


def opened(path: str):
    """A file, open for reading at any place."""
    at, base = store(path)
    return at.open_input_file(base)


def rows(path: str) -> list[dict]:
    """The rows of a stored table of bounded size, read without Spark (a data source plans in a process of its own)."""
    import pyarrow.parquet as pq

    at, base = store(path)
    return pq.read_table(base, filesystem=at).to_pylist()


def drained(stream: DataFrame, label: str, **settings: str) -> DataFrame:
    """What a stream gives when it has taken all there is: run into a table of the shared folder.

    The settings hold while the query starts and are then set back."""
    spark, at = stream.sparkSession, fresh_dir(stream.sparkSession, label)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/_state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
