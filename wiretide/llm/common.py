"""Helpers shared by the training-data operators: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it; words are maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, whose executors are the driver's own threads, may do without; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_wiretide_dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = spark._wiretide_dir = tempfile.mkdtemp(prefix="wiretide-")
    return at


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors and recompute nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/wiretide/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    written(spark).append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._wiretide_path = at
    return out


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session has materialised and not swept."""
    if not hasattr(spark, "_wiretide_paths"):
        spark._wiretide_paths = []
    return spark._wiretide_paths


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables materialised since then, but those to keep, and let Spark drop shuffle files no plan needs."""
    paths, kept = written(spark), {getattr(k, "_wiretide_path", None) for k in keep}
    for at in paths[since:]:
        if at not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths[since:] = [at for at in paths[since:] if at in kept]
    gc.collect()
    spark._jvm.System.gc()


def crc32_mod(column: str, n: int):
    """crc32 of the id written as text, modulo n: the fold rule of the learning operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra input columns can never clash with computed ones."""
    return docs.select(*[F.col(n) for n in names])
