"""Indicator feeds in four text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E

FORMATS = ("FEODO_IP", "URLHAUS", "PLAIN_IP", "PLAIN_DOMAIN")
# Fixed value: what counts as a name in a feed; deliberately wide, for the feed decides what is in it.
DOMAIN = r"^(?=.{1,253}$)(?!-)[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+$"

STAMP = r"(?i)^#.*(?:last updated|generated)\s*:?\s*(\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\d)?)"


def _kind(ip: Column) -> Column:
    h = E.ip_hex(ip)
    return F.when(F.length(h) == 8, "ipv4").when(F.length(h) == 32, "ipv6")


def parse_feed(lines: DataFrame, fmt: str, feed_id: int = 1) -> DataFrame:
    """feed_id, kind, value, context, source_line, line_no of each indicator, the first of equal ones.

    lines: line_no, value.  Comments, headers and rows that do not parse are skipped."""
    if fmt not in FORMATS:
        raise ValueError(fmt)
    rows = lines.select("line_no", F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    if fmt in ("FEODO_IP", "URLHAUS"):
        width = 6 if fmt == "FEODO_IP" else 9
        rows = rows.withColumn("c", F.from_csv("line", F.lit(", ".join(f"c{i} STRING" for i in range(width))), {"mode": "PERMISSIVE", "escape": '"'}))
    if fmt == "FEODO_IP":
        ip = F.trim("c.c1")
        out = rows.select("line_no", "line", F.array(F.struct(_kind(ip).alias("kind"), ip.alias("value"))).alias("i"), F.concat_ws(" · ", F.when(F.col("c.c5") != "", F.col("c.c5")), F.when(F.col("c.c2") != "", F.concat(F.lit("port "), F.col("c.c2")))).alias("context"))
    elif fmt == "URLHAUS":
        url = F.trim("c.c2")
        host = F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        kind = F.coalesce(_kind(host), F.when(host.rlike(DOMAIN), "domain"))
        out = rows.where(url.rlike("^[a-z]+://")).select("line_no", "line", F.array(F.struct(F.lit("url").alias("kind"), url.alias("value")), F.struct(kind.alias("kind"), host.alias("value"))).alias("i"), F.concat_ws(" · ", "c.c5", "c.c6").alias("context"))
    else:
        word = F.lower(F.regexp_extract("line", r"^([^\s,;]+)", 1))
        kind = _kind(word) if fmt == "PLAIN_IP" else F.when(word.rlike(DOMAIN), "domain")
        out = rows.select("line_no", "line", F.array(F.struct(kind.alias("kind"), word.alias("value"))).alias("i"), F.lit("").alias("context"))
    out = out.select("line_no", F.substring("line", 1, 2000).alias("source_line"), F.substring("context", 1, 300).alias("context"), F.inline("i")).where("kind IS NOT NULL")
    first = out.groupBy("kind", "value").agg(F.min_by(F.struct("line_no", "context", "source_line"), "line_no").alias("f"))
    return first.select(F.lit(feed_id).cast("long").alias("feed_id"), "kind", "value", "f.context", "f.source_line", "f.line_no")


def published_on(lines: DataFrame) -> DataFrame:
    """One row: the time that a comment names as the feed's, else NULL."""
    stamp = F.regexp_extract("value", STAMP, 1)
    return lines.select(stamp.alias("s")).where("s <> ''").select(F.expr("try_cast(s AS timestamp_ntz)").alias("t")).agg(F.min("t").alias("published_on"))


def describe_feed(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row for each file: path, sha256 of its bytes, published_on, lines, and indicators of each kind."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_sha256"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"), "value")
    stamp = F.regexp_extract("value", STAMP, 1)
    counted = lines.withColumn("s", stamp).groupBy("path").agg(F.count("*").alias("lines"), F.min(F.when(F.col("s") != "", F.expr("try_cast(s AS timestamp_ntz)"))).alias("published_on"))
    found = parse_feed(lines.select("line_no", "value"), fmt).join(lines.select("line_no", "path"), "line_no")
    kinds = found.groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("ipv4", "ipv6", "domain", "url")])
    return files.join(counted, "path", "left").join(kinds, "path", "left").fillna(0, ["lines", "ipv4", "ipv6", "domain", "url"])


def read_feed(spark: SparkSession, path: str, fmt: str, feed_id: int = 1) -> DataFrame:
    """The indicators of a feed file; a feed without any is refused."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    found = parse_feed(lines, fmt, feed_id)
    if found.isEmpty():
        raise ValueError(f"{path}: no indicator in it")
    return found
