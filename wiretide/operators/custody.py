"""Hash-chained custody logs: building, verifying, registers."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("exhibit_id", "sequence", "action", "actor_badge", "actor_ip", "detail", "timestamp")


def _text(e, previous) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", part(e.exhibit_id), part(e.sequence), part(e.action), part(e.actor_badge), part(e.actor_ip), part(e.detail), part(e.timestamp), F.coalesce(previous, F.lit("")))


def append(events: DataFrame) -> DataFrame:
    """events in order of sequence, numbered from 1 and chained: previous_hash and entry_hash.  Serial within an exhibit."""
    numbered = events.withColumn("sequence", F.row_number().over(Window.partitionBy("exhibit_id").orderBy("sequence")))
    rows = numbered.groupBy("exhibit_id").agg(F.array_sort(F.collect_list(F.struct("sequence", *[f for f in FIELDS if f not in ("exhibit_id", "sequence")], "exhibit_id"))).alias("e"))
    # The fold keeps hashes only, so each step copies digests and no texts.
    hashes = F.aggregate("e", F.array().cast("array<string>"), lambda acc, x: F.array_append(acc, F.sha2(_text(x, F.when(F.size(acc) > 0, F.element_at(acc, -1))), 256)))
    return rows.withColumn("h", hashes).select("exhibit_id", F.posexplode("e").alias("i", "x"), "h").select(*[F.col(f"x.{f}").alias(f) for f in FIELDS], F.coalesce(F.get("h", F.col("i") - 1), F.lit("")).alias("previous_hash"), F.get("h", F.col("i")).alias("entry_hash"))


def problems(chain: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """exhibit_id, sequence, problem: everything that does not hold together; nothing means intact.

    chain also carries position (the order in which the log presents its entries) if that is not the sequence.
    head: exhibit_id, entry_count, head_hash as recorded elsewhere."""
    at = "position" if "position" in chain.columns else "sequence"
    w = Window.partitionBy("exhibit_id").orderBy(at)
    c = chain.withColumns({"n": F.row_number().over(w), "before": F.coalesce(F.lag("entry_hash").over(w), F.lit(""))})
    e = {k: F.col(k) for k in FIELDS}
    digest = F.sha2(_text(SimpleNamespace(**e), F.col("previous_hash")), 256)
    piped = [F.when(F.contains(F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("|")), F.lit(f"{k} holds a separator")) for k in ("action", "actor_badge", "actor_ip", "timestamp", "previous_hash")]
    hexed = F.coalesce(F.col("entry_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))
    found = F.array_compact(F.array(
        F.when(~F.col("sequence").eqNullSafe(F.col("n")), F.lit("numbered out of order")),
        F.when(~F.coalesce("previous_hash", F.lit("")).eqNullSafe(F.col("before")), F.lit("not linked to the entry before")),
        *piped,
        F.when(~hexed, F.lit("no digest")).when(digest != F.col("entry_hash"), F.lit("content altered")),
    ))
    out = c.select("exhibit_id", "sequence", F.explode(found).alias("problem"))
    if head is not None:
        last = c.groupBy("exhibit_id").agg(F.count("*").cast("int").alias("n"), F.max_by("entry_hash", "n").alias("last"))
        h = head.join(last, "exhibit_id", "left").select("exhibit_id", F.lit(None).cast("int").alias("sequence"), F.explode(F.array_compact(F.array(F.when(F.col("entry_count") != F.coalesce("n", F.lit(0)), F.lit("recorded count differs")), F.when(F.col("head_hash") != F.coalesce("last", F.lit("")), F.lit("recorded end differs"))))).alias("problem"))
        out = out.unionByName(h)
    return out


# Wording of custody actions; others are shown as they are.
WORDING = {"USER": "Submitted by the investigator", "ASSISTANT": "Answered by the examiner", "SYSTEM": "Recorded by the system"}


def register(chain: DataFrame) -> DataFrame:
    """The log in order with its wording and the days since each exhibit's first entry."""
    first = F.min(F.col("timestamp").cast("double")).over(Window.partitionBy("exhibit_id"))
    words = F.col("action")
    for k, v in WORDING.items():
        words = F.when(F.col("action") == k, F.lit(v)).otherwise(words)
    return chain.select("exhibit_id", "sequence", words.alias("wording"), "actor_badge", F.floor((F.col("timestamp").cast("double") - first) / 86400).cast("int").alias("day"))
