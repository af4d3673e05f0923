"""Reports over cases, sign-ins, reviews and update bundles.  Every clock is a parameter, in epoch seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

DAY = 86400.0


def triage_backlog(findings: DataFrame, waiting: str = "pending") -> DataFrame:
    """One row: findings awaiting review, by severity, and the worst of them."""
    f = findings.where(F.col("triage_status") == waiting)
    return f.agg(F.count("*").alias("awaiting_review"), *[F.count_if(F.col("severity") == s).alias(s) for s in E.SEVERITY_RANK], F.coalesce(F.max_by("severity", E.severity_rank()), F.lit("")).alias("worst_waiting"))


def certificate_state(certificates: DataFrame) -> DataFrame:
    """Certificates need both signatures; columns part_a_signed_at and part_b_signed_at."""
    a, b = F.col("part_a_signed_at").isNotNull(), F.col("part_b_signed_at").isNotNull()
    return certificates.agg(F.count("*").alias("total"), F.count_if(a & b).alias("complete"), F.count_if(a & ~b).alias("awaiting_part_b"), F.count_if(b & ~a).alias("awaiting_part_a"), F.count_if(~a & ~b).alias("unsigned"))


def age_states(rows: DataFrame, since: str, as_of: float, warn_days: float = 30, late_days: float = 90) -> DataFrame:
    """Each row's age in days and whether it is fresh, ageing or late; unknown without a date."""
    days = (F.lit(float(as_of)) - F.col(since)) / DAY
    return rows.withColumns({"age_days": F.floor(days).cast("int"), "state": F.when(F.col(since).isNull(), "unknown").when(days > late_days, "late").when(days > warn_days, "ageing").otherwise("fresh")})


def label_mismatches(exhibits: DataFrame, cases: DataFrame) -> DataFrame:
    """Exhibits whose written case reference names neither number of their case."""
    norm = lambda c: F.lower(F.trim(c))
    j = exhibits.join(cases, "case_id")
    ref = norm(F.col("case_reference"))
    return j.where((ref != "") & ~F.coalesce(ref == norm(F.col("case_number")), F.lit(False)) & ~F.coalesce(ref == norm(F.col("fir_number")), F.lit(False))).select("exhibit_id", "case_id", "case_reference")


def sign_in_log(audit: DataFrame, users: DataFrame, as_of: float, contains: str = "", action: str | None = None) -> DataFrame:
    """Attempts with whether the account exists, newest first."""
    a = audit.where(F.col("username_attempted").ilike(f"%{contains}%"))
    if action:
        a = a.where(F.col("action") == action)
    known = users.select(F.col("username").alias("username_attempted")).distinct().withColumn("known", F.lit(True))
    return a.join(known, "username_attempted", "left").withColumns({"account_exists": F.coalesce("known", F.lit(False)), "last_day": F.col("timestamp") >= as_of - DAY}).drop("known")


def sign_in_counts(audit: DataFrame, as_of: float) -> DataFrame:
    return audit.where(F.col("timestamp") >= as_of - DAY).groupBy("action").agg(F.count("*").alias("attempts"), F.countDistinct("username_attempted").alias("users"))


def report_by_machine(findings: DataFrame, detail: int = 5) -> DataFrame:
    """Machines by worst finding, with up to ``detail`` findings of each rule and how many more there are."""
    f = findings.withColumns({"machine": F.coalesce("subject_ip", F.lit("(no single machine)")), "rank": E.severity_rank()})
    w = Window.partitionBy("session_id", "machine")
    r = Window.partitionBy("session_id", "machine", "rule_id")
    f = f.withColumns({"machine_rank": F.max("rank").over(w), "nth": F.row_number().over(r.orderBy(F.desc("rank"), F.desc("confidence"), "flow_id")), "of_rule": F.count("*").over(r)})
    return f.where(F.col("nth") <= detail).withColumn("more", F.greatest(F.col("of_rule") - detail, F.lit(0)))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("subject_ip").alias("subjects"))


def observed_share(flows: DataFrame) -> DataFrame:
    g = flows.where("app_protocol <> ''").groupBy("session_id").agg(F.count("*").alias("labelled"), F.count_if(F.col("app_protocol_source") == "observed").alias("observed"))
    return g.withColumn("share", F.col("observed") / F.col("labelled"))


def stale_imports(sessions: DataFrame, as_of: float, limit: float = 600) -> DataFrame:
    return sessions.withColumn("stale", (F.col("state") == "running") & (F.lit(float(as_of)) - F.col("progress_at") > limit))


# Feed formats and replaceable files of update bundles, and their limits.
FEED_FORMATS = ("FEODO_IP", "URLHAUS", "PLAIN_IP", "PLAIN_DOMAIN")
ENGINE_FILES = ("known_signers.json", "tlds.txt")
MAX_ITEMS, MAX_ITEM_BYTES = 32, 64 * 1024 * 1024


def bundle_problems(items: DataFrame, as_of: float) -> DataFrame:
    """bundle_id, item_no, code: what is wrong with each bundle's items.

    items: bundle_id, item_no, type, name, file, format, retrieved_on (text), sha256, payload (binary)."""
    w = Window.partitionBy("bundle_id")
    i = items.withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(Window.partitionBy("bundle_id", "type", "file").orderBy("item_no"))})
    size = F.coalesce(F.length("payload"), F.lit(0))
    present = F.col("payload").isNotNull()
    matches = F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
    sound = present & (size <= MAX_ITEM_BYTES) & matches
    feed, engine = F.col("type") == "ioc_feed", F.col("type") == "engine_data"
    day = F.expr("try_cast(retrieved_on AS DATE)")
    limit = F.date_add(F.lit("1970-01-01").cast("date"), int((as_of + DAY) // DAY))
    codes = F.array_compact(F.array(
        F.when(F.col("n") > MAX_ITEMS, F.lit("too-many-items")),
        F.when(~present, F.lit("missing-payload")).when(size > MAX_ITEM_BYTES, F.lit("item-too-large")).when(~matches, F.lit("payload-mismatch")),
        F.when(sound & engine & ~F.coalesce(F.col("file").isin(*ENGINE_FILES), F.lit(False)), F.lit("not-updatable")).when(sound & engine & (F.col("nth") > 1), F.lit("duplicate-file")),
        F.when(sound & ~feed & ~engine, F.lit("unknown-type")),
        F.when(sound & feed & ~F.coalesce(F.col("format").isin(*FEED_FORMATS), F.lit(False)), F.lit("bad-format")),
        F.when(sound & feed & ((F.coalesce(F.trim("name"), F.lit("")) == "") | (F.length("name") > 160)), F.lit("bad-name")),
        F.when(sound & feed & day.isNull(), F.lit("bad-date")).when(sound & feed & (day > limit), F.lit("future-date")),
    ))
    return i.select("bundle_id", "item_no", F.explode(codes).alias("code"))


def bundle_order(bundles: DataFrame, applied: DataFrame, trusted: DataFrame, as_of: float) -> DataFrame:
    """bundle_id, code: untrusted, bad-sequence, rollback, bad-time, expired.  bundles: bundle_id, publisher, sequence,
    created, expires (epoch seconds)."""
    last = applied.groupBy("publisher").agg(F.max("sequence").alias("last"))
    b = bundles.join(last, "publisher", "left").join(trusted.select("publisher").distinct().withColumn("ok", F.lit(True)), "publisher", "left")
    codes = F.array_compact(F.array(F.when(F.col("ok").isNull(), F.lit("untrusted")), F.when(F.col("sequence").isNull() | (F.col("sequence") < 1), F.lit("bad-sequence")).when(F.col("sequence") <= F.col("last"), F.lit("rollback")), F.when(F.col("expires").isNull() | F.col("created").isNull() | (F.col("expires") <= F.col("created")), F.lit("bad-time")).when(F.col("expires") < as_of, F.lit("expired"))))
    return b.select("bundle_id", F.explode(codes).alias("code"))
