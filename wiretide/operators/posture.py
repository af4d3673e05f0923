"""How the record stands: findings with what they belong to, exhibits and their seals, measured rates, running captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E

# Rows of a page, and the most that one may have; shares of free space that are low; how long a check holds.
PAGE, LARGEST_PAGE = 50, 500
LOW_SPACE, FULL = 15.0, 5.0
SEAL_HOLDS = 900.0


def finding_details(findings: DataFrame, flows: DataFrame, sessions: DataFrame, exhibits: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Findings with their flow, session, exhibit and reviewer, each where there is one; every finding once.

    sessions: session_id, name, exhibit_id; exhibits: exhibit_id, exhibit_number; reviewers: badge, reviewer_name."""
    f = flows.select("session_id", "flow_id", "src_ip", "dst_ip", "protocol")
    out = findings.join(f, ["session_id", "flow_id"], "left").join(sessions.select("session_id", F.col("name").alias("session_name"), "exhibit_id"), "session_id", "left")
    out = out.join(exhibits.select("exhibit_id", "exhibit_number"), "exhibit_id", "left")
    return out.join(reviewers.select(F.col("badge").alias("reviewed_by"), "reviewer_name"), "reviewed_by", "left")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    """One page of rows in an order, which should be total."""
    size = max(1, min(size, LARGEST_PAGE))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def exhibits_of_reports(reports: DataFrame, examinations: DataFrame, exhibits: DataFrame) -> DataFrame:
    """reports plus exhibit_id and how it was found: by the latest examination of the same file, else by the seal of an
    exhibit that is the file, else not at all.  All by sha256."""
    seen = examinations.groupBy("sha256").agg(F.max_by("exhibit_id", F.struct("examined_at", "exhibit_id")).alias("examined"))
    sealed = exhibits.groupBy("sha256").agg(F.min("exhibit_id").alias("sealed"))
    how = F.when(F.col("examined").isNotNull(), "examined").when(F.col("sealed").isNotNull(), "sealed").otherwise("none")
    found = reports.join(seen, "sha256", "left").join(sealed, "sha256", "left")
    return found.withColumns({"exhibit_id": F.coalesce("examined", "sealed"), "matched": how}).drop("examined", "sealed")


def seal_states(exhibits: DataFrame, digests: DataFrame, as_of: float, holds: float = SEAL_HOLDS) -> DataFrame:
    """Each exhibit's seal: ok true, false or, where it cannot be read, null; whether it was computed now; its status after.

    exhibits: exhibit_id, sha256, status, last_verified_at; digests: exhibit_id, computed (null if unreadable).  An exhibit
    once altered stays so; a check younger than ``holds`` seconds is used again."""
    e = exhibits.join(digests, "exhibit_id", "left")
    altered = F.col("status") == "tampered"
    recent = F.coalesce(F.lit(float(as_of)) - F.col("last_verified_at") < holds, F.lit(False))
    ok = F.when(altered, F.lit(False)).when(recent, F.lit(True)).otherwise(F.col("computed") == F.col("sha256"))
    fresh = ~altered & ~recent
    status = F.when(~F.coalesce(ok, F.lit(True)), "tampered").otherwise(F.col("status"))
    return e.select("exhibit_id", ok.alias("ok"), fresh.alias("computed_now"), status.alias("status"))


def rule_tally(detections: DataFrame, captures: DataFrame, rules: list[str]) -> DataFrame:
    """For each rule on how many ordinary and attack captures it fired, and its findings on the ordinary ones, with the
    exact upper bound of its rate there and both bounds of its rate on attacks.

    detections: capture_id, rule_id; captures: capture_id, corpus ('benign' or 'malicious'), one row each."""
    n = {r["corpus"]: r["n"] for r in captures.groupBy("corpus").agg(F.count("*").alias("n")).where("corpus IN ('benign', 'malicious')").collect()}
    per = detections.groupBy("capture_id", "rule_id").agg(F.count("*").alias("k")).join(captures.select("capture_id", "corpus"), "capture_id")
    t = per.groupBy("rule_id").agg(F.count_if(F.col("corpus") == "benign").alias("benign_fired"), F.sum(F.when(F.col("corpus") == "benign", F.col("k"))).alias("benign_findings"), F.count_if(F.col("corpus") == "malicious").alias("malicious_fired"))
    every = detections.sparkSession.createDataFrame([(r,) for r in rules], "rule_id string")
    t = every.join(t, "rule_id", "left").fillna(0)
    t = t.withColumns({"benign_captures": F.lit(n.get("benign", 0)).cast("long"), "malicious_captures": F.lit(n.get("malicious", 0)).cast("long")})
    return t.withColumns({"benign_upper95": E.rnd(E.binomial_upper(F.col("benign_fired"), F.col("benign_captures")), 4), **two_sided("malicious_fired", "malicious_captures", "malicious")})


def two_sided(k: str, n: str, name: str, alpha: float = 0.05) -> dict[str, Column]:
    """Exact (Clopper-Pearson) bounds of a rate on both sides, each of half the risk."""
    low = F.when(F.col(k) <= 0, F.lit(0.0)).otherwise(1 - E.binomial_upper(F.col(n) - F.col(k), F.col(n), alpha / 2))
    return {f"{name}_low": E.rnd(low, 4), f"{name}_high": E.rnd(E.binomial_upper(F.col(k), F.col(n), alpha / 2), 4)}


def limits(rates: DataFrame) -> DataFrame:
    """One row: rules that fire on ordinary traffic, that never fired, and that fired on ordinary traffic alone."""
    rule = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("rule_id"))))
    seen, model = F.col("benign_fired") > 0, F.col("rule_id") == "ANOMALY_STATISTICAL"
    none = (F.col("benign_fired") == 0) & (F.col("malicious_fired") == 0)
    return rates.agg(rule(seen & ~model).alias("on_ordinary_traffic"), rule(none).alias("untested"), rule(seen & (F.col("malicious_fired") == 0) & ~model).alias("never_on_an_attack"))


def heartbeat(sessions: DataFrame) -> DataFrame:
    """One row: whether a capture runs now, and the latest one that runs, else the latest of all.

    sessions: session_id, name, state, started_at."""
    latest = F.max_by(F.struct("session_id", "name", "state"), F.struct(F.col("state") == "running", "started_at", "session_id"))
    return sessions.agg(latest.alias("s")).select(F.coalesce(F.col("s.state") == "running", F.lit(False)).alias("running"), "s.session_id", "s.name", "s.state")


def headroom(volumes: DataFrame) -> DataFrame:
    """Free share and level of each volume.  volumes: path, total_bytes, free_bytes."""
    share = F.when(F.col("total_bytes") > 0, F.col("free_bytes") / F.col("total_bytes") * 100).otherwise(0.0)
    level = F.when(share <= FULL, "critical").when(share <= LOW_SPACE, "warning").otherwise("ok")
    return volumes.select("path", (F.col("total_bytes") - F.col("free_bytes")).alias("used_bytes"), E.rnd(share, 1).alias("free_pct"), level.alias("level"))
