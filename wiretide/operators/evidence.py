"""Cross-checks between examinations: correlation with captures, second opinions, identity, packages of custody logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import custody, rules

MIN_GROUP, LONG_GAP = 4, 30.0


def correlate(endpoints: DataFrame, dns: DataFrame, flows: DataFrame, indicators: DataFrame, limit: int = 60) -> DataFrame:
    """Where a sample's hosts, addresses and URLs were seen: sample_id, kind, indicator, session_id, detail.

    endpoints: sample_id, value, scope ('name', 'global', 'private', 'url').  At most limit rows of a kind for each sample,
    in a fixed order."""
    hosts, ips = endpoints.where("scope = 'name'"), endpoints.where("scope = 'global'")
    asked = dns.select(F.lower("query_name").alias("value"), "session_id", F.concat(F.lit("resolved by "), "src_ip").alias("detail"))
    reached = flows.select(F.col("dst_ip").alias("value"), "session_id", F.format_string("contacted by %s on port %d", "src_ip", "dst_port").alias("detail"))
    listed = indicators.select("value", F.lit(None).cast("long").alias("session_id"), F.concat(F.lit("listed in feed "), F.col("feed_id").cast("string")).alias("detail"))

    def first(seen):
        """What one value can add to a sample: its first rows in the order, each once."""
        w = Window.partitionBy("value").orderBy("session_id", "detail")
        return seen.distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("nth")

    parts = [e.distinct().join(first(seen), "value").withColumn("kind", F.lit(kind)) for e, seen, kind in ((hosts, asked, "dns"), (ips, reached, "flow"), (endpoints, listed, "feed"))]
    cols = ["sample_id", "kind", F.col("value").alias("indicator"), "session_id", "detail"]
    rows = parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(parts[2].select(*cols)).distinct()
    w = Window.partitionBy("sample_id", "kind").orderBy("indicator", "session_id", "detail")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


SECOND = "package_name string, app_name string, md5 string, sha256 string, appsec struct<security_score: int, high: array<string>, warning: array<string>, info: array<string>>, permissions map<string, struct<status: string>>, activities array<string>, services array<string>, receivers array<string>, providers array<string>"


def second_opinions(reports: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Summaries of another scanner's JSON reports (report_id, content); valid says whether one can be used."""
    r = reports.withColumn("j", F.from_json("content", SECOND))
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0))
    hashed = F.coalesce(F.col("j.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    dangerous = F.size(F.filter(F.map_values(F.coalesce("j.permissions", F.create_map().cast("map<string,struct<status:string>>"))), lambda p: p.status == "dangerous"))
    return r.select(
        "report_id", F.col("j.package_name").alias("package"), F.col("j.sha256").alias("sha256"), F.col("j.appsec.security_score").alias("score"),
        n("j.appsec.high").alias("high"), n("j.appsec.warning").alias("warning"), F.size(F.map_keys(F.coalesce("j.permissions", F.create_map().cast("map<string,struct<status:string>>")))).alias("permissions"), dangerous.alias("dangerous"),
        (n("j.activities") + n("j.services") + n("j.receivers") + n("j.providers")).alias("components"), ((F.length("content") <= limit) & hashed).alias("valid"),
    )


def compare(examinations: DataFrame, opinions: DataFrame) -> DataFrame:
    """Four aspects side by side for each file that both looked at; no score of agreement."""
    j = opinions.join(examinations.select("sha256", F.col("tier"), F.col("package").alias("own_package"), "basis"), "sha256", "left")
    ours = lambda c, other: F.when(F.col("tier").isNull(), "not examined here").otherwise(F.coalesce(c, F.lit(other)))
    row = lambda aspect, own, other: F.struct(F.lit(aspect).alias("aspect"), own.alias("ours"), other.alias("theirs"))
    rows = F.array(
        row("conclusion", ours(F.format_string("tier %d of 4", "tier"), ""), F.when(F.col("score").isNull(), "no score").otherwise(F.format_string("security score %d/100", "score"))),
        row("package", ours(F.col("own_package"), "not read"), F.coalesce("package", F.lit("not read"))),
        row("flagged", ours(F.when(F.size("basis") > 0, F.array_join("basis", ", ")), "nothing that raised a tier"), F.format_string("%d high, %d warning", "high", "warning")),
        row("permissions and components", F.lit("-"), F.format_string("%d permissions (%d dangerous), %d components", "permissions", "dangerous", "components")),
    )
    return j.select("report_id", F.inline(rows))


def identity_findings(identities: DataFrame, reference: DataFrame) -> DataFrame:
    """What a package's claimed identity contradicts.

    identities: sample_id, package, label, certificates (array of digests), not_after (date); reference: package, label,
    certificates, authority ('publisher' or another)."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    known = reference.select(F.col("package").alias("known_package"), F.col("label").alias("known_label"), F.col("certificates").alias("known_certificates"), "authority")
    j = identities.join(known, F.col("package") == F.col("known_package"), "left")
    differs = F.col("known_package").isNotNull() & (F.size("certificates") > 0) & ~F.arrays_overlap("certificates", "known_certificates")
    signer = j.where(differs).select("sample_id", F.lit("identity.signer_not_authorised").alias("finding_id"), F.lit("identity").alias("establishes"), F.when(F.col("authority") == "publisher", 3).otherwise(2).alias("tier"))
    unknown = j.where(F.col("known_package").isNull() & (norm(F.col("label")) != "")).select("sample_id", norm(F.col("label")).alias("n"))
    label = unknown.join(reference.select(norm(F.col("label")).alias("n")).distinct(), "n", "left_semi").select("sample_id", F.lit("identity.label_claims_another_package").alias("finding_id"), F.lit("claim").alias("establishes"), F.lit(0).alias("tier"))
    expiry = identities.where(F.col("not_after") < F.lit("2033-10-22").cast("date")).select("sample_id", F.lit("cert.expires_before_play_minimum").alias("finding_id"), F.lit("claim").alias("establishes"), F.lit(0).alias("tier"))
    return signer.unionByName(label).unionByName(expiry)


PACKAGE = "exhibit_id long, event_count int, head_hash string, events array<struct<sequence: int, action: string, actor_badge: string, actor_ip: string, detail: string, timestamp: string, previous_hash: string, entry_hash: string>>"


def package_problems(packages: DataFrame) -> DataFrame:
    """Problems of the custody logs in case packages (package_id, content as JSON), judged in the order presented."""
    p = packages.select("package_id", F.from_json("content", PACKAGE).alias("j")).select(F.col("package_id").alias("exhibit_id"), F.col("j.exhibit_id").alias("real"), "j.event_count", "j.head_hash", F.posexplode_outer("j.events").alias("position", "e"))
    empty = p.where("e IS NULL").select("exhibit_id", F.lit(None).cast("int").alias("sequence"), F.lit("the log is empty").alias("problem"))
    chain = p.where("e IS NOT NULL").select(F.col("exhibit_id").alias("package_id"), F.col("real").alias("exhibit_id"), "position", "e.*")
    # One package is one log, whatever exhibits others hold; hashes cover the exhibit's own number.
    head = p.groupBy(F.col("real").alias("exhibit_id")).agg(F.max("event_count").alias("entry_count"), F.max("head_hash").alias("head_hash")).where("exhibit_id IS NOT NULL")
    return custody.problems(chain.drop("package_id"), head).unionByName(empty)


def beacon_groups(flows: DataFrame, ctx: rules.Context) -> DataFrame:
    """Connections grouped by server name, else by peer: spread of gaps and sizes, and the share of long gaps that fall
    within two seconds of each other (2 in the frame)."""
    named = F.coalesce("tls_sni", F.lit("")) != ""
    f = flows.select("session_id", E.initiator().alias("host"), F.when(named, F.lower("tls_sni")).otherwise(E.peer()).alias("destination"), F.when(named, "sni").otherwise("ip").alias("grouped_by"), E.service_port().alias("port"), "protocol", "first_seen", "bytes_sent", "flow_id")
    key = ["session_id", "host", "destination", "grouped_by", "port", "protocol"]
    w = Window.partitionBy(*key)
    f = f.withColumns({"gap": F.col("first_seen") - F.lag("first_seen").over(w.orderBy("first_seen", "flow_id")), "n": F.count("*").over(w)}).where(F.col("n") >= MIN_GROUP)
    long = F.when(F.col("gap") >= LONG_GAP, F.col("gap"))
    near = Window.partitionBy(*key, F.col("gap") >= LONG_GAP).orderBy("gap").rangeBetween(0, 2)
    f = f.withColumn("near", F.when(F.col("gap") >= LONG_GAP, F.count("*").over(near)))
    gap, size = F.when(F.col("gap") > 0, F.col("gap")), F.when(F.col("bytes_sent") > 0, F.col("bytes_sent"))
    g = f.groupBy(*key).agg(F.count("*").alias("connections"), (F.max("first_seen") - F.min("first_seen")).alias("span"), F.count(gap).alias("intervals"), F.median(gap).alias("median_s"), (F.stddev_pop(gap) / F.avg(gap)).alias("cv"), F.count(long).alias("flare_intervals"), (F.max("near") / F.count(long)).alias("flare_share"), (F.stddev_pop(size) / F.avg(size)).alias("bytes_cov"))
    return g.withColumns({c: F.when(F.col("intervals") >= 2, F.col(c)) for c in ("median_s", "cv")})


def thresholds(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    """The thresholds in force, one row each."""
    rows = [(k, float((overrides or {}).get(k, v)), k in (overrides or {})) for k, v in sorted(rules.THRESHOLDS.items())]
    return spark.createDataFrame(rows, "name string, value double, overridden boolean")


def suffix_rules(lines) -> dict[str, str]:
    """Public-suffix rules from the lines of a list: suffix -> rule, wildcard or exception."""
    out = {}
    for line in lines:
        line = line.split("//")[0].strip().lower()
        if line:
            kind = "exception" if line[0] == "!" else "wildcard" if line.startswith("*.") else "rule"
            name = line.lstrip("!").removeprefix("*.")
            out[name.encode("idna").decode() if not name.isascii() else name] = kind
    return out


def manifest_mismatches(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest: missing, unlisted or changed.  items and manifest: path, sha256."""
    j = items.select("path", F.col("sha256").alias("found")).join(manifest.select("path", F.col("sha256").alias("listed")), "path", "full_outer")
    return j.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") != F.col("listed"), "changed").alias("problem")).where("problem IS NOT NULL")
