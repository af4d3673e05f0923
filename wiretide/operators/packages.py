"""Static examination of packages: capabilities, behaviours, baselines, tiers, attribution, reachability, endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

MIN_BENIGN = 30
# Behaviours with the capabilities they need (all of the first list, one of each group), and their tier.
BEHAVIOURS = {
    "beh.dropper_with_bundled_payload": (["install_packages", "bundled_package"], [], 3),
    "beh.runtime_code_from_network": (["dynamic_code_loading", "network_use"], [], 3),
    "beh.accessibility_types_into_other_apps": (["accessibility_text_entry", "overlay_window"], [], 3),
    "beh.screen_capture_to_network": (["screen_capture", "network_use"], [], 3),
    "beh.adb_payload_dropper": (["install_packages", "shell_exec", "boot_start"], [], 3),
    "beh.install_under_network_blackout": (["install_packages", "vpn_catch_all_route"], [], 3),
    "beh.install_from_quick_tunnel": (["install_packages", "quick_tunnel_url"], [], 3),
    "beh.sms_to_telegram_bot": (["telegram_bot_api"], [["sms_receiver", "sms_read"]], 3),
    "beh.hides_launcher_icon": (["hides_launcher_icon"], [], 2),
    "beh.accessibility_control_with_overlay": (["accessibility_service", "accessibility_actions", "overlay_window"], [], 3),
    "beh.nfc_card_relay": (["contactless_card_read", "network_use", "minimal_permission_set"], [], 3),
    "beh.packed_code_payload": (["encrypted_code_payload"], [], 2),
}


def behaviours(signals: DataFrame) -> DataFrame:
    """sample_id, behaviour_id, tier of every behaviour whose capabilities a sample has.  signals: sample_id, signal_id, fired."""
    caps = signals.where("fired").groupBy("sample_id").agg(F.collect_set("signal_id").alias("caps"))
    held = lambda c: F.array_contains("caps", c)
    tests = []
    for name, (every, groups, tier) in BEHAVIOURS.items():
        needs = [held(c) for c in every] + [reduce(lambda a, b: a | b, [held(c) for c in g]) for g in groups]
        tests.append(F.when(reduce(lambda a, b: a & b, needs), F.struct(F.lit(name).alias("behaviour_id"), F.lit(tier).alias("tier"))))
    return caps.select("sample_id", F.inline(F.array_compact(F.array(*tests))))


def signal_table(signals: DataFrame) -> DataFrame:
    """How often each signal fired on each label, of how many samples, with the exact 95% upper bound of its rate."""
    n = signals.select("sample_id", "label").distinct().groupBy("label").agg(F.count("*").alias("samples"))
    g = signals.groupBy("signal_id", "label").agg(F.count_if("fired").alias("fired"), F.slice(F.array_sort(F.collect_set(F.when(F.col("fired") & (F.col("label") == "benign"), F.col("sample_id")))), 1, 10).alias("benign_examples"))
    return g.join(n, "label").withColumn("upper95", E.rnd(E.binomial_upper(F.col("fired"), F.col("samples")), 4))


def baseline_status(table: DataFrame) -> DataFrame:
    """signal_id and status: validated (never on enough ordinary samples), experimental, or unmeasured."""
    g = table.groupBy("signal_id").agg(F.max(F.when(F.col("label") == "benign", F.col("fired"))).alias("benign_fired"), F.max(F.when(F.col("label") == "benign", F.col("samples"))).alias("benign_n"), F.max(F.when(F.col("label") == "malicious", F.col("fired"))).alias("malicious_fired"))
    status = F.when(F.coalesce("benign_n", F.lit(0)) == 0, "unmeasured").when((F.col("benign_fired") == 0) & (F.col("benign_n") >= MIN_BENIGN), "validated").otherwise("experimental")
    return g.withColumn("status", status)


def tiers(samples: DataFrame, found: DataFrame, statuses: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Each sample's tier: 1 if examined, more from validated behaviours, or from what establishes its identity."""
    f = found.join(statuses.select(F.col("signal_id").alias("behaviour_id"), "status"), "behaviour_id", "left").withColumn("ok", F.coalesce(F.col("status") == "validated", F.lit(False)))
    g = f.groupBy("sample_id").agg(F.max(F.when(F.col("ok"), F.col("tier"))).alias("by_behaviour"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("behaviour_id")))).alias("basis"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("behaviour_id")))).alias("not_established"))
    s = samples.join(g, "sample_id", "left")
    s = s.join(identity.groupBy("sample_id").agg(F.max("tier").alias("by_identity")), "sample_id", "left") if identity is not None else s.withColumn("by_identity", F.lit(None).cast("int"))
    empty = F.array().cast("array<string>")
    return s.select("sample_id", "label", F.greatest(F.lit(1), F.coalesce("by_behaviour", F.lit(0)), F.coalesce("by_identity", F.lit(0))).alias("tier"), F.coalesce("basis", empty).alias("basis"), F.coalesce("not_established", empty).alias("not_established"))


def tier_histogram(t: DataFrame) -> DataFrame:
    return t.groupBy("label", "tier").agg(F.count("*").alias("samples"))


def intel_matches(facts: DataFrame, intel: DataFrame) -> DataFrame:
    """facts and intel: kind, value.  A matching hash or certificate establishes identity; other matches support it."""
    j = facts.join(intel.withColumnRenamed("product", "named"), ["kind", "value"])
    return j.withColumn("strength", F.when(F.col("kind").isin("sha256", "certificate"), "identity").otherwise("supporting"))


def attribute(names: DataFrame, prefixes: DataFrame, app_namespace: str = "app_namespace") -> DataFrame:
    """Longest library prefix of a class, else the application's own namespace, else unattributed.

    names: sample_id, class_name, app_namespace; prefixes: prefix (dotted), library.  Prefixes are matched by exploding a
    name's own prefixes, so the join is an equality."""
    parts = F.split("class_name", r"\.")
    n = names.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))))
    hit = n.join(prefixes, "prefix").groupBy("sample_id", "class_name").agg(F.max_by("library", F.length("prefix")).alias("library"))
    own = (F.col("class_name") == F.col(app_namespace)) | F.col("class_name").startswith(F.concat(app_namespace, F.lit(".")))
    return names.join(hit, ["sample_id", "class_name"], "left").withColumn("owner", F.when(F.col("library").isNotNull(), "library").when(F.coalesce(own, F.lit(False)), "app").otherwise("unattributed"))


def api_capabilities(calls: DataFrame, apis: DataFrame) -> DataFrame:
    """sample_id, capability, app_calls, library_calls; present where application or unattributed code calls.

    calls: sample_id, owner (app, library, unattributed), api_class, api_method; apis: capability, api_class, api_method."""
    j = calls.dropDuplicates().join(apis, ["api_class", "api_method"])
    g = j.groupBy("sample_id", "capability").agg(F.count_if(F.col("owner") != "library").alias("app_calls"), F.count_if(F.col("owner") == "library").alias("library_calls"))
    return g.withColumn("present", F.col("app_calls") > 0)


def string_capabilities(strings: DataFrame, patterns: dict[str, str]) -> DataFrame:
    s = strings.select("sample_id", *[F.col("value").rlike(p).alias(k) for k, p in patterns.items()])
    return s.groupBy("sample_id").agg(*[F.max(k).alias(k) for k in patterns])


def descendants(extends: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """All classes under the roots.  extends: child, parent; the frontier shrinks to nothing or depth ends it."""
    spark = extends.sparkSession
    sql = "WITH RECURSIVE d(name, depth) AS (SELECT name, 0 FROM {roots} UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN {extends} e ON e.parent = d.name WHERE d.depth < {depth}) SELECT name, min(depth) AS depth FROM d GROUP BY name"
    return spark.sql(sql.replace("{depth}", str(int(depth))), roots=roots, extends=extends)


def reaching(calls: DataFrame, targets: DataFrame, depth: int = 8) -> DataFrame:
    """Callers of the targets within depth steps, with the fewest steps: a breadth-first search over reversed calls that
    keeps each method once, however many paths lead to it.  calls: caller, callee; targets: name."""
    seen = targets.select("name", F.lit(0).alias("steps")).distinct()
    front = seen
    for step in range(1, depth + 1):
        front = calls.join(front.select(F.col("name").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("steps", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def entry_budget(entries: DataFrame, count: int = 64, each: int = 16 << 20, total: int = 64 << 20) -> DataFrame:
    """Which entries of an archive are read: in order, of a bounded size, within a bounded number and total."""
    ok = F.col("size") <= each
    w = Window.partitionBy("sample_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0)
    e = entries.withColumns({"nth": F.sum(ok.cast("int")).over(w), "upto": F.sum(F.when(ok, F.col("size")).otherwise(0)).over(w)})
    return e.withColumn("read", ok & (F.col("nth") <= count) & (F.col("upto") <= total)).drop("nth", "upto")


def overlapping_entries(entries: DataFrame) -> DataFrame:
    """Archive entries whose bytes begin before an earlier one's end.  entries: sample_id, entry_no, start, end."""
    w = Window.partitionBy("sample_id").orderBy("start", "entry_no").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("overlaps", F.coalesce(F.col("start") < F.max("end").over(w), F.lit(False)))


URL = r"""\b(?:[Hh][Tt][Tt][Pp][Ss]?|[Ww][Ss][Ss]?|[Ff][Tt][Pp])://[^\s"'<>`\\]{3,2048}"""
# Hosts of XML name spaces, which are never contacted.
NAMESPACE_HOSTS = ("schemas.android.com", "www.w3.org", "w3.org", "ns.adobe.com", "xmlpull.org", "schemas.xmlsoap.org", "schemas.microsoft.com", "purl.org", "xml.org")


def endpoints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Hosts that texts name in URLs, with a sample URL, whether it is a template, the registered domain and scope."""
    u = texts.select(F.col(key), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(URL), F.lit(0)))).alias("url"))
    u = u.withColumn("url", F.regexp_replace("url", r"[.,;:)\]}]+$", ""))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    u = u.withColumn("host", host).where((F.col("host") != "") & ~F.col("host").isin(*NAMESPACE_HOSTS))
    ip = F.col("host").rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
    scope = F.when(ip & E.in_nets("host", ("127.0.0.0/8", "0.0.0.0/8", "224.0.0.0/3", "169.254.0.0/16")), F.lit(None)).when(ip & E.in_nets("host", E.DEFAULT_HOME), "private").when(ip, "global").otherwise("name")
    u = u.withColumns({"template": F.col("url").rlike(r"%[sdif0-9]|\{[^}]*\}|<[^>]*>"), "scope": scope}).where("scope IS NOT NULL")
    return u.groupBy(key, "host", "scope").agg(F.count("*").alias("urls"), F.min("url").alias("example"), F.max("template").alias("template"), F.min(F.when(F.col("scope") == "name", E.registered_domain("host")).otherwise(F.col("host"))).alias("registered_domain"))


def opaque_payloads(entries: DataFrame, least: int = 1 << 20, sample: int = 1 << 16, bar: float = 7.99) -> DataFrame:
    """Large entries that look like encrypted data by the entropy of their head.  entries: sample_id, name, size, head."""
    return entries.where(F.col("size") >= least).withColumn("entropy", E.shannon_entropy(F.substring("head", 1, sample))).withColumn("opaque", F.col("entropy") >= bar)


# First bytes of compressed formats, which look random too but say what they are; ISO media say so at byte 4.
FORMATS = (
    "504b0304", "504b0506", "89504e470d0a1a0a", "ffd8ff", "474946383761", "474946383961", "52494646", "4f676753", "664c6143", "494433",
    "1f8b", "fd377a585a00", "377abcaf271c", "425a68", "28b52ffd", "774f4646", "774f4632", "00010000", "4f54544f",
)
MEDIA = "66747970"


def opaque_entries(entries: DataFrame, least: int = 1_000_000, sample: int = 1 << 16, bar: float = 7.99, most: int = 64) -> DataFrame:
    """sample_id, name, size, entropy: entries outside the code that look like encrypted data and announce no format.

    entries: sample_id, entry_no, name, size, head.  Of a package the first ``most`` entries in question are looked at."""
    code = F.startswith("name", F.lit("lib/")) | (F.startswith("name", F.lit("classes")) & F.endswith("name", F.lit(".dex"))) | F.endswith("name", F.lit("/"))
    asked = entries.where(~code & (F.col("size") >= least))
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("entry_no"))
    head = F.lower(F.hex(F.substring("head", 1, 8)))
    known = F.substring(head, 9, 8) == MEDIA
    for f in FORMATS:
        known = known | F.startswith(head, F.lit(f))
    looked = asked.withColumn("nth", nth).where(F.col("nth") <= most).where(~F.coalesce(known, F.lit(True)))
    return looked.select("sample_id", "name", "size", E.shannon_entropy(F.substring("head", 1, sample)).alias("entropy")).where(F.col("entropy") >= bar)
