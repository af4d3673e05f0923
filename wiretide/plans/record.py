"""Registered queries of the record's posture and of packages' capabilities, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import capabilities, dataflow, evidence, governance, packages, posture, transport
from .queries import AS_OF, TALLY, query, tally, v_flow
from .views import view


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(column: str):
    """An array as text, which every engine compares alike."""
    return F.array_join(column, "|").alias(column)


# ---- posture -----------------------------------------------------------------------------------------------------------

DETAILS = """SELECT f.session_id, f.flow_id, f.rule_id, w.src_ip, w.dst_ip, w.protocol, n.n_name AS session_name, r.r_name AS exhibit_number, s.s_name AS reviewer_name
FROM v_finding f LEFT JOIN v_flow w ON w.session_id = f.session_id AND w.flow_id = f.flow_id LEFT JOIN nation n ON n.n_nationkey = f.session_id LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON f.triage_status <> 'pending' AND s.s_suppkey = f.flow_id % 9"""


def details(spark, sf_dir):
    f = view(spark, sf_dir, "v_finding").withColumn("reviewed_by", F.when(F.col("triage_status") != "pending", F.col("flow_id") % 9))
    sessions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("session_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("exhibit_id"))
    exhibits = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("exhibit_id"), F.col("r_name").alias("exhibit_number"))
    reviewers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("badge"), F.col("s_name").alias("reviewer_name"))
    return posture.finding_details(f, v_flow(spark, sf_dir), sessions, exhibits, reviewers)


@query("finding_details", DETAILS)
def finding_details(spark, sf_dir):
    return details(spark, sf_dir).select("session_id", "flow_id", "rule_id", "src_ip", "dst_ip", "protocol", "session_name", "exhibit_number", "reviewer_name")


@query("findings_page", "SELECT session_id, flow_id, rule_id, severity FROM v_finding ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, flow_id LIMIT 50 OFFSET 100")
def findings_page(spark, sf_dir):
    order = [F.desc(E.severity_rank()), F.desc("confidence"), F.col("flow_id")]
    return posture.page(view(spark, sf_dir, "v_finding"), order, number=3).select("session_id", "flow_id", "rule_id", "severity")


# A report names a document by the hash of its text; every third was examined, every second is an exhibit.
@query("exhibits_of_reports", """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), x AS (SELECT sha, arg_max(doc_id, (doc_id % 5, doc_id)) AS examined FROM d WHERE doc_id % 3 = 0 GROUP BY sha), s AS (SELECT sha, min(doc_id) AS sealed FROM d WHERE doc_id % 2 = 0 GROUP BY sha)
SELECT d.doc_id AS report_id, coalesce(examined, sealed) AS exhibit_id, CASE WHEN examined IS NOT NULL THEN 'examined' WHEN sealed IS NOT NULL THEN 'sealed' ELSE 'none' END AS matched FROM d LEFT JOIN x USING (sha) LEFT JOIN s USING (sha)""")
def exhibits_of_reports(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    seen = d.where("doc_id % 3 = 0").select("sha256", F.col("doc_id").alias("exhibit_id"), (F.col("doc_id") % 5).alias("examined_at"))
    sealed = d.where("doc_id % 2 = 0").select("sha256", F.col("doc_id").alias("exhibit_id"))
    return posture.exhibits_of_reports(d.select(F.col("doc_id").alias("report_id"), "sha256"), seen, sealed).select("report_id", "exhibit_id", "matched")


# An order is an exhibit: every seventh cannot be read, every eleventh was changed since, every fifth was checked lately.
@query("seal_states", """SELECT o_orderkey AS exhibit_id, CASE WHEN o_orderstatus = 'P' THEN FALSE WHEN o_orderkey % 5 = 0 THEN TRUE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 11 <> 0 END AS ok, o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AS computed_now,
  CASE WHEN o_orderstatus = 'P' OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0) THEN 'tampered' ELSE 'sealed' END AS status FROM orders""")
def seal_states(spark, sf_dir):
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    o = read(spark, sf_dir, "orders")
    exhibits = o.select(k.alias("exhibit_id"), F.sha2(text, 256).alias("sha256"), F.when(F.col("o_orderstatus") == "P", "tampered").otherwise("sealed").alias("status"), F.when(k % 5 == 0, F.lit(AS_OF - 60.0)).alias("last_verified_at"))
    now = o.where(k % 7 != 0).select(k.alias("exhibit_id"), F.sha2(F.when(k % 11 == 0, F.concat(text, F.lit("."))).otherwise(text), 256).alias("computed"))
    return posture.seal_states(exhibits, now, AS_OF)


# A conversation is a capture, its roles are rules; odd ones are attacks.
TALLIED = ["assistant", "nobody", "user"]


@query("rule_tally", """WITH c AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 1 THEN 'malicious' ELSE 'benign' END AS corpus FROM conversations), d AS (SELECT conv_id, role, count(*) AS k FROM conversations WHERE (conv_id + turn) % 3 = 0 GROUP BY ALL),
t AS (SELECT role, count(*) FILTER (corpus = 'benign') AS benign_fired, coalesce(sum(k) FILTER (corpus = 'benign'), 0) AS benign_findings, count(*) FILTER (corpus = 'malicious') AS malicious_fired FROM d JOIN c USING (conv_id) GROUP BY role)
SELECT r.role AS rule_id, coalesce(benign_fired, 0) AS benign_fired, CAST(coalesce(benign_findings, 0) AS BIGINT) AS benign_findings, coalesce(malicious_fired, 0) AS malicious_fired, (SELECT count(*) FROM c WHERE corpus = 'benign') AS benign_captures, (SELECT count(*) FROM c WHERE corpus = 'malicious') AS malicious_captures
FROM (VALUES ('assistant'), ('nobody'), ('user')) r(role) LEFT JOIN t USING (role)""")
def rule_tally(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "capture_id")
    captures = c.select("capture_id", F.when(F.col("capture_id") % 2 == 1, "malicious").otherwise("benign").alias("corpus")).distinct()
    t = posture.rule_tally(c.where("(capture_id + turn) % 3 = 0").select("capture_id", F.col("role").alias("rule_id")), captures, TALLIED)
    return t.select("rule_id", "benign_fired", "benign_findings", "malicious_fired", "benign_captures", "malicious_captures")


@query("rate_limits", f"""WITH t AS ({TALLY.replace("{most}", "1").replace("{part}", "part")}) SELECT string_agg(rule_id, '|' ORDER BY rule_id) FILTER (benign_fired > 0) AS on_ordinary_traffic, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (benign_fired = 0 AND malicious_fired = 0) AS untested, string_agg(rule_id, '|' ORDER BY rule_id) FILTER (benign_fired > 0 AND malicious_fired = 0) AS never_on_an_attack FROM t""")
def rate_limits(spark, sf_dir):
    said = posture.limits(tally(spark, sf_dir, 1))
    return said.select(*[F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c) for c in ("on_ordinary_traffic", "untested", "never_on_an_attack")])  # as SQL joins no rows


@query("heartbeat", "SELECT o_orderstatus = 'P' AS running, o_orderkey AS session_id, o_orderpriority AS name, CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS state FROM orders ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC LIMIT 1")
def heartbeat(spark, sf_dir):
    return posture.heartbeat(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("state"), F.col("o_orderdate").alias("started_at")))


@query("headroom", "SELECT s_name AS path, CAST(100000 - s_suppkey * 97 % 100001 AS BIGINT) AS used_bytes, round_even(CAST(s_suppkey * 97 % 100001 AS DOUBLE) / 100000 * 100 * 10, 0) / 10 AS free_pct, CASE WHEN (s_suppkey * 97 % 100001) <= 5000 THEN 'critical' WHEN (s_suppkey * 97 % 100001) <= 15000 THEN 'warning' ELSE 'ok' END AS level FROM supplier")
def headroom(spark, sf_dir):
    return posture.headroom(read(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.lit(100000).cast("long").alias("total_bytes"), (F.col("s_suppkey") * 97 % 100001).alias("free_bytes")))


@query("review_ages", f"SELECT o_orderkey, CAST(floor(({AS_OF} - {{seconds:o_orderdate}}) / 86400) AS INT) AS age_days, CASE WHEN o_orderdate IS NULL THEN 'unknown' WHEN ({AS_OF} - {{seconds:o_orderdate}}) / 86400 > 1500 THEN 'late' WHEN ({AS_OF} - {{seconds:o_orderdate}}) / 86400 > 900 THEN 'ageing' ELSE 'fresh' END AS state FROM orders")
def review_ages(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("since"))
    return governance.age_states(o, "since", AS_OF, 900, 1500).select("o_orderkey", "age_days", "state")


@query("label_mismatches", "SELECT o_orderkey AS exhibit_id, o_custkey AS case_id, 'Case ' || CAST(o_custkey + o_orderkey % 2 AS VARCHAR) AS case_reference FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1")
def label_mismatches(spark, sf_dir):
    exhibits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exhibit_id"), F.col("o_custkey").alias("case_id"), F.concat(F.lit("Case "), (F.col("o_custkey") + F.col("o_orderkey") % 2).cast("string")).alias("case_reference"))
    cases = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("case "), F.col("c_custkey").cast("string")).alias("case_number"), F.lit(None).cast("string").alias("fir_number"))
    return governance.label_mismatches(exhibits, cases)


# ---- packages ----------------------------------------------------------------------------------------------------------


@query("archive_integrity", """WITH e AS (SELECT sample_id, name, max(method) FILTER (side = 'central') AS cm, max(method) FILTER (side = 'local') AS lm, max(flags) FILTER (side = 'central') AS cf, max(flags) FILTER (side = 'local') AS lf, max(crc) FILTER (side = 'central') AS cc, max(crc) FILTER (side = 'local') AS lc, max(size) FILTER (side = 'central') AS cs, max(size) FILTER (side = 'local') AS ls, bool_or(side = 'central') AS c, bool_or(side = 'local') AS l FROM v_header GROUP BY sample_id, name),
k AS (SELECT *, EXISTS (SELECT 1 FROM e f WHERE f.sample_id = e.sample_id AND starts_with(f.name, e.name || '/')) AS folder FROM e),
s AS (SELECT sample_id, name, unnest([CASE WHEN cm NOT IN (0, 8) OR lm NOT IN (0, 8) THEN 'zip.unknown_compression_method' END, CASE WHEN c AND l AND (cm <> lm OR cf <> lf OR cc <> lc OR cs <> ls) THEN 'zip.header_mismatch' END, CASE WHEN c <> l THEN 'zip.entry_sets_differ' END, CASE WHEN folder THEN 'zip.path_collisions' END, CASE WHEN name = '' THEN 'zip.empty_filename' END, CASE WHEN cf & 1 > 0 OR lf & 1 > 0 THEN 'zip.encryption_flag_on_package' END, CASE WHEN strlen(name) > 255 THEN 'zip.oversized_filename' END]) AS indicator FROM k)
SELECT sample_id, indicator, count(*) AS entries, array_to_string(list_sort(list(name))[1:5], '|') AS examples FROM s WHERE indicator IS NOT NULL GROUP BY sample_id, indicator""")
def archive_integrity(spark, sf_dir):
    return capabilities.integrity(view(spark, sf_dir, "v_header")).select("sample_id", "indicator", "entries", joined("examples"))


RUNTIME_SQL = """r AS (SELECT DISTINCT sample_id, CASE WHEN name LIKE 'lib/%/libflutter.so' THEN 'flutter' WHEN name = 'assets/index.android.bundle' THEN 'react_native_hermes' WHEN name LIKE 'lib/%/libreactnativejni.so' THEN 'react_native' WHEN name LIKE 'assemblies/%' THEN 'dotnet' WHEN name LIKE 'lib/%/libunity.so' THEN 'unity' WHEN name = 'assets/www/index.html' THEN 'web' END AS runtime FROM v_entry),
f AS (SELECT * FROM r a WHERE runtime IS NOT NULL AND NOT (runtime = 'react_native' AND EXISTS (SELECT 1 FROM r b WHERE b.sample_id = a.sample_id AND b.runtime = 'react_native_hermes')))"""


@query("runtime_gaps", f"WITH {RUNTIME_SQL} SELECT sample_id, runtime FROM f UNION ALL SELECT DISTINCT f.sample_id, CAST(NULL AS VARCHAR) FROM f JOIN v_package USING (sample_id) WHERE dex_bytes < 400000")
def runtime_gaps(spark, sf_dir):
    found = capabilities.runtimes(view(spark, sf_dir, "v_entry"))
    return capabilities.gaps(found, view(spark, sf_dir, "v_package")).where("length(note) > 20").select("sample_id", "runtime")


@query("entry_capabilities", "WITH c AS (SELECT sample_id, 'bundled_package' AS capability FROM v_entry WHERE lower(name) LIKE '%.apk' UNION ALL SELECT sample_id, 'encrypted_code_payload' FROM v_entry JOIN v_package USING (sample_id) WHERE opaque AND dex_bytes < 100000) SELECT sample_id, capability, count(*) AS evidence FROM c GROUP BY ALL")
def entry_capabilities(spark, sf_dir):
    return capabilities.entry_capabilities(view(spark, sf_dir, "v_entry"), view(spark, sf_dir, "v_package"))


# A part is a component; its kind names its action or permission.
@query("component_capabilities", """WITH c AS (SELECT p_size AS sample_id, p_name AS name, unnest([CASE WHEN p_partkey % 4 = 0 THEN 'boot_start' END, CASE WHEN p_partkey % 6 = 0 THEN 'sms_receiver' END, CASE p_partkey % 5 WHEN 0 THEN 'accessibility_service' WHEN 1 THEN 'notification_listener' WHEN 2 THEN 'device_admin' END]) AS capability FROM part)
SELECT sample_id, capability, array_to_string(list_sort(list(DISTINCT name)), '|') AS components FROM c WHERE capability IS NOT NULL GROUP BY sample_id, capability""")
def component_capabilities(spark, sf_dir):
    k = F.col("p_partkey")
    actions = F.array_compact(F.array(F.when(k % 4 == 0, "android.intent.action.BOOT_COMPLETED"), F.when(k % 6 == 0, "android.provider.Telephony.SMS_RECEIVED"), F.lit("other")))
    permission = F.when(k % 5 == 0, "android.permission.BIND_ACCESSIBILITY_SERVICE").when(k % 5 == 1, "android.permission.BIND_NOTIFICATION_LISTENER_SERVICE").when(k % 5 == 2, "android.permission.BIND_DEVICE_ADMIN")
    c = read(spark, sf_dir, "part").select(F.col("p_size").alias("sample_id"), F.col("p_name").alias("name"), actions.alias("actions"), permission.alias("permission"))
    return capabilities.component_capabilities(c).select("sample_id", "capability", joined("components"))


# An order line is a call.
@query("constant_calls", """SELECT sample_id, capability, count(DISTINCT site) AS sites FROM (SELECT l_suppkey AS sample_id, l_orderkey AS site, CASE l_linenumber WHEN 1 THEN CASE WHEN l_quantity < 10 THEN 'vpn_catch_all_route' END WHEN 2 THEN CASE WHEN l_quantity < 20 THEN 'overlay_window' END WHEN 3 THEN CASE WHEN l_quantity < 30 THEN 'accessibility_text_entry' END WHEN 4 THEN CASE WHEN l_quantity < 40 AND l_partkey % 3 = 0 THEN 'hides_launcher_icon' END END AS capability FROM lineitem WHERE l_returnflag <> 'R') c WHERE capability IS NOT NULL GROUP BY ALL""")
def constant_calls(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    api = F.when(n == 1, "Landroid/net/VpnService$Builder; addRoute").when(n == 2, "Landroid/view/WindowManager; addView").when(n == 3, "Landroid/view/accessibility/AccessibilityNodeInfo; performAction").otherwise("Landroid/content/pm/PackageManager; setComponentEnabledSetting")
    calls = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("site"), F.when(F.col("l_returnflag") == "R", "library").otherwise("app").alias("owner"), F.split(api, " ")[0].alias("api_class"), F.split(api, " ")[1].alias("api_method"),
        F.array(F.when((n == 2) & (q < 20), 2038).when((n == 3) & (q < 30), 2097152).otherwise(1)).alias("constants"),
        F.array(F.when((n == 1) & (q < 10), "0.0.0.0").otherwise("10.0.0.0"), F.when(n == 1, "0").when((n == 4) & (q < 40), "2").otherwise("1")).alias("arguments"),
        F.array(F.when(F.col("l_partkey") % 3 == 0, "Lapp/Main;").otherwise("Lapp/Other;")).alias("refers"),
    )
    launchers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.array(F.lit("Lapp/Main;")).alias("names"))
    return capabilities.constant_calls(calls, launchers)


@query("native_capabilities", """WITH s AS (SELECT DISTINCT o_custkey AS sample_id, o_orderstatus AS library, ['execve', 'ptrace', 'dlopen', 'strlen', 'chmod'][CAST(o_orderkey % 5 + 1 AS INT)] AS symbol FROM orders), g AS (SELECT sample_id, library, CASE symbol WHEN 'execve' THEN 'process_execution' WHEN 'ptrace' THEN 'anti_debugging' WHEN 'dlopen' THEN 'dynamic_loading' WHEN 'chmod' THEN 'file_permissions' END AS capability FROM s
UNION ALL SELECT o_custkey, o_orderstatus, CASE o_orderkey % 4 WHEN 0 THEN 'su_binary' WHEN 1 THEN 'root_manager' WHEN 2 THEN 'emulator_check' END FROM orders)
SELECT sample_id, library, capability, count(*) AS evidence FROM g WHERE capability IS NOT NULL GROUP BY ALL""")
def native_capabilities(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("library"), pick("execve", "ptrace", "dlopen", "strlen", "chmod").alias("symbol"), pick("x /system/xbin/su", "Magisk here", "goldfish", "nothing").alias("value"))
    return capabilities.native_capabilities(o.select("sample_id", "library", "symbol"), o.select("sample_id", "library", "value"))


@query("code_packages", "SELECT DISTINCT p_size AS sample_id, unnest([split_part(c, '.', 1), split_part(c, '.', 1) || '.' || split_part(c, '.', 2)]) AS package FROM (SELECT p_size, p_type, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '.' || lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) || '.C' || CAST(p_partkey AS VARCHAR) AS c FROM part) t")
def code_packages(spark, sf_dir):
    word = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    c = read(spark, sf_dir, "part").select(F.col("p_size").alias("sample_id"), F.concat(word("p_brand"), F.lit("."), word("p_type"), F.lit(".C"), F.col("p_partkey").cast("string")).alias("class_name"))
    return capabilities.code_packages(c)


@query("call_or_string_capabilities", """WITH c AS (SELECT l_suppkey AS s, 'sms_send' AS capability FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = 2 GROUP BY l_suppkey, l_partkey, l_returnflag UNION ALL SELECT o_custkey, 'sms_send' FROM orders WHERE o_orderpriority LIKE '1%') SELECT s AS sample_id, capability, count(*) AS evidence FROM c GROUP BY ALL""")
def call_or_string_capabilities(spark, sf_dir):
    calls = read(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("site"), F.when(F.col("l_returnflag") == "R", "library").otherwise(F.col("l_returnflag")).alias("owner"), F.lit("Landroid/telephony/SmsManager;").alias("api_class"), F.lit("sendTextMessage").alias("api_method"))
    apis = spark.createDataFrame([("sms_send", "Landroid/telephony/SmsManager;", "sendTextMessage")], "capability string, api_class string, api_method string")
    a = packages.api_capabilities(calls, apis).where("present").select("sample_id", "capability", F.col("app_calls").alias("evidence"))
    strings = read(spark, sf_dir, "orders").where(F.col("o_orderpriority").rlike("^1")).select(F.col("o_custkey").alias("sample_id"), F.lit("sms_send").alias("capability"), F.lit(1).cast("long").alias("evidence"))
    return capabilities.either(a, strings)


@query("string_capabilities", "SELECT doc_id % 50 AS sample_id, bool_or(regexp_matches(coalesce(text, ''), 'token')) AS token, bool_or(regexp_matches(coalesce(text, ''), '@[a-z]+[.]')) AS mail FROM documents GROUP BY ALL")
def string_capabilities(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("sample_id"), F.coalesce("text", F.lit("")).alias("value"))
    return packages.string_capabilities(d, {"token": "token", "mail": "@[a-z]+[.]"})


@query("intel_matches", "SELECT c_custkey AS sample_id, kind, value, CASE WHEN kind = 'sha256' THEN 'identity' ELSE 'supporting' END AS strength FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'sha256' ELSE 'domain' END AS kind, c_mktsegment AS value FROM customer) f WHERE EXISTS (SELECT 1 FROM (VALUES ('sha256', 'BUILDING'), ('domain', 'MACHINERY'), ('sha256', 'MACHINERY')) i(k, v) WHERE k = kind AND v = value)")
def intel_matches(spark, sf_dir):
    facts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.when(F.col("c_custkey") % 2 == 0, "sha256").otherwise("domain").alias("kind"), F.col("c_mktsegment").alias("value"))
    intel = spark.createDataFrame([("sha256", "BUILDING", "x"), ("domain", "MACHINERY", "y"), ("sha256", "MACHINERY", "z")], "kind string, value string, product string")
    return packages.intel_matches(facts, intel).select("sample_id", "kind", "value", "strength")


@query("overlapping_entries", """WITH e AS (SELECT sample_id, entry_no, sum(size) OVER (PARTITION BY sample_id ORDER BY entry_no) - size - CASE WHEN entry_no % 3 = 0 THEN 10 ELSE 0 END AS s, size FROM v_entry), f AS (SELECT *, max(s + size) OVER (PARTITION BY sample_id ORDER BY s, entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT sample_id, entry_no, coalesce(s < before, FALSE) AS overlaps FROM f""")
def overlapping_entries(spark, sf_dir):
    from pyspark.sql import Window

    e = view(spark, sf_dir, "v_entry")
    start = F.sum("size").over(Window.partitionBy("sample_id").orderBy("entry_no")) - F.col("size") - F.when(F.col("entry_no") % 3 == 0, 10).otherwise(0)
    return packages.overlapping_entries(e.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))).select("sample_id", "entry_no", "overlaps")


@query("payloads_like_ciphertext", f"WITH d AS (SELECT doc_id, substr(text, 1, 500) AS h, length(text) AS size FROM documents WHERE length(text) >= 400 AND length(text) = strlen(text)), c AS (SELECT doc_id, unnest(string_split(h, '')) AS ch, length(h) AS n FROM d), k AS (SELECT doc_id, ch, n, count(*) AS k FROM c GROUP BY ALL) SELECT doc_id, round_even(-sum(k / n * log2(k / n)) * 1e4, 0) / 1e4 >= 4.1 AS opaque FROM k GROUP BY doc_id")
def payloads_like_ciphertext(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("length(text) = octet_length(text)").select("doc_id", F.length("text").alias("size"), F.col("text").cast("binary").alias("head"))
    return packages.opaque_payloads(d, 400, 500, 4.1).select("doc_id", "opaque")


@query("scanner_comparison", """SELECT p_partkey AS report_id, unnest(['conclusion', 'package', 'flagged', 'permissions and components']) AS aspect, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'tier ' || CAST(p_size % 4 + 1 AS VARCHAR) || ' of 4' ELSE 'not examined here' END, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'not examined here' END, CASE WHEN p_partkey % 2 = 1 THEN 'not examined here' WHEN p_size % 3 = 0 THEN 'nothing that raised a tier' ELSE 'a, b' END, '-']) AS ours,
  unnest(['security score ' || CAST(p_size AS VARCHAR) || '/100', p_name, CAST(p_size % 5 AS VARCHAR) || ' high, 2 warning', '7 permissions (3 dangerous), 9 components']) AS theirs FROM part""")
def scanner_comparison(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    opinions = p.select(F.col("p_partkey").alias("report_id"), F.col("p_partkey").alias("sha256"), F.col("p_name").alias("package"), F.col("p_size").alias("score"), (F.col("p_size") % 5).alias("high"), F.lit(2).alias("warning"), F.lit(7).alias("permissions"), F.lit(3).alias("dangerous"), F.lit(9).alias("components"))
    own = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sha256"), (F.col("p_size") % 4 + 1).alias("tier"), F.col("p_brand").alias("package"), F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("basis"))
    return evidence.compare(own, opinions)


# A conversation is a mail session: its turns are commands.
@query("mail_envelope", "SELECT conv_id AS flow_id, coalesce(string_agg(DISTINCT 'u' || turn, '|' ORDER BY 'u' || turn) FILTER (turn % 3 = 0), '') AS senders, coalesce(string_agg(DISTINCT 'r' || turn, '|' ORDER BY 'r' || turn) FILTER (turn % 3 = 1), '') AS recipients, bool_or(turn % 3 = 2) AS credentials FROM conversations GROUP BY conv_id")
def mail_envelope(spark, sf_dir):
    t = F.col("turn").cast("string")
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("MAIL FROM:<u"), t, F.lit(">"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("RCPT TO:<r"), t, F.lit(">"))).otherwise("AUTH PLAIN x")
    streams = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("flow_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x.line), "\r\n").alias("text")).withColumn("direction", F.lit("client"))
    return transport.mail_envelope(transport.transcript(streams, "smtp")).select("flow_id", joined("senders"), joined("recipients"), "credentials")


# Order lines are instructions of methods (orders): constants, moves, jumps, calls that are watched and others.
INSTRUCTIONS = """SELECT CAST(1 AS INT) AS sample_id, l_orderkey AS method, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS pc, l_partkey % 7 AS kind, CAST(l_suppkey % 3 AS INT) AS r, l_partkey % 50 AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) l"""


@query("constant_arguments", f"""WITH i AS ({INSTRUCTIONS}), w AS (SELECT method, r, pc, CASE kind WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN 's' || v WHEN 2 THEN CAST(-v AS VARCHAR) END AS value FROM i WHERE kind IN (0, 1, 2, 3, 6)),
a AS (SELECT method, pc, unnest([1, 2]) AS place, unnest([(r + 1) % 3, (r + 2) % 3]) AS register FROM i WHERE kind = 5), h AS (SELECT a.method, a.pc, place, max(w.pc) AS at FROM a LEFT JOIN w ON w.method = a.method AND w.r = register AND w.pc < a.pc GROUP BY a.method, a.pc, place)
SELECT h.method, h.pc, array_to_string(list(coalesce(w.value, '?') ORDER BY place), '|') AS arguments FROM h LEFT JOIN w ON w.method = h.method AND w.pc = h.at GROUP BY h.method, h.pc""")
def constant_arguments(spark, sf_dir):
    k, reg = F.col("kind"), lambda n: F.concat(F.lit("v"), ((F.col("r") + n) % 3).cast("string"))
    i = spark.sql(INSTRUCTIONS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    op = F.when(k == 0, "const/16").when(k == 1, "const-string").when(k == 2, "const/4").when(k == 3, "move-result").when(k == 4, "if-eqz").when(k == 5, "invoke-virtual").otherwise("invoke-static")
    literal = F.when(k == 0, F.concat(F.lit("0x"), F.lower(F.hex("v")))).when(k == 1, F.concat(F.lit('"s'), F.col("v"), F.lit('"'))).when(k == 2, F.concat(F.lit("-"), F.col("v")))
    i = i.select("sample_id", "method", "pc", op.alias("op"), F.when(k == 5, F.array(reg(0), reg(1), reg(2))).otherwise(F.array(reg(0))).alias("registers"), literal.alias("literal"), F.when(k >= 5, "La;").alias("api_class"), F.when(k == 5, "watched").when(k == 6, "other").alias("api_method"), F.lit(False).alias("label"))
    found = dataflow.constant_arguments(i, spark.createDataFrame([("La;", "watched")], "api_class string, api_method string"))
    return found.select("method", "pc", F.array_join("arguments", "|", "?").alias("arguments"))


# Suppliers call each other by their keys; those of one nation in five are components.
@query("ways_from_components", """WITH RECURSIVE c AS (SELECT s_suppkey AS caller, unnest([CAST(floor(s_suppkey / 2) AS BIGINT), CAST(floor(s_suppkey / 3) AS BIGINT)]) AS callee FROM supplier), t AS (SELECT s_suppkey AS target FROM supplier WHERE s_suppkey % 10 = 1),
w(target, name, steps) AS (SELECT target, target, 0 FROM t UNION SELECT w.target, c.caller, w.steps + 1 FROM w JOIN c ON c.callee = w.name WHERE w.steps < 8 AND c.caller <> w.name)
SELECT target, CAST(min(steps) AS INT) AS steps FROM w JOIN supplier s ON s.s_suppkey = w.name WHERE s_nationkey % 5 = 0 GROUP BY target""")
def ways_from_components(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    one = F.lit(1).alias("sample_id")
    calls = s.select(one, F.col("s_suppkey").cast("long").alias("caller"), F.explode(F.array(F.floor(F.col("s_suppkey") / 2), F.floor(F.col("s_suppkey") / 3))).alias("callee"))
    targets = s.where("s_suppkey % 10 = 1").select(one, F.col("s_suppkey").cast("long").alias("target"))
    components = s.where("s_nationkey % 5 = 0").select(one, F.col("s_suppkey").cast("long").alias("method"))
    return dataflow.ways(calls, targets, components).select("target", "steps")
