"""Registered queries over files that are composed from the given tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import capabilities, flows, packages, tables
from ..sinks import delivery
from ..sources import archives, captures, storage
from . import compose
from .queries import ORACLES, RANK, SEGMENTS, full_findings, packets, query


CARRIER = "fd00:1:1:1:"


# Packets become captures, one for each session and ten days; these are read in ranges far smaller than a file.
@query("capture_round_trip", """WITH p AS (SELECT *, 's' || CAST(session_id AS VARCHAR) || '-' || CAST(CAST(floor(ts / 864000) AS BIGINT) AS VARCHAR) AS capture FROM v_packet)
SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY packet_no) AS packet_no, ts, src, dst, proto, CASE proto WHEN 'ICMP' THEN 0 ELSE sport END AS sport, CASE proto WHEN 'ICMP' THEN 2048 ELSE dport END AS dport, CASE proto WHEN 'TCP' THEN tcp_flags ELSE 0 END AS tcp_flags,
  CAST(strlen(payload_text) AS INT) AS data_len, CAST(strlen(payload_text) + CASE proto WHEN 'TCP' THEN 40 ELSE 28 END AS INT) AS frame_len, md5(payload_text) AS payload_md5 FROM p""")
def capture_round_trip(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("capture", F.concat(F.lit("s"), F.col("session_id"), F.lit("-"), F.floor(F.col("ts") / 864000)))
    p = p.withColumns({"seq": F.col("packet_no"), "dport": F.when(F.col("proto") == "ICMP", 2048).otherwise(F.col("dport"))})
    # Numbers of users beyond IPv4 make addresses like 10.0.256.1: such packets travel as IPv6, whose last groups are the numbers.
    beyond = F.exists(F.split(F.concat_ws(".", "src", "dst"), r"\."), lambda x: x.cast("int") > 255)
    carried = lambda c: F.when(beyond, F.concat(F.lit(CARRIER), F.array_join(F.transform(F.split(c, r"\."), lambda x: F.hex(x.cast("int"))), ":"))).otherwise(F.col(c))
    p = p.select(*[c for c in p.columns if c not in ("src", "dst")], carried("src").alias("src"), carried("dst").alias("dst"))
    root = storage.fresh_dir(spark, "captures")
    captures.write_captures(p, root)
    plan = captures.plan_ranges(spark, root, 16_384)
    named = plan.select("session_id", F.regexp_extract("path", r"([^/]+)\.pcap$", 1).alias("capture")).distinct()
    found = captures.read_captures(spark, root, plan=plan).join(named, "session_id")
    six = F.col("src").startswith(CARRIER)
    plain = lambda c: F.when(six, E.let(E.ip_hex(c), lambda h: F.array_join(F.transform(F.sequence(F.lit(17), F.lit(29), F.lit(4)), lambda i: F.conv(F.substr(h, i, F.lit(4)), 16, 10)), "."))).otherwise(F.col(c)).alias(c)
    size = (F.col("frame_len") - F.when(six, 20).otherwise(0)).alias("frame_len")  # by which the header is longer
    return found.select("capture", "packet_no", "ts", plain("src"), plain("dst"), "proto", "sport", "dport", "tcp_flags", "data_len", size, F.md5("payload").alias("payload_md5"))


# The records of the sessions' gravest findings, through the sink's spool; what is withheld is said in a record of its own.
def alert_spool(spark, sf_dir):
    ledger = storage.fresh_dir(spark, "alerts")
    delivery.send(delivery.alert_records(full_findings(spark, sf_dir)), transport="spool", ledger=ledger)
    return delivery.spooled(spark, ledger)


SYSLOG = ORACLES["export_syslog"].rpartition("SELECT flow_id AS finding_id, ")
query("alert_spool", f"""WITH c AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY session_id) AS n FROM v_finding WHERE {RANK} >= 3 WINDOW w AS (PARTITION BY session_id ORDER BY {RANK} DESC, confidence DESC, flow_id))
SELECT {SYSLOG[2].replace("FROM v_finding", "FROM c WHERE place <= 100")} UNION ALL SELECT '<133>1 - - wiretide - withheld - ' || CAST(n - 100 AS VARCHAR) || ' further findings of severity high or above are withheld from session ' || CAST(session_id AS VARCHAR) FROM c WHERE place = 1 AND n > 100""")(alert_spool)


# Messages (packets of port 53) are stored before their flows are, linked session by session, and read with their flows.
@query("late_links", f"""WITH {SEGMENTS}, f AS (SELECT *, min(packet_no) OVER z AS flow_id, count(*) OVER z AS n FROM x WINDOW z AS (PARTITION BY session_id, k, proto, seg))
SELECT session_id, packet_no, flow_id, n AS packets FROM f WHERE 53 IN (sport, dport)""")
def late_links(spark, sf_dir):
    p = packets(spark, sf_dir)
    name, at = f"t{uuid.uuid4().hex}", storage.fresh_dir(spark, "tables")
    asked = p.where("53 IN (sport, dport)").select("session_id", "packet_no", "ts", "src", "dst", "proto", "sport", "dport", "tcp_flags").withColumn("flow_id", F.lit(None).cast("long"))
    tables.save(asked, f"{name}_dns", f"{at}/dns", 8)
    tables.save(flows.build_flows(p, {"TCP": 86400.0}, 43200.0), f"{name}_flows", f"{at}/flows", 8)
    sessions = [0, 1, 2]
    for s in sessions:
        tables.link(spark, f"{name}_dns", f"{name}_flows", [s])
    each = [tables.with_flows(spark, f"{name}_dns", f"{name}_flows", s) for s in sessions]
    found = each[0].unionByName(each[1]).unionByName(each[2])
    return found.select("session_id", "packet_no", "flow_id", (F.col("packets_sent") + F.col("packets_received")).cast("long").alias("packets"))


# ---- packages: five pages are one; a page is an entry, whose kind and faults follow from its number ----------------------

IMPORTED = ["execve", "ptrace", "dlopen", "strlen", "chmod"]
FORGED = ["", "axml.attribute_size", "axml.attribute_start", "axml.junk_between_elements", "axml.unknown_chunk", "axml.bad_magic", "axml.string_count_mismatch", "axml.zero_size_namespace_end", "axml.attribute_names"]


def entry_of(page: int, html: str) -> tuple:
    kind, pick = page % 6, page // 6
    if kind in (0, 1):
        data = compose.library([IMPORTED[pick % 5], IMPORTED[pick % 3]], ["JNI_OnLoad"], ["libc.so"], bits=64 if pick % 2 else 32, more=b"..magisk.." * (pick % 4 == 0))
        return (f"lib/arm64-v8a/lib{page}.so" if kind == 0 else f"assets/{page}.png", data, 8)
    if kind == 2:
        return ("lib/x86/libjiagu.so", compose.library(["execve"])[: 80 if pick % 2 else None], 0)
    if kind == 3:
        parts = [("uses-sdk", {"targetSdkVersion": 20 + page % 5}, []), *[("uses-permission", {"name": f"p{i}"}, []) for i in range(page % 14)]]
        boot = [("intent-filter", {}, [("action", {"name": "android.intent.action.BOOT_COMPLETED"}, [])])] if pick % 2 else []
        parts.append(("application", {}, [("receiver", {"name": f"R{page}"}, boot)]))
        return ("AndroidManifest.xml", compose.manifest([("manifest", {"package": f"org.p{page}"}, parts)], FORGED[pick % 9], utf8=pick % 4 == 1), 8)
    forged = [{}, {"method": 99}, {"flags": 0x801}, {"crc": 1}, {"name": f"other{page}"}]
    return (f"../{page}" if kind == 4 else f"res/{page}", html.encode(), 8 if page % 2 else 0, forged[pick % 5] if pick % 3 == 0 else {}, {})


def written_packages(spark, sf_dir):
    root = storage.fresh_dir(spark, "packages")

    def write(part):
        import pandas as pd

        at, base = storage.store(root)
        at.create_dir(base, recursive=True)
        sample = int(part["page_id"].iloc[0]) // 5
        data = compose.archive([entry_of(int(p), h or "") for p, h in zip(part["page_id"], part["html"], strict=True)], b"#!" * (sample % 2))
        with at.open_output_stream(f"{base}/.{sample}", compression=None) as out:
            out.write(data)
        at.move(f"{base}/.{sample}", f"{base}/{sample}.apk")
        return pd.DataFrame({"sample": [sample]})

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    storage.stored(pages.groupBy(F.floor(F.col("page_id") / 5).alias("s")).applyInPandas(lambda part: write(part.sort_values("page_id")), "sample long"), "packages-written")
    return root


def numbered(spark, root, df):
    """sample_id as the number in the file's name."""
    files = spark.read.format("binaryFile").load(root).select(F.xxhash64("path").alias("sample_id"), F.regexp_extract("path", r"(\d+)\.apk$", 1).cast("long").alias("sample"))
    return df.join(files, "sample_id").drop("sample_id").withColumnRenamed("sample", "sample_id")


@query("package_headers", """WITH e AS (SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, page_id % 6 AS kind, CAST(floor(page_id / 6) AS BIGINT) AS pick FROM pages), f AS (SELECT *, CASE WHEN kind IN (4, 5) AND pick % 3 = 0 THEN pick % 5 ELSE 0 END AS forged FROM e),
m AS (SELECT sample_id, pick % 9 AS k FROM e WHERE kind = 3 AND pick % 9 > 0)
SELECT sample_id, unnest(CASE forged WHEN 1 THEN ['zip.unknown_compression_method', 'zip.header_mismatch'] WHEN 2 THEN ['zip.encryption_flag_on_package', 'zip.header_mismatch'] WHEN 3 THEN ['zip.header_mismatch'] WHEN 4 THEN ['zip.entry_sets_differ'] ELSE [] END) AS indicator, CAST(sum(CASE WHEN forged = 4 THEN 2 ELSE 1 END) AS BIGINT) AS entries FROM f GROUP BY sample_id, indicator
UNION ALL SELECT sample_id, ['axml.attribute_size', 'axml.attribute_start', 'axml.junk_between_elements', 'axml.unknown_chunk', 'axml.bad_magic', 'axml.string_count_mismatch', 'axml.zero_size_namespace_end', 'axml.attribute_names'][CAST(k AS INT)], CASE WHEN k = 8 THEN NULL ELSE 1 END FROM m
UNION ALL SELECT sample_id, 'archive.path_traversal_names', count(*) FILTER (kind = 4 AND forged <> 4) FROM f GROUP BY sample_id HAVING count(*) FILTER (kind = 4 AND forged <> 4) > 0""")
def package_headers(spark, sf_dir):
    root = written_packages(spark, sf_dir)
    headers = storage.stored(archives.read_headers(spark, root), "package-headers")
    found = capabilities.package_integrity(headers, archives.read_manifests(spark, root)).withColumn("entries", F.when(F.col("indicator") != "axml.attribute_names", F.col("entries"))).select("sample_id", "indicator", "entries")
    return numbered(spark, root, found.unionByName(archives.safety(headers).withColumnRenamed("finding", "indicator")))


@query("package_libraries", """WITH e AS (SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, page_id, page_id % 6 AS kind, CAST(floor(page_id / 6) AS BIGINT) AS pick FROM pages),
i AS (SELECT sample_id, page_id, unnest(list_distinct([['execve', 'ptrace', 'dlopen', 'strlen', 'chmod'][CAST(pick % 5 + 1 AS INT)], ['execve', 'ptrace', 'dlopen', 'strlen', 'chmod'][CAST(pick % 3 + 1 AS INT)]])) AS s FROM e WHERE kind < 2 UNION ALL SELECT sample_id, page_id, 'execve' FROM e WHERE kind = 2 AND pick % 2 = 0),
c AS (SELECT sample_id, CASE s WHEN 'execve' THEN 'process_execution' WHEN 'ptrace' THEN 'anti_debugging' WHEN 'dlopen' THEN 'dynamic_loading' WHEN 'chmod' THEN 'file_permissions' END AS capability, page_id FROM i UNION ALL SELECT sample_id, 'root_manager', page_id FROM e WHERE kind < 2 AND pick % 4 = 0
  UNION ALL SELECT sample_id, 'native_code_outside_lib', page_id FROM e WHERE kind = 1 UNION ALL SELECT sample_id, 'native_code_disguised', page_id FROM e WHERE kind = 1 UNION ALL SELECT sample_id, 'native_header_damaged', page_id FROM e WHERE kind = 2 AND pick % 2 = 1 UNION ALL SELECT sample_id, 'packer_library', page_id FROM e WHERE kind = 2)
SELECT sample_id, capability, count(*) AS evidence FROM c WHERE capability IS NOT NULL GROUP BY sample_id, capability""")
def package_libraries(spark, sf_dir):
    root = written_packages(spark, sf_dir)
    libraries = storage.stored(archives.read_libraries(spark, root), "package-libraries")
    native = capabilities.native_capabilities(*capabilities.library_tables(libraries)).groupBy("sample_id", "capability").agg(F.sum("evidence").alias("evidence"))
    placed = capabilities.library_placement(libraries).withColumn("evidence", F.size("evidence").cast("long"))
    return numbered(spark, root, native.unionByName(placed))


@query("package_manifests", """WITH e AS (SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, page_id, CAST(floor(page_id / 6) AS BIGINT) AS pick FROM pages WHERE page_id % 6 = 3)
SELECT sample_id, 'boot_start' AS capability, 'R' || page_id AS evidence FROM e WHERE pick % 2 = 1 UNION ALL SELECT sample_id, 'targets_pre_marshmallow', CAST(20 + page_id % 5 AS VARCHAR) FROM e WHERE page_id % 5 < 3 UNION ALL SELECT sample_id, 'minimal_permission_set', (page_id % 14) || ' permissions' FROM e WHERE page_id % 14 BETWEEN 1 AND 10""")
def package_manifests(spark, sf_dir):
    root = written_packages(spark, sf_dir)
    manifests = storage.stored(archives.read_manifests(spark, root), "package-manifests")
    declared = capabilities.component_capabilities(capabilities.manifest_components(manifests)).withColumn("evidence", F.array_join("components", "|")).drop("components")
    return numbered(spark, root, declared.unionByName(capabilities.manifest_capabilities(manifests)))


# Of the entries made of pages' bytes (kinds 4 and 5), those whose first 500 bytes are varied; without those whose forged
# method makes them read as they are packed.
@query("package_payloads", """WITH e AS (SELECT CAST(floor(page_id / 5) AS BIGINT) AS sample_id, page_id, hex(encode(html)) AS h FROM pages WHERE page_id % 6 IN (4, 5) AND strlen(html) >= 600 AND NOT floor(page_id / 6) % 15 = 6), c AS (SELECT sample_id, page_id, substr(h, 2 * CAST(i AS INT) + 1, 2) AS b FROM e, range(500) t(i)), k AS (SELECT sample_id, page_id, b, count(*) AS k FROM c GROUP BY ALL),
x AS (SELECT sample_id, page_id, round_even(-sum(k / 500 * log2(k / 500)) * 1e4, 0) / 1e4 AS entropy FROM k GROUP BY sample_id, page_id) SELECT sample_id, count(*) AS entries, max(entropy) AS entropy FROM x WHERE entropy >= 4.5 GROUP BY sample_id""")
def package_payloads(spark, sf_dir):
    root = written_packages(spark, sf_dir)
    heads = archives.read_heads(spark, root, 600, 500).where("NOT name LIKE 'assets/%' AND name <> 'AndroidManifest.xml'")
    heads = heads.where(F.floor(F.regexp_extract("name", r"(\d+)$", 1).cast("long") / 6) % 15 != 6)
    found = packages.opaque_entries(heads, 600, 500, 4.5).groupBy("sample_id").agg(F.count("*").alias("entries"), F.max("entropy").alias("entropy"))
    return numbered(spark, root, found)
