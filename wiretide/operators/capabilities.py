"""What a package's extracted tables say it can do, and where its archive is not what it seems."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Runtimes by the archive entries that mark them, and where their own code lies.
RUNTIMES = {
    "flutter": ("Flutter, with Dart compiled to machine code", "lib/<abi>/libapp.so", r"^lib/[^/]+/libflutter\.so$|^lib/[^/]+/libapp\.so$|^assets/flutter_assets/"),
    "react_native_hermes": ("React Native on the Hermes engine", "assets/index.android.bundle", r"^assets/index\.android\.bundle$|^lib/[^/]+/libhermes"),
    "react_native": ("React Native with a script bundle", "assets/index.android.bundle", r"^lib/[^/]+/libreactnativejni\.so$"),
    "dotnet": ("a .NET runtime with managed assemblies", "assemblies/", r"^assemblies/|^lib/[^/]+/libmonodroid\.so$|^lib/[^/]+/libnetcoremain\.so$|^lib/[^/]+/libxamarin-app\.so$"),
    "unity": ("Unity, compiled through IL2CPP", "lib/<abi>/libil2cpp.so", r"^lib/[^/]+/libil2cpp\.so$|^lib/[^/]+/libunity\.so$|^assets/bin/Data/Managed/Metadata/global-metadata\.dat$"),
    "web": ("a web view shell with scripts among its assets", "assets/www/", r"^assets/www/index\.html$|^assets/www/cordova\.js$|^assets/public/index\.html$"),
}
STUB_DEX_BYTES, LOADER_DEX_BYTES = 400_000, 100_000
# Manifest actions and permissions that a capability declares.
COMPONENTS = {
    "sms_receiver": ("action", ("android.provider.Telephony.SMS_RECEIVED", "android.provider.Telephony.SMS_DELIVER")),
    "boot_start": ("action", ("android.intent.action.BOOT_COMPLETED",)),
    "accessibility_service": ("permission", ("android.permission.BIND_ACCESSIBILITY_SERVICE",)),
    "notification_listener": ("permission", ("android.permission.BIND_NOTIFICATION_LISTENER_SERVICE",)),
    "device_admin": ("permission", ("android.permission.BIND_DEVICE_ADMIN",)),
}
# Calls whose constant arguments tell the capability.
OVERLAY_TYPES, SET_TEXT, DISABLED = (2038, 2003, 2006, 2010), 2097152, 2
# Imported symbols and strings of native libraries, by what they are for.
IMPORTS = {
    "process_execution": ("system", "execv", "execve", "execl", "execlp", "execvp", "popen", "fork", "vfork", "posix_spawn"),
    "dynamic_loading": ("dlopen", "dlsym", "android_dlopen_ext"),
    "anti_debugging": ("ptrace",),
    "memory_permissions": ("mprotect",),
    "file_permissions": ("chmod", "fchmod", "chown"),
    "process_inspection": ("kill", "getppid", "prctl"),
}
STRINGS = {
    "proc_self_maps": ("/proc/self/maps",),
    "proc_version": ("/proc/version",),
    "su_binary": ("/system/bin/su", "/system/xbin/su"),
    "root_manager": ("magisk", "Magisk", "supersu", "SuperSU"),
    "instrumentation_tooling": ("frida", "xposed", "Xposed", "substrate"),
    "emulator_check": ("ro.kernel.qemu", "goldfish", "ranchu"),
    "jni_dynamic_binding": ("RegisterNatives",),
}
# Libraries of commercial packers by their file names.
PACKERS = {
    "libjiagu": "Qihoo 360 Jiagu", "libjiagu_art": "Qihoo 360 Jiagu", "libjiagu_a64": "Qihoo 360 Jiagu", "libsecexe": "Bangcle", "libsecmain": "Bangcle", "libsecshell": "Bangcle", "libdexhelper": "DexProtector",
    "libexec": "Ijiami", "libexecmain": "Ijiami", "libapktoolplus_jiagu": "APKProtect", "libapkprotect": "APKProtect", "libshell": "Tencent Legu", "libshella": "Tencent Legu", "libtup": "Tencent Legu", "libtosprotection": "Tencent",
    "libbaiduprotect": "Baidu", "libnesec": "NetEase", "libmobisec": "Alibaba", "libddog": "Naga", "libfakejni": "Naga", "libnqshield": "NetQin",
}
# The last SDK before permissions are asked for at run time, and how few permissions are few.
OLD_SDK, FEW_PERMISSIONS = 22, 10
LONGEST_NAME = 255
EXAMPLES = 5


def integrity(headers: DataFrame) -> DataFrame:
    """sample_id, indicator, entries (how many) and examples (the first names) of each sign of tampering in an archive.

    headers: sample_id, side ('central' or 'local'), name, method, flags, crc, size: one row for each header of an entry."""
    fields = ("method", "flags", "crc", "size")
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    e = headers.groupBy("sample_id", "name").agg(*[side(s, c).alias(f"{s}_{c}") for s in ("central", "local") for c in fields], F.max(F.col("side") == "central").alias("c"), F.max(F.col("side") == "local").alias("l"))
    any_of = lambda f: F.coalesce(f("central"), F.lit(False)) | F.coalesce(f("local"), F.lit(False))
    differ = F.lit(False)
    for c in fields:
        differ = differ | ~F.col(f"central_{c}").eqNullSafe(F.col(f"local_{c}"))
    used = e.where(F.contains("name", F.lit("/"))).select("sample_id", "name").withColumnRenamed("name", "path")
    parents = used.select("sample_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("name")).distinct().withColumn("is_folder", F.lit(True))
    e = e.join(parents, ["sample_id", "name"], "left")
    signs = {
        "zip.unknown_compression_method": any_of(lambda s: ~F.col(f"{s}_method").isin(0, 8)),
        "zip.header_mismatch": F.col("c") & F.col("l") & differ,
        "zip.entry_sets_differ": F.col("c") != F.col("l"),
        "zip.path_collisions": F.coalesce("is_folder", F.lit(False)),
        "zip.empty_filename": F.col("name") == "",
        "zip.encryption_flag_on_package": any_of(lambda s: F.col(f"{s}_flags").bitwiseAND(1) > 0),
        "zip.oversized_filename": F.octet_length("name") > LONGEST_NAME,
    }
    each = e.select("sample_id", "name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in signs.items()]))).alias("indicator"))
    # The least names go by a partial aggregate of at most EXAMPLES, not by a list of all entries.
    nth = F.row_number().over(Window.partitionBy("sample_id", "indicator").orderBy("name"))
    first = each.withColumn("nth", nth).where(F.col("nth") <= EXAMPLES).groupBy("sample_id", "indicator").agg(F.array_sort(F.collect_list("name")).alias("examples"))
    return each.groupBy("sample_id", "indicator").agg(F.count("*").alias("entries")).join(first, ["sample_id", "indicator"])


def runtimes(entries: DataFrame) -> DataFrame:
    """sample_id, runtime: the runtimes that a package carries by its entries' names.  Hermes implies React Native."""
    found = entries.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, (_, _, p) in RUNTIMES.items()]))).alias("runtime")).distinct()
    hermes = found.where("runtime = 'react_native_hermes'").select("sample_id", F.lit("react_native").alias("runtime"))
    return found.join(hermes, ["sample_id", "runtime"], "left_anti")


def gaps(found: DataFrame, packages: DataFrame) -> DataFrame:
    """sample_id, runtime, note: what was not examined.  packages: sample_id, dex_bytes.  Runtime is null in a note on the
    size of the package's own code."""
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in RUNTIMES.items() for x in (k, v[0])]), F.col("runtime"))
    holds = F.element_at(F.create_map(*[F.lit(x) for k, v in RUNTIMES.items() for x in (k, v[1])]), F.col("runtime"))
    notes = found.select("sample_id", "runtime", F.concat(F.lit("Carries "), name, F.lit(": code in "), holds, F.lit(" has not been read, so what it does is not known.")).alias("note"))
    small = packages.where(F.col("dex_bytes") < STUB_DEX_BYTES).join(found.select("sample_id").distinct(), "sample_id", "left_semi")
    small = small.select("sample_id", F.lit(None).cast("string").alias("runtime"), F.concat(F.lit("Its own code is "), F.col("dex_bytes").cast("string"), F.lit(" bytes, a loader's size: most of the package has not been read.")).alias("note"))
    return notes.unionByName(small)


def component_capabilities(components: DataFrame) -> DataFrame:
    """sample_id, capability, components (names): what a manifest's components declare.

    components: sample_id, name, actions (array), permission."""
    hits = {k: F.arrays_overlap("actions", F.array(*map(F.lit, v))) if by == "action" else F.col("permission").isin(*v) for k, (by, v) in COMPONENTS.items()}
    each = components.select("sample_id", "name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in hits.items()]))).alias("capability"))
    return each.groupBy("sample_id", "capability").agg(F.array_sort(F.collect_set("name")).alias("components"))


def either(*parts: DataFrame) -> DataFrame:
    """sample_id, capability, evidence (number): capabilities that a call, a string or a declared component may show, all
    counted together.  Each part: sample_id, capability, evidence."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("sample_id", "capability").agg(F.sum("evidence").alias("evidence"))


def constant_calls(calls: DataFrame, launchers: DataFrame) -> DataFrame:
    """sample_id, capability, sites: calls by application code whose constants tell what they are for.

    calls: sample_id, site, owner, api_class, api_method, constants (array of numbers loaded in the method), arguments
    (array of the call's constant arguments as text), refers (array of names the method refers to); launchers: sample_id,
    names (array)."""
    c = calls.where(F.col("owner") != "library").join(launchers, "sample_id", "left")
    arg = lambda i: F.get("arguments", F.lit(i))
    is_api = lambda *api: F.struct("api_class", "api_method").isin(*[F.struct(F.lit(a), F.lit(m)) for a, m in api])
    tests = {
        "vpn_catch_all_route": is_api(("Landroid/net/VpnService$Builder;", "addRoute")) & arg(0).isin("0.0.0.0", "::") & (arg(1) == "0"),
        "overlay_window": is_api(("Landroid/view/WindowManager$LayoutParams;", "<init>"), ("Landroid/view/WindowManager;", "addView"), ("Landroid/view/ViewManager;", "addView")) & F.arrays_overlap("constants", F.array(*map(F.lit, OVERLAY_TYPES))),
        "accessibility_text_entry": is_api(("Landroid/view/accessibility/AccessibilityNodeInfo;", "performAction"), ("Landroid/app/UiAutomation;", "performGlobalAction")) & F.array_contains("constants", SET_TEXT),
        "hides_launcher_icon": is_api(("Landroid/content/pm/PackageManager;", "setComponentEnabledSetting")) & (arg(1) == str(DISABLED)) & F.arrays_overlap("refers", "names"),
    }
    each = c.select("sample_id", "site", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("capability")).distinct()
    return each.groupBy("sample_id", "capability").agg(F.count("*").alias("sites"))


def entry_capabilities(entries: DataFrame, packages: DataFrame) -> DataFrame:
    """sample_id, capability, evidence: packages carried inside, and an opaque entry beside code of a loader's size.

    entries: sample_id, name, opaque; packages: sample_id, dex_bytes."""
    inside = entries.where(F.lower("name").rlike(r"\.(?:apk|apks|xapk|aab)$")).select("sample_id", F.lit("bundled_package").alias("capability"))
    loader = packages.where(F.col("dex_bytes") < LOADER_DEX_BYTES).select("sample_id")
    sealed = entries.where("opaque").join(loader, "sample_id", "left_semi").select("sample_id", F.lit("encrypted_code_payload").alias("capability"))
    return inside.unionByName(sealed).groupBy("sample_id", "capability").agg(F.count("*").alias("evidence"))


def native_capabilities(symbols: DataFrame, strings: DataFrame) -> DataFrame:
    """sample_id, library, capability, evidence: what native libraries import, and which telling strings they hold.

    symbols: sample_id, library, symbol; strings: sample_id, library, value."""
    group = F.create_map(*[F.lit(x) for k, names in IMPORTS.items() for n in names for x in (n, k)])
    a = symbols.dropDuplicates(["sample_id", "library", "symbol"]).withColumn("capability", F.element_at(group, F.col("symbol"))).where("capability IS NOT NULL").select("sample_id", "library", "capability")
    hits = F.array_compact(F.array(*[F.when(reduce(or_, [F.contains("value", F.lit(n)) for n in names]), F.lit(k)) for k, names in STRINGS.items()]))
    b = strings.select("sample_id", "library", F.explode(hits).alias("capability"))
    return a.unionByName(b).groupBy("sample_id", "library", "capability").agg(F.count("*").alias("evidence"))


def code_packages(classes: DataFrame) -> DataFrame:
    """sample_id, package: every package that a class name is in.  classes: sample_id, class_name (dotted)."""
    n = F.size(F.split("class_name", r"\."))
    each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(F.split("class_name", r"\."), F.lit(1), i), "."))
    return classes.where(n > 1).select("sample_id", F.explode(each).alias("package")).distinct()


def library_placement(libraries: DataFrame) -> DataFrame:
    """sample_id, capability, evidence (array of the first names): where native libraries lie, what they are called and
    whether they can be read.  libraries: as ``sources.archives.read_libraries`` gives them."""
    base = F.regexp_replace(F.lower(F.regexp_extract("library", r"([^/]*)$", 1)), r"\.so$", "")
    vendor = F.element_at(F.create_map(*[F.lit(x) for kv in PACKERS.items() for x in kv]), base)
    signs = {
        "native_code_outside_lib": F.when(~F.startswith("library", F.lit("lib/")), F.col("library")),
        "native_code_disguised": F.when(~F.endswith("library", F.lit(".so")), F.col("library")),
        "native_header_damaged": F.when(F.col("broken").isNotNull(), F.concat_ws(": ", "library", "broken")),
        "packer_library": F.when(vendor.isNotNull(), F.concat_ws(": ", F.col("library"), vendor)),
    }
    each = libraries.select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("capability"), v.alias("what")) for k, v in signs.items()])).alias("s")).select("sample_id", "s.*").where("what IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy("sample_id", "capability").orderBy("what"))
    return each.withColumn("nth", nth).where(F.col("nth") <= EXAMPLES).groupBy("sample_id", "capability").agg(F.array_sort(F.collect_list("what")).alias("evidence"))


def library_tables(libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols and strings that ``native_capabilities`` takes, from the libraries that could be read."""
    whole = libraries.where("broken IS NULL")
    return whole.select("sample_id", "library", F.explode("imports").alias("symbol")), whole.select("sample_id", "library", F.explode("telling").alias("value"))


def manifest_capabilities(manifests: DataFrame) -> DataFrame:
    """sample_id, capability, evidence: what a manifest's scalars say."""
    n = F.size("permissions")
    signs = {
        "targets_pre_marshmallow": F.when(F.col("target_sdk") <= OLD_SDK, F.col("target_sdk").cast("string")),
        "minimal_permission_set": F.when((n > 0) & (n <= FEW_PERMISSIONS), F.concat(n.cast("string"), F.lit(" permissions"))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("capability"), v.alias("evidence")) for k, v in signs.items()]))
    return manifests.select("sample_id", each.alias("s")).select("sample_id", "s.*").where("evidence IS NOT NULL")


def manifest_components(manifests: DataFrame) -> DataFrame:
    """The components that ``component_capabilities`` takes."""
    return manifests.select("sample_id", F.explode("components").alias("c")).select("sample_id", "c.name", "c.actions", "c.permission")


def package_integrity(headers: DataFrame, manifests: DataFrame) -> DataFrame:
    """sample_id, indicator, entries, examples: signs of tampering in the archive's headers and in the manifest."""
    own = headers.where("side IS NOT NULL").select("sample_id", "side", "name", "method", "flags", "crc", "size")
    inside = manifests.select("sample_id", F.explode("indicators").alias("i")).select("sample_id", "i.indicator", F.col("i.entries").cast("long").alias("entries"), F.array("i.example").alias("examples"))
    return integrity(own).unionByName(inside)
