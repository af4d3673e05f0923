"""Archives, native libraries and manifests from bytes: sound, forged and cut short."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wiretide.operators import capabilities, packages
from wiretide.plans import compose
from wiretide.sources import archives, binary_xml, elf

BOOT = ("action", {"name": "android.intent.action.BOOT_COMPLETED"}, [])
TREE = [("manifest", {"package": "org.a", "versionCode": 7}, [("uses-sdk", {"minSdkVersion": 19, "targetSdkVersion": 22}, []), ("uses-permission", {"name": "p"}, []), ("application", {}, [("receiver", {"name": "R", "permission": "g"}, [("intent-filter", {}, [BOOT])]), ("service", {"name": "S"}, [])])])]


@pytest.mark.parametrize("utf8", [False, True])
@pytest.mark.parametrize("forged", ["", "axml.bad_magic", "axml.string_count_mismatch", "axml.attribute_size", "axml.attribute_start", "axml.junk_between_elements", "axml.zero_size_namespace_end", "axml.unknown_chunk"])
def test_manifest_is_read_on_after_damage(forged, utf8):
    m = binary_xml.read(compose.manifest(TREE, forged, utf8))
    assert [i for i, _, _ in m.indicators()] == ([forged] if forged else [])
    assert (m.package, m.version_code, m.min_sdk, m.target_sdk, m.permissions) == ("org.a", 7, 19, 22, {"p"})
    assert m.components == [("receiver", "R", "g", ["android.intent.action.BOOT_COMPLETED"]), ("service", "S", None, [])]


def test_manifest_with_blanked_names_is_read_by_numbers():
    m = binary_xml.read(compose.manifest(TREE, "axml.attribute_names"))
    assert [i for i, _, _ in m.indicators()] == ["axml.attribute_names"]
    assert [c[1] for c in m.components] == ["R", "S"]


def test_manifest_cut_anywhere_does_not_fail():
    data = compose.manifest(TREE)
    for n in range(0, len(data), 7):
        binary_xml.read(data[:n])
        binary_xml.read(data[:n] + b"\xff" * 50 + data[n + 50 :])
    assert binary_xml.read(b"").problem == "no chunks"
    assert binary_xml.read(b"\x03\0\x08\0" + b"\0" * 100_000).package is None


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("order", ["<", ">"])
def test_library(bits, order):
    data = compose.library(["execve", "ptrace"], ["JNI_OnLoad"], ["libc.so", "liblog.so"], bits, order, 0x28, b"/proc/self/maps frida")
    x = elf.read(data)
    assert (x.broken, x.machine, x.bits, x.imports, x.exports, x.needed) == (None, "arm", bits, {"execve", "ptrace"}, {"JNI_OnLoad"}, {"libc.so", "liblog.so"})
    assert elf.telling(data) == ["/proc/self/maps", "frida"]
    for n in range(len(data)):
        cut = elf.read(data[:n])
        assert cut.broken
        assert elf.read(data[:n], partial=True).broken is None
    assert elf.read(data[:4] + b"\x07" + data[5:]).broken


def write(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.apk").write_bytes(data)
    return str(tmp_path)


def by_file(spark, root, df):
    names = spark.read.format("binaryFile").load(root).select(F.xxhash64("path").alias("sample_id"), F.regexp_extract("path", r"([^/]+)\.apk$", 1).alias("file"))
    return df.join(names, "sample_id").drop("sample_id")


def zipped(*names, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, n * 100)
        z.comment = comment
    return out.getvalue()


def test_archives_of_all_kinds(spark, tmp_path):
    good = zipped("a", "b/c", "ünï")
    two = compose.archive([("a", b"x" * 50, 0), ("b", b"y" * 50, 0, {"start": 0}), ("../c", b"z", 0), ("d\\..\\e", b"z", 0), ("C:/f", b"z", 0), ("/g", b"z", 0), ("x.apk", b"", 0, {"size": 1 << 31})])
    root = write(tmp_path, good=good, front=b"#!/bin/sh\n" + good, comment=zipped("a", comment=b"PK\x05\x06 is no end"), cut=good[: len(good) // 2], text=b"no archive", none=b"", end=zipped(), bad=two, hole=compose.archive([("a", b"x", 0, {"start": 5}), ("b", b"x", 0)]))
    headers = by_file(spark, root, archives.read_headers(spark, root)).collect()
    seen = lambda f, side: sorted(r.name for r in headers if r.file == f and r.side == side)
    for f in ("good", "front"):
        assert seen(f, "central") == seen(f, "local") == ["a", "b/c", "ünï"]
    assert seen("comment", "central") == ["a"]
    assert seen("end", "central") == []
    assert (seen("hole", "central"), seen("hole", "local")) == (["a", "b"], ["b"])
    assert {r.file: r.problem for r in headers if r.problem} == dict.fromkeys(("cut", "text"), "not an archive: it has no end record")
    unsafe = by_file(spark, root, archives.safety(archives.read_headers(spark, root))).collect()
    assert {(r.file, r.finding, r.entries) for r in unsafe} == {("bad", "archive.overlapping_entries", 1), ("bad", "archive.path_traversal_names", 4), ("bad", "archive.declared_size_exceeds_limit", 1)}


def test_contents_are_bounded_and_read_as_installers_do():
    data = b"abc" * 100_000
    for method, forged in ((8, {}), (0, {}), (8, {"flags": 1}), (0, {"method": 77})):
        raw = compose.archive([("e", data, method, forged)])
        a = archives.Archive(io.BytesIO(raw), len(raw))
        assert a.content(a.entries[0], 10) == data[:10]
        assert a.content(a.entries[0], 1 << 30) == data
    broken = raw[:1000] + b"\xff" * 10 + raw[1010:]
    a = archives.Archive(io.BytesIO(broken), len(broken))
    assert len(a.content(a.entries[0], 1 << 30)) <= len(data)


def test_libraries_of_a_package(spark, tmp_path, monkeypatch):
    lib = compose.library(["execve"], more=b"goldfish" + bytes(5000))
    damaged = lib[:200]
    root = write(tmp_path, a=compose.archive([("lib/x/liba.so", lib, 8), ("assets/pic.png", lib, 8), ("lib/x/libjiagu.so", damaged, 0), ("text", b"\x7fEL" + b"x" * 100, 0), ("tiny", b"\x7fELF", 0)]), text=b"none")
    libraries = archives.read_libraries(spark, root)
    got = {(r.capability, tuple(r.evidence)) for r in capabilities.library_placement(libraries).collect()}
    assert {(c, len(e)) for c, e in got} == {("native_code_outside_lib", 1), ("native_code_disguised", 1), ("native_header_damaged", 1), ("packer_library", 1)}
    assert ("packer_library", ("lib/x/libjiagu.so: Qihoo 360 Jiagu",)) in got
    native = capabilities.native_capabilities(*capabilities.library_tables(libraries)).collect()
    assert {(r.library, r.capability) for r in native} == {(lib, c) for lib in ("lib/x/liba.so", "assets/pic.png") for c in ("process_execution", "emulator_check")}
    monkeypatch.setattr(archives, "ELF_TOTAL", len(lib) + 100)  # the second is read in part, the third not at all
    rows = archives.read_libraries(spark, root).collect()
    assert [(r.library, r.partial, r.broken, r.truncated) for r in rows] == [("lib/x/liba.so", False, None, True), ("assets/pic.png", True, None, True)]


def test_strings_are_literals(spark):
    s = spark.createDataFrame([(1, "l", "roxkernel.qemu"), (2, "l", "..ro.kernel.qemu..")], "sample_id int, library string, value string")
    none = spark.createDataFrame([], "sample_id int, library string, symbol string")
    assert [(r.sample_id, r.capability) for r in capabilities.native_capabilities(none, s).collect()] == [(2, "emulator_check")]


def test_manifests_of_packages(spark, tmp_path):
    root = write(tmp_path, a=compose.archive([("AndroidManifest.xml", compose.manifest(TREE, "axml.attribute_size"), 8)]), b=zipped("x"), c=b"none")
    m = archives.read_manifests(spark, root)
    assert {r.file: r.problem for r in by_file(spark, root, m).collect()} == {"a": None, "b": "no manifest", "c": "not an archive: it has no end record"}
    assert [(r.capability, r.evidence) for r in capabilities.manifest_capabilities(m).orderBy("capability").collect()] == [("minimal_permission_set", "1 permissions"), ("targets_pre_marshmallow", "22")]
    assert [(r.capability, r.components) for r in capabilities.component_capabilities(capabilities.manifest_components(m)).collect()] == [("boot_start", ["R"])]
    assert [(r.indicator, r.entries) for r in capabilities.package_integrity(archives.read_headers(spark, root), m).collect()] == [("axml.attribute_size", 1)]


def test_opaque_entries_announce_no_format(spark):
    noise = bytes(range(256)) * 8
    names = ["a", "lib/x/b.so", "classes2.dex", "dir/", "z.zip", "v.mp4", "flat", "small"]
    heads = [noise, noise, noise, noise, b"PK\x03\x04" + noise, b"\0\0\0\x18ftyp" + noise, b"x" * 2048, noise]
    rows = [(1, k, n, 10 if n == "small" else 5000, bytearray(h)) for k, (n, h) in enumerate(zip(names, heads, strict=True))]
    rows += [(2, k, f"e{k}", 5000, bytearray(noise)) for k in range(10)] + [(3, 0, "empty", 5000, None)]
    df = spark.createDataFrame(rows, "sample_id int, entry_no int, name string, size long, head binary")
    got = packages.opaque_entries(df, 1000, 1 << 16, 7.9, most=4).collect()
    assert sorted((r.sample_id, r.name) for r in got) == [(1, "a"), (2, "e0"), (2, "e1"), (2, "e2"), (2, "e3")]
