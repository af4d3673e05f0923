"""Centroid clustering, spelling variants and WARC archives against brute force, with odd rows."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from wiretide.llm import centroids, spellings, warc

VECTORS = "vec_id long, embedding array<double>, cluster string, distance int, n int"


def lloyd(rows, k, rounds, dims):
    """Clusters by plain loops over Python's integers."""
    kept = [(i, [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, "" if kept[r][0] is None else hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    middle = [kept[r][1] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(middle)]
    found = [(i, *nearest(v)) for i, v in kept]
    whole = lambda x: x if x < 2**63 else None
    each = {j: sum(d for _, d, c in found if c == j) if all(whole(d) is not None for _, d, c in found if c == j) else None for j in range(len(middle))}
    total = sum(d for _, d, _ in found)
    total = whole(total) if all(whole(d) is not None for _, d, _ in found) else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, j, whole(d), each[j] if each[j] is None else whole(each[j]), total, digest[j]) for i, d, j in found), key=str)


def clustered(spark, rows, k, rounds, dims, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS).repartition(parts)
    return sorted((tuple(r) for r in centroids.cluster(df, k, rounds, dims).collect()), key=str)


def test_clusters_equal_plain_loops(spark):
    draw = random.Random(5)
    rows = [(i, [draw.choice([-1.5, 0.0, 0.25, 0.7, 3.0]) + draw.random() * (i % 3) for _ in range(4)]) for i in range(150)]
    rows += [(7, rows[7][1]), (7, [9.0] * 4), (None, [1.0] * 4), (None, [0.5] * 4)]  # repeated rows, ids with two vectors, null ids
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] * 4)]
    want = lloyd(rows, 9, 4, 4)
    assert clustered(spark, rows, 9, 4, 4) == want == clustered(spark, rows, 9, 4, 4, parts=1)


def test_clusters_of_equal_vectors_and_of_few(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)]
    got = clustered(spark, rows, 4, 2, 2)
    assert got == lloyd(rows, 4, 2, 2)
    assert {r[1] for r in got} == {0}  # ties go to the lowest number
    assert len(clustered(spark, rows[:2], 40, 5, 2)) == 2
    assert clustered(spark, [(1, None)], 40, 5, 2) == []


def test_clusters_of_huge_vectors_are_exact(spark):
    draw = random.Random(1)
    rows = [(i, [draw.uniform(-1, 1) * 10.0 ** draw.choice([0, 0, 3, 7, 9, 20, 38, 200]) for _ in range(3)]) for i in range(60)]
    assert clustered(spark, rows, 7, 3, 3) == lloyd(rows, 7, 3, 3)


def respelled(docs, ratio=10):
    """Forms, roots and near words by comparing every two words."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def variants(docs):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spellings.variants(docs).collect())


def test_variants_equal_all_pairs(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abÀÿ") for _ in range(draw.choice([6, 7, 7, 8, 9]))) for _ in range(60)]
    docs = []
    for i in range(200):
        text = []
        for _ in range(60):
            w = words[min(59, int(draw.expovariate(0.12)))]
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "c", "ab", "×"]) + w[at + draw.choice([0, 1]) :]
            text.append(draw.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w.isascii() else w]))
        docs.append((i if i % 50 else None, draw.choice([" ", "-", "1"]).join(text)))
    docs.append((900, "mountain " * 900 + "mauntain " * 60 + "mauntein mauntein mauntein"))  # a chain of forms
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string")
    want = respelled(docs)
    assert len(want) > 100
    assert any(f for _, f, *_ in want)
    assert any(f and r != f for _, f, r, *_ in want)
    assert variants(df) == want


def test_variants_of_odd_documents(spark, odd, none):
    assert variants(none) == []
    assert variants(odd) == respelled([(r.doc_id, r.text) for r in odd.collect()])


def test_variants_of_very_long_words(spark):
    long = "ab" * 30_000
    docs = [(i, w) for i, w in enumerate([long, long + "c", "x" + long, long[:-1] + "z", long[:-2]] * 3)]
    got = {(r.word, r.n_near) for r in spellings.variants(spark.createDataFrame(docs, "doc_id long, text string"), every=10**9).collect()}
    assert got == {(long, 3), (long + "c", 1), ("x" + long, 1), (long[:-1] + "z", 1), (long[:-2], 0)}


def archived(rows, least):
    """What reading back must give, by a dictionary of payloads."""
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id is not None, page_id or 0, url is not None, url or ""))
    out = []
    for text, members in groups.items():
        body, top = text.encode(), max(members)
        first = True
        for m in sorted(members, reverse=True):
            response = len(body) < least or first
            first = False
            out.append((m[1] if m[0] else None, len(body), hashlib.sha1(body).hexdigest(), "response" if response else "revisit", None if response or not top[0] else top[1]))
    return sorted(out, key=str)


PAGES = [(i, f"http://h/{i % 7} ä", f"<p>{'word ' * (i % 5 * 90)}{i % 11}</p>") for i in range(300)]
PAGES += [(1000, None, None), (1001, "", ""), (None, "u", "short"), (None, "u", "x" * 3000), (None, None, "x" * 3000), (-5, "a\r\nb c", "x" * 3000), (1002, "z", "日本語\r\n\r\n" * 500)]
PAGES += [(2000, "same", "y" * 2000)] * 4 + [(2001, "same", "few")] * 3 + [(2002, "a", "q" * 1500), (2002, "b", "q" * 1500)]


def frame(spark, rows=PAGES, parts=4):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, key string, shard int").repartition(parts)


def read_back(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20_000, "file_bytes": 3_000}])
def test_archives_come_back(spark, options):
    got = warc.round_trip(frame(spark), **options)
    assert read_back(got) == archived(PAGES, 1000)
    assert all(r.sound for r in got.collect())


def test_the_same_rows_give_the_same_files(spark, tmp_path):
    options = {"shard_bytes": 30_000, "file_bytes": 4_000}
    sums = []
    for k, parts in enumerate((1, 5)):
        root = str(tmp_path / str(k))
        made = warc.write_archives(frame(spark, parts=parts), root, **options)
        sums.append(sorted((r.shard, r.file, r.n_records, r.n_bytes, r.sha256) for r in made.collect()))
        for _, file, n, size, digest in sums[-1]:
            data = Path(root, file).read_bytes()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (size, digest)
            assert gzip.decompress(data).count(b"WARC-Type: re") == n
    assert sums[0] == sums[1]
    assert len({s[0] for s in sums[0]}) > 3  # several shards, one of them with several files
    assert len(sums[0]) > len({s[0] for s in sums[0]})


def test_only_listed_files_are_read_and_temporary_ones_go(spark, tmp_path):
    root = str(tmp_path / "a")
    warc.write_archives(frame(spark, PAGES[:50]), root)
    Path(root, "part-99999-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_archives(spark, root).count() == 50
    assert not Path(root, "_temporary").exists()
    with pytest.raises(FileExistsError):
        warc.write_archives(frame(spark, PAGES[:50]), root)


def test_renaming_can_be_repeated(tmp_path):
    import pandas as pd

    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "a-1").write_bytes(b"abc")
    rows = pd.DataFrame({"temporary": ["_temporary/a-1"], "file": ["a"], "n_bytes": [3]})
    for _ in range(2):
        list(warc.renamed(str(tmp_path))([rows]))
    assert (tmp_path / "a").read_bytes() == b"abc"
    (tmp_path / "a").unlink()
    with pytest.raises(FileNotFoundError):
        list(warc.renamed(str(tmp_path))([rows]))


def test_no_pages(spark):
    assert warc.round_trip(frame(spark).limit(0)).collect() == []


def test_reading_records_of_other_writers(tmp_path):
    text = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    for data in (text * 2, gzip.compress(text) * 2, gzip.compress(text * 2)):
        (tmp_path / "f").write_bytes(data)
        with (tmp_path / "f").open("rb", buffering=0) as f:
            got = list(warc.records(f))
        assert [warc.page_of("f", *r)[5:8] for r in got] == [("http://a/ b", 4, hashlib.sha1(b"body").hexdigest())] * 2
    (tmp_path / "f").write_bytes(text[:-8])
    with (tmp_path / "f").open("rb", buffering=0) as f, pytest.raises(ValueError, match="ends early"):
        list(warc.records(f))
