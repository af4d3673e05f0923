import random
import re
from collections import defaultdict

import pytest

from wiretide.llm import components, jaccard_join


def brute(rows):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
            where[x].append(k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                up[root(k)] = root(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(sets):
        r = root(k)
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    return sorted(((i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)), key=str)


def check(df):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_tables(docs):
    check(docs)


def test_awkward_rows(odd, none):
    check(odd.where("doc_id IS NOT NULL"))
    assert jaccard_join.link(odd).count() == odd.count()
    assert jaccard_join.link(none).count() == 0


def test_near_copies_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)  # long lists and stars are split
    monkeypatch.setattr(jaccard_join, "TURNS", 1)  # most is left to the exhaustive step
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    core, passage = [rng.choice(words) for _ in range(80)], [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(core)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage + [rng.choice(words) for _ in range(rng.randrange(8, 40))])) for i in range(60)]
    rows += [(300 + i, rows[i % 60][1].upper()) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_threshold_is_inclusive(spark):
    a = [f"a{i}" for i in range(7)]  # 3 shingles; 3 of 4 is 0.75
    check(spark.createDataFrame([(1, " ".join(a)), (2, " ".join([*a, "b"])), (3, " ".join([*a, "b", "c"]))], "doc_id long, text string"))


@pytest.mark.parametrize("seed", range(20))
def test_divide_skip(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 25))]
    t = rng.randrange(1, 15)
    want = {k: n for k in range(40) if (n := sum(k in x for x in lists)) >= t}
    assert jaccard_join.divide_skip(lists, t) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0}
    assert all(got[a] == got[b] for a, b in edges if a != b) and all(got[v] == v for v in got.values())


def test_one_of_each(docs):
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs).select("doc_id").collect()]
    want = {c for _, n, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert sorted(kept) == sorted(want)


def test_one_of_each_goes_by_id_and_text(spark):
    """Two texts under one id: the near copy goes, the other stays; columns may have any name."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    names = ["t", "n", "h1", "h2", "node", "kept_id", "kept_t", "text_hash", "_hash", "_id", "component_id"]
    rows = [(3, near), (7, near + " x"), (7, other), (9, near), (9, near), (None, near), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, near), (7, other), (None, near), (4, None), (5, "")], key=str)


def test_profiles_find_what_stars_leave(spark, monkeypatch):
    """Chains and borderline copies without a single turn of stars: all is left to the profiles."""
    monkeypatch.setattr(jaccard_join, "TURNS", 1)
    monkeypatch.setattr(jaccard_join, "CENTRES", 1)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard_join, "ENTRIES_PER_CELL", 300)
    monkeypatch.setattr(jaccard_join, "BLOCK", 500)
    rng = random.Random(11)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(core)
        for _ in range(rng.choice([0, 1, 1, 2, 2])):
            w[rng.randrange(60)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(w[: rng.choice([60, 60, 55, 50, 46])] + [f"e{i}_{k}" for k in range(rng.choice([0, 0, 4, 9, 14]))])))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
