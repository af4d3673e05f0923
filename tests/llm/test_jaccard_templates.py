"""Documents that share a template: what cannot link leaves early, and every link is still found."""

import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd

from wiretide.llm import jaccard_join as J


def components(docs):
    """Least reachable ids by comparing every two documents."""
    sets = []
    for i, text in docs:
        w = text.split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            c = len(x & y)
            if 100 * c >= 75 * (len(x) + len(y) - c):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i, _ in sets}


def test_templates_of_many_sizes_equal_all_pairs(spark):
    draw = random.Random(8)
    templates = [[f"t{k}_{i}" for i in range(60 + 10 * k)] for k in range(3)]
    footers = [[f"f{k}_{i}" for i in range(20)] for k in range(4)]
    docs = []
    for i in range(240):
        body = [f"w{i}_{j}" for j in range(draw.randrange(2, 45))] if draw.random() < 0.8 else [f"p{draw.randrange(30)}" for _ in range(draw.randrange(5, 25))]
        docs.append((i, " ".join(templates[i % 3] + body + (footers[draw.randrange(4)] if draw.random() < 0.6 else []))))
    want = components(docs)
    sizes = defaultdict(int)
    for r in want.values():
        sizes[r] += 1
    assert 20 < len(sizes) < 200  # neither all alone nor all together
    got = {r.doc_id: r.component_id for r in J.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_lists_of_larger_classes_alone_are_of_no_use():
    small = np.array([96] * 82 + [90] * 3)
    assert len(J.within_reach(96, np.arange(82), small)) == 0  # 82 allow a partner of 95 at most
    assert len(J.within_reach(96, np.arange(83), np.array([96] * 83))) == 83
    assert len(J.within_reach(96, np.arange(85), small)) == 85  # 85 allow 102
    assert len(J.within_reach(10, np.zeros(0, dtype=int), small)) == 0


def test_a_search_that_finds_nothing_is_linear():
    def took(n):
        row = lambda i: np.sort(np.array([*range(82), *(1000 + 14 * i + j for j in range(14))], dtype="<u8")).tobytes()
        part = pd.DataFrame({"n": [96] * n, "x": [row(i) for i in range(n)]})
        began = time.perf_counter()
        found = J._queries(part, part, lambda a, b: int(J.overlap_needed(a, b)))
        assert [(a, b) for a, b, _ in found if a != b] == []
        return time.perf_counter() - began

    took(50)
    assert took(1600) < 12 * max(took(400), 0.05)


def edited(n, draw):
    """What is left of sets of 396: 350 shingles of one base, of which two share 309 or so; a link needs 340."""
    sets = [np.sort(draw.permutation(396)[:350]).astype("<u8") for _ in range(n)]
    return pd.DataFrame({"n": [396] * n, "x": [x.tobytes() for x in sets]}), sets


def test_edits_of_one_text_that_do_not_link_are_counted_not_merged_one_by_one():
    part, sets = edited(500, np.random.default_rng(3))
    began = time.perf_counter()
    found = J._queries(part, part, lambda a, b: int(J.overlap_needed(a, b)))
    took = time.perf_counter() - began
    assert [(a, b, c) for a, b, c in found] == [(i, i, 350) for i in range(500)]
    began = time.perf_counter()
    for x in sets[:40]:  # every two compared, one at a time
        for y in sets:
            np.intersect1d(x, y, assume_unique=True)
    assert took < (time.perf_counter() - began) * 500 / 40


def test_a_template_meets_in_few_cells(spark, monkeypatch):
    """Classes share dozens of lists, but go to the cell of the largest component that holds them, not to a cell for each."""
    monkeypatch.setattr(J, "TURNS", 1)
    monkeypatch.setattr(J, "ENTRIES_PER_CELL", 500)
    seen, search = [], J.opened

    def spy(rest):
        seen.append(rest.selectExpr("kind", "size(meets) AS cells").collect())
        return search(rest)

    monkeypatch.setattr(J, "opened", spy)
    draw = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(base)) for i in range(2)]
    for i in range(2, 60):
        w = list(base)
        for k in draw.sample(range(20), 4 + i % 5):
            w[k * 10 + i % 10] = f"n{i}_{k}"
        docs.append((i, " ".join(w)))
    want = components(docs)
    got = {r.doc_id: r.component_id for r in J.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want
    rows = seen[0]
    assert len(rows) > 10 and max(r.cells for r in rows) <= 8
