"""Odd inputs of the nearest neighbours and of the extraction from pages."""

import random
import time

import pytest

from wiretide.llm import html_extraction as H
from wiretide.llm import neighbours

TEXT = "The committee met on Tuesday and decided that the plan should be changed in several ways, because the earlier version had not taken into account what the people of the town had said about it. " * 2


def nearest(rows, every, k):
    """All pairs, in the arithmetic of doubles."""
    out = []
    for q, v in rows:
        if q % every == 0:
            scores = []
            for i, w in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(v, w, strict=True):
                        s += a * b
                    scores.append((-s if s == s else float("inf"), i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("powers", [[0], [200, 0, 0], [-200, -190], [150, 155, -150], [0, -300]])
def test_neighbours_of_components_of_any_size(spark, powers):
    draw = random.Random(4)
    rows = [(i, [draw.uniform(-1, 1) * 10.0 ** draw.choice(powers) for _ in range(4)]) for i in range(40)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4, k=3, factor=1.0, shard_rows=15)
    want = nearest(rows, 4, 3)
    if powers == [0]:
        assert sorted(map(tuple, got.collect())) == want
    else:
        found = {(q, r): s for q, r, _, s in map(tuple, got.collect())}
        assert len(found) == len(want)
        exact = sum(found[q, r] == s for q, r, _, s in want)
        assert exact >= 0.9 * len(want)


def page(inside):
    return f"<html><body><article><h1>A title of it</h1><p>{TEXT.replace('Tuesday', 'Monday')}</p>{inside}<p>{TEXT.replace('Tuesday', 'Friday')}</p></article></body></html>"


@pytest.mark.parametrize("inside", [f"<p class='related-work'>{TEXT}</p>", f"<div class='menu-description'>{TEXT}</div>", f"<section class='comments-on-the-law'><p>{TEXT}</p></section>", f"<h2>Responses</h2><p>{TEXT}</p>"])
def test_a_name_that_says_more_keeps_long_text(inside):
    assert all(day in H.extract(page(inside)) for day in ("Monday", "Tuesday", "Friday"))


@pytest.mark.parametrize("inside", [f"<div class='advert'><p>{TEXT}</p></div>", f"<div class='user-comments'><p>{TEXT}</p></div>", f"<ul class='nav-menu-list'><li>{TEXT}</li></ul>", "<h2>Comments</h2><p>Great, I say on Tuesday.</p>"])
def test_a_name_that_says_nothing_else_decides(inside):
    text = H.extract(page(inside))
    assert "Tuesday" not in text
    assert "Monday" in text


def test_length_without_spaces():
    text = "这是一个很长的段落，讲述了城市的历史和人们的生活。" * 10
    assert H.extract(f"<div><p>{text}</p></div>") == text


def cheapest(net, edges):
    """The smallest value of a cut, by trying all of them."""
    best = None
    for bits in range(1 << len(net)):
        side = [bits >> i & 1 for i in range(len(net))]
        value = sum(v if v > 0 and not s else -v if v < 0 and s else 0 for v, s in zip(net, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = value if best is None else min(best, value)
    return best


def test_blocking_flows_find_minimum_cuts():
    draw = random.Random(9)
    for _ in range(200):
        n = draw.randrange(1, 9)
        net = [draw.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(n)]
        edges = [(a, b, draw.choice([0.25, 0.5, 1, 2])) for a in range(n) for b in range(a) if draw.random() < 0.5]
        side = H.max_flow(net, edges)
        value = sum(v if v > 0 and not s else -v if v < 0 and s else 0 for v, s in zip(net, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert abs(value - cheapest(net, edges)) < 1e-9


def test_a_page_of_doubtful_blocks_takes_seconds():
    blocks = "".join(f"<p>{'seven or eight words of no weight ' * (1 + i % 2)}{'.' * (i % 3 == 0)}</p>" for i in range(20_000))
    began = time.time()
    H.extract(f"<div>{blocks}</div>")
    draw = random.Random(1)
    H.max_flow([draw.uniform(-1, 1) for _ in range(20_000)], [(i, i + 1, draw.uniform(0.2, 2)) for i in range(19_999)] + [(i, i + 3, 0.3) for i in range(19_997)])
    assert time.time() - began < 60
