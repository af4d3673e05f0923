import importlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.llm import html_extraction, neighbours, packing, tokens


def test_packing(docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.public_files()[0])
    for df in (docs, odd):
        rows = packing.pack(df, group_size=64).collect()
        texts = df.collect()
        want = sorted((str(r["doc_id"]), zlib.crc32(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for r in texts)
        one = sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows if r["piece"] == 0 and sum(x["doc_id"] == r["doc_id"] for x in rows) == sum(x["doc_id"] == r["doc_id"] for x in texts))
        assert set(one) <= set(want) and one
        sequences: dict = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        total = sum(r["length"] for r in rows)
        assert total == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in texts)
        assert len(sequences) <= 1.02 * -(-total // packing.CAPACITY) + 1
    assert packing.pack(none).count() == 0


def test_pieces_are_cut_only_when_long(docs):
    for r in packing.tokens.pieces(docs, 1024, 2).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "length"))).alias("p")).collect():
        at = 0
        for k, p in enumerate(r["p"]):
            assert (p["piece"], p["start"]) == (k, at) and (p["length"] == 1024 or k == 0)
            at += p["length"]


def test_ids_by_every_way():
    """Single white space goes by the pattern without lookahead, runs by the whole one, long runs by the library."""
    enc = tokens.encoder(*tokens.public_files())
    assert enc is tokens.encoder(*tokens.public_files())
    assert "(?!" in enc.fast._pat_str and "(?!" not in enc.single._pat_str
    rng = random.Random(7)
    letters = [*" \n\t\rab's\u00e9tZ9\u00bd\u00b2_-\u2026\u2028\u202f\u20ac\u024f", "'re", "  ", "\n\n", " x", "\x0b", "\xa0", "\u65e5", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters[: rng.choice([-4, None])], k=rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a b " * k + "q" * n + " z" for k in (0, 1, 249, 250, 400) for n in (999, 1999, 2999, 3000, 3999)]
    for text in texts:
        assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids
    assert [enc.odd(t) for t in ("a" * 2999 + " b", "b" + " a" * 700 + "a" * 3000, "a " * 3000, "a\xa0b", "a<|endoftext|>")] == [False, True, False, True, True]


@pytest.mark.parametrize("seed", range(6))
def test_genetic_steps_keep_every_item(seed):
    rng = random.Random(seed)
    size = sorted((rng.randrange(1, 1024) for _ in range(300)), reverse=True)
    a = packing.evolve(size, [], 0, seed, 1024, 4, 4)
    b = packing.evolve(size, [a], 1, seed, 1024, 4, 4)
    for bins in (a, b, packing.crossover(a, b, size, 1024, rng), packing.mutate(b, size, 1024, rng)):
        assert sorted(i for x in bins for i in x) == list(range(300)) and all(sum(size[i] for i in x) <= 1024 for x in bins)
    assert len(b) <= len(a)


@pytest.mark.parametrize(("low", "high", "n", "gain"), [(200, 600, 1000, 5), (250, 500, 600, 8), (100, 700, 2000, 2)])
def test_islands_beat_best_fit(low, high, n, gain):
    """Sizes on which plain best fit in decreasing order wastes bins."""
    rng = random.Random(1)
    size = sorted((rng.randrange(low, high) for _ in range(n)), reverse=True)
    plain: list = []
    packing.best_fit(plain, [], list(range(n)), size, 1024)
    best = [packing.evolve(size, [], i, 0, 1024, 8, 60) for i in range(3)]
    best = [packing.evolve(size, [best[i], best[i - 1]], i, 1, 1024, 8, 60) for i in range(3)]
    assert min(map(len, best)) <= len(plain) - gain
    assert all(sorted(i for x in b for i in x) == list(range(n)) for b in best)


def test_html(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_extraction.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><div class=logo>Site</div></header><div class="cookie-notice">We use cookies on this site, read more.</div>
<nav><ul><li><a href=/>Home</a></li></ul></nav><main><article><h1>Title A &amp; B</h1><!-- <p>no</p> --><p>First part with <b>bold</b> and a <a href=x>link</a> in it.<p>Second   part&#8212;with
lines.</p><aside>See also this other thing.</aside><div class="ad-slot">Buy now, a great offer today only.</div><form><label>Mail</label><button>Send</button></form><p>Short.</article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I like this long comment, it is great and long.</p></article></section></main><footer>Foot &copy; 2020</footer></body></html>"""


def test_html_parts():
    assert html_extraction.extract(PAGE) == "Title A & B First part with bold and a link in it. Second part—with lines. Short."
    plain = "<div><p>This is a long paragraph outside of any article, with words in it.</p><ul><li><a href=1>one</a></li><li><a>two</a></li></ul></div>"
    assert html_extraction.extract(plain) == "This is a long paragraph outside of any article, with words in it."
    for x in (None, "", "<", "<p", "<!--", "</p></p>", "<div" * 50, "&#xFFFFFFF;", "<script>"):
        html_extraction.extract(x)


def test_html_skips_no_more_than_an_element():
    first, last = "This is the first long paragraph of the article.", "This is the last long paragraph of the article."
    for x in ('<svg class="i"/>', "<math/>", "<video-player></video-player>", "<select-box>", "<svg>", "<svg><path/></svg>", "<SVG />", "<script>var a</script>"):
        assert html_extraction.extract(f"<article><p>{first}</p>{x}<p>{last}</p></article>") == f"{first} {last}", x
    assert html_extraction.extract(f"<article><p>{first}</p><script>var a = 1;<p>{last}</p></article>") == first


LONG = "This is a long paragraph of the article, with many words in it and an end."


def test_html_names_alone_decide_nothing():
    for kind in ("share-story", "legal", "feedback", "search-result-text", "notice-of-intent"):
        assert html_extraction.extract(f"<article><div class='{kind}'><p>{LONG}</p></div></article>") == LONG, kind
        assert html_extraction.extract(f"<article><p>{LONG}</p><p class='{kind}'>{LONG}</p></article>") == f"{LONG} {LONG}", kind
    for wrap in ("<form id=aspnetForm>{}</form>", "<div class='sidebar'>{}</div>", "<div class='page with-comments'>{}</div>"):
        assert html_extraction.extract(wrap.format(f"<article><p>{LONG}</p></article>")) == LONG
    for kind in ("ad", "ad-slot", "comments", "cookie-notice", "related-posts", "newsletter-signup"):
        assert html_extraction.extract(f"<article><p>{LONG}</p><div class='{kind}'><p>{LONG}</p></div><p>{LONG}</p></article>") == f"{LONG} {LONG}", kind


def test_html_comments_without_names():
    page = f"<div><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p></div><div><h3>3 Comments</h3><div><p>A remark by a reader, which goes on for long enough.</p><p>{LONG}</p></div></div>"
    assert html_extraction.extract(page) == f"Title of it {LONG} {LONG}"


def test_html_cut_overrules_the_classifier():
    """Blocks whose own log-odds point one way go the other with their surroundings."""
    page = html_extraction.Page(f"<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div><h1>Some title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li>item</li></ul><p>{LONG}</p></div><div><a href=3>About</a> <a href=4>Help</a></div>")
    own = html_extraction.costs(page)
    cut = html_extraction.min_cut(own, html_extraction.graph(page, 0.8, 0.7))
    alone = html_extraction.min_cut(own, [])
    assert [t for t, k in zip(page.text, cut, strict=True) if k] == ["Some title", LONG, "Short.", LONG, LONG][: sum(cut)] or "Short." in [t for t, k in zip(page.text, cut, strict=True) if k]
    changed = {t for t, a, b in zip(page.text, alone, cut, strict=True) if a != b}
    assert "Short." in changed and page.text[0] not in changed


def test_html_cut_decides_on_pages_without_names(spark, sf_dir):
    """Given pages with every semantic name taken away: the article is still found on most, and the flow is needed."""
    import html
    import re

    found = flips = 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        bare = re.sub(r"</?(?:article|nav|footer|header|main|aside)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", r["html"])
        page = html_extraction.Page(re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|\S+?)(?=[\s>])", "", bare))
        own = html_extraction.costs(page)
        cut = html_extraction.min_cut(own, html_extraction.graph(page, 0.8, 0.7))
        flips += sum((c > 0) != k for c, k in zip(own, cut, strict=True))
        found += want in " ".join(t for t, k in zip(page.text, cut, strict=True) if k)
    assert found >= 0.7 * len(pages) and flips >= len(pages) // 2


def test_html_is_linear_in_depth():
    import time

    took = []
    for n in (4000, 16000):
        start = time.time()
        html_extraction.extract("<div>" * n + LONG + "</div>" * n)
        html_extraction.extract(f"<div>{LONG}" * n)
        took.append(time.time() - start)
    assert took[1] < 12 * took[0]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 3), (2, "u", "", 3), (3, "u", PAGE, 3)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"], r["n_chars"] > 0) for r in html_extraction.main_text(df).collect()) == [(1, False), (2, False), (2, False), (3, True)]
    assert html_extraction.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_minimum_cut(seed):
    """The cut's value against all labellings."""
    from itertools import product

    rng = random.Random(seed)
    n = 8
    net = [rng.uniform(-2, 2) for _ in range(n)]
    edges = [(i, i + 1, rng.uniform(0, 1.5)) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.random()) for _ in range(5)]
    edges = [e for e in edges if e[0] != e[1]]

    def value(x):
        return sum(max(0, v) for k, v in zip(x, net, strict=True) if not k) + sum(max(0, -v) for k, v in zip(x, net, strict=True) if k) + sum(w for a, b, w in edges if x[a] != x[b])

    best = min(value(x) for x in product([False, True], repeat=n))
    assert abs(value(html_extraction.min_cut(net, edges)) - best) < 1e-9
    assert abs(value(html_extraction.max_flow(net, edges)) - best) < 1e-9


def nearest(rows, every, k):
    v = {i: np.array(e, dtype=float) for i, e in rows}
    out = {}
    for q in v:
        if q % every == 0:
            s = sorted(((-round(float(v[q] @ v[i]), 9), i) for i in v if i != q))[:k]
            out[q] = [i for _, i in s]
    return out


def test_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    for factor, bar in ((1.0, 1.0), (2.0, 0.97), (5.0, 0.9)):
        got: dict = {}
        for r in sorted(neighbours.search(df, factor=factor, shard_rows=70, block_rows=5).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert set(got) == set(want)
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= bar * sum(map(len, want.values()))
        if factor == 1.0:
            assert got == want


def test_neighbours_prune_what_has_structure():
    """Scored share and recall of one tree of many leaves, on clustered vectors and on few dimensions."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 64))
    clustered = centres[rng.integers(100, size=8000)] + 0.3 * rng.normal(size=(8000, 64))
    flat = rng.normal(size=(8000, 8))
    for v, factor, share in ((clustered, 1.0, 0.97), (clustered, 2.0, 0.8), (clustered, 3.0, 0.6), (flat, 1.0, 0.9), (flat, 2.0, 0.4)):
        v = v / np.linalg.norm(v, axis=1)[:, None]
        ids = np.arange(len(v))
        q = ids[::4]
        tree = neighbours.Tree(v, ids, 1.0, 20)
        who, name, _ = tree.answers(q, v[q], 20, factor)
        s = v[q] @ v.T
        s[np.arange(len(q)), q] = -9
        want = np.argsort(-s, axis=1, kind="stable")[:, :20]
        recall = np.mean([len(set(name[who == k]) & set(want[k])) / 20 for k in range(len(q))])
        assert recall >= (1.0 if factor == 1.0 else 0.95) and tree.scored < share * len(q) * len(v), (factor, recall, tree.scored / len(q) / len(v))


def test_neighbours_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    run = lambda rows, **o: sorted(map(tuple, neighbours.search(make(rows), **o).collect()))
    assert run([(1, [1.0, 0.0]), (2, [0.0, 1.0])]) == []  # no query
    assert run([(20, [1.0, 0.0])]) == [] and run([(0, [0.0, 0.0])]) == []  # no candidate, no vector
    assert run([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.0])]) == [(20, 1, 3, 0.5)]  # a repeated query row
    many = [(0, [1.0, 0.0])] + [(7, [1.0, 0.0])] * 4 + [(i, [0.5, 0.5]) for i in (8, 9)]
    assert run(many, k=5) == [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 7, 1.0), (0, 4, 7, 1.0), (0, 5, 8, 0.5)]
    mixed = [(i, [1.0, float(i)]) for i in range(30)] + [(100 + i, [1.0] * 3) for i in range(40)]
    assert {r[0] for r in run(mixed, k=2)} == {100, 120}  # the most frequent length takes part
    assert {r[0] for r in run(mixed, k=2, dims=2)} == {0, 20}


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (None, [1.0, 1.0])] + [(20 * i + 8, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, q int")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, k=5, shard_rows=10).collect())
    assert got == [(k + 1, i, 1.0) for k, i in enumerate([1, 8, 28, 48, 68])]
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(df.where("vec_id IN (0, 1, 7)"), k=5).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few) == [(1, 1), (2, 7)]


def test_neighbours_outlive_one_short_vector(spark):
    rows = [(i, [1.0, float(i)]) for i in range(25)]
    search = lambda r: sorted(map(tuple, neighbours.search(spark.createDataFrame(r, "vec_id long, embedding array<float>"), k=3).collect()))
    want = search(rows)
    assert len(want) == 6 and search([*rows, (40, [0.5])]) == want and search([*rows, (41, [0.5] * 3)]) == want


def test_pipeline(spark, sf_dir):
    """The stages against the operators' own verdicts and the brute-force groups."""
    import corpus_pipeline
    from tests.llm.test_jaccard_join import brute
    from wiretide.llm import language_id, pii, quality_rules

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r["doc_id"] for r in quality_rules.quality(docs).where("kept").collect()}
    first = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == docs.columns
    known = {r["doc_id"] for r in language_id.identify(first).where("NOT rejected").collect()}
    second = corpus_pipeline.language_stage(spark, first, sf_dir)
    assert {r["doc_id"] for r in second.collect()} == known
    groups = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in second.collect()])}
    third = corpus_pipeline.near_duplicate_stage(spark, second, sf_dir)
    assert {r["doc_id"] for r in third.collect()} == groups
    fourth = corpus_pipeline.personal_data_stage(spark, third, sf_dir)
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} == groups
    assert all(r[f"n_{k}"] == 0 for r in pii.digest(pii.detect(fourth)).collect() for k in ("email", "card"))
    assert {r["doc_id"] for r in corpus_pipeline.packing_stage(spark, fourth, sf_dir).collect()} == groups


def test_registry():
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op")} and "pipeline" in entry.queries()
