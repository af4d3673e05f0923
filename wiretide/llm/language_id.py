"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams over its lower-cased letters (other runs are one space), with
weights log(1 + tf) * idf, normalised.  Document frequencies cover every training document.  Each language has several
centroids, found by spherical k-means on a bounded sample of its training vectors (``sample_rows`` documents in all,
chosen by a hash of the id).  The language of the nearest centroid by cosine wins; ``rejected`` marks texts farther from
it than documents are.  That limit is learned: for each centroid and class of length, a low quantile of the cosines of the
sample, each document left out of its own centroid, and lower for short texts.  Grams are hashed into many bins, so
that texts of other scripts share next to nothing with a centroid by chance.

Cases: null text, or one without a letter, is ``und`` with score 0 and rejected.  Documents with a null language train nothing.  With
nothing to learn from, every text is ``und``.  Ties go to the language first in order.  Repeated rows are judged alone; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, pick

FOLDS, HELD_OUT = 4, 2
LANGUAGES = 512  # the most frequent labels are learned; rarer ones are taken for dirt
#: Classes of length: powers of two of a text's letters and spaces.
LENGTHS = 32


def letters_table():
    """For each code point whether it is a letter."""
    import numpy as np

    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str, letter, dims: int):
    """Bins of the hashed 1- to 3-grams of a text, their counts, and its letters and spaces; None without a letter."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    is_letter = letter[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    p = np.uint64(0x9E3779B97F4A7C15)
    shift, mask = np.uint64(40), np.uint64(dims - 1)
    one = c * p
    two = (one[:-1] ^ (c[1:] + np.uint64(0x1F0000))) * p
    three = (two[:-1] ^ (c[2:] + np.uint64(0x3F0000))) * p
    bins, counts = np.unique((np.concatenate([one, two, three]) >> shift & mask).astype(np.int64), return_counts=True)
    return bins, counts, len(c)


def weigh(bins, counts, idf):
    import numpy as np

    v = np.log1p(counts) * idf[bins]
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def document_frequencies(docs: DataFrame, dims: int):
    """(documents, array of dims) over all given documents; each task sends at most dims + 1 rows."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        letter, df, n = letters_table(), np.zeros(dims, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                g = grams(t.as_py() or "", letter, dims)
                if g is not None:
                    df[g[0]] += 1
                    n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen]), pa.int32()), pa.array(np.concatenate([[n], df[seen]]), pa.int64())], ["dim", "df"])

    rows = docs.select("text").mapInArrow(count, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(dims + 1)
    for r in rows:
        out[r["dim"] + 1] = r["df"]
    return out[0], out[1:]


def clusters(rows: list, dims: int, k: int, rounds: int):
    """Spherical k-means of sparse rows (bins, weights), seeded by the row farthest from all seeds so far; deterministic.

    Centroids, and for each row its cosine to the nearest of them, itself left out, and that centroid's place."""
    import numpy as np

    bins, weights = np.concatenate([b for b, _ in rows]), np.concatenate([w for _, w in rows])
    sizes = np.array([len(b) for b, _ in rows])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)

    def cosines(c):
        return np.add.reduceat(weights * c[bins], starts)

    def total(mine):
        at = mine[of]
        return np.bincount(bins[at], weights=weights[at], minlength=dims)

    def dense(i):
        return total(np.arange(len(rows)) == i)

    seeds = [int(np.argmax(cosines(total(np.ones(len(rows), dtype=bool)))))]
    near = cosines(dense(seeds[0]))
    for _ in range(1, min(k, len(rows))):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, cosines(dense(seeds[-1])))
    c = np.array([dense(i) for i in seeds])
    for _ in range(rounds):
        to = np.argmax([cosines(x) for x in c], axis=0)
        for j in range(len(c)):
            if (to == j).any():
                m = total(to == j)
                c[j] = m / (np.linalg.norm(m) or 1)
    sim = np.array([cosines(x) for x in c])
    for j in range(len(c)):
        own = np.flatnonzero(to == j)
        if len(own):
            m = total(to == j)
            dot, square = cosines(m)[own], np.add.reduceat(weights * weights, starts)[own]
            left = np.sqrt(np.maximum(0, m @ m - 2 * dot + square))
            sim[j, own] = np.where(left > 1e-6, (dot - square) / np.maximum(left, 1e-6), 0)
    return c, sim.max(axis=0), sim.argmax(axis=0)


def length_class(n):
    import numpy as np

    return np.minimum(LENGTHS - 1, np.log2(n).astype(int))


def limits(owner: list[int], cosine, to, letters, quantile: float, least: int):
    """For each centroid and class of length, the quantile of the cosines of at least ``least`` documents of that class or
    the next: those of the centroid, else of its language, else of all; else of all in ever more classes."""
    import numpy as np

    owner, kind = np.array(owner), length_class(letters)
    out = np.zeros((len(owner), LENGTHS))
    for j in range(len(owner)):
        for c in range(LENGTHS):
            level = (kind == c) | (kind == c + 1)
            choices = [level & (to == j), level & (owner[to] == owner[j]), level]
            choices += [(kind >= c - d) & (kind <= c + 1 + d) for d in range(1, LENGTHS)]
            mine = next((m for m in choices if m.sum() >= least), np.ones(len(kind), dtype=bool))
            out[j, c] = np.quantile(cosine[mine], quantile, method="lower") if mine.any() else 0
    return out


def held_out():
    """Whether a document is kept from learning; a null id never is."""
    return F.coalesce(crc32_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, dims: int, centroids: int, sample_rows: int, rounds: int, quantile: float, least: int) -> tuple[list[str], list[int], object, object, object]:
    """(languages, language of each centroid, centroids, idf, limits) from documents with a language outside the held-out fold."""
    import numpy as np
    import pandas as pd

    train = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out()).where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], [], np.zeros((0, dims)), np.zeros(dims), np.zeros((0, LENGTHS))
    n, df = document_frequencies(train, dims)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    each = max(1, sample_rows // len(langs))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, each / sizes[lang]) * (1 << 30)))])
    limit = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0))

    def vectors(batches: Iterator) -> Iterator:
        letter = letters_table()
        for pdf in batches:
            got = [(lang, g[2], g[0].astype("<i4").tobytes(), weigh(*g[:2], idf).astype("<f4").tobytes()) for lang, t in zip(pdf["lang"], pdf["text"], strict=True) if (g := grams(t, letter, dims)) is not None]
            yield pd.DataFrame(got, columns=["lang", "letters", "bins", "v"])

    rows = train.where(draw < limit).select("lang", "text", "doc_id").mapInPandas(vectors, "lang string, letters long, bins binary, v binary").collect()
    owner, found, cosine, to, letters = [], [], [], [], []
    for i, lang in enumerate(langs):
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (bytes(r["bins"]), bytes(r["v"])))
        if mine:
            c, s, j = clusters([(np.frombuffer(r["bins"], dtype="<i4"), np.frombuffer(r["v"], dtype="<f4").astype(float)) for r in mine], dims, centroids, rounds)
            cosine.append(s)
            to.append(j + len(owner))
            letters.append([r["letters"] for r in mine])
            owner += [i] * len(c)
            found.append(c.astype("f4"))
    if not found:
        return langs, owner, np.zeros((0, dims)), idf, np.zeros((0, LENGTHS))
    low = limits(owner, np.concatenate(cosine), np.concatenate(to), np.concatenate(letters), quantile, least)
    return langs, owner, np.concatenate(found), idf, low


class Predictor:
    """Names the language of texts with a fitted model."""

    def __init__(self, langs: list[str], owner: list[int], c, idf, low, margin: float, slack: float) -> None:
        self.langs, self.owner, self.c, self.idf, self.letter = langs, owner, c, idf, letters_table()
        self.low, self.margin, self.slack = low, margin, slack

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its nearest centroid, and whether the text is rejected."""
        import numpy as np

        g = grams(text or "", self.letter, len(self.idf)) if self.owner else None
        if g is None:
            return "und", 0.0, True
        bins, counts, n = g
        sim = self.c[:, bins] @ weigh(bins, counts, self.idf)
        k = int(np.argmax(sim))
        limit = self.low[k, length_class(n)] * self.margin * max(0.1, 1 - self.slack / n**0.5)
        return self.langs[self.owner[k]], float(min(1.0, max(0.0, sim[k]))), bool(sim[k] < limit)


def identify(docs: DataFrame, dims: int = 1 << 16, centroids: int = 4, sample_rows: int = 4000, rounds: int = 8, quantile: float = 0.005, least: int = 50, margin: float = 0.8, slack: float = 3.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected."""
    model = fit(docs, dims, centroids, sample_rows, rounds, quantile, least)

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name = Predictor(*model, margin, slack)
        for batch in batches:
            got = [name(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, dims: int = 1 << 16, centroids: int = 4, sample_rows: int = 4000, rounds: int = 8, quantile: float = 0.005, least: int = 50, margin: float = 0.8, slack: float = 3.0) -> DataFrame:
    """The documents with a language, as they were; those without letters or far from every centroid go."""
    model = fit(docs, dims, centroids, sample_rows, rounds, quantile, least)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        name = Predictor(*model, margin, slack)
        for batch in batches:
            yield batch.filter(pa.array([not name(t.as_py())[2] for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
