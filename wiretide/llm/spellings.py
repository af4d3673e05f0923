"""Grouping of spelling variants without pairs: wildcard groups for replacements, deletions joined with the vocabulary.

The vocabulary is sorted once and numbered in code-point order, so that ties between words compare numbers.  A pass over it
gives each word one row for each position, with the 128-bit digest of (position, what precedes, what follows): words that
share one differ by a replaced code point there.  A group keeps its size and its two leading words, and every member
learns from those what the group is worth to it: size - 1 near words, the best of them the leader, or for the leader the
second.  A group holds at most one word for each letter.  Words that differ by an insertion or deletion meet where a
word's deletions join the digests of the vocabulary; these matches are links themselves, at most one for each letter of a
word.  What the groups and the join credit to a word is then summed.

A digest is the sum of mixed (position, code point) numbers, so all digests of a word take one pass over its letters,
however long it is; two sums of 64 bits make an accidental match about as likely as 1 in 10^18 for 10^10 words.

Cases: a null text has no words; a null doc_id counts as empty text in the hash that chooses deletions; repeated rows count
again.  Empty tables and tables without a frequent word give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick

#: Letters of a word, after A-Z have been lower-cased.
RUN = "[a-zÀ-ÿ]+"
#: Letters of a slice of the vocabulary that one pass holds at a time (a longer word is a slice of its own).
SLICE = 1 << 20


def damaged(run: Column, doc_id: Column, every: int) -> Column:
    """The run without one code point, where ``every`` divides the hash of document and run; else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """Words and their numbers of occurrences (n), with an id that follows code-point order."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = pick(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= least_letters).select(damaged(F.col("run"), F.col("doc_id"), every).alias("word"))
    counts = words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return materialise(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def mix(x):
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(parts) -> Iterator[tuple]:
    """ids, counts, code points, lengths and first places of at most SLICE letters at a time."""
    import numpy as np

    for part in parts:
        ids, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
        words = part.column("word").to_pylist()
        ends = np.cumsum([len(w) for w in words])
        a = 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
            lens = np.array([len(w) for w in words[a:b]], dtype=np.int64)
            codes = np.frombuffer("".join(words[a:b]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield ids[a:b], n[a:b], codes.astype(np.uint64), lens, np.cumsum(lens) - lens
            a = b


def digests(codes, lens, starts, salt: int):
    """64-bit digests of the whole words, of each wildcard position and of each deletion."""
    import numpy as np

    place = np.arange(len(codes)) - np.repeat(starts, lens)
    salted = np.uint64(mix(np.array([salt], dtype=np.uint64))[0])
    at = lambda place: mix(((place.astype(np.uint64) << np.uint64(32)) | codes) + salted)
    here, before = at(place), at(np.maximum(place - 1, 0))
    run_here, run_before = np.cumsum(here), np.cumsum(before)
    first, last = np.repeat(starts, lens), np.repeat(starts + lens - 1, lens)
    prefix = run_here - here - (run_here[first] - here[first])
    suffix = run_before[last] - run_before
    whole = run_here[last] - (run_here[first] - here[first])
    size = np.repeat(lens, lens).astype(np.uint64)
    wild = whole - here + mix((size << np.uint64(32)) + place.astype(np.uint64) + ~salted)
    return (whole + mix(size + salted))[starts], wild, prefix + suffix + mix(size - np.uint64(1) + salted)


def keys(kind: str) -> Callable:
    """A pass over the vocabulary: a row for each word ("whole"), for each position ("wild") or for each different deletion."""

    def run(parts):
        import numpy as np
        import pyarrow as pa

        for ids, n, codes, lens, starts in slices(parts):
            with np.errstate(over="ignore"):
                pairs = [dict(zip(("whole", "wild", "deletion"), digests(codes, lens, starts, salt), strict=True)) for salt in (1, 2)]
            k1, k2 = (p[kind].view(np.int64) for p in pairs)
            if kind == "whole":
                keep = np.ones(len(lens), dtype=bool)
            else:
                ids, n = np.repeat(ids, lens), np.repeat(n, lens)
                keep = np.ones(len(codes), dtype=bool)
                if kind == "deletion":  # either of two equal neighbours leaves the same word
                    keep[1:] = codes[1:] != codes[:-1]
                    keep[starts] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, ids, n)], names=["k1", "k2", "id", "n"])

    return run


def keyed(words: DataFrame, kind: str) -> DataFrame:
    return words.mapInArrow(keys(kind), "k1 long, k2 long, id long, n long")


def by_replacement(words: DataFrame) -> DataFrame:
    """(id, near, near_n, number): what each wildcard group is worth to each of its words."""
    ranked = Window.partitionBy("k1", "k2").orderBy(F.desc("n"), "id")
    size = F.count(F.lit(1)).over(Window.partitionBy("k1", "k2"))
    leads = F.row_number().over(ranked) == 1
    best = lambda c: F.when(leads, F.lead(c).over(ranked)).otherwise(F.first(c).over(ranked))
    groups = keyed(words, "wild").select("id", best("id").alias("near"), best("n").alias("near_n"), (size - 1).alias("number"))
    return groups.where("number > 0")


def by_deletion(words: DataFrame) -> DataFrame:
    """(id, near, near_n, number): each match of a word's deletion with a word, credited to both."""
    shorter = keyed(words, "whole").select("k1", "k2", F.col("id").alias("short"), F.col("n").alias("short_n"))
    both = keyed(words, "deletion").join(shorter, ["k1", "k2"])
    sides = F.explode(F.array(F.struct("id", F.col("short").alias("near"), F.col("short_n").alias("near_n")), F.struct(F.col("short").alias("id"), F.col("id").alias("near"), F.col("n").alias("near_n"))))
    return both.select(sides.alias("s")).select("s.*", F.lit(1).cast("long").alias("number"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for words with a form: the end of the chain.  A form is ten times as frequent, so chains are short."""
    at = materialise(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = at.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        if moved.where("moved").isEmpty():
            return moved.select("id", "root")
        at = moved.select("id", "root")


def variants(docs: DataFrame, ratio: int = 10, least_letters: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """One row for each word: its form, the root of its chain of forms, and the numbers behind them."""
    words = vocabulary(docs, least_letters, least, every)
    credits = by_replacement(words).unionByName(by_deletion(words))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    near = credits.groupBy("id").agg(F.sum("number").alias("n_near"), best.alias("best"))
    rated = words.join(near, "id", "left")
    leads = -F.col("best.m") >= ratio * F.col("n")
    rated = rated.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.m")).alias("form_n"))
    rated = materialise(rated, "rated")
    ends = roots(rated.where("form IS NOT NULL"))
    names = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    named = rated.join(names, "form", "left").join(ends, "id", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
