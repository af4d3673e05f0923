"""Quality rules: word statistics plus distribution divergence, entirely in SQL expressions.

``features`` counts, for each document, what the base rules need and two histograms: character classes and common
words.  ``references`` sums the histograms of all documents that pass the base rules, for each language, and once more of
those that the first sums keep, so that junk does not make itself look normal.  A document's
divergence is the smallest Jensen-Shannon distance (base 2, so 0 to 1) to any language's reference; it rejects a
document only above a limit, which is wider for short documents (noise falls with the root of the length), and only if
the document reaches a minimum length.  Symbols are too rare to move that distance, so their share is also held against
the largest share of the references.

Languages without a fixed list of common words learn theirs from the corpus, given enough documents.  The distances judge
only documents whose language has a reference (and for words, common words at all, which texts without spaces lack);
the share of symbols judges every document.

Cases: null text is an empty document (no words, base_failed, not kept).  A null or unlisted language adds to no
reference, and its documents are not judged by distance.  With no reference at all (an empty or wholly rejected corpus) no document
diverges.  Ties and repeated rows are separate rows, each judged alone; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, pick

# Frequent function words of each reference language.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on as with be by this are from or an".split(),
    "de": "der die und das den von zu mit ist ein eine nicht für auf dem sich des im er es".split(),
    "fr": "le la les de et un une du en est que qui dans pour sur pas au par il ne".split(),
    "es": "el los las del y a una por con para se su lo como más no al sus o ha".split(),
}
# Character classes counted by pattern; the rest of a word's characters are plain letters.
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "punct": r"[.,;:!?'\"()\-]"}
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Place of the symbols in the histogram of character classes.
SYMBOL_CLASS = len(CLASSES) + 1


def _bins(words: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(w for ws in words.values() for w in ws))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def common_words(docs: DataFrame, least_docs: int = 50, size: int = 20, share: float = 0.002) -> dict[str, list[str]]:
    """The fixed lists, and for each further language with enough documents its most frequent words of letters only."""
    sizes = {r["lang"]: r["count"] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    more = sorted(k for k, n in sizes.items() if n >= least_docs and k not in COMMON_WORDS)
    out = COMMON_WORDS | {k: [] for k in more}
    if more:
        d = docs.where(F.col("lang").isin(more)).select("lang", F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
        counts = materialise(d.groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n")), "quality-words")
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        # At most 1 / share words of a language reach the driver.
        enough = F.lit(False)
        for k in totals:
            enough = enough | ((F.col("lang") == k) & (F.col("n") >= share * totals[k]))
        rows = counts.where(enough & F.col("word").rlike(r"^[\p{L}\p{M}]+$")).collect()
        for r in sorted(rows, key=lambda r: (-r["n"], r["word"])):
            if len(out[r["lang"]]) < size:
                out[r["lang"]].append(r["word"])
    return out


def features(docs: DataFrame, words: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, the five counts of the base rules, base_failed, and the histograms as arrays of doubles."""
    bins = _bins(words)
    # One character of one width stands for each common word, so that counting a word is counting bytes.
    width = 1 if len(bins) <= 74 else 4
    code = {w: chr(0xF0000 + i) if width == 4 else chr(48 + i) if i < 44 else chr(93 + i - 44 + 4) for i, w in enumerate(bins)}
    forms = {f: code[w] for w in bins for f in (w, w.capitalize())}
    inset = ",".join(map(_quoted, forms))
    mapped = "map(" + ",".join(f"{_quoted(k)},{_quoted(v)}" for k, v in forms.items()) + ")"
    d = pick(docs, "doc_id", "lang", "text").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    d = d.select(
        "doc_id",
        "lang",
        "t",
        "words",
        F.expr(f"CASE WHEN size(words) > {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END").alias("w"),
        F.expr(f"array_join(transform(filter(words, x -> x IN ({inset})), x -> element_at({mapped}, x)), '')").alias("seen"),
    )
    # Positions of windows that occur again, by sorting (hash, position); only documents with a repeat pay for the sort.
    repeats = """CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE
        transform(array(sort_array(transform(w, (h, i) -> struct(h, i)))), p ->
          transform(array(sort_array(transform(filter(p, (x, k) -> get(p, k - 1).h <=> x.h OR get(p, k + 1).h <=> x.h), x -> x.i))), q ->
            aggregate(transform(q, (x, k) -> least(8, coalesce(get(q, k + 1) - x, 8))), 0L, (a, x) -> a + x))[0])[0] END"""
    lines = r"filter(split(t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')".replace(r"'\n'", r"'\\n'")
    count = lambda pattern: F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).cast("double")
    d = d.select(
        "doc_id",
        "lang",
        F.xxhash64("t").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("t", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), x -> size(x) - size(array_distinct(x)))[0]").cast("long").alias("n_dup_lines"),
        F.expr(repeats).cast("long").alias("n_repeat_words"),
        F.char_length("t").cast("double").alias("n"),
        (F.octet_length("t") - F.char_length("t")).cast("double").alias("wide"),
        *[count(p).alias(k) for k, p in CLASSES.items()],
        (F.octet_length("seen") / width).alias("n_common"),
        F.array(*[((F.octet_length("seen") - F.octet_length(F.replace("seen", F.lit(code[w])))) / width) for w in bins]).alias("common"),
    )
    rest = F.greatest(F.lit(0.0), F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.col("wide")) - F.col("n_symbols"))
    return d.select(
        "doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.array(*[F.col(k) for k in CLASSES], "wide", F.col("n_symbols").cast("double"), F.col("n") - F.col("word_chars"), rest).alias("chars"),
        F.concat("common", F.array(F.greatest(F.lit(0.0), F.col("n_words") - F.col("n_common")))).alias("common"),
    )


def references(feats: DataFrame, languages: list[str], words: dict[str, list[str]] = COMMON_WORDS) -> dict[str, dict[str, list[float]]]:
    """For each histogram, one normalised reference for each language that the corpus has: a result of bounded size."""
    sizes = {"chars": len(CLASSES) + 4, "common": len(_bins(words)) + 1}
    sums = [F.sum(F.col(h)[i]).alias(f"{h}{i}") for h, n in sizes.items() for i in range(n)]
    rows = feats.where(~F.col("base_failed") & F.col("lang").isin(languages)).groupBy("lang").agg(*sums).orderBy("lang").collect()
    out: dict[str, dict[str, list[float]]] = {h: {} for h in sizes}
    for r in rows:
        for h, n in sizes.items():
            v = [r[f"{h}{i}"] or 0.0 for i in range(n)]
            if (total := sum(v)) and (h == "chars" or words[r["lang"]]):
                out[h][r["lang"]] = [x / total for x in v]
    return out


def js_distance(hist: str, refs: list[list[float]]) -> Column:
    """Smallest Jensen-Shannon distance of an array column of counts to any reference; 0 without counts or references."""
    if not refs:
        return F.lit(0.0)
    lits = ",".join("array(" + ",".join(f"{x!r}D" for x in r) + ")" for r in refs)
    half = "aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0D END), 0D, (s, x) -> s + x)"
    return F.expr(f"""transform(array(aggregate({hist}, 0D, (s, x) -> s + x)), total -> CASE WHEN total = 0 THEN 0D ELSE
        transform(array(transform({hist}, x -> x / total)), p ->
          array_min(transform(array({lits}), r -> sqrt(greatest(0D, ({half.format(a="p", b="r")} + {half.format(a="r", b="p")}) / 2)))))[0] END)[0]""")


def quality(
    docs: DataFrame,
    languages: tuple[str, ...] | None = None,
    max_char_distance: float = 0.25,
    char_slack: float = 1.0,
    max_word_distance: float = 0.27,
    word_slack: float = 0.8,
    min_chars: int = 100,
    min_words: int = 50,
    max_symbol_excess: float = 0.02,
    symbol_slack: float = 0.3,
) -> DataFrame:
    """One row for each document: counts, base_failed, both distances and kept.  Languages: all with enough documents."""
    words = common_words(pick(docs, "lang", "text"))
    names = [k for k in words if languages is None or k in languages]

    def judged(f: DataFrame, ref: dict[str, dict[str, list[float]]]) -> DataFrame:
        usual = max((r[SYMBOL_CLASS] for r in ref["chars"].values()), default=1.0)
        known = {h: F.coalesce(F.col("lang").isin(list(r)), F.lit(False)) for h, r in ref.items()}
        f = f.withColumn("char_distance", js_distance("chars", [*ref["chars"].values()])).withColumn("word_distance", js_distance("common", [*ref["common"].values()]))
        odd_chars = known["chars"] & (F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance + char_slack / F.sqrt("word_chars"))
        odd_words = known["common"] & (F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance + word_slack / F.sqrt("n_words"))
        odd_symbols = (F.col("word_chars") >= min_chars) & (F.col("n_symbols") / F.col("word_chars") > usual + max_symbol_excess + symbol_slack / F.sqrt("word_chars"))
        return f.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words & ~odd_symbols)

    f = materialise(features(docs, words), "quality")
    first = references(f, names, words)
    again = references(judged(f, first).where("kept"), names, words)
    # A language that loses every document in the first pass keeps its first reference.
    return judged(f, {h: first[h] | again[h] for h in first}).drop("lang", "chars", "common")


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns as they were.  A verdict belongs to an id and its text."""
    kept = quality(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["_hash"]), "left_semi")
