"""Personal data by weak supervision, entirely in SQL expressions.

Candidates come from the base patterns and three looser ones.  Five labelers vote on each: a strict format check, a
gazetteer (top-level domains, issuer prefixes, country codes, key words), the characters at the span's edges, words that
announce a kind, and the span's shape.  Expectation-maximisation over the counts of vote patterns (at most 32 for each
source, whatever the corpus) estimates each labeler's reliability and each pattern's posterior; a logistic classifier of
spans, which sees the votes, the length and the share of digits, is trained on these posteriors and alone decides the
candidates.  Valid base matches are always kept; accepted candidates that overlap none of them are added.

Matching twice over a text is linear: a match is tried only where a run of its leading characters begins or the last
match ended (nowhere else can a leftmost match begin), and repetitions never give back.  Positions come from the lengths
of matches and of the text between them.

Cases: null text is empty and has no spans; base_sha256 is then the hash of the empty string.  Equal starts are ordered
by kind.  Repeated rows are judged alone; an empty table gives no rows and trains nothing; extra columns are ignored, or carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Base kinds in the order in which equal starts are listed, then added kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
# For each candidate source its kind, a cheap test and its pattern.
SOURCES = {
    "email": ("email", "contains(t, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", "t RLIKE '[0-9][.][0-9]'", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("card", "t RLIKE '[0-9][ -]?[0-9]'", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("phone", "contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("secret", "t RLIKE '[A-Za-z0-9_+/-]{20}'", r"(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{20,}+"),
    "solid card": ("card", "t RLIKE '[0-9]{14}'", r"(?<![0-9])[0-9]{14,19}+(?![0-9])"),
    "strict phone": ("phone", "contains(t, '+')", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])"),
}
DOMAINS = "com net org edu gov mil int info biz io co eu uk de fr es it nl be ch at pl pt se no fi dk ie us ca au nz jp cn in br mx ru".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEYWORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential)s?[\"']?\s*[:=]*\s*[\"']?$"
MARK = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>"}


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefix_sums(a: str, block: int = 256) -> str:
    """Running sums of an array, in blocks so that the work stays linear."""
    run = "aggregate({x}, CAST(array() AS ARRAY<BIGINT>), (acc, v) -> array_append(acc, coalesce(get(acc, size(acc) - 1), 0L) + v))"
    blocks = f"transform(sequence(0, greatest(0, size({a}) - 1), {block}), b -> {run.format(x=f'slice({a}, b + 1, {block})')})"
    offsets = run.format(x="transform(bl, z -> coalesce(get(z, size(z) - 1), 0L))")
    return _let(blocks, "bl", _let(offsets, "off", "flatten(transform(bl, (z, i) -> transform(z, v -> v + coalesce(get(off, i - 1), 0L))))"))


def _matches(pattern: str, test: str) -> str:
    """array<struct<start,end,m,before,after>> of a pattern's leftmost non-overlapping matches in t."""
    p = _q(pattern)
    lens = "transform(m, (x, i) -> CAST(char_length(x) + char_length(g[i]) AS BIGINT))"
    each = "transform(m, (x, i) -> struct(ends[i] - char_length(x) AS start, ends[i] AS end, x AS m, right(g[i], 40) AS before, left(g[i + 1], 1) AS after))"
    found = _let(f"regexp_extract_all(t, {p}, 0)", "m", f"CASE WHEN size(m) = 0 THEN NULL ELSE {_let(f'split(t, {p}, -1)', 'g', _let(lens, 'l', _let(_prefix_sums('l'), 'ends', each)))} END")
    return f"coalesce(CASE WHEN {test} THEN {found} END, array())"


def _luhn(m: str) -> str:
    total = "aggregate(transform(sequence(1, char_length(d)), i -> CAST(substr(d, i, 1) AS INT) * (2 - i % 2)), 0, (s, v) -> s + CASE WHEN v > 9 THEN v - 9 ELSE v END)"
    return _let(f"reverse(translate({m}, ' -', ''))", "d", f"coalesce(CASE WHEN char_length(d) BETWEEN 14 AND 19 THEN {total} % 10 = 0 END, false)")


#: The labelers, in order: format, gazetteer, edges of the span, key words before it, shape.
LABELERS = ("format", "gazetteer", "edges", "words", "shape")
#: Words that announce a kind.
HINTS = {
    "email": r"(?i)(?:e-?mail|mail(?:to)?|contact|write|reach|at|address)\W*$",
    "ip": r"(?i)(?:ip|address|host|server|from|client|addr|node)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|number|no|pan)\W*$",
    "phone": r"(?i)(?:tel|telephone|phone|call|mobile|cell|fax|contact|number|dial|ring|whatsapp)\W*$",
}


def _base(source: str) -> str:
    """Whether candidate x is a valid match of its base pattern."""
    if source == "email":
        return "true"
    if source == "ip":
        return r"x.m RLIKE '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:[.]|$)){4}$'"
    if source == "card":
        return _luhn("x.m")
    return "char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 10 AND 15" if source == "phone" else "false"


def _votes(source: str) -> tuple[str, ...]:
    """The labelers' votes on candidate x, in their order."""
    edge = "x.before NOT RLIKE '[\\\\p{L}0-9]$' AND x.after NOT RLIKE '[\\\\p{L}0-9]'"
    kind = SOURCES[source][0]
    if kind == "email":
        good = r"x.m RLIKE '^[A-Za-z0-9_%+-]+(?:[.][A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?[.])+[A-Za-z]{2,}$'"
        return good, f"lower(substring_index(x.m, '.', -1)) IN ({','.join(map(_q, DOMAINS))})", edge, f"x.before RLIKE {_q(HINTS[kind])}", "char_length(x.m) BETWEEN 6 AND 80"
    if kind == "ip":
        routed = "x.m RLIKE '^0*(?:[1-9][0-9]?|1[0-9][0-9]|2[0-2][0-9]|23[0-9])[.]'"
        return _base("ip"), routed, f"{edge} AND x.before NOT RLIKE '(?i)(?:version|release|v|ver)[. ]*$'", f"x.before RLIKE {_q(HINTS[kind])}", "x.m NOT RLIKE '(?:^|[.])0[0-9]' AND x.m RLIKE '[0-9]{2}'"
    if kind == "card":
        return _luhn("x.m"), f"x.m RLIKE {_q(ISSUERS)}", edge, f"x.before RLIKE {_q(HINTS[kind])}", "x.m RLIKE '^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$' AND x.m NOT RLIKE '^([0-9])[ -]*(?:\\\\1[ -]*)+$'"
    if kind == "phone":
        return "char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 10 AND 15", f"x.m RLIKE {_q(COUNTRIES)}", edge, f"x.before RLIKE {_q(HINTS[kind])}", "x.m RLIKE '^[+][0-9]{1,3}[ .-]?[(]?[0-9]{1,4}[)]?(?:[ .-]?[0-9]{2,4}){2,4}$'"
    digits = "char_length(regexp_replace(x.m, '[^0-9]', ''))"
    mixed = f"{digits} >= 4 AND x.m RLIKE '[A-Za-z]'"
    variety = "size(array_distinct(split(x.m, ''))) >= least(12, char_length(x.m) / 2)"
    format = f"({mixed} AND x.m RLIKE '^[0-9a-f]{{32,}}$') OR (x.m RLIKE '[a-z]' AND x.m RLIKE '[A-Z]' AND {mixed})"
    return format, f"x.before RLIKE {_q(KEYWORDS)}", r"x.before RLIKE '[:=]\s*[\"\']?$'", f"x.before RLIKE {_q(KEYWORDS.replace('$', '.{0,12}$'))}", f"{digits} BETWEEN char_length(x.m) / 10 AND char_length(x.m) * 9 / 10 AND {variety}"


def _span_features() -> tuple[str, str]:
    """Of candidate x: its length in four steps, and its share of digits in four."""
    length = "CAST(least(3, greatest(0, floor(log2(greatest(1, char_length(x.m)))) - 3)) AS INT)"
    share = "CAST(least(3, floor(4 * char_length(regexp_replace(x.m, '[^0-9]', '')) / greatest(1, char_length(x.m)))) AS INT)"
    return length, share


def candidates(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, c: an array of start, kind (a number), end, source, votes (a bit each, the first labeler's lowest), len and
    dig (features of the span) and base (a valid base match); with carry also row, the document as it came."""
    d = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns] if carry else ["doc_id", "text"]).alias("row")).withColumn("t", F.coalesce("row.text", F.lit("")))
    arrays = []
    for source, (kind, test, pattern) in SOURCES.items():
        votes = " + ".join(f"CASE WHEN coalesce({v}, false) THEN {1 << i} ELSE 0 END" for i, v in enumerate(_votes(source)))
        length, share = _span_features()
        inner = f"struct(x.start AS start, {KINDS.index(kind)} AS kind, x.end AS end, {_q(source)} AS source, {votes} AS votes, {length} AS len, {share} AS dig, coalesce({_base(source)}, false) AS base)"
        arrays.append(f"transform({_matches(pattern, test)}, x -> {inner})")
    return d.select(F.col("row.doc_id").alias("doc_id"), *(["row"] if carry else []), F.expr(f"concat({','.join(arrays)})").alias("c"))


def posteriors(table: list[tuple[str, int, float]], rounds: int = 50) -> dict[tuple[str, int], float]:
    """Expectation-maximisation over (source, votes, count): the probability of each vote pattern of each source.

    The labelers' reliabilities are estimated for each source, drawn to those over all sources where a source has few
    candidates; it starts from the share of votes, and no rule on votes follows."""
    n = len(LABELERS)
    total: dict[tuple[str, int], float] = {}
    for s, v, c in table:
        total[s, v] = total.get((s, v), 0.0) + c
    post = {k: min(0.95, max(0.05, bin(k[1]).count("1") / n)) for k in total}
    sources = sorted({s for s, _ in total})
    for _ in range(rounds):
        mass = {k: (c * (1 - post[k]), c * post[k]) for k, c in total.items()}
        pooled = {(i, y): (2 * (0.75 if y else 0.25) + sum(m[y] for k, m in mass.items() if k[1] >> i & 1)) / (2 + sum(m[y] for m in mass.values())) for i in range(n) for y in (0, 1)}
        after = {}
        for s in sources:
            own = {k: m for k, m in mass.items() if k[0] == s}
            whole = [sum(m[y] for m in own.values()) for y in (0, 1)]
            prior = (1 + whole[1]) / (2 + sum(whole))
            rate = [[(5 * pooled[i, y] + sum(m[y] for k, m in own.items() if k[1] >> i & 1)) / (5 + whole[y]) for i in range(n)] for y in (0, 1)]
            for k in own:
                like = [math.log(1 - prior), math.log(prior)]
                for y in (0, 1):
                    for i in range(n):
                        p = min(max(rate[y][i], 1e-4), 1 - 1e-4)
                        like[y] += math.log(p if k[1] >> i & 1 else 1 - p)
                after[k] = 1 / (1 + math.exp(min(60.0, like[0] - like[1])))
        post = after
    return post


def features(source: str, votes: int, length: int, digits: int) -> dict[str, float]:
    """What the span classifier sees: the votes (of the source, and of all), the length and the share of digits."""
    x = {f"{source}": 1.0, f"{source} len {length}": 1.0, f"{source} dig {digits}": 1.0}
    for i, name in enumerate(LABELERS):
        x[name] = x[f"{source} {name}"] = 1.0 if votes >> i & 1 else -1.0
    return x


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier: logistic regression on the posteriors.

    Only counts of patterns reach the driver: sources * 2^labelers * 16 rows at most."""
    rows = found.select(F.explode("c").alias("x")).groupBy("x.source", "x.votes", "x.len", "x.dig").count().collect()
    return fit(sorted((r["source"], r["votes"], r["len"], r["dig"], r["count"]) for r in rows))


def fit(table: list[tuple[str, int, int, int, float]], steps: int = 600) -> dict[str, float]:
    import numpy as np

    if not table:
        return {}
    post = posteriors([(s, v, c) for s, v, _, _, c in table])
    rows = [features(*t[:4]) for t in table]
    names = sorted({n for r in rows for n in r})
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for n, v in r.items():
            x[i, at[n]] = v
    y = np.array([post[t[0], t[1]] for t in table])
    c = np.log1p([t[4] for t in table])
    w = np.zeros(len(names))
    for _ in range(steps):  # Newton steps would need few; plain ones keep a separable table tame
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 0.5 * (x.T @ (c * (y - p)) / c.sum() - 0.0005 * w)
    return {n: round(float(w[i]), 9) for n, i in at.items()}


def chance(weights: dict[str, float], source: str, votes: int, length: int, digits: int) -> float:
    z = sum(weights.get(n, 0.0) * v for n, v in features(source, votes, length, digits).items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _score(weights: dict[str, float]) -> str:
    """The classifier's linear score of candidate x in SQL."""
    n = lambda k: f"{weights.get(k, 0.0):.9f}D"
    cases = []
    for s in SOURCES:
        votes = " + ".join(f"CASE WHEN (x.votes & {1 << i}) > 0 THEN 1D ELSE -1D END * ({n(k)} + {n(f'{s} {k}')})" for i, k in enumerate(LABELERS))
        steps = " + ".join(f"element_at(array({','.join(n(f'{s} {f} {j}') for j in range(4))}), x.{f} + 1)" for f in ("len", "dig"))
        cases.append(f"WHEN {_q(s)} THEN {n(s)} + {votes} + {steps}")
    return f"CASE x.source {' '.join(cases)} END"


SPAN = "STRUCT<start: BIGINT, kind: INT, end: BIGINT, base: BOOLEAN>"


def _fold(spans: str, first: str, keep: str, after: str, block: int = 256) -> str:
    """The spans that pass, from the left: ``keep`` and ``after`` say of span x and the state i.at whether x stays and what
    the state then is.  In blocks, so that the work stays linear."""
    one = f"aggregate(z, struct(s.at AS at, CAST(array() AS ARRAY<{SPAN}>) AS out), (i, x) -> CASE WHEN {keep} THEN struct({after} AS at, array_append(i.out, x) AS out) ELSE i END)"
    blocks = f"transform(sequence(0, greatest(0, size({spans}) - 1), {block}), b -> slice({spans}, b + 1, {block}))"
    step = f"transform(array({one}), v -> struct(v.at AS at, array_append(s.out, v.out) AS out))[0]"
    return f"aggregate({blocks}, struct({first} AS at, CAST(array() AS ARRAY<ARRAY<{SPAN}>>) AS out), (s, z) -> {step}, s -> flatten(s.out))"


def detect(docs: DataFrame, threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, base and spans (and row, with carry): sorted arrays of (start, kind, end); kind indexes KINDS, ends are
    exclusive.  Base spans stay; of the others the classifier accepts, those that overlap no base span stay, from left to
    right where they overlap each other."""
    found = materialise(candidates(docs, carry), "pii")
    weights = train(found)
    limit = math.log(threshold / (1 - threshold))
    ids = ["doc_id", *(["row"] if carry else [])]
    chosen = f"transform(filter(c, x -> x.base OR coalesce({_score(weights)} >= {limit:.9f}D, false)), x -> CAST(struct(x.start AS start, x.kind AS kind, x.end AS end, x.base AS base) AS {SPAN}))"
    return settle(found.select(*ids, F.expr(f"sort_array({chosen})").alias("all")), ids)


def settle(found: DataFrame, ids: list[str]) -> DataFrame:
    """The columns named, base and spans, from all: sorted (start, kind, end, base)."""
    # From the right: no base span may begin before a span's end; from the left: none, and no span kept, may end after its start.
    before = _fold("reverse(all)", "9223372036854775807L", "x.base OR x.end <= i.at", "CASE WHEN x.base THEN x.start ELSE i.at END")
    found = found.select(*ids, "all", F.expr(f"CASE WHEN forall(all, x -> x.base) THEN NULL ELSE reverse({before}) END").alias("some"))
    free = _fold("some", "0L", "x.base OR x.start >= i.at", "greatest(i.at, x.end)")
    plain = "transform({}, x -> struct(x.start AS start, x.kind AS kind, x.end AS end))"
    base = F.expr(plain.format("filter(all, x -> x.base)"))
    return found.select(*ids, base.alias("base"), F.expr(f"CASE WHEN some IS NULL THEN {plain.format('all')} ELSE {plain.format(free)} END").alias("spans"))


def _listing(spans: str) -> str:
    names = f"array({','.join(map(_q, KINDS))})"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.expr(f"sha2({_listing('base')}, 256)").alias("base_sha256"),
        F.expr(_listing("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents, every span of their texts replaced by its kind's mark; of overlapping spans the first counts.  Columns
    stay as they are, whatever their names."""
    marks = f"array({','.join(_q(MARK[k]) for k in KINDS)})"
    # The text is cut in blocks of spans, so that no array of pieces is copied for every span.
    piece = f"concat(substr(row.text, CAST(i.at + 1 AS INT), CAST(x.start - i.at AS INT)), {marks}[x.kind])"
    step = f"CASE WHEN x.start < i.at THEN i ELSE struct(x.end AS at, array_append(i.out, {piece}) AS out) END"
    one = f"aggregate(z, struct(s.at AS at, CAST(array() AS ARRAY<STRING>) AS out), (i, x) -> {step})"
    each = f"transform(array({one}), v -> struct(v.at AS at, array_append(s.out, array_join(v.out, '')) AS out))[0]"
    built = f"aggregate(transform(sequence(0, size(spans) - 1, 256), b -> slice(spans, b + 1, 256)), struct(0L AS at, CAST(array() AS ARRAY<STRING>) AS out), (s, z) -> {each}, s -> concat(array_join(s.out, ''), substr(row.text, CAST(s.at + 1 AS INT))))"
    text = F.expr(f"CASE WHEN size(spans) = 0 THEN row.text ELSE {built} END")
    found = detect(docs, carry=True).select("row", text.alias("clean"))
    return found.select(*[F.col("clean").alias("text") if n == "text" else F.col(f"row.`{n}`").alias(n) for n in docs.columns])
