"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, html_extraction, jaccard_join, language_id, lm_scoring, neighbours, packing, pii, quality_rules, sentencepieces, spellings, tokens, warc
from .common import table

COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(*COUNTS)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_counts(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_html_extraction": op3_html_extraction,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}


def lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as two tables: the assignment and the moved centroids."""
    nearest = "SELECT c, vec_id, d FROM (SELECT k.c, x.vec_id, list_sum(list_transform(range(1, 65), lambda i: (x.q[i] - k.q[i]) * (x.q[i] - k.q[i]))) AS d FROM x, k{r} k) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    moved = "SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM (SELECT a.c, j, sum(x.q[j]) AS s, count(*) AS n FROM a{r} a JOIN x USING (vec_id), range(1, 65) t(j) GROUP BY a.c, j) GROUP BY c UNION ALL SELECT c, q FROM k{r} WHERE c NOT IN (SELECT c FROM a{r})"
    steps = ["x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)"]
    steps.append(f"k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM x QUALIFY c < {k})")
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < rounds:
            steps.append(f"k{r + 1} AS MATERIALIZED ({moved.format(r=r)})")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a{rounds} JOIN k{rounds} USING (c)"


#: Where SQL expresses the whole result.  The search's SQL is exact; at the oracle's size its pruning loses nothing.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w, ' ') AS seq, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(node, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, CASE WHEN len(sh) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY seq) END AS n_copies FROM s JOIN (SELECT node, min(other) AS c FROM r GROUP BY node) m ON m.node = s.doc_id""",
    "op10_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i]), lambda a, b: a + b) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
    "op11_centroid_clustering": lloyd_sql(),
    "op12_spelling_variants": r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
own AS MATERIALIZED (SELECT run, count(*) AS n, concat(doc_id, ':', run) AS s FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h FROM own, t),
words AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, concat(substr(word, 1, i), '*', substr(word, i + 2)) AS wild, concat(substr(word, 1, i), substr(word, i + 2)) AS shorter FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM v)),
short AS MATERIALIZED (SELECT DISTINCT c.word AS a, c.n AS a_n, v.word AS b, v.n AS b_n FROM cut c JOIN v ON v.word = c.shorter),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.wild = y.wild AND x.word <> y.word UNION ALL SELECT a, b, b_n FROM short UNION ALL SELECT b, a, a_n FROM short),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, first(other ORDER BY other_n DESC, other) AS other FROM near GROUP BY word),
rated AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, tip, form) AS (SELECT word, word, form FROM rated UNION ALL SELECT c.word, r.word, r.form FROM chain c JOIN rated r ON r.word = c.form)
SELECT r.word, r.form, c.tip AS root, r.n, r.n_near, r.form_n FROM rated r JOIN chain c ON c.word = r.word AND c.form IS NULL""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages), r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM r""",
}
