"""The queries of the text operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    decontamination,
    divergence,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    toxicity,
    url_filter,
)
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can express: host, path and rule, and the verdict where a rule fits."""
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.score(documents, quality_classifier.fit(documents, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.fit(documents))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_shingles", "n_shared"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded with an end id, decoded from the ids alone, and both digested."""
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = sentence_pieces.decode(encoded.select("doc_id", F.col("pieces.ids").alias("ids")), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_url_filter,
        url_rules,
        op3_quality_classifier,
        op4_quality_rules,
        op5_pii,
        op6_line_dedup,
        op7_near_dedup,
        op8_language_id,
        op9_decontamination,
        op10_best_fit_packing,
        op11_divergence_audit,
        op12_centroid_clustering,
        op13_sentence_pieces,
    )
}


def _ratio(rule: tuple) -> str:
    _, top, bottom, least, most = rule
    return f"coalesce({top}::double / nullif({bottom}, 0), {least}) BETWEEN {least} AND {most}"


_STOP = ", ".join(f"'{w}'" for word in dict.fromkeys(quality_rules.STOP_WORDS) for w in dict.fromkeys((word, word.capitalize())))

OP4_SQL = rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::bigint AS n_words,
         length(array_to_string(w, ''))::bigint AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
         (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
         coalesce(n, 0)::bigint AS n_repeat_words,
         len(l)::bigint AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOP})))::bigint AS n_stop_words
  FROM base LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
            OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_ratio, quality_rules.THRESHOLDS))} AS kept,
       n_lines, n_stop_words
FROM failed
"""

OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, l, unnest(range(0, len(l))) AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
full_lines AS (
  SELECT doc_id, l[ln + 1] AS line, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos
  FROM lines WHERE regexp_matches(l[ln + 1], '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS key,
         [ln, lead(ln, 1) OVER w, lead(ln, 2) OVER w] AS covered
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, covered FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM windows WHERE key IS NOT NULL)
  WHERE n > 1),
removed AS (SELECT DISTINCT doc_id, unnest(covered) AS ln FROM later),
kept AS (
  SELECT lines.doc_id, string_agg(l[lines.ln + 1], chr(10) ORDER BY lines.ln) AS text
  FROM lines ANTI JOIN removed ON lines.doc_id = removed.doc_id AND lines.ln = removed.ln GROUP BY lines.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END::bigint AS n_lines,
       coalesce(counts.n, 0)::bigint AS n_removed,
       CASE WHEN counts.n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN counts ON d.doc_id = counts.doc_id
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM item_shingles),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, ks))
SELECT doc_id, item_id, n_shingles::bigint AS n_shingles, count(*)::bigint AS n_shared
FROM doc_shingles JOIN item_shingles USING (k, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in url_filter.RULES)

URL_RULES_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 1) AS h,
         regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
hosts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(name, start, said) AS (VALUES {_RULES})
SELECT page_id, host, path,
       (SELECT max_by(name || start, length(name || start)) FROM rules
        WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS rule,
       (SELECT max_by(said, length(name || start)) FROM rules
        WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS verdict
FROM hosts
"""

OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (
  SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(w) AS w FROM docs)),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v))::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v))::HUGEINT AS everywhere
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::bigint AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - everywhere) * (p - everywhere) // everywhere)::bigint AS value
  FROM shares WHERE n > 0 AND p > everywhere),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::int AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


def _kmeans_sql(k: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """Rounds of exact k-means, each a few steps of SQL."""
    assigned = """
a{r} AS (
  SELECT vec_id, q, i, d FROM (
    SELECT r, vec_id, q, i, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
           row_number() OVER (PARTITION BY r ORDER BY d, i) AS best
    FROM kept, c{r}) WHERE best = 1)"""
    moved = """,
m{r} AS (SELECT i, j, sum(q[j]) AS s, count(*) AS n FROM (SELECT i, q, unnest(range(1, {size} + 1)) AS j FROM a{r}) GROUP BY i, j),
c{next} AS (
  SELECT c{r}.i, coalesce(f.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT i, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM m{r} GROUP BY i) f ON f.i = c{r}.i),"""
    steps = "".join(assigned.format(r=r) + moved.format(r=r, next=r + 1, size=size) for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) AS q
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1)::int AS i, q AS c
  FROM kept ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k}),{steps}{assigned.format(r=rounds)}
SELECT vec_id, a{rounds}.i AS cluster, d::bigint AS distance,
       (sum(d) OVER (PARTITION BY a{rounds}.i))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.i = a{rounds}.i
"""


OP12_SQL = _kmeans_sql(centroids.K, centroids.ROUNDS, centroids.SIZE, centroids.SCALE, centroids.SEED)

ORACLE_SQL = {
    "url_rules": URL_RULES_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_divergence_audit": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
