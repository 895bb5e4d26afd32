"""Queries whose results are counts and sums over whole tables, exact in integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm import divergence, hadamard
from chartloom.llm.common import LOWER, UPPER, table
from chartloom.llm.registry import query

AUDIT_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {divergence.LEAST_DOCS}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
of_lang AS (
  SELECT lang, term, 1 + CAST({divergence.WHOLE} AS HUGEINT) * (n + 2) // CAST(total + 2 * v AS HUGEINT) AS q FROM kept JOIN langs USING (lang)),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL) USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n, q,
         1 + CAST({divergence.WHOLE} AS HUGEINT) * (coalesce(f.n, 0) + 2) // CAST(g.total + 2 * v AS HUGEINT) AS p
  FROM groups g JOIN langs USING (lang) JOIN of_lang k ON k.lang = g.lang
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
valued AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


@query("op12_source_divergence", AUDIT_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def _codes_sql() -> str:
    parts, entries = hadamard.PARTS, hadamard.ENTRIES
    rounds = []
    for k in range(hadamard.ROUNDS + 1):
        rounds.append(f"""
a{k} AS MATERIALIZED (
  SELECT row, part, unnest(first) FROM (
    SELECT row, part, min({{'error': error, 'entry': entry}}) AS first FROM (
      SELECT p.row, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS error
      FROM parts p JOIN c{k} c USING (part)) GROUP BY row, part))""")
        if k < hadamard.ROUNDS:
            rounds.append(f"""
m{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, sum(x) AS s, count(*) AS n
    FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM parts JOIN a{k} USING (row, part)) GROUP BY ALL)
  GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))""")
    last = hadamard.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({hadamard.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM (SELECT row, v, unnest(range(0, {parts})) AS part FROM kept)),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {entries}),{",".join(rounds)},
book AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM c{last})),
coded AS (
  SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{last} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), book
"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).drop("label")
