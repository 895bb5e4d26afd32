"""Queries whose operators are columns and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import chat, hosts, kdtree, quality
from chartloom.llm.common import table
from chartloom.llm.registry import query

CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
prefixes AS (
  SELECT conv_id, nth, n, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY nth) AS said
  FROM turns),
whole AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, said FROM prefixes WHERE nth = n GROUP BY n, said),
kept AS (
  SELECT conv_id, n_turns, n_copies FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.nth < p.n AND p.nth = w.n_turns AND p.said = w.said))
SELECT conv_id, (nth - 1) // 256 AS part, n_turns, n_copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                  ORDER BY nth) AS text
FROM turns JOIN kept USING (conv_id)
GROUP BY ALL
"""


@query("op1_chat_formatting", CHAT_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


QUALITY_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
split AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines
  FROM docs),
at_word AS (SELECT row, words, unnest(range(1, len(words) - {quality.WINDOW} + 2)) AS i FROM split),
windows AS (SELECT row, i, words[i:i + {quality.WINDOW - 1}] AS win FROM at_word),
doubled AS (SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, win HAVING count(*) > 1),
covered AS (
  SELECT row, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT row, i + unnest(range(0, {quality.WINDOW})) AS pos FROM doubled) GROUP BY row),
by_line AS (
  SELECT row, line, len(regexp_extract_all(line, '[^ \t-\r]+')) AS n,
         len(regexp_extract_all(line, '{quality.MARKS}')) AS marks,
         len(regexp_extract_all(line, '{quality.SHOUTS}')) AS shouts,
         len(regexp_extract_all(line, '{quality.SEPARATORS}')) AS seps
  FROM (SELECT row, unnest(lines) AS line FROM split)),
ruled AS (
  SELECT row, length(line) AS chars,
         marks * 100 > length(line) * {quality.MARK_SHARE}
         OR (shouts >= 2 AND shouts * {quality.SHOUT_WORDS} >= n)
         OR (n >= {quality.LONG_LINE} AND NOT regexp_matches(line, '{quality.SENTENCE_MARKS}'))
         OR (seps >= 2 AND n - seps <= (seps + 1) * {quality.NAV_WORDS})
         OR (n <= {quality.NOTICE_WORDS} AND regexp_matches(line, '{quality.BOILERPLATE}')) AS bad
  FROM by_line),
lost AS (
  SELECT row, sum(chars) AS line_chars, coalesce(sum(chars) FILTER (bad), 0) AS lost_chars, count(*) FILTER (bad) AS n_bad
  FROM ruled GROUP BY row),
counted AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_bad, 0) AS n_removed_lines, coalesce(lost_chars, 0) AS lost_chars, coalesce(line_chars, 0) AS line_chars
  FROM split LEFT JOIN covered USING (row) LEFT JOIN lost USING (row))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words)
         AND lost_chars * 100 <= line_chars * {quality.MAX_LOST} AS kept,
       n_removed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
FROM counted
"""


@query("op5_quality_rules", QUALITY_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_removed_lines lost_chars".split()
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _urls_sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1]))
    whens = lambda pick: " ".join(f"WHEN {_fits(r)} THEN '{pick(v, r)}'" for v, r in cases)
    low = f"translate(%s, '{hosts.UPPER}', '{hosts.LOWER}')"
    rounds = []
    for k in range(1, hosts.ROUNDS + 1):
        rounds.append(
            f"r{k} AS (SELECT host, kind, sum(score) AS score FROM (SELECT * FROM base UNION ALL "
            f"SELECT s.dst, s.kind, r.score * s.share * {hosts.DAMPING} FROM r{k - 1} r JOIN shares s ON s.src = r.host AND s.kind = r.kind) "
            f"GROUP BY host, kind)"
        )
    link = hosts.LINK.replace("'", "''")
    return rf"""
WITH parsed AS (
  SELECT page_id, html, {low % f"coalesce(regexp_extract(url, '{hosts.ADDRESS}', 1), '')"} AS host,
         coalesce(regexp_extract(url, '{hosts.ADDRESS}', 2), '') AS path
  FROM pages),
named AS (
  SELECT *, CASE {whens(lambda v, r: r)} END AS rule, CASE {whens(lambda v, r: v)} END AS says FROM parsed),
found AS (
  SELECT DISTINCT page_id, host AS src, {low % "dst"} AS dst
  FROM (SELECT page_id, host, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM named)),
links AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS pages FROM found WHERE src <> '' AND src <> dst GROUP BY src, dst),
both_ways AS (SELECT src, dst, 0 AS kind, pages AS w FROM links UNION ALL SELECT dst, src, 1, pages FROM links),
shares AS (SELECT src, dst, kind, w / sum(w) OVER (PARTITION BY src, kind) AS share FROM both_ways),
ruled AS (
  SELECT host, count(*) FILTER (says = 'allow') AS allowed, count(*) FILTER (says = 'block') AS blocked
  FROM named WHERE host <> '' AND says IS NOT NULL GROUP BY host),
base AS (
  SELECT host, kind, seed * (1 - {hosts.DAMPING}) AS score
  FROM (SELECT host, 0 AS kind, allowed / (allowed + blocked) AS seed FROM ruled
        UNION ALL SELECT host, 1, blocked / (allowed + blocked) FROM ruled) WHERE seed > 0),
r0 AS (SELECT * FROM base),
{", ".join(rounds)},
flow AS (
  SELECT host, coalesce(round(sum(score) FILTER (kind = 0), 9), 0) AS trust,
         coalesce(round(sum(score) FILTER (kind = 1), 9), 0) AS distrust
  FROM r{hosts.ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {hosts.OUTWEIGHS} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM named LEFT JOIN flow USING (host)
"""


@query("op9_url_filters", _urls_sql())
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)
    return judged.select("page_id", *[F.col("judged")[c].alias(c) for c in ("host", "path", "rule", "verdict", "trust", "distrust")])


SHARDS = 8


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    sharded = kdtree.kd_shards(
        docs, ["lang", "source", "n_chars"], F.octet_length(text) + 1, n_shards=SHARDS, tie=crc, keep=["doc_id", crc.alias("text_crc32")]
    )
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
