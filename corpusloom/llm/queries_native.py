"""Registered queries of the operators that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, quality_rules, secrets, sharding


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.with_spans(documents(spark, d).select("doc_id", "text"))
    n_base = len(secrets.BASE_RULES)
    counts = [_of_kind(rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES]
    base = secrets.told(F.filter("spans", lambda s: s["order"] < n_base))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.told(F.col("spans")).alias("spans"))


def op3_line_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.clean_lines(documents(spark, d)).drop("cleaned")


def op9_rendezvous_shards(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, d))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_reply_trees(spark: SparkSession, d: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    done = chat.format_trees(chat.message_tree(given.unionByName(own)))
    read = done.select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(rule: secrets.Rule, order: int) -> str:
    pattern = _quoted(rule.pattern)
    at = "coalesce(list_sum([len(x) FOR x IN gaps[1:i]]), 0) + coalesce(list_sum([len(x) FOR x IN found[1:i - 1]]), 0)"
    return f"""
SELECT doc_id, {order} AS k, '{rule.kind}' AS kind, a AS a, a + len(found[i]) AS b FROM (
  SELECT doc_id, found, i, ({at})::BIGINT AS a FROM (
    SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, {pattern}) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS secret,
        regexp_split_to_array(t, {pattern}) AS gaps
      FROM d WHERE regexp_matches(t, {pattern})
    )
  ) WHERE len(secret[i]) >= {rule.least}
)"""


_TOLD = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(rule, k) for k, rule in enumerate(secrets.RULES))}),
g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
    {_TOLD} FILTER (k < {len(secrets.BASE_RULES)}) AS base, {_TOLD} AS spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{quality_rules.WORD}') AS ws FROM d),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '{quality_rules.WORD}')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
),
once AS (SELECT doc_id, l, any_value(n) AS n, count(*) AS c FROM lines WHERE n > 0 GROUP BY doc_id, l),
judged AS (
  SELECT doc_id, n, c,
    len(l) - len(translate(l, {_quoted(quality_rules.SYMBOLS)}, '')) AS symbols,
    len(l) - len(translate(l, {_quoted(quality_rules.SEPARATORS)}, '')) AS separators,
    len(l) - len(replace(l, '!', '')) AS marks,
    regexp_matches(l, '{quality_rules.SENTENCE_MARKS}') AS sentence,
    regexp_matches(l, {_quoted(quality_rules.BOILERPLATE)}) AS boilerplate
  FROM once
),
found AS (
  SELECT doc_id, sum(c - 1) AS dup,
    sum(CASE WHEN symbols * {quality_rules.PER_SYMBOL} < n AND separators * {quality_rules.PER_SYMBOL} < n
      AND marks * {quality_rules.PER_MARK} < n AND (n < {quality_rules.UNPUNCTUATED} OR sentence) AND NOT boilerplate
      THEN n ELSE 0 END) AS good
  FROM judged GROUP BY doc_id
),
facts AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    len(regexp_replace(t, '{quality_rules.GAP}', '', 'g'))::BIGINT AS word_chars,
    (len(t) - len(translate(t, {_quoted(quality_rules.SYMBOLS)}, '')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(ws) - coalesce(good, 0))::BIGINT AS n_lost_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN found USING (doc_id)
)
SELECT *, n_words < {quality_rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MAX_REPEATED} AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MAX_REPEATED})
  AND n_lost_words * 100 <= n_words * {quality_rules.MAX_LOST} AS kept
FROM facts
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op3_line_cleaning": op3_line_cleaning,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_reply_trees": op10_reply_trees,
}
ORACLES = {"op1_secret_scan": OP1_SQL, "op3_line_cleaning": OP3_SQL}
