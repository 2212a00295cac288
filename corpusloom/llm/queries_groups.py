"""Registered queries of the operators on word variants, fingerprints and token alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, simhash, spelling
from .queries_native import documents


DROP_EVERY = 199  # the contract's typing errors: one letter goes where this divides the crc32


def op11_spelling_groups(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(documents(spark, d), drop_every=DROP_EVERY))


def op12_simhash_bk_trees(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.linked_documents(documents(spark, d))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def tokenizer_files() -> alignment.Tokenizers:
    """The public byte-level vocabulary, in both of its forms, and the public piece model."""
    import public_tokenizers as public

    return alignment.Tokenizers(
        public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    )


def op13_diagonal_alignment(spark: SparkSession, d: str) -> DataFrame:
    found = alignment.aligned_documents(documents(spark, d), tokenizer_files(), keep_groups=False)
    return found.withColumnRenamed("groups", "groups_sha256")


_RUN = f"[{spelling.LETTERS}]{{{spelling.MIN_LENGTH},}}"
_TABLE = "list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)"
_ASCII = "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(({_TABLE})::BIGINT ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_ASCII.upper()}', '{_ASCII}'), '{_RUN}')) AS run FROM documents)
  GROUP BY ALL
),
coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs),
bytes AS (SELECT run, n, [('0x' || code[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(code) // 2)] AS bytes FROM coded),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(bytes,
    lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295::BIGINT)) AS h
  FROM bytes, crc
),
typed AS (
  SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, n FROM hashed
),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE len(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest
  UNION ALL
  SELECT x.word, y.word FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word < y.word
),
near AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
best AS (
  SELECT a AS word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS form, max(w.n) AS form_n
  FROM near JOIN words w ON w.word = b GROUP BY a
),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.FORM_RATIO} * n THEN form END AS form,
    CASE WHEN form_n >= {spelling.FORM_RATIO} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT walk.word, form FROM walk JOIN formed ON formed.word = walk.root WHERE form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk USING (word) JOIN formed last ON last.word = walk.root
WHERE last.form IS NULL
"""

QUERIES = {
    "op11_spelling_groups": op11_spelling_groups,
    "op12_simhash_bk_trees": op12_simhash_bk_trees,
    "op13_diagonal_alignment": op13_diagonal_alignment,
}
ORACLES = {"op11_spelling_groups": OP11_SQL}
