"""Reusable pieces of the check SQL. Written from the rules, not generated from the Spark code."""

from __future__ import annotations

from ..settings import (
    BREADCRUMB_LINE,
    DOT_RE,
    FENCE_LINE,
    HTML_TAG_LINE,
    LINE_WS_RE,
    LINK_LIST_LINE,
    NON_BLANK_LINE,
    PAGINATION_LINE,
    STOP_WORDS,
    WORD_RE,
    WS,
    WS_RE,
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"trim({x}, {lit(WS)})"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(WORD_RE)}))"


def norm_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {lit(WS_RE + '+')}, ' ', 'g'))"


def link_list(x: str) -> str:
    fence, item, line = (lit("(?m)" + p) for p in (FENCE_LINE, LINK_LIST_LINE, NON_BLANK_LINE))
    prose = (
        f"(CASE WHEN contains({x}, '```') THEN array_to_string(list_filter(string_split_regex({x}, {fence}), "
        f"lambda p, i: i % 2 = 1), chr(10)) ELSE {x} END)"
    )
    n = f"len(regexp_extract_all({prose}, {line}))"
    return f"({n} > 0 AND len(regexp_extract_all({prose}, {item})) / {n} > 0.7)"


def terms(x: str) -> str:
    stop = ", ".join(map(lit, STOP_WORDS))
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains([{stop}], w))"


def hashed(name: str, relation: str, key: str, text: str) -> str:
    """CTE `name` (key, vector): feature hashing of words into 64 dimensions, unit length, as FLOAT[]."""
    return f"""
{name}_sums AS (
  SELECT {key}, ('0x' || code[1:2])::INTEGER % 64 AS dim, sum(CASE WHEN ('0x' || code[15:16])::INTEGER >= 128 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM (SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))) AS code FROM {relation})
  GROUP BY {key}, dim),
{name} AS MATERIALIZED (
  SELECT {key}, list_transform(v, lambda x: (x / CASE WHEN n = 0 THEN 1 ELSE sqrt(n) END)::FLOAT) AS vector
  FROM (SELECT {key}, list(coalesce(x, 0) ORDER BY dim) AS v, sum(coalesce(x, 0) * coalesce(x, 0)) AS n
        FROM (SELECT {key}, unnest(range(64))::INTEGER AS dim FROM {relation}) LEFT JOIN {name}_sums USING ({key}, dim) GROUP BY {key}))"""


def chunk_ctes(docs: str) -> str:
    """CTEs `passages` and `chunks` (k, chunk_index, content, heading, path) of the relation `docs` (k, text)."""
    heading = f"^(#{{1,6}}){LINE_WS_RE}+({DOT_RE}+)"
    return f"""
walk AS (
  SELECT k, string_split(text, chr(10)) AS ls, 0 AS n, '' AS buf, false AS fenced, 0 AS prev,
         NULL::VARCHAR AS head, []::VARCHAR[] AS path,
         NULL::VARCHAR AS c1, NULL::VARCHAR AS h1, []::VARCHAR[] AS p1,
         NULL::VARCHAR AS c2
  FROM {docs}
  UNION ALL
  SELECT k, ls, n + 1,
         CASE WHEN full_now THEN '' ELSE buf2 END, fenced2, prev2, head2, path2,
         CASE WHEN cut THEN buf END, head, path, CASE WHEN full_now THEN buf2 END
  FROM (
    SELECT *, (NOT skip AND length(buf2) >= 2000) OR n + 1 = len(ls) AS full_now
    FROM (
      SELECT *, CASE WHEN skip THEN buf WHEN cut THEN ln || chr(10) ELSE buf || ln || chr(10) END AS buf2,
             CASE WHEN lvl > 0 THEN lvl ELSE prev END AS prev2,
             CASE WHEN lvl > 0 THEN title ELSE head END AS head2,
             CASE WHEN lvl > 0 THEN list_resize(path, lvl - 1) || [title] ELSE path END AS path2
      FROM (
        SELECT *, lvl > 0 AND {trimmed("buf")} <> '' AND lvl <= prev AS cut
        FROM (
          SELECT *, CASE WHEN skip THEN 0 ELSE length(regexp_extract(ln, {lit(heading)}, 1)) END AS lvl,
                 regexp_extract(ln, {lit(heading)}, 2) AS title
          FROM (
            SELECT *, NOT fenced2 AND regexp_matches({trimmed("ln")}, {lit(HTML_TAG_LINE)}) AS skip
            FROM (
              SELECT k, ls, n, buf, fenced, prev, head, path, ls[n + 1] AS ln,
                     fenced <> regexp_matches(ls[n + 1], {lit(FENCE_LINE)}) AS fenced2
              FROM walk WHERE n < len(ls)))))))
),
passages AS (
  SELECT k, n, 1 AS slot, {trimmed("c1")} AS content, h1 AS heading, p1 AS path FROM walk WHERE c1 IS NOT NULL
  UNION ALL
  SELECT k, n, 2, {trimmed("c2")}, head, path FROM walk WHERE c2 IS NOT NULL
),
judged AS (
  SELECT *, {link_list("content")} AS is_list FROM passages WHERE length(content) > 50
),
chunks AS (
  SELECT k, (row_number() OVER (PARTITION BY k ORDER BY n, slot) - 1)::INTEGER AS chunk_index, content, heading, path,
         {words("content")}::INTEGER AS token_count
  FROM judged WHERE NOT is_list
)"""


# documents in the shape of the model
DOCS = """
docs AS (
  SELECT md5(md5(source) || '|doc://' || doc_id) AS k, md5(source) AS source_id, source AS source_name,
         'doc://' || doc_id AS url, lang || ' ' || doc_id AS title, doc_id AS seq, lang, text
  FROM documents
)"""
DOC_CHUNKS = f"WITH RECURSIVE {DOCS}, {chunk_ctes('docs')}"

MARKED_LINE = """CASE WHEN length(l) = 0 THEN l WHEN length(l) < 12 THEN '# ' || l WHEN length(l) < 18 THEN '## ' || l
  WHEN length(l) < 24 THEN '### ' || l WHEN length(l) < 30 THEN '#### ' || l WHEN length(l) < 34 THEN '```'
  WHEN length(l) < 38 THEN '<div class="card">' WHEN length(l) < 70 THEN '- [' || l || '](/x)' ELSE l END"""
MARKED = f"""
marked AS (
  SELECT doc_id AS k, md5(source) AS source_id,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l: {MARKED_LINE}), chr(10)) AS text
  FROM documents
)"""

NOISY_LINE = """CASE WHEN length(l) = 0 THEN l WHEN length(l) < 18 THEN 'Next: [' || l || '](/n)'
  WHEN length(l) < 26 THEN '  [Home](/) › [Docs](/d) » [' || l || '](/x) ' WHEN length(l) < 32 THEN '```'
  WHEN length(l) < 40 THEN 'prev | [' || l || '](/p)' ELSE l END"""
NOISE = f"(regexp_matches({trimmed('ln')}, {lit(PAGINATION_LINE)}) OR regexp_matches({trimmed('ln')}, {lit(BREADCRUMB_LINE)}))"


def numbered_lines(relation: str, key: str, text: str = "text") -> str:
    """Subquery (key, pos, ln, fenced): lines with whether they stand inside or on a fence."""
    return f"""(
  SELECT *, is_fence OR (sum(is_fence::INT) OVER (PARTITION BY {key} ORDER BY pos)) % 2 = 1 AS fenced
  FROM (SELECT {key}, pos, ln, regexp_matches(ln, {lit(FENCE_LINE)}) AS is_fence
        FROM (SELECT {key}, unnest(ls) AS ln, generate_subscripts(ls, 1) AS pos
              FROM (SELECT {key}, string_split({text}, chr(10)) AS ls FROM {relation}))))"""


# pages
NAV = "regexp_extract(html, '<nav><ul>(.*?)</ul></nav>', 1)"
H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
PAGE_LANG = "regexp_extract(html, '<html lang=\"([a-z]*)\"', 1)"
ITEM = "'<li><a href=\"([^\"]*)\">([^<]*)</a></li>'"


def entities(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


def element_text(tag: str) -> str:
    inner = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return f"nullif({trimmed(entities(f'''regexp_replace({inner}, '<[^>]*>', '', 'g')'''))}, '')"


PAGE_TITLE = f"coalesce({element_text('title')}, {element_text('h1')}, '')"


def origin(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([a-zA-Z]+://[^/?#]+)', 1))"


def path(x: str) -> str:
    return f"(CASE WHEN regexp_extract({x}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({x}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END)"


def encoded(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN ch = '' THEN '' "
        f"WHEN regexp_matches(ch, '[\\x00-\\x20\"<>^`{{}}\\x7f-\\x{{10ffff}}]') THEN url_encode(ch) ELSE ch END), '')"
    )


def normalized(x: str) -> str:
    p = f"regexp_replace({encoded(path(x))}, '/index\\.html?$', '')"
    filled = f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
    short = f"(CASE WHEN length({filled}) > 1 THEN regexp_replace({filled}, '/$', '') ELSE {filled} END)"
    return f"({origin(x)} || {short} || {encoded(f'''regexp_extract({x}, '^[^?#]*(\\?[^#]+)', 1)''')})"


# jobs
JOBS = """
jobs AS (
  SELECT event_id AS id, md5('src' || (user_id % 20)) AS source_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'running'
                         WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'cancelled' END AS status,
         (json_extract_string(props, '$.k')::INTEGER) AS k,
         (json_extract_string(props, '$.k')::INTEGER) % 5 AS retry_count,
         3 AS max_retries,
         CASE WHEN event_type NOT IN ('view', 'signup') THEN floor(value * 1000)::INTEGER END AS duration_ms,
         ts AS created_at
  FROM events
)"""
SOURCES = "sources AS (SELECT DISTINCT md5(source) AS id, source AS name, 'src://' || source AS url, length(source) > 4 AS enabled FROM documents)"


def duration_text(x: str) -> str:
    s = f"floor({x} / 1000)::BIGINT"
    return f"""CASE WHEN {x} IS NULL THEN '—' WHEN {x} < 1000 THEN '< 1s'
      WHEN {s} >= 3600 THEN ({s} // 3600) || 'h' || CASE WHEN ({s} // 60) % 60 > 0 THEN ' ' || (({s} // 60) % 60) || 'm' ELSE '' END
      WHEN {s} >= 60 THEN ({s} // 60) || 'm' || CASE WHEN {s} % 60 > 0 THEN ' ' || ({s} % 60) || 's' ELSE '' END
      ELSE {s} || 's' END"""
