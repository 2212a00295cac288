"""Registered queries: sources, sinks and the text-to-chunk operators, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_link_list, long_enough, strip_crawler_noise, strip_html_lines, word_count
from ..operators.chunking import (
    chunk_markdown,
    chunk_sets,
    heading_outline,
    link_list_counts,
)
from ..settings import HTML_TAG_LINE, materialise, scratch_path
from ..sources.files import read_index, read_markdown_tree, read_pages, repo_digest, select_repo_docs, write_index, write_tree
from ..sources.listings import (
    discover_sources,
    llms_full_to_docs,
    llms_links,
    llms_meta,
    packages_to_docs,
    parse_url_list,
)
from ..sources.openapi import openapi_chunks, openapi_operations
from . import tables as t
from .snippets import (
    DOC_CHUNKS,
    H1,
    ITEM,
    MARKED,
    NAV,
    NOISE,
    NOISY_LINE,
    PAGE_LANG,
    PAGE_TITLE,
    chunk_ctes,
    link_list,
    lit,
    numbered_lines,
    path,
    trimmed,
    words,
)


def src_markdown_tree(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as text files, one file each in the folder of its source, and read back as a tree.

    The folders of the sources lie below 64 numbered ones, so that tasks list them.
    """
    root = scratch_path(spark, "tree")
    docs = t.spread(t.table(spark, d, "documents").select("source", "text"))
    write_tree(docs.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64))), root, "part", "source")
    files = read_markdown_tree(spark, root, "*.txt")
    folder = F.regexp_replace(F.regexp_extract("title", "(?:^|/)source=([^/]*)/", 1), r"\+", "%2B")
    return files.groupBy(F.url_decode(folder).alias("source")).agg(F.sum(F.length("text")).alias("n_chars"))


def src_url_list(spark, d):
    return parse_url_list(t.url_lists(spark, d))


def src_package_json(spark, d):
    return packages_to_docs(t.packages(spark, d)).select("url", "title", F.md5("text").alias("text_hash"))


def src_repo_docs(spark, d):
    docs = select_repo_docs(t.repo_files(spark, d))
    return docs.select("repo", "url", "title", F.md5("text").alias("text_hash"))


def src_llms_full(spark, d):
    files = t.markdown_documents(spark, d).select(
        "source_id", F.col("doc_id").cast("string").alias("name"), F.concat(F.lit("doc://"), "doc_id").alias("url"), "text"
    )
    return llms_full_to_docs(files).select("url", "title", F.md5("text").alias("text_hash"))


def src_pages(spark, d):
    pages = read_pages(spark, f"{d}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"))


def sink_index(spark, d):
    """All sources are written, then one of them again with new titles; every row is read back."""
    path_ = scratch_path(spark, "index")
    docs = t.docs(spark, d).drop("seq", "lang")
    chunks = materialise(t.chunks(spark, d).drop("created_at"), "chunks")
    vectors = chunks.select(F.col("id").alias("chunk_id"), F.md5("content").alias("model"))
    write_index({"docs": docs, "chunks": chunks, "embeddings": vectors}, path_)
    one = F.col("source_id") == F.md5(F.lit("src3"))
    again = read_index(spark, path_, "chunks")["chunks"].filter(one).join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    part = {"docs": docs.filter(one).withColumn("title", F.upper("title")), "chunks": materialise(again, "again")}
    write_index(part | {"embeddings": vectors.join(part["chunks"].select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")}, path_)
    stored = read_index(spark, path_, "docs", "chunks", "embeddings")
    joined = stored["chunks"].join(stored["embeddings"].select(F.col("chunk_id").alias("id"), "model"), "id")
    named = joined.join(stored["docs"].select(F.col("id").alias("doc_id"), "url", "title"), "doc_id")
    return named.select("source_id", "url", "title", "chunk_index", F.md5("content").alias("content_hash"), "model")


def sink_repo_digest(spark, d):
    digest = repo_digest(t.repo_files(spark, d))
    return digest.select("repo", "section", "path", F.md5("line").alias("line_hash"))


def _path_text(c: str = "heading_path"):
    return F.array_join(c, " > ", "~").alias("path_text")


def chunk_markdown_q(spark, d):
    rows = chunk_markdown(t.markdown_documents(spark, d))
    return rows.select(
        "doc_id", "chunk_index", F.md5("content").alias("content_hash"), "heading", _path_text(), "token_count"
    )


def chunk_size_only(spark, d):
    rows = chunk_markdown(t.documents(spark, d).select("doc_id", "text"))
    return rows.select("doc_id", "chunk_index", F.md5("content").alias("content_hash"), "token_count")


def strip_html_lines_q(spark, d):
    docs = t.markdown_documents(spark, d)
    return docs.select("doc_id", F.md5(strip_html_lines(F.col("text"))).alias("text_hash"))


def is_link_list_q(spark, d):
    docs = t.markdown_documents(spark, d).select(F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("content"))
    pieces = t.page_snippets(spark, d).select("id", "content")
    return docs.unionByName(pieces).select("id", is_link_list(F.col("content")).alias("link_list"))


def drop_link_lists_q(spark, d):
    stored = link_list_counts(t.page_snippets(spark, d)).select("source_id", "kept", "dropped")
    sets = chunk_sets(t.markdown_documents(spark, d))
    imported = sets.groupBy("source_id").agg(
        F.sum(F.size("chunks")).alias("kept"), F.sum("dropped").alias("dropped")
    )
    return stored.unionByName(imported)


def min_length_q(spark, d):
    return t.table(spark, d, "conversations").filter(long_enough(F.col("text"))).select("conv_id", "turn")


def word_count_q(spark, d):
    return t.table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"))


def heading_outline_q(spark, d):
    rows = heading_outline(t.markdown_documents(spark, d))
    return rows.select("doc_id", "pos", "level", "heading", _path_text("path"))


def strip_crawler_noise_q(spark, d):
    docs = t.noisy_documents(spark, d)
    return docs.select("doc_id", F.md5(strip_crawler_noise(F.col("text"))).alias("text_hash"))


def openapi_chunks_q(spark, d):
    rows = openapi_chunks(t.api_specs(spark, d))
    return rows.select("source_id", "chunk_index", "doc_title", "heading", _path_text(), "content")


def openapi_operations_q(spark, d):
    return openapi_operations(t.api_specs(spark, d))


def _links_with_meta(spark, d):
    files = t.page_links_text(spark, d)
    meta = llms_meta(files).withColumnRenamed("description", "about")
    return llms_links(files).join(meta, "source_id")


def discover_sources_q(spark, d):
    known = (
        t.page_links_text(spark, d)
        .join(t.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", t.page_title(F.col("html")).alias("p")), "source_id")
        .select(F.when(F.length("p") > 40, F.col("url")).otherwise(F.concat("url", F.lit("/llms.txt"))).alias("url"))
    )
    return discover_sources(t.page_links_text(spark, d), known.filter("url not like '%?%'"))


QUERIES = {
    "src_markdown_tree": src_markdown_tree,
    "src_url_list": src_url_list,
    "src_package_json": src_package_json,
    "src_repo_docs": src_repo_docs,
    "src_llms_full": src_llms_full,
    "src_pages": src_pages,
    "sink_index": sink_index,
    "sink_repo_digest": sink_repo_digest,
    "chunk_markdown": chunk_markdown_q,
    "chunk_size_only": chunk_size_only,
    "strip_html_lines": strip_html_lines_q,
    "is_link_list": is_link_list_q,
    "drop_link_lists": drop_link_lists_q,
    "min_length": min_length_q,
    "word_count": word_count_q,
    "heading_outline": heading_outline_q,
    "strip_crawler_noise": strip_crawler_noise_q,
    "openapi_chunks": openapi_chunks_q,
    "openapi_operations": openapi_operations_q,
    "llms_links": _links_with_meta,
    "discover_sources": discover_sources_q,
}

REPO_FILES = """
repo_files AS (
  SELECT 'https://git.example/' || source AS repo, source, text AS content,
         CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN 'README.md'
              WHEN doc_id = max(doc_id) OVER (PARTITION BY source) THEN 'readme'
              WHEN lang = 'fr' AND length(source) = 4 THEN 'docs/' || doc_id || '.md'
              WHEN lang = 'es' THEN 'doc/' || doc_id || '.md'
              WHEN lang = 'de' THEN 'documentation/a/' || doc_id || '.md'
              WHEN n_chars < 300 THEN 'test/' || doc_id || '.md'
              ELSE 'src/' || doc_id || '.md' END AS path
  FROM documents
),
ranked AS (
  SELECT *, list_position(['README.md', 'readme.md', 'README', 'readme'], path) AS r,
         CASE WHEN contains(path, '/') THEN list_position(['docs', 'doc', 'documentation'], split_part(path, '/', 1)) END AS dir
  FROM repo_files
),
best AS (
  SELECT *, min(nullif(r, 0)) OVER (PARTITION BY repo) AS best_r, min(nullif(dir, 0)) OVER (PARTITION BY repo) AS best_dir
  FROM ranked
),
repo_docs AS (
  SELECT repo, path, content, coalesce(r = best_r AND r > 0, false) AS is_readme,
         CASE WHEN r = best_r AND r > 0 THEN repo ELSE repo || '/' || path END AS url,
         CASE WHEN r = best_r AND r > 0 THEN source || ' README' ELSE source || path END AS title
  FROM best
  WHERE coalesce(r = best_r AND r > 0, false)
     OR coalesce(dir = best_dir AND dir > 0 AND regexp_matches(path, '^[^/]+/[^/]+\\.md$'), false)
)"""

LINK_TEXT = f"""
link_text AS (
  SELECT page_id::VARCHAR AS source_id,
         '# ' || {H1} || chr(10) || chr(10) || '> Page ' || page_id || '  ' || chr(10) || '> second line' || chr(10) || chr(10)
         || '## Links' || chr(10) || regexp_replace({NAV}, {ITEM}, '- [\\2](https://docs.example\\1)' || chr(10), 'g')
         || '- not a link' || chr(10) || '## Optional' || chr(10) || '- [Self](' || url || '): the page itself ' || chr(10)
         || '- [Spec](https://api.example/' || page_id || '.json)' || chr(10) AS text
  FROM pages
),
link_lines AS (
  SELECT source_id, pos, rtrim(ln, {lit(' ' + chr(9) + chr(13) + chr(160))}) AS ln
  FROM (SELECT source_id, unnest(ls) AS ln, generate_subscripts(ls, 1) - 1 AS pos
        FROM (SELECT source_id, string_split(text, chr(10)) AS ls FROM link_text))
)"""

ORACLES = {
    "src_markdown_tree": "SELECT source, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY source",
    "src_url_list": f"""
WITH lists AS (
  SELECT page_id::VARCHAR AS source_id,
         '# list ' || page_id || chr(10) || '  ' || url || chr(10)
         || regexp_replace({NAV}, '<li><a href="([^"]*)">[^<]*</a></li>', chr(9) || 'https://list.example\\1 ' || chr(10) || chr(10), 'g')
         || ' # end' AS text
  FROM pages)
SELECT source_id, pos::INTEGER AS pos, url FROM (
  SELECT source_id, pos, {trimmed('ln')} AS url FROM (
    SELECT source_id, unnest(ls) AS ln, generate_subscripts(ls, 1) - 1 AS pos
    FROM (SELECT source_id, string_split(text, chr(10)) AS ls FROM lists)))
WHERE url <> '' AND url NOT LIKE '#%'""",
    "src_package_json": """
SELECT 'pkg://' || doc_id AS url,
       'pkg-' || doc_id || CASE WHEN lang <> 'fr' THEN ': about ' || source ELSE '' END AS title,
       md5(text) AS text_hash
FROM documents WHERE lang <> 'de' AND text <> ''""",
    "src_repo_docs": f"WITH {REPO_FILES} SELECT repo, url, title, md5(content) AS text_hash FROM repo_docs",
    "src_llms_full": f"""
WITH {MARKED}
SELECT 'doc://' || k AS url, md5(text) AS text_hash,
       coalesce((SELECT {trimmed('substring(ln, 3)')} FROM (
           SELECT unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS pos)
         WHERE ln LIKE '# %' ORDER BY pos LIMIT 1), k::VARCHAR) AS title
FROM marked""",
    "src_pages": "SELECT page_id, url, length(html)::INTEGER AS n_chars FROM pages",
    "sink_index": f"""{DOC_CHUNKS}
SELECT source_id, url, CASE WHEN source_name = 'src3' THEN upper(title) ELSE title END AS title, chunk_index,
       md5(content) AS content_hash, md5(content) AS model
FROM chunks JOIN docs USING (k)""",
    "sink_repo_digest": f"""
WITH {REPO_FILES},
repos AS (SELECT DISTINCT repo FROM repo_files),
lines AS (
  SELECT repo, 1 AS section, '' AS path, '# Repository Documentation' || chr(10) || chr(10) || '**Source:** ' || repo || chr(10) AS line FROM repos
  UNION ALL SELECT repo, 2, '', '## Overview' || chr(10) || chr(10) || content || chr(10) FROM repo_docs WHERE is_readme
  UNION ALL SELECT repo, 3, '', 'Repository Structure:' || chr(10) || '```' FROM repos
  UNION ALL SELECT repo, 3, path, repeat('  ', length(path) - length(replace(path, '/', ''))) || '📄 ' || string_split(path, '/')[-1]
            FROM repo_files WHERE NOT (contains(path, 'test') OR contains(path, 'dist') OR contains(path, 'build')
              OR contains(path, '.git') OR contains(path, 'node_modules') OR contains(path, '__pycache__'))
  UNION ALL SELECT repo, 3, chr(1114111), '```' || chr(10) FROM repos
  UNION ALL SELECT DISTINCT repo, 4, '', '## Documentation Files' || chr(10) FROM repo_docs WHERE NOT is_readme
  UNION ALL SELECT repo, 4, path, '- ' || path FROM repo_docs WHERE NOT is_readme
)
SELECT repo, section, path, md5(line) AS line_hash FROM lines""",
    "chunk_markdown": f"""WITH RECURSIVE {MARKED}, {chunk_ctes('marked')}
SELECT k AS doc_id, chunk_index, md5(content) AS content_hash, heading,
       array_to_string(list_transform(path, lambda p: coalesce(p, '~')), ' > ') AS path_text, token_count FROM chunks""",
    "chunk_size_only": f"""{DOC_CHUNKS}
SELECT d.seq AS doc_id, chunk_index, md5(content) AS content_hash, token_count FROM chunks JOIN docs d USING (k)""",
    "strip_html_lines": f"""WITH {MARKED}
SELECT k AS doc_id, md5(coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (
         fenced OR NOT regexp_matches({trimmed('ln')}, {lit(HTML_TAG_LINE)})), '')) AS text_hash
FROM {numbered_lines('marked', 'k')} GROUP BY k""",
    "is_link_list": f"""WITH {MARKED},
items AS (
  SELECT 'doc' || k AS id, text AS content FROM marked
  UNION ALL SELECT page_id || '-nav', regexp_replace({NAV}, {ITEM}, '- [\\2](\\1)' || chr(10), 'g') FROM pages
  UNION ALL SELECT page_id || '-head', {H1} FROM pages)
SELECT id, {link_list('content')} AS link_list FROM items""",
    "drop_link_lists": f"""WITH RECURSIVE {MARKED}, {chunk_ctes('marked')},
items AS (
  SELECT {PAGE_LANG} AS source_id, regexp_replace({NAV}, {ITEM}, '- [\\2](\\1)' || chr(10), 'g') AS content FROM pages
  UNION ALL SELECT {PAGE_LANG}, {H1} FROM pages)
SELECT source_id, count(*) FILTER (NOT ll) AS kept, count(*) FILTER (ll) AS dropped
FROM (SELECT source_id, {link_list('content')} AS ll FROM items) GROUP BY source_id
UNION ALL
SELECT m.source_id, count(j.k) FILTER (NOT is_list), count(j.k) FILTER (is_list)
FROM marked m LEFT JOIN judged j USING (k) GROUP BY m.source_id""",
    "min_length": f"SELECT conv_id, turn FROM conversations WHERE length({trimmed('text')}) > 50",
    "word_count": f"SELECT doc_id, {words('text')}::INTEGER AS n_words FROM documents",
    "heading_outline": f"""WITH {MARKED},
heads AS (
  SELECT k, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::INTEGER AS pos,
         length(regexp_extract(ln, '^(#{{1,6}})[ \\t]', 1))::INTEGER AS level, regexp_extract(ln, '^#{{1,6}}[ \\t]+(.*)', 1) AS heading
  FROM (SELECT k, unnest(ls) AS ln, generate_subscripts(ls, 1) AS pos FROM (SELECT k, string_split(text, chr(10)) AS ls FROM marked))
  WHERE regexp_matches(ln, '^#{{1,6}}[ \\t]+.')
)
SELECT k AS doc_id, pos, level, heading,
       array_to_string(list_transform(range(1, level), lambda lv: coalesce(
         (list_filter(before, lambda b: b.level = lv AND
            len(list_filter(before, lambda o: o.level < lv AND o.pos > b.pos)) = 0)[-1]).heading, '~')) || [heading], ' > ') AS path_text
FROM (SELECT *, coalesce(list({{'pos': pos, 'level': level, 'heading': heading}}) OVER (
        PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM heads)""",
    "strip_crawler_noise": f"""
WITH noisy AS (
  SELECT doc_id AS k, array_to_string(list_transform(string_split(text, chr(10)), lambda l: {NOISY_LINE}), chr(10)) AS text FROM documents)
SELECT k AS doc_id, md5(coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (fenced OR NOT {NOISE}), '')) AS text_hash
FROM {numbered_lines('noisy', 'k')} GROUP BY k""",
    "openapi_chunks": f"""
WITH p AS (SELECT page_id::VARCHAR AS source_id, {PAGE_LANG} AS lang, {PAGE_TITLE} AS title, {path('url')} AS path FROM pages),
q AS (SELECT *, (lang = 'en' AND title <> '')::INTEGER AS shift FROM p)
SELECT source_id, 0 AS chunk_index, 'API ' || source_id AS doc_title, 'Description' AS heading, 'Description' AS path_text, title AS content
FROM q WHERE shift = 1
UNION ALL
SELECT source_id, shift, 'API ' || source_id, 'Schema: Page' || source_id, 'Schemas > Page' || source_id,
       array_to_string(['Schema: Page' || source_id, 'type: object', 'required: [id]', 'properties:', '  id: type: integer',
                        '  names: type: array', '    items: type: string'], chr(10))
FROM q
UNION ALL
SELECT source_id, shift + 1, 'GET ' || path, title, lang || ' > page > ' || title,
       array_to_string(list_filter([title, 'Operation ID: get' || source_id, 'Tags: ' || lang || ', page',
         'Parameters:' || chr(10) || '- ref (query) [required] ' || chr(10) || '    schema: type: string',
         'Responses:' || chr(10) || '- 200: fine' || chr(10) || '- 404: not here'], lambda x: x <> ''), chr(10) || chr(10))
FROM q
UNION ALL
SELECT source_id, shift + 2, 'DELETE ' || path, 'DELETE ' || path, 'DELETE ' || path,
       array_to_string(['remove the page', 'Operation ID: N/A', 'Tags: N/A', 'Deprecated: true'], chr(10) || chr(10))
FROM q""",
    "openapi_operations": f"""
WITH p AS (SELECT page_id::VARCHAR AS source_id, {PAGE_LANG} AS lang, {PAGE_TITLE} AS title, {path('url')} AS path FROM pages)
SELECT source_id, 0 AS pos, path, 'GET' AS method, 'get' || source_id AS operation_id, title AS summary,
       lang || ', page' AS tags, 1 AS n_params, false AS deprecated FROM p
UNION ALL SELECT source_id, 1, path, 'DELETE', NULL, NULL, '', 0, true FROM p""",
    "llms_links": f"""WITH {LINK_TEXT},
placed AS (
  SELECT *, max_by(ln, pos) FILTER (ln LIKE '## %' OR ln LIKE '# %') OVER (
    PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM link_lines),
meta AS (
  SELECT source_id, arg_max({trimmed('substring(ln, 3)')}, pos) FILTER (ln LIKE '# %') AS title,
         string_agg({trimmed('substring(ln, 3)')}, ' ' ORDER BY pos) FILTER (ln LIKE '> %') AS about
  FROM link_lines GROUP BY source_id)
SELECT source_id, pos::INTEGER AS pos, regexp_extract(ln, '^- \\[([^\\]]+)\\]', 1) AS label,
       regexp_extract(ln, '^- \\[[^\\]]+\\]\\(([^)]+)\\)', 1) AS url,
       regexp_extract(ln, '^- \\[[^\\]]+\\]\\([^)]+\\):\\s*(.*)$', 1) AS description,
       lower(section) = '## optional' AS optional, title, about
FROM placed JOIN meta USING (source_id)
WHERE regexp_matches(ln, '^- \\[[^\\]]+\\]\\([^)]+\\)(:\\s*(.*))?$')""",
    "discover_sources": f"""WITH {LINK_TEXT},
known AS (
  SELECT CASE WHEN length({PAGE_TITLE}) > 40 THEN url ELSE url || '/llms.txt' END AS url FROM pages WHERE NOT contains(
    CASE WHEN length({PAGE_TITLE}) > 40 THEN url ELSE url || '/llms.txt' END, '?')),
links AS (
  SELECT source_id, pos, regexp_extract(ln, '\\[([^\\]]+)\\]\\s*\\(([^)]+)\\)', 1) AS name,
         regexp_extract(ln, '\\[([^\\]]+)\\]\\s*\\(([^)]+)\\)', 2) AS url
  FROM link_lines WHERE regexp_matches(ln, '-\\s*\\[([^\\]]+)\\]\\s*\\(([^)]+)\\)')),
firsts AS (SELECT url, arg_min(name, {{'s': source_id, 'p': pos}}) AS name FROM links GROUP BY url)
SELECT name, url, CASE WHEN regexp_matches(url, '\\.(json|yaml|yml)$') THEN 'openapi' ELSE 'llmstxt-crawl' END AS importer_type
FROM firsts WHERE url NOT IN (SELECT url FROM known)
  AND regexp_replace(url, '/?$', '/llms.txt') NOT IN (SELECT url FROM known)""",
}
