"""Registered queries on pages and the link graph, with their check SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.html import html_to_markdown, main_html, page_title
from ..functions.text import content_hash, norm_key, strip_crawler_noise
from ..functions.urls import normalize_url, url_origin
from ..operators.chunking import chunk_markdown
from ..operators.crawl import (
    apply_budget,
    crawl_seeds,
    canonicalize,
    crawl_plan,
    cut_on_failures,
    expand_sitemaps,
    extract_links,
    failure_drops,
    filter_links,
    reachable,
    robots_filter,
    robots_rules,
    sitemap_locs,
)
from ..operators.dedup import dedup_chunks
from ..settings import materialise
from ..sources.registry import pages_to_docs
from . import tables as t
from .snippets import (
    DOCS,
    DOC_CHUNKS,
    ITEM,
    NAV,
    PAGE_TITLE,
    chunk_ctes,
    normalized,
    origin,
    path,
    trimmed,
)

AGENT = "LoomBot"


def page_title_q(spark, d):
    return t.pages(spark, d).select("page_id", page_title(F.col("html")).alias("title"))


def page_main_content(spark, d):
    return t.pages(spark, d).select("page_id", F.md5(main_html(F.col("html"))).alias("main_hash"))


def page_markdown(spark, d):
    text = strip_crawler_noise(html_to_markdown(F.col("html")))
    return t.pages(spark, d).select("page_id", text.alias("markdown"))


def page_chunks(spark, d):
    """Pages to markdown to chunks; passages repeated on several pages are kept once."""
    raw = t.pages(spark, d).select(F.lit("web").alias("source_id"), "url", "html")
    docs = pages_to_docs(raw).withColumnRenamed("url", "doc_url").withColumnRenamed("title", "doc_title")
    rows = dedup_chunks(chunk_markdown(docs), "source_id", ("doc_url", "chunk_index"))
    return rows.select("doc_url", "doc_title", "chunk_index", "heading", "content", "token_count")


def _all_urls(spark, d):
    raw = t.table(spark, d, "pages").select("url")
    folders = raw.select(F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("/index.html#part")).alias("url"))
    return raw.unionByName(folders)


def normalize_url_q(spark, d):
    return _all_urls(spark, d).select("url", normalize_url(F.col("url")).alias("normalized"))


def canonical_url(spark, d):
    """Pages of which those with a query string name the plain address as canonical."""
    plain = F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "^https?://[^/]*", "")
    tag = F.concat(F.lit('<head><link href="'), plain, F.lit('/" rel="canonical">'))
    html = F.when(F.col("url").contains("?"), F.replace(F.col("html"), F.lit("<head>"), tag)).otherwise(F.col("html"))
    pages = t.pages(spark, d).select("page_id", "url", html.alias("html"))
    return canonicalize(pages).select("page_id", "page_url", "canonical_url", "effective_url")


def page_links(spark, d):
    return extract_links(t.pages(spark, d))


def filter_links_q(spark, d):
    """Page to page and page to navigation edges under a crawl configuration."""
    nav = extract_links(t.pages(spark, d))
    files = nav.select("page_url", F.concat("link", F.lit(".pdf")).alias("link"))
    feeds = t.pages(spark, d).select(
        F.concat(F.lit("https://www.start.example"), F.regexp_replace("url", "^https?://[^/]*|[?#].*", "")).alias("page_url"),
        normalize_url(F.col("url")).alias("link"),
    )
    edges = nav.unionByName(files).unionByName(feeds)
    return filter_links(edges, excluded_prefixes=("/a", "/de/"))


def robots_rules_q(spark, d):
    return robots_rules(t.robots_files(spark, d), AGENT)


def robots_filter_q(spark, d):
    rules = robots_rules(t.robots_files(spark, d), AGENT)
    return robots_filter(t.table(spark, d, "pages").select("page_id", "url"), rules)


def crawl_reach(spark, d):
    """Reach in a catalogue whose supplier pages link to parts and whose part pages link back."""
    lines = t.table(spark, d, "lineitem")
    part = F.concat(F.lit("/part/"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("/supplier/"), F.col("l_suppkey").cast("string"))
    edges = lines.select(supplier.alias("src"), part.alias("dst")).unionByName(lines.select(part.alias("src"), supplier.alias("dst")))
    seeds = t.table(spark, d, "supplier").agg(F.concat(F.lit("/supplier/"), F.min("s_suppkey").cast("string")).alias("url"))
    return reachable(edges.distinct(), seeds)


def _catalogue(spark, d):
    """Links of a shop: supplier pages list their parts and part pages their suppliers, in the order of the first sale."""
    sold = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    pairs = t.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(sold).alias("link_pos"))
    part = F.concat(F.lit("https://shop.example/part/"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("https://shop.example/supplier/"), F.col("l_suppkey").cast("string"))
    both = F.array(F.struct(supplier.alias("src"), part.alias("dst")), F.struct(part.alias("src"), supplier.alias("dst")))
    return pairs.select(F.inline(both), "link_pos")


def _catalogue_pages(spark, d):
    part = t.table(spark, d, "part").select(
        F.concat(F.lit("https://shop.example/part/"), F.col("p_partkey").cast("string")).alias("url"),
        (F.col("p_partkey") % 4).alias("chunk_count"), (F.col("p_size") * 10).alias("byte_count"),
    )
    supplier = t.table(spark, d, "supplier").select(
        F.concat(F.lit("https://shop.example/supplier/"), F.col("s_suppkey").cast("string")).alias("url"),
        (F.col("s_suppkey") % 3 + 1).alias("chunk_count"), F.lit(700).alias("byte_count"),
    )
    return part.filter(F.col("chunk_count") + F.col("byte_count") > 130).unionByName(supplier)


CRAWL = {"max_depth": 4, "max_pages": 690, "max_chunks": 870, "max_bytes": 165_000}


def crawl_plan_q(spark, d):
    """A crawl for every nation: it starts at the nation's first supplier, the next two are in its sitemap."""
    order = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    ranked = t.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", order.alias("n")).filter("n <= 3")
    seeds = ranked.select(
        F.col("s_nationkey").cast("string").alias("source_id"), F.concat(F.lit("https://shop.example/supplier/"), F.col("s_suppkey").cast("string")).alias("url"),
        (F.col("n") > 1).cast("int").alias("depth"), F.col("n").alias("seq"),
    )
    rules = spark.createDataFrame(
        [("https://shop.example", kind, value) for kind, value in CRAWL_RULES], "origin STRING, kind STRING, value STRING"
    )
    plan, stops = crawl_plan(_catalogue(spark, d), _catalogue_pages(spark, d), seeds, rules, **CRAWL)
    return plan.join(stops, "source_id").select("source_id", "url", "depth", "pos", "chunk_count", "byte_count", "stop_reason", "visited", "chunks", "bytes")


CRAWL_RULES = (("disallow", "/part/1"), ("allow", "/part/12"), ("disallow", "/part/129"), ("allow", "/part/129"), ("disallow", "/supplier/7"))


def _budget_pages(spark, d):
    sets = t.doc_chunk_sets(spark, d)
    size = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + F.length(c["content"]))
    return materialise(sets.select("source_id", "seq", F.size("chunks").alias("chunk_count"), size.alias("byte_count")), "pages")


BUDGET = {"max_pages": 40, "max_chunks": 60, "max_bytes": 100_000}


def crawl_budget(spark, d):
    kept, stops = apply_budget(_budget_pages(spark, d), **BUDGET)
    sums = kept.groupBy("source_id").agg(
        F.sum("chunk_count").alias("chunks"), F.sum("byte_count").alias("bytes"), F.max("seq").alias("last_seq")
    )
    return stops.join(sums, "source_id")


def sitemap_locs_q(spark, d):
    maps = t.sitemaps(spark, d)
    return sitemap_locs(maps.withColumn("origin", url_origin(F.col("sitemap_url")))).drop("origin")


def sitemap_tree(spark, d):
    """Every page origin starts from one shared root that lists all page sitemaps; foreign pages are left out."""
    maps = t.sitemaps(spark, d)
    root = F.lit("https://root.example/sitemap.xml")
    listing = maps.select(root.alias("sitemap_url"), F.concat(F.lit("<sitemap><loc>"), "sitemap_url", F.lit("</loc></sitemap>")).alias("xml"))
    roots = t.table(spark, d, "pages").select(url_origin(F.col("url")).alias("origin"), root.alias("sitemap_url"))
    return expand_sitemaps(maps.unionByName(listing), roots)


def crawl_seeds_q(spark, d):
    """Starts and sitemap pages of every page origin, whose own sitemap names the page sitemaps."""
    maps = t.sitemaps(spark, d)
    named = F.concat(F.lit("<sitemap><loc>"), "sitemap_url", F.lit("</loc></sitemap>"))
    listing = maps.select(F.concat(url_origin(F.col("sitemap_url")), F.lit("/sitemap.xml")).alias("sitemap_url"), named.alias("xml"))
    return crawl_seeds(t.table(spark, d, "pages"), maps.unionByName(listing), robots_rules(t.robots_files(spark, d), "LoomBot"))


def _page_results(spark, d):
    return t.table(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok")
    )


def consecutive_failures(spark, d):
    return failure_drops(cut_on_failures(_page_results(spark, d)))


def dedup_chunks_q(spark, d):
    kept = dedup_chunks(t.chunks(spark, d))
    return kept.select("id", "source_id", "chunk_index", F.md5("content").alias("content_hash"))


def content_hash_q(spark, d):
    return t.table(spark, d, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("hash"), F.md5(norm_key(F.col("text"))).alias("key")
    )


QUERIES = {
    "page_title": page_title_q,
    "page_main_content": page_main_content,
    "page_markdown": page_markdown,
    "page_chunks": page_chunks,
    "normalize_url": normalize_url_q,
    "canonical_url": canonical_url,
    "page_links": page_links,
    "filter_links": filter_links_q,
    "robots_rules": robots_rules_q,
    "robots_filter": robots_filter_q,
    "crawl_reach": crawl_reach,
    "crawl_plan": crawl_plan_q,
    "crawl_budget": crawl_budget,
    "sitemap_locs": sitemap_locs_q,
    "sitemap_tree": sitemap_tree,
    "crawl_seeds": crawl_seeds_q,
    "consecutive_failures": consecutive_failures,
    "dedup_chunks": dedup_chunks_q,
    "content_hash": content_hash_q,
}



def _crawl_sql():
    """The walk of `crawl_plan`, one CTE for each step of a level."""
    longest = lambda kind: "greatest(0, " + ", ".join(
        f"CASE WHEN starts_with(path, '{value}') THEN {len(value)} ELSE 0 END" for k, value in CRAWL_RULES if k == kind
    ) + ")"
    steps = f"""
WITH pairs AS (
  SELECT 'https://shop.example/supplier/' || l_suppkey AS s, 'https://shop.example/part/' || l_partkey AS p, l_orderkey * 8 + l_linenumber AS sold FROM lineitem),
edges AS MATERIALIZED (
  SELECT src, dst, min(sold)::BIGINT AS link_pos FROM (SELECT s AS src, p AS dst, sold FROM pairs UNION ALL SELECT p, s, sold FROM pairs)
  GROUP BY src, dst),
allowed AS MATERIALIZED (
  SELECT src, dst, link_pos FROM (SELECT *, dst[21:] AS path FROM edges)
  WHERE {longest('disallow')} = 0 OR {longest('allow')} > {longest('disallow')}),
pages_in AS (
  SELECT 'https://shop.example/part/' || p_partkey AS url, (p_partkey % 4)::BIGINT AS chunk_count, (p_size * 10)::BIGINT AS byte_count FROM part
  WHERE p_partkey % 4 + p_size * 10 > 130
  UNION ALL SELECT 'https://shop.example/supplier/' || s_suppkey, (s_suppkey % 3 + 1)::BIGINT, 700::BIGINT FROM supplier),
seeds AS (
  SELECT s_nationkey::VARCHAR AS source_id, 'https://shop.example/supplier/' || s_suppkey AS url, (n > 1)::INTEGER AS depth, n AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) WHERE n <= 3),
state0 AS (SELECT DISTINCT source_id, NULL::VARCHAR AS stop_reason, 0::BIGINT AS visited, 0::BIGINT AS chunks, 0::BIGINT AS bytes FROM seeds),
seen0 AS (SELECT '' AS source_id, '' AS url, 0 AS depth, 0::BIGINT AS pos, 0::BIGINT AS chunk_count, 0::BIGINT AS byte_count WHERE false),
front0 AS (SELECT * FROM seen0)"""
    chunks, size, pages = CRAWL["max_chunks"], CRAWL["max_bytes"], CRAWL["max_pages"]
    for i in range(CRAWL["max_depth"] + 1):
        steps += f""",
named{i} AS (
  SELECT source_id, url, min({{'p': p, 'l': l}}) AS spot FROM (
    SELECT source_id, url, -1::BIGINT AS p, seq::BIGINT AS l FROM seeds WHERE depth = {i}
    UNION ALL SELECT f.source_id, a.dst, f.pos, a.link_pos FROM front{i} f JOIN allowed a ON a.src = f.url)
  WHERE source_id IN (SELECT source_id FROM state{i} WHERE stop_reason IS NULL)
    AND (source_id, url) NOT IN (SELECT (source_id, url) FROM seen{i}) GROUP BY source_id, url),
sized{i} AS (
  SELECT n.source_id, n.url, {i} AS depth, s.visited + row_number() OVER w AS pos, chunk_count, byte_count,
         s.chunks + sum(CASE WHEN chunk_count > 0 THEN chunk_count ELSE 0 END) OVER w AS tc,
         s.bytes + sum(CASE WHEN chunk_count > 0 THEN byte_count ELSE 0 END) OVER w AS tb
  FROM named{i} n JOIN state{i} s USING (source_id) LEFT JOIN pages_in p ON p.url = n.url
  WINDOW w AS (PARTITION BY n.source_id ORDER BY spot, n.url ROWS UNBOUNDED PRECEDING)),
cuts{i} AS MATERIALIZED (
  SELECT source_id, min(pos) FILTER (chunk_count > 0 AND tc >= {chunks}) AS c, min(pos) FILTER (chunk_count > 0 AND tb >= {size}) AS b,
         CASE WHEN max(pos) > {pages} THEN {pages} END AS p FROM sized{i} GROUP BY source_id),
visited{i} AS MATERIALIZED (
  SELECT z.*, CASE WHEN c <= least(c, b, p) THEN 'maxChunks' WHEN b <= least(c, b, p) THEN 'maxBytes' WHEN p IS NOT NULL THEN 'maxPages' END AS reason
  FROM sized{i} z JOIN cuts{i} USING (source_id) WHERE pos <= coalesce(least(c, b, p), pos)),
state{i + 1} AS MATERIALIZED (
  SELECT s.source_id, coalesce(s.stop_reason, v.reason) AS stop_reason, coalesce(v.pos, s.visited) AS visited,
         coalesce(v.tc, s.chunks)::BIGINT AS chunks, coalesce(v.tb, s.bytes)::BIGINT AS bytes
  FROM state{i} s LEFT JOIN (SELECT source_id, any_value(reason) AS reason, max(pos) AS pos, max(tc) AS tc, max(tb) AS tb FROM visited{i} GROUP BY source_id) v
    USING (source_id)),
seen{i + 1} AS MATERIALIZED (FROM seen{i} UNION ALL SELECT source_id, url, depth, pos, chunk_count, byte_count FROM visited{i}),
front{i + 1} AS (SELECT source_id, url, depth, pos, chunk_count, byte_count FROM visited{i} WHERE reason IS NULL AND chunk_count > 0)"""
    return f"{steps} SELECT * FROM seen{i + 1} JOIN state{i + 1} USING (source_id)"


LINKS = f"""
links AS (
  SELECT DISTINCT page_url, {normalized("o || h")} AS link
  FROM (SELECT {normalized('url')} AS page_url, {origin('url')} AS o,
               unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
)"""

RULES = f"""
firsts AS (SELECT {origin('url')} AS origin, min(url) AS url FROM pages GROUP BY 1),
folders AS (SELECT origin, {path('url')} AS p, regexp_extract({path('url')}, '^(/[^/]*)', 1) AS folder FROM firsts),
rules AS (
  SELECT origin, 'disallow' AS kind, '/de' AS value FROM folders WHERE origin LIKE 'https%'
  UNION ALL SELECT origin, 'disallow', '/fr/' FROM folders WHERE origin LIKE 'https%'
  UNION ALL SELECT origin, 'disallow', folder FROM folders WHERE origin LIKE 'http:%'
  UNION ALL SELECT origin, 'allow', p FROM folders WHERE origin LIKE 'http:%'
  UNION ALL SELECT origin, 'disallow', '/es' FROM folders WHERE origin LIKE 'http:%'
  UNION ALL SELECT origin, 'delay', '3' FROM folders WHERE origin LIKE 'http:%'
  UNION ALL SELECT origin, 'sitemap', origin || '/sitemap.xml' FROM folders
)"""

ORACLES = {
    "page_title": f"SELECT page_id, {PAGE_TITLE} AS title FROM pages",
    "page_main_content": """
SELECT page_id, md5(regexp_extract(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<nav\\b.*?</nav>', '', 'g'),
    '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<footer\\b.*?</footer>', '', 'g'),
  '(?is)<article>(.*?)</article>', 1)) AS main_hash FROM pages""",
    "normalize_url": f"""
WITH urls AS (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '[?#].*', '') || '/index.html#part' FROM pages)
SELECT url, {origin('url')} ||
  CASE WHEN contains(url, '/index.html') THEN regexp_replace(regexp_replace({path('url')}, '/index.html$', ''), '(.)/$', '\\1')
       ELSE regexp_replace({path('url')}, '(.)/$', '\\1') END || regexp_extract(url, '(\\?[^#]*)', 1) AS normalized
FROM urls""",
    "canonical_url": f"""
WITH p AS (
  SELECT page_id, {normalized('url')} AS page_url,
         CASE WHEN contains(url, '?') THEN {normalized("regexp_replace(url, '[?#].*', '')")} END AS canonical_url FROM pages)
SELECT page_id, page_url, canonical_url, coalesce(canonical_url, page_url) AS effective_url FROM p""",
    "page_links": f"WITH {LINKS} SELECT page_url, link FROM links",
    "filter_links": f"""
WITH {LINKS},
feeds AS (SELECT 'https://www.start.example' || regexp_replace(url, '^https?://[^/]*|[?#].*', '', 'g') AS page_url, {normalized('url')} AS link FROM pages),
edges AS (SELECT * FROM links UNION ALL SELECT page_url, link || '.pdf' FROM links UNION ALL SELECT * FROM feeds)
SELECT page_url, link FROM edges
WHERE link NOT LIKE '%.pdf' AND {origin('link')} = {origin('page_url')}
  AND NOT starts_with({path('link')}, '/a') AND NOT starts_with({path('link')}, '/de/')""",
    "robots_rules": f"WITH {RULES} SELECT origin, kind, value FROM rules",
    "robots_filter": f"""
WITH {RULES},
urls AS (SELECT page_id, url, {origin('url')} AS origin, {path('url')} AS p FROM pages),
best AS (
  SELECT page_id, url,
         coalesce(max(length(value)) FILTER (kind = 'allow'), 0) AS a, coalesce(max(length(value)) FILTER (kind = 'disallow'), 0) AS b
  FROM urls LEFT JOIN rules ON rules.origin = urls.origin AND kind IN ('allow', 'disallow') AND starts_with(p, value)
  GROUP BY page_id, url)
SELECT page_id, url, b = 0 OR a > b AS allowed FROM best""",
    "crawl_reach": """
WITH RECURSIVE edges AS (
  SELECT DISTINCT '/supplier/' || l_suppkey AS src, '/part/' || l_partkey AS dst FROM lineitem
  UNION SELECT DISTINCT '/part/' || l_partkey, '/supplier/' || l_suppkey FROM lineitem),
reach AS (
  SELECT '/supplier/' || min(s_suppkey) AS url, 0 AS depth FROM supplier
  UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = url WHERE depth < 5)
SELECT url, min(depth) AS depth FROM reach GROUP BY url""",
    "crawl_plan": _crawl_sql(),
    "crawl_budget": f"""{DOC_CHUNKS},
sized AS (
  SELECT source_id, seq, count(c.k) AS chunk_count, coalesce(sum(length(content)), 0) AS byte_count
  FROM docs LEFT JOIN chunks c USING (k) GROUP BY source_id, seq),
running AS (
  SELECT *, row_number() OVER w AS pos, sum(chunk_count) OVER w AS tc, sum(byte_count) OVER w AS tb FROM sized
  WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
judged2 AS (
  SELECT *, coalesce(max(chunk_count > 0 AND (tc >= 60 OR tb >= 100000)) OVER (
    PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR pos > 40 AS gone FROM running),
lasts AS (
  SELECT source_id, count(*) AS total, count(*) FILTER (NOT gone) AS kept,
         sum(chunk_count) FILTER (NOT gone) AS chunks, sum(byte_count) FILTER (NOT gone) AS bytes, max(seq) FILTER (NOT gone) AS last_seq,
         bool_or(NOT gone AND chunk_count > 0 AND tc >= 60) AS by_chunks, bool_or(NOT gone AND chunk_count > 0 AND tb >= 100000) AS by_bytes
  FROM judged2 GROUP BY source_id)
SELECT source_id, total, kept, chunks::BIGINT AS chunks, bytes::BIGINT AS bytes, last_seq,
       CASE WHEN by_chunks THEN 'maxChunks' WHEN by_bytes THEN 'maxBytes' WHEN total > kept THEN 'maxPages' END AS stop_reason FROM lasts""",
    "sitemap_locs": f"""
WITH maps AS (
  SELECT regexp_replace({normalized('url')} || '/sitemap.xml', '\\?[^/]*', '') AS sitemap_url, url, {NAV} AS nav FROM pages),
locs AS (
  SELECT sitemap_url, {normalized('url')} AS loc FROM maps
  UNION SELECT sitemap_url, {normalized("o || h")} FROM (
    SELECT sitemap_url, {origin('url')} AS o, unnest(regexp_extract_all(nav, 'href="([^"]*)"', 1)) AS h FROM maps)
  UNION SELECT sitemap_url, 'https://maps.example/sitemap_index.xml' FROM maps)
SELECT sitemap_url, loc, loc = 'https://maps.example/sitemap_index.xml' AS nested FROM locs""",
    "sitemap_tree": f"""
SELECT DISTINCT {origin('url')} AS origin, url FROM (
  SELECT {normalized('url')} AS url FROM pages
  UNION SELECT {normalized("o || h")} FROM (
    SELECT {origin('url')} AS o, unnest(regexp_extract_all({NAV}, 'href="([^"]*)"', 1)) AS h FROM pages))""",
    "crawl_seeds": f"""
SELECT origin, url, min(depth)::INTEGER AS depth FROM (
  SELECT {origin('url')} AS origin, {normalized('url')} AS url, 0 AS depth FROM pages
  UNION ALL SELECT o, {normalized("o || h")}, 1 FROM (
    SELECT {origin('url')} AS o, unnest(regexp_extract_all({NAV}, 'href="([^"]*)"', 1)) AS h FROM pages))
GROUP BY origin, url""",
    "consecutive_failures": """
WITH r AS (SELECT user_id AS source_id, event_id AS seq, event_type = 'purchase' AS ok,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
s AS (SELECT *, pos - coalesce(max(CASE WHEN ok THEN pos END) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS streak FROM r),
stops AS (SELECT source_id, min(pos) FILTER (streak >= 10 AND pos % 3 = 0) AS stop FROM s GROUP BY source_id),
j AS (SELECT s.*, stop IS NULL OR pos <= stop AS kept, (pos - 1) // 3 AS batch FROM s JOIN stops USING (source_id)),
b AS (SELECT source_id, batch, count(*) AS n, bool_or(ok) AS any_ok, bool_and(kept) AS kept FROM j GROUP BY source_id, batch)
SELECT source_id, 'crawl_error' AS reason, sum(n)::BIGINT AS count FROM b WHERE kept AND NOT any_ok GROUP BY source_id
UNION ALL
SELECT source_id, 'too_many_consecutive_failures', count(*) FROM j WHERE NOT kept GROUP BY source_id""",
    "dedup_chunks": f"""{DOC_CHUNKS}
SELECT md5(k || '|' || chunk_index) AS id, source_id, chunk_index, md5(content) AS content_hash
FROM (SELECT c.*, d.source_id, d.seq FROM chunks c JOIN docs d USING (k))
QUALIFY row_number() OVER (PARTITION BY source_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) ORDER BY seq, chunk_index) = 1""",
    "content_hash": """
SELECT doc_id, md5(text) AS hash, md5(trim(regexp_replace(lower(text), '[\\s\\x{a0}]+', ' ', 'g'))) AS key FROM documents""",
}
