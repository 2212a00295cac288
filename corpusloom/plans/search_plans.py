"""Registered retrieval queries with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import analyse, stable_id
from ..operators.fusion import mmr_rerank, rrf_merge
from ..operators.search import (
    eval_retrieval,
    format_hits,
    get_chunks,
    hit_details,
    noise_hits,
    pack_context,
    search_docs,
    search_hybrid,
)
from ..operators.chunking import chunk_markdown
from ..operators.text_search import search_text, text_match
from ..operators.text_store import import_chunks
from ..operators.vector_search import search_vector
from ..operators.vector_store import write_vectors
from ..settings import scratch_path
from . import tables as t
from .index_plans import CENTROIDS
from .snippets import DOC_CHUNKS, DOCS, MARKED_LINE, chunk_ctes, hashed, link_list, lit, terms

K = 10
SECOND_EDITION = "\nThis is the second edition of the document."


def result(hits):
    """Hits with the score as it is shown; ranks come from the full score."""
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def text_analyse(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", analyse(F.col("text")).alias("terms"))
    return docs.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ")).alias("terms_hash"))


def text_match_q(spark, d):
    """Whole benchmark passages as queries: all their terms must occur."""
    return text_match(t.search_index(spark, d), t.passage_queries(spark, d))


def search_text_q(spark, d):
    return result(search_text(t.search_index(spark, d), t.queries(spark, d), K))


def search_vector_q(spark, d):
    """The nearest vectors of every label's centroid."""
    vectors = t.embeddings(spark, d)
    hits = search_vector(vectors, t.label_centroids(spark, d), K)
    return result(hits)


def search_vector_store(spark, d):
    """The same from a store of the vectors, which reads only the blocks that can matter."""
    store = write_vectors(t.embeddings(spark, d), scratch_path(spark, "vectors"))
    return result(search_vector(store, t.label_centroids(spark, d), K))


def search_vector_source(spark, d):
    vectors = t.chunk_vectors(spark, d)
    queries = t.query_vectors(spark, d).filter("vector is not null").select("query_id", "vector")
    return result(search_vector(vectors, queries, K, source="src3", model=t.MODEL.model))


def _both_lists(spark, d):
    queries = t.query_vectors(spark, d)
    vectors = t.chunk_vectors(spark, d)
    by_vector = search_vector(vectors, queries.filter("vector is not null").select("query_id", "vector"), 3 * K)
    by_text = search_text(t.search_index(spark, d), queries.select("query_id", "text"), 3 * K)
    return by_vector, by_text


def rrf_merge_q(spark, d):
    fused = rrf_merge(*_both_lists(spark, d))
    return fused.select("query_id", "chunk_id", "rank_v", "rank_t", F.round("score", 9).alias("score"), "rank")


def mmr_rerank_q(spark, d):
    picked = mmr_rerank(rrf_merge(*_both_lists(spark, d)), K)
    return picked.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def search_hybrid_q(spark, d):
    queries = t.query_vectors(spark, d).filter("vector is not null")
    hits = search_hybrid(t.search_index(spark, d), t.chunk_vectors(spark, d), queries, 5)
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def search_docs_q(spark, d):
    hits = search_docs(t.search_index(spark, d), t.chunk_vectors(spark, d), t.query_vectors(spark, d), 5)
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _details(spark, d):
    """Text hits of the benchmark queries with content, document and source."""
    hits = search_text(t.search_index(spark, d), t.queries(spark, d), K)
    return hit_details(hits, t.chunks(spark, d), t.docs(spark, d), t.sources(spark, d))


def get_chunk(spark, d):
    """Look up the first chunk of every document by its id; a document without chunks has none."""
    docs = t.docs(spark, d)
    ids = docs.select(stable_id(F.col("id"), F.lit(0)).alias("chunk_id"))
    found = get_chunks(t.chunks(spark, d), docs, t.sources(spark, d), ids)
    return found.select("chunk_id", "heading", "doc_url", "doc_title", "source_name", F.md5("content").alias("content_hash"))


def result_snippet(spark, d):
    return format_hits(_details(spark, d))


def context_pack(spark, d):
    packed = pack_context(_details(spark, d))
    return packed.select("query_id", F.md5("context").alias("context_hash"), "tokens")


def retrieval_eval(spark, d):
    """Whole passages and their short queries, judged by the chunks that hold the whole passage."""
    index = t.search_index(spark, d)
    whole = text_match(index, t.passage_queries(spark, d))
    gold = whole.unionByName(whole.withColumn("query_id", F.concat("query_id", F.lit("s"))))
    return eval_retrieval(search_text(index, t.queries(spark, d), K), gold, K)


def noise_hits_q(spark, d):
    """Hits whose text, with its short lines turned into links, is a link list."""
    shown = _details(spark, d).withColumn("content", t.marked_lines(F.col("content")))
    return noise_hits(shown).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def build_text_index(spark, d):
    """Build the stored index of all chunks; per length of a word: how many words, postings and occurrences."""
    path = scratch_path(spark, "text-index")
    store = import_chunks(spark, path, t.named_chunks(spark, d))
    rows = spark.read.parquet(f"{path}/{store.segments[0].path}/blocks")
    sums = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    terms = rows.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("n"), F.sum(sums).alias("tf"), F.max("max_tf").alias("top"))
    return terms.groupBy(F.length("term").alias("length")).agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"), F.sum("tf").alias("occurrences"), F.max("top").alias("most_in_a_chunk")
    )


def index_segments(spark, d):
    """Search an index after three imports: all but German documents; German ones, and French ones again with another
    end; then only the removal of the Spanish ones. Two segments with tombstones answer like an index of what is left."""
    path = scratch_path(spark, "text-index")
    docs = t.documents(spark, d)
    doc = stable_id(F.md5("source"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")))
    named = docs.select(doc.alias("doc_id"), F.col("source").alias("source_name"), "lang", "text")
    ended = named.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(SECOND_EDITION))).otherwise(F.col("text")))

    def chunks(rows):
        made = chunk_markdown(rows.drop("lang"))
        return made.select(stable_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "source_name", "content")

    import_chunks(spark, path, chunks(named.filter("lang <> 'de'")))
    import_chunks(spark, path, chunks(ended.filter("lang IN ('de', 'fr')")))
    store = import_chunks(spark, path, chunks(named).limit(0), gone=named.filter("lang = 'es'").select("doc_id"))
    return result(search_text(store, t.queries(spark, d), K))


QUERIES = {
    "text_analyse": text_analyse,
    "build_text_index": build_text_index,
    "index_segments": index_segments,
    "text_match": text_match_q,
    "search_text": search_text_q,
    "search_vector": search_vector_q,
    "search_vector_store": search_vector_store,
    "search_vector_source": search_vector_source,
    "rrf_merge": rrf_merge_q,
    "mmr_rerank": mmr_rerank_q,
    "search_hybrid": search_hybrid_q,
    "search_docs": search_docs_q,
    "get_chunk": get_chunk,
    "result_snippet": result_snippet,
    "context_pack": context_pack,
    "retrieval_eval": retrieval_eval,
    "noise_hits": noise_hits_q,
}

PICKED = """array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{5,}')),
           lambda w: {'n': length(w), 'w': w}))[1:2], lambda p: p.w), ' ')"""
INDEX = f"""
terms AS MATERIALIZED (
  SELECT md5(c.k || '|' || chunk_index) AS chunk_id, source_name, {terms('content')} AS tokens FROM chunks c JOIN docs USING (k)),
sizes AS MATERIALIZED (SELECT chunk_id, source_name, len(tokens) AS n_tokens FROM terms),
totals AS (SELECT count(*) AS n, avg(n_tokens) AS mean FROM sizes),
queries AS MATERIALIZED (
  SELECT item_id::VARCHAR AS query_id, text FROM benchmark UNION ALL SELECT item_id || 's', {PICKED} FROM benchmark),
query_terms AS MATERIALIZED (SELECT query_id, unnest(list_distinct({terms('text')})) AS term FROM queries),
passage_terms AS (SELECT * FROM query_terms WHERE query_id NOT LIKE '%s'),
postings AS MATERIALIZED (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM terms)
  WHERE term IN (SELECT term FROM query_terms) GROUP BY chunk_id, term),
frequency AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def matches(query_terms: str) -> str:
    """(query_id, chunk_id, score) of chunks with all terms."""
    return f"""
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
           / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))), 12) AS score
  FROM {query_terms} JOIN (SELECT query_id, count(*) AS need FROM {query_terms} GROUP BY query_id) USING (query_id)
    JOIN postings USING (term) JOIN frequency USING (term) JOIN sizes USING (chunk_id) CROSS JOIN totals
  GROUP BY query_id, chunk_id
  HAVING count(*) = any_value(need)"""


def text_hits(k: int) -> str:
    return f"""
text_hits AS MATERIALIZED (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM ({matches('query_terms')}) QUALIFY rank <= {k})"""


COS = """round(coalesce(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[])
  / nullif(sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[])), 0), 0), {digits})"""
VECTORS = f"""
named AS MATERIALIZED (SELECT md5(c.k || '|' || chunk_index) AS chunk_id, source_name, content FROM chunks c JOIN docs USING (k)),
{hashed('embedded', 'named', 'chunk_id', 'content')},
chunk_vectors AS MATERIALIZED (SELECT chunk_id, source_name, vector FROM embedded JOIN named USING (chunk_id)),
passages_in AS (SELECT item_id::VARCHAR AS query_id, text FROM benchmark),
{hashed('query_vectors', 'passages_in', 'query_id', 'text')}"""


def vector_hits(k: int, where: str = "true") -> str:
    return f"""
vector_hits AS MATERIALIZED (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, {COS.format(digits=12)} AS score FROM query_vectors a CROSS JOIN chunk_vectors b WHERE {where})
  QUALIFY rank <= {k})"""


def fused(k: int) -> str:
    return f"""{DOC_CHUNKS}, {INDEX}, {text_hits(k)}, {VECTORS}, {vector_hits(k)},
fused AS MATERIALIZED (
  SELECT query_id, chunk_id, v.rank AS rank_v, x.rank AS rank_t,
         coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + x.rank), 0) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + x.rank), 0) DESC,
                            v.rank NULLS LAST, x.rank NULLS LAST) AS rank
  FROM vector_hits v FULL JOIN text_hits x USING (query_id, chunk_id))"""


def diversified(limit: int) -> str:
    """Greedy steps, one CTE each; `penalty` of a candidate is its best similarity to what was picked."""
    steps = f"""
cands AS MATERIALIZED (
  SELECT f.query_id, f.chunk_id, f.score, f.rank, f.score / max(f.score) OVER (PARTITION BY f.query_id) AS rel,
         CASE WHEN rank_v IS NOT NULL THEN c.vector END AS vector
  FROM fused f LEFT JOIN chunk_vectors c USING (chunk_id)),
left0 AS (SELECT *, 0.0::DOUBLE AS penalty FROM cands)"""
    for i in range(limit):
        steps += f""",
pick{i} AS MATERIALIZED (
  SELECT *, {i + 1} AS pos FROM left{i}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * penalty, 12) DESC, rank) = 1),
left{i + 1} AS MATERIALIZED (
  SELECT a.query_id, a.chunk_id, a.score, a.rank, a.rel, a.vector, greatest(a.penalty, coalesce({COS.format(digits=15)}, 0)) AS penalty
  FROM left{i} a JOIN pick{i} b ON b.query_id = a.query_id AND b.chunk_id <> a.chunk_id)"""
    picks = " UNION ALL ".join(f"SELECT query_id, chunk_id, round(score, 9) AS score, pos AS rank FROM pick{i}" for i in range(limit))
    return f"{steps}, picked AS ({picks})"


DETAILS = f"""{DOC_CHUNKS}, {INDEX}, {text_hits(K)},
details AS (
  SELECT query_id, chunk_id, score, rank, content, heading, url, title, source_name
  FROM text_hits JOIN (SELECT md5(c.k || '|' || chunk_index) AS chunk_id, content, heading, url, title, source_name
                       FROM chunks c JOIN docs USING (k)) USING (chunk_id))"""

NEAREST = f"""WITH {CENTROIDS}
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
FROM (SELECT query_id, 'doc://' || vec_id AS chunk_id, {COS.format(digits=12)} AS score
      FROM (SELECT vec_id, embedding AS vector FROM embeddings) a CROSS JOIN centroids b)
QUALIFY rank <= {K}"""

ORACLES = {
    "text_analyse": f"SELECT doc_id, len({terms('text')})::INTEGER AS n_terms, md5(array_to_string({terms('text')}, ' ')) AS terms_hash FROM documents",
    "text_match": f"{DOC_CHUNKS}, {INDEX} SELECT query_id, chunk_id FROM ({matches('passage_terms')})",
    "search_text": f"{DOC_CHUNKS}, {INDEX}, {text_hits(K)} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM text_hits",
    "search_vector": NEAREST,
    "search_vector_store": NEAREST,
    "search_vector_source": f"{DOC_CHUNKS}, {VECTORS}, {vector_hits(K, '''source_name = 'src3' ''')} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM vector_hits",
    "rrf_merge": f"{fused(3 * K)} SELECT query_id, chunk_id, rank_v::INTEGER AS rank_v, rank_t::INTEGER AS rank_t, round(score, 9) AS score, rank::INTEGER AS rank FROM fused",
    "mmr_rerank": f"{fused(3 * K)}, {diversified(K)} SELECT query_id, chunk_id, score, rank FROM picked",
    "search_hybrid": f"""{fused(15)}, {diversified(5)}
SELECT query_id, chunk_id, score, rank FROM picked WHERE query_id IN (SELECT query_id FROM query_vectors)""",
    "search_docs": f"""{fused(15)}, {diversified(5)}
SELECT query_id, chunk_id, score, rank FROM picked WHERE query_id IN (SELECT query_id FROM query_vectors)
UNION ALL
SELECT query_id, chunk_id, round(score, 9), rank::INTEGER FROM text_hits WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM query_vectors)""",
    "get_chunk": f"""{DOC_CHUNKS}
SELECT md5(k || '|0') AS chunk_id, heading, url AS doc_url, title AS doc_title, source_name, md5(content) AS content_hash
FROM chunks JOIN docs USING (k) WHERE chunk_index = 0""",
    "result_snippet": f"""{DETAILS}
SELECT query_id, rank::INTEGER AS rank, chunk_id,
       concat_ws(chr(10), '[' || source_name || '] ' || coalesce(title, url), CASE WHEN heading <> '' THEN '## ' || heading END,
                 content[1:500], 'Score: ' || printf('%.1f', round(score * 100, 1)) || '%', 'Chunk: ' || chunk_id) AS agent_text,
       CASE WHEN length(content) > 400 THEN content[1:400] || '...' ELSE content END AS preview,
       floor(score * 100 + 0.5)::BIGINT AS score_percent
FROM details""",
    "context_pack": f"""{DETAILS}
SELECT query_id, md5(string_agg('--- Source: ' || source_name || ' | ' || coalesce(title, url) || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS context_hash,
       floor(sum(length(content)) / 4 + 0.5)::BIGINT AS tokens
FROM details GROUP BY query_id""",
    "retrieval_eval": f"""{DOC_CHUNKS}, {INDEX}, {text_hits(K)},
whole AS (SELECT query_id, chunk_id FROM ({matches('passage_terms')})),
gold AS (FROM whole UNION ALL SELECT query_id || 's', chunk_id FROM whole),
best AS (SELECT g.query_id, min(h.rank) AS rank FROM gold g LEFT JOIN text_hits h USING (query_id, chunk_id) GROUP BY g.query_id)
SELECT count(*) AS n_queries, count(rank) AS n_found, round(coalesce(avg((rank IS NOT NULL)::INT), 0), 6) AS recall,
       round(coalesce(avg(coalesce(1 / rank, 0)), 0), 6) AS mrr FROM best""",
    "noise_hits": f"""{DETAILS}
SELECT query_id, count(*) AS n
FROM (SELECT query_id, array_to_string(list_transform(string_split(content, chr(10)), lambda l: {MARKED_LINE}), chr(10)) AS shown FROM details)
WHERE {link_list('shown')} GROUP BY query_id""",
    "build_text_index": f"""{DOC_CHUNKS},
words AS (SELECT k, chunk_index, unnest({terms('content')}) AS term FROM chunks),
counted AS (SELECT term, count(*) AS tf FROM words GROUP BY k, chunk_index, term),
known AS (SELECT term, count(*) AS n, sum(tf) AS tf, max(tf) AS top FROM counted GROUP BY term)
SELECT length(term)::INTEGER AS length, count(*) AS terms, sum(n)::BIGINT AS postings, sum(tf)::BIGINT AS occurrences, max(top) AS most_in_a_chunk
FROM known GROUP BY length(term)""",
    "index_segments": f"""WITH RECURSIVE {DOCS},
edited AS (SELECT k, CASE WHEN lang = 'fr' THEN text || {lit(SECOND_EDITION)} ELSE text END AS text FROM docs WHERE lang <> 'es'),
{chunk_ctes('edited')}, {INDEX}, {text_hits(K)} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM text_hits""",
}
