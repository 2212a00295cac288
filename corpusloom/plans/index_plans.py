"""Registered queries on the stored index: change detection, lifecycle and vectors, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, format_vector, parse_vector
from ..operators.dedup import diff_docs, skipped_docs
from ..operators.embedding import (
    Embedder,
    back_fill,
    count_pending,
    embed_pending,
    embedding_stats,
    filled,
    hashing_embedder,
    normalise_vectors,
    pending_chunks,
    unfilled,
)
from ..operators.lifecycle import (
    cascade_delete,
    import_outcome,
    insert_chunks,
    orphan_audit,
    purge_noisy,
    register_sources,
    table_counts,
    update_sources,
    upsert_docs,
)
from ..settings import materialise, scratch_path
from . import tables as t
from .snippets import DOCS, DOC_CHUNKS, H1, ITEM, MARKED, NAV, PAGE_LANG, SOURCES, chunk_ctes, hashed, link_list

NOW = 1_706_745_600


def _stored_docs(spark, d):
    """An earlier state of the corpus: German documents are missing, French ones had another end."""
    docs = t.docs(spark, d).filter("lang <> 'de'")
    body = F.when(F.col("lang") == "fr", F.concat("content_md", F.lit(" (old)"))).otherwise(F.col("content_md"))
    return docs.withColumn("content_md", body).withColumn("content_hash", F.md5("content_md"))


def changed_docs(spark, d):
    incoming = t.docs(spark, d).select("source_id", "url", "content_md")
    return diff_docs(incoming, _stored_docs(spark, d)).select("source_id", "url", "content_hash", "change")


def changed_docs_summary(spark, d):
    incoming = t.docs(spark, d).select("source_id", "url", "content_md")
    return skipped_docs(diff_docs(incoming, _stored_docs(spark, d)))


def upsert_docs_q(spark, d):
    """Every document arrives twice; the second time only English ones bring a body."""
    once = t.docs(spark, d)
    first = once.select("source_id", "url", "title", F.when(F.col("lang") != "es", F.col("content_md")).alias("content_md"), F.lit(1).alias("seq"))
    again = once.select(
        "source_id", "url", F.upper("title").alias("title"),
        F.when(F.col("lang") == "en", F.concat("content_md", F.lit("!"))).alias("content_md"), F.lit(2).alias("seq"),
    )
    merged = upsert_docs(_stored_docs(spark, d), first.unionByName(again))
    return merged.select("id", "source_id", "url", "title", "content_hash", F.md5("content_md").alias("body_hash"))


def _incoming_chunks(spark, d, chunks):
    docs = t.docs(spark, d).select(F.col("id").alias("doc_id"), F.col("url").alias("doc_url"))
    return chunks.join(docs, "doc_id").select(
        "source_id", "doc_url", "chunk_index", "content", "heading", "heading_path"
    )


def insert_chunks_q(spark, d):
    """Chunks of all documents on top of stored ones that carry an outdated text and a former tail, beside a kept document."""
    chunks = materialise(t.chunks(spark, d), "chunks")
    stale = chunks.withColumn("content", F.lit("stale"))
    stray = chunks.withColumn("id", F.concat("id", F.lit("-x"))).filter("chunk_index = 0")
    other = stray.withColumn("id", F.concat("id", F.lit("-y"))).withColumn("doc_id", F.concat("doc_id", F.lit("-y")))
    merged = insert_chunks(stale.unionByName(stray).unionByName(other).drop("seq", "created_at"), _incoming_chunks(spark, d, chunks))
    return merged.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("content") == "stale").alias("stale"),
        F.count_if(F.col("id").endswith("-x")).alias("stray"),
        F.count_if(F.col("id").endswith("-y")).alias("other"),
        F.sum("token_count").alias("tokens"),
    )


def save_outcome(spark, d):
    return import_outcome(_incoming_chunks(spark, d, t.chunks(spark, d)))


def _noisy_index(spark, d):
    chunks = materialise(t.stored_chunks(spark, d), "chunks")
    embeddings = chunks.select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"))
    return {"chunks": chunks, "embeddings": embeddings}


def purge_noisy_q(spark, d):
    index, purged = purge_noisy(_noisy_index(spark, d))
    left = index["chunks"].groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks_left"))
    owner = index["chunks"].select(F.col("id").alias("chunk_id"), "source_id")
    vectors = index["embeddings"].join(owner, "chunk_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("embeddings_left"))
    return purged.join(left, "source_id", "full_outer").join(vectors, "source_id", "full_outer").na.fill(0)


def _linked_index(spark, d):
    """The corpus index with embeddings on document level chunk ids and logs on the jobs."""
    index = t.index(spark, d)
    index["chunks"] = materialise(index["chunks"].select("id", "doc_id", "source_id", "chunk_index"), "chunks")
    first = index["chunks"].filter("chunk_index = 0").select(F.col("id").alias("chunk_id"), F.lit("m").alias("model"))
    logs = index["jobs"].select(F.col("id").alias("job_id"), F.lit("started").alias("message"))
    return {**index, "embeddings": first, "job_logs": logs}


def cascade_delete_q(spark, d):
    """Delete the disabled sources with everything below them."""
    index = _linked_index(spark, d)
    gone = index["sources"].filter("not enabled").select("id")
    return table_counts(cascade_delete(index, gone))


def orphan_audit_q(spark, d):
    """Audit of an index whose sources and documents were cut without their children."""
    index = _linked_index(spark, d)
    index["sources"] = index["sources"].filter("enabled")
    index["docs"] = index["docs"].filter("lang <> 'fr'")
    index["jobs"] = index["jobs"].filter("status <> 'failed'")
    return orphan_audit(index)


def register_sources_q(spark, d):
    """Every page host asks to be a source, several times; some urls are registered already."""
    new = t.table(spark, d, "pages").select(
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("name"),
        F.concat(F.lit("src://"), F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("/"), F.regexp_extract("url", "^https?://([^/]*)", 1)).alias("url"),
        F.lit("crawler").alias("importer_type"),
        F.col("page_id").alias("seq"),
    )
    known = new.filter(F.col("name").startswith("www.")).select("url")
    return register_sources(known, new)


def update_sources_q(spark, d):
    sources = t.sources(spark, d)
    enabled = sources.filter("enabled")
    patches = enabled.select("id", F.when(F.col("name") > "src15", F.concat("name", F.lit("-b"))).alias("name"), F.lit(False).alias("enabled"))
    out = update_sources(sources, patches, F.timestamp_seconds(F.lit(NOW)))
    return out.select("id", "name", "url", "enabled", F.unix_timestamp("updated_at").alias("updated_at"))


def _doc_level_chunks(spark, d):
    docs = t.documents(spark, d)
    return docs.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("source_id"), F.col("text").alias("content"))


def pending_chunks_q(spark, d):
    return pending_chunks(_doc_level_chunks(spark, d), t.embeddings(spark, d), "small").select("id", "source_id")


def count_pending_q(spark, d):
    return count_pending(_doc_level_chunks(spark, d), t.embeddings(spark, d), "small")


def embed_pending_q(spark, d):
    """Documents whose stored vector is of another model get one; the vector shows as whole millionths."""
    model = hashing_embedder()
    stored = t.embeddings(spark, d).withColumn("model", F.when(F.col("model") == "small", model.model).otherwise(F.col("model")))
    made = embed_pending(_doc_level_chunks(spark, d), stored, model)
    shown = F.transform("vector", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    return made.select("chunk_id", "model", "dimensions", F.md5(F.array_join(shown, ",")).alias("vector_hash"))


def embed_back_fill(spark, d):
    """A back-fill whose model fails on texts of certain lengths, and a second one with a sound model for what is left."""
    path = scratch_path(spark, "back-fill")
    sound = hashing_embedder()

    def fails(texts):
        if any(len(text) % 7 == 0 for text in texts):
            raise ValueError("length")
        return sound.embed(texts)

    chunks = _doc_level_chunks(spark, d)
    back_fill(chunks, Embedder(sound.model, sound.dimensions, fails), path, slices=2)
    left = unfilled(spark, path).select("chunk_id", "tries", "error")
    back_fill(chunks, sound, path, slices=1)
    shown = F.transform("vector", lambda x: F.round(x.cast("double") * 1_000_000).cast("long").cast("string"))
    made = filled(spark, path, sound).select("chunk_id", "run", F.md5(F.array_join(shown, ",")).alias("vector_hash"))
    return made.join(materialise(left, "left"), "chunk_id", "left")


def normalise_vectors_q(spark, d):
    doubled = t.embeddings(spark, d).withColumn(
        "vector", F.transform("vector", lambda x: F.when(F.col("source_name") == "4", F.lit(0.0)).otherwise(x.cast("double") * 3))
    )
    unit = normalise_vectors(doubled).select("chunk_id", F.posexplode("vector").alias("pos", "x"))
    return unit.select("chunk_id", "pos", F.round("x", 6).alias("x"))


def vector_parse(spark, d):
    """Vectors through their text form and back, with a broken entry added."""
    text = F.replace(format_vector(F.col("vector")), F.lit("]"), F.lit(",NaN, x , 2]"))
    rows = t.embeddings(spark, d).select("chunk_id", F.posexplode(parse_vector(text)).alias("pos", "x"))
    return rows.select("chunk_id", "pos", F.col("x").cast("float").cast("double").alias("x"))


def cosine_pairs(spark, d):
    """Similarity of each vector with the centroid of its label."""
    centroids = t.label_centroids(spark, d).select(F.col("query_id").alias("source_name"), F.col("vector").alias("centroid"))
    pairs = t.embeddings(spark, d).join(centroids, "source_name")
    return pairs.select("chunk_id", "source_name", F.round(cosine(F.col("vector"), F.col("centroid")), 6).alias("score"))


def vector_stats(spark, d):
    return embedding_stats(t.embeddings(spark, d))


QUERIES = {
    "changed_docs": changed_docs,
    "changed_docs_summary": changed_docs_summary,
    "upsert_docs": upsert_docs_q,
    "insert_chunks": insert_chunks_q,
    "save_outcome": save_outcome,
    "purge_noisy": purge_noisy_q,
    "cascade_delete": cascade_delete_q,
    "orphan_audit": orphan_audit_q,
    "register_sources": register_sources_q,
    "update_sources": update_sources_q,
    "pending_chunks": pending_chunks_q,
    "count_pending": count_pending_q,
    "embed_pending": embed_pending_q,
    "embed_back_fill": embed_back_fill,
    "normalise_vectors": normalise_vectors_q,
    "vector_parse": vector_parse,
    "cosine_pairs": cosine_pairs,
    "vector_stats": vector_stats,
}

CHANGE = "CASE lang WHEN 'de' THEN 'new' WHEN 'fr' THEN 'changed' ELSE 'unchanged' END"
EMBEDDINGS = """
emb AS (SELECT 'doc://' || vec_id AS chunk_id, CASE WHEN label < 5 THEN 'small' ELSE 'large' END AS model,
               CASE WHEN label = 3 THEN 128 ELSE len(embedding)::INTEGER END AS dimensions, embedding AS vector, label::VARCHAR AS source_name
        FROM embeddings)"""
CENTROIDS = """
entries AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM entries GROUP BY label, pos),
centroids AS (SELECT label::VARCHAR AS query_id, list(x ORDER BY pos) AS vector FROM means GROUP BY label)"""
JOB_SOURCES = "(SELECT event_id AS id, md5('src' || (user_id % 20)) AS source_id, event_type FROM events)"

ORACLES = {
    "changed_docs": f"WITH {DOCS} SELECT source_id, url, md5(text) AS content_hash, {CHANGE} AS change FROM docs",
    "changed_docs_summary": f"""WITH {DOCS}
SELECT source_id, count(*) FILTER (lang NOT IN ('de', 'fr')) AS skipped, count(*) FILTER (lang = 'fr') AS changed,
       count(*) FILTER (lang = 'de') AS new FROM docs GROUP BY source_id""",
    "upsert_docs": f"""WITH {DOCS},
bodies AS (SELECT *, CASE lang WHEN 'en' THEN text || '!' ELSE text END AS body FROM docs)
SELECT k AS id, source_id, url, upper(title) AS title, md5(body) AS content_hash, md5(body) AS body_hash FROM bodies""",
    "insert_chunks": f"""{DOC_CHUNKS}
SELECT source_id, count(*) + count(*) FILTER (chunk_index = 0) AS n, 0::BIGINT AS stale, 0::BIGINT AS stray, count(*) FILTER (chunk_index = 0) AS other,
       (sum(token_count) + coalesce(sum(token_count) FILTER (chunk_index = 0), 0))::BIGINT AS tokens
FROM chunks JOIN docs USING (k) GROUP BY source_id""",
    "save_outcome": f"""{DOC_CHUNKS}
SELECT source_id, count(DISTINCT k) AS doc_count, count(*) AS chunk_count FROM chunks JOIN docs USING (k) GROUP BY source_id""",
    "purge_noisy": f"""WITH RECURSIVE {MARKED}, {chunk_ctes('marked')},
items AS (
  SELECT source_id, content FROM judged JOIN marked USING (k)
  UNION ALL SELECT {PAGE_LANG} AS source_id, regexp_replace({NAV}, {ITEM}, '- [\\2](\\1)' || chr(10), 'g') AS content FROM pages
  UNION ALL SELECT {PAGE_LANG}, {H1} FROM pages)
SELECT source_id, count(*) FILTER (ll) AS purged, count(*) FILTER (NOT ll) AS chunks_left, count(*) FILTER (NOT ll) AS embeddings_left
FROM (SELECT source_id, {link_list('content')} AS ll FROM items) GROUP BY source_id""",
    "cascade_delete": f"""{DOC_CHUNKS}, {SOURCES},
kept AS (SELECT id FROM sources WHERE enabled), gone AS (SELECT id FROM sources WHERE NOT enabled)
SELECT 'sources' AS "table", count(*) AS n FROM kept
UNION ALL SELECT 'docs', count(*) FROM docs WHERE source_id IN (FROM kept)
UNION ALL SELECT 'chunks', count(*) FROM chunks JOIN docs USING (k) WHERE source_id IN (FROM kept)
UNION ALL SELECT 'embeddings', count(*) FROM chunks JOIN docs USING (k) WHERE source_id IN (FROM kept) AND chunk_index = 0
UNION ALL SELECT 'jobs', count(*) FROM {JOB_SOURCES} WHERE source_id NOT IN (FROM gone)
UNION ALL SELECT 'job_logs', count(*) FROM {JOB_SOURCES} WHERE source_id NOT IN (FROM gone)""",
    "orphan_audit": f"""{DOC_CHUNKS}, {SOURCES},
kept AS (SELECT id FROM sources WHERE enabled)
SELECT 'docs' AS "table", 'source_id -> sources' AS reference, count(*) AS n FROM docs WHERE lang <> 'fr' AND source_id NOT IN (FROM kept)
UNION ALL SELECT 'chunks', 'source_id -> sources', count(*) FROM chunks JOIN docs USING (k) WHERE source_id NOT IN (FROM kept)
UNION ALL SELECT 'chunks', 'doc_id -> docs', count(*) FROM chunks JOIN docs USING (k) WHERE lang = 'fr'
UNION ALL SELECT 'embeddings', 'chunk_id -> chunks', 0
UNION ALL SELECT 'jobs', 'source_id -> sources', count(*) FROM {JOB_SOURCES} WHERE event_type <> 'error' AND source_id NOT IN (FROM kept)
UNION ALL SELECT 'job_logs', 'job_id -> jobs', count(*) FROM events WHERE event_type = 'error'""",
    "register_sources": """
WITH new AS (
  SELECT split_part(url, '/', 3) AS name, 'src://' || regexp_extract(url, '/([a-z]{2})/', 1) || '/' || split_part(url, '/', 3) AS url,
         'crawler' AS importer_type, page_id AS seq FROM pages)
SELECT *, name NOT LIKE 'www.%' AND row_number() OVER (PARTITION BY url ORDER BY seq) = 1 AS registered FROM new""",
    "update_sources": f"""WITH {SOURCES}
SELECT id, CASE WHEN enabled AND name > 'src15' THEN name || '-b' ELSE name END AS name, url, false AS enabled,
       (CASE WHEN enabled THEN {NOW} ELSE 1700000000 END)::BIGINT AS updated_at FROM sources""",
    "pending_chunks": f"""WITH {EMBEDDINGS}
SELECT 'doc://' || doc_id AS id, source AS source_id FROM documents
WHERE 'doc://' || doc_id NOT IN (SELECT chunk_id FROM emb WHERE model = 'small')""",
    "count_pending": f"""WITH {EMBEDDINGS}
SELECT source AS source_id, count(*) AS pending FROM documents
WHERE 'doc://' || doc_id NOT IN (SELECT chunk_id FROM emb WHERE model = 'small') GROUP BY source""",
    "embed_pending": f"""WITH {EMBEDDINGS},
todo AS (SELECT 'doc://' || doc_id AS id, text FROM documents WHERE 'doc://' || doc_id NOT IN (SELECT chunk_id FROM emb WHERE model = 'small')),
{hashed('embedded', 'todo', 'id', 'text')}
SELECT id AS chunk_id, 'hashing-64' AS model, 64 AS dimensions,
       md5(array_to_string(list_transform(vector, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS vector_hash FROM embedded""",
    "embed_back_fill": f"""WITH all_docs AS (SELECT 'doc://' || doc_id AS id, text FROM documents), {hashed('embedded', 'all_docs', 'id', 'text')}
SELECT id AS chunk_id, CASE WHEN length(text) % 7 = 0 THEN 2 ELSE 1 END AS run,
       md5(array_to_string(list_transform(vector, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS vector_hash,
       CASE WHEN length(text) % 7 = 0 THEN 1 END AS tries, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: length' END AS error
FROM embedded JOIN all_docs USING (id)""",
    "normalise_vectors": f"""WITH {EMBEDDINGS},
scaled AS (SELECT chunk_id, list_transform(vector, lambda x: CASE WHEN source_name = '4' THEN 0.0 ELSE x::DOUBLE * 3 END) AS v FROM emb),
normed AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM scaled)
SELECT chunk_id, unnest(range(len(v)))::INTEGER AS pos, round(unnest(list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 6) AS x FROM normed""",
    "vector_parse": f"""WITH {EMBEDDINGS}, longer AS (SELECT chunk_id, list_transform(vector, lambda x: x::DOUBLE) || [2.0] AS v FROM emb)
SELECT chunk_id, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM longer""",
    "cosine_pairs": f"""WITH {EMBEDDINGS}, {CENTROIDS}
SELECT chunk_id, source_name, round(list_dot_product(e.vector::DOUBLE[], c.vector)
         / (sqrt(list_dot_product(e.vector::DOUBLE[], e.vector::DOUBLE[])) * sqrt(list_dot_product(c.vector, c.vector))), 6) AS score
FROM emb e JOIN centroids c ON c.query_id = e.source_name""",
    "vector_stats": f"""WITH {EMBEDDINGS}
SELECT model, dimensions, count(*) AS n, count(*) FILTER (len(vector) <> dimensions) AS mismatched FROM emb GROUP BY model, dimensions""",
}
