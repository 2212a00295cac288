"""Text to chunks. No operator here shuffles; each works row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import array_rows, struct_rows
from ..functions.markdown import outline_rows, split_passages
from ..functions.text import is_link_list, long_enough, strip_html_lines, word_count


def chunk_sets(docs: DataFrame, text: str = "text", noisy: bool = False) -> DataFrame:
    """Replace `text` by `chunks` (kept passages in order) and `dropped` (link lists removed; none if `noisy` keeps them)."""
    split = docs.withColumn("_all", split_passages(strip_html_lines(F.col(text)))).drop(text)
    if noisy:
        return split.withColumnRenamed("_all", "chunks").withColumn("dropped", F.lit(0))
    kept = split.withColumn("chunks", F.filter("_all", lambda b: ~is_link_list(b["content"])))
    return kept.withColumn("dropped", F.size("_all") - F.size("chunks")).drop("_all")


def explode_chunks(sets: DataFrame) -> DataFrame:
    """One row per kept chunk of `chunk_sets`."""
    keep = [c for c in sets.columns if c not in ("chunks", "dropped")]
    rows = array_rows(sets, keep, F.col("chunks"), "_c", "chunk_index")
    return rows.select(*keep, "chunk_index", "_c.*").withColumn("token_count", word_count(F.col("content")))


def chunk_markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs -> (doc columns, chunk_index, content, heading, heading_path, token_count)."""
    return explode_chunks(chunk_sets(docs, text))


def chunk_drops(sets: DataFrame, by: str = "source_id") -> DataFrame:
    """Import outcome (`by`, reason, count) of a chunking run."""
    counts = sets.groupBy(by).agg(F.sum("dropped").cast("long").alias("count"))
    return counts.filter("count > 0").select(by, F.lit("link_list").alias("reason"), "count")


def drop_link_lists(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~is_link_list(F.col("content")))


def link_list_counts(chunks: DataFrame, by: str = "source_id") -> DataFrame:
    """Kept and dropped chunks per source in one pass."""
    noisy = is_link_list(F.col("content"))
    return chunks.groupBy(by).agg(
        F.count_if(~noisy).alias("kept"),
        F.count_if(noisy).alias("dropped"),
    )


def min_length(chunks: DataFrame) -> DataFrame:
    return chunks.filter(long_enough(F.col("content")))


def heading_outline(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, level, heading, path): headings in order with their ancestors, row by row."""
    return struct_rows(docs, [doc_id], outline_rows(F.col(text)), pos="pos")
