"""Full-text retrieval for batches of queries."""

from __future__ import annotations

from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.arrays import array_rows
from ..functions.stem import stem_words
from ..functions.text import analyse
from ..settings import materialise

if TYPE_CHECKING:
    from .text_store import TextStore

# --- fixed values: BM25 parameters (Robertson et al.) ---------------------------------
K1 = 1.2
B = 0.75
# --------------------------------------------------------------------------------------
POSTINGS_PART = 65_536
INDEX_PARTS = 64
PUSHED_TERMS = 1000  # asked terms that are pushed to the scan by name
RANK_DIGITS = 12  # scores that differ less are ties


def exact_score(part: Column) -> Column:
    """The sum of the terms' shares of a score. Decimals add up alike in any order, so equal chunks have equal scores
    (doubles don't: at 250, one step is 3e-14, and sums of a hundred terms differ in the last of the RANK_DIGITS)."""
    return F.round(F.sum(part.cast("decimal(30,18)")), RANK_DIGITS).cast("double")


def exact_total(parts: Column) -> Column:
    """`exact_score` of an array of shares."""
    kind = "decimal(30,18)"
    total = F.aggregate(parts, F.lit(0).cast(kind), lambda a, x: (a + x.cast(kind)).cast(kind))
    return F.round(total, RANK_DIGITS).cast("double")


def search_terms(text: str, stem: bool) -> Column:
    return stem_words(analyse(F.col(text))) if stem else analyse(F.col(text))


class TextIndex(NamedTuple):
    """An inverted index: postings (part, term, chunk_id, source_name, n_tokens, tf) and one row of totals (n, mean).

    `part` is a hash of the term; a stored index is partitioned by it. A search names its parts and,
    of a small batch, its terms before the scan, so other files are not listed. This is the plain
    form for one corpus at once; `text_store` stops early and grows by imports.
    """

    postings: DataFrame
    totals: DataFrame


def _part(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_PARTS)).cast("int").alias("part")


def text_index(chunks: DataFrame, stem: bool = False) -> TextIndex:
    """Index of chunks (chunk_id, source_name, content).

    With `stem`, English words are reduced to their stems; queries then need `stem` as well. The
    words of a chunk sit in one input row, so they are counted before anything is shuffled.
    """
    tokens = chunks.select("chunk_id", "source_name", search_terms("content", stem).alias("tokens"))
    sized = tokens.withColumn("n_tokens", F.size("tokens"))
    words = array_rows(sized, ["chunk_id", "source_name", "n_tokens"], F.col("tokens"), "term")
    counted = words.groupBy("term", "chunk_id", "source_name", "n_tokens").agg(F.count(F.lit(1)).alias("tf"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"))
    return TextIndex(counted.select(_part(), "term", "chunk_id", "source_name", "n_tokens", "tf"), totals)


def write_text_index(index: TextIndex, path: str) -> None:
    """Store an index; a part with a very frequent term is split over several files."""
    clustered = index.postings.hint("rebalance", "part").sortWithinPartitions("part", "term")
    clustered.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def read_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def query_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, term): the distinct terms of queries (query_id, text)."""
    return array_rows(queries, ["query_id"], F.array_distinct(search_terms("text", stem)), "term")


def postings(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The postings of the terms that are asked for, written once because several joins read them."""
    wanted = asked.select(_part(), "term").distinct()
    parts = [r.part for r in wanted.select("part").distinct().collect()]  # at most INDEX_PARTS
    few = wanted.select("term").limit(PUSHED_TERMS + 1).collect()
    rows = index.postings.filter(F.col("part").isin(parts))
    if len(few) <= PUSHED_TERMS:
        rows = rows.filter(F.col("term").isin([r.term for r in few]))
    else:
        rows = rows.join(wanted, ["part", "term"], "left_semi")
    return materialise(rows.drop("part"), "postings")


def _parts(df: Column) -> Column:
    return F.ceil(df / POSTINGS_PART).cast("long")


def _matches(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, term, tf, n_tokens, df): rows of the chunks that hold all terms of a query.

    A query first meets the postings of its rarest term only; frequent words are then looked up per
    candidate, on the evenly spread key (chunk_id, term). The rarest term of a query may still be a
    frequent word: its postings are cut into parts of about `POSTINGS_PART` rows for the first join.
    """
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    plan = (
        asked.join(frequency, "term", "left")
        .groupBy("query_id")
        .agg(
            F.collect_list(F.struct("term", "df")).alias("terms"),
            F.min_by("term", F.struct("df", "term")).alias("anchor"),
            F.min("df").alias("anchor_df"),
            F.count("df").alias("_known"),
        )
        .filter(F.col("_known") == F.size("terms"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), _parts(F.col("anchor_df")) - 1)))
    )
    cut = found.join(frequency.withColumnRenamed("df", "anchor_df"), "term").select(
        "chunk_id", F.col("term").alias("anchor"), F.pmod(F.xxhash64("chunk_id"), _parts(F.col("anchor_df"))).alias("part")
    )
    candidates = cut.join(plan, ["anchor", "part"]).select("query_id", "chunk_id", "terms")
    expected = candidates.select(
        "query_id", "chunk_id", F.size("terms").alias("n_terms"), F.inline("terms").alias("term", "df")
    )
    return expected.join(found.select("chunk_id", "term", "tf", "n_tokens", "source_name"), ["chunk_id", "term"])


def text_match(index: TextIndex | TextStore, queries: DataFrame, stem: bool = False) -> DataFrame:
    """(query_id, chunk_id) where the chunk contains every term of the query; a store knows about its stems itself."""
    if not isinstance(index, TextIndex):
        return index.match(queries)
    asked = query_terms(queries, stem)
    hits = _matches(postings(index, asked), asked).groupBy("query_id", "chunk_id", "n_terms")
    return hits.agg(F.count(F.lit(1)).alias("n")).filter("n = n_terms").select("query_id", "chunk_id")


def search_text(
    index: TextIndex | TextStore, queries: DataFrame, k: int, source: str | None = None, stem: bool = False
) -> DataFrame:
    """(query_id, chunk_id, score, rank): matching chunks by BM25, at most k per query.

    Document frequencies are those of the whole index; `source` only restricts the results.
    """
    if not isinstance(index, TextIndex):
        return index.search(queries, k, source)
    asked = query_terms(queries, stem)
    rows = _matches(postings(index, asked), asked)
    if source is not None:
        rows = rows.filter(F.col("source_name") == source)
    totals = index.totals.select(F.struct("n", "mean").alias("s")).scalar()
    tf, df, size = F.col("tf"), F.col("df"), F.col("n_tokens")
    idf = F.log(1 + (F.col("_s.n") - df + 0.5) / (df + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.col("_s.mean")))
    scored = (
        rows.withColumn("_s", totals)
        .groupBy("query_id", "chunk_id", "n_terms")
        .agg(F.count(F.lit(1)).alias("n"), exact_score(part).alias("score"))
        .filter("n = n_terms")
    )
    return top_k(scored.select("query_id", "chunk_id", "score"), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k per query with `rank` from 1. Each input task forwards at most k rows per query."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
