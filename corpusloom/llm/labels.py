"""Folds, and all or bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def _marks(labels: DataFrame, label: str, key: str) -> DataFrame:
    """(key, label): one label of 0 or 1 a document."""
    return labels.groupBy(key).agg(F.max(label).alias("label")).filter(F.col("label").isin(0, 1) & F.col(key).isNotNull())


def all_labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of every labelled document.

    The labels grow with the documents, so a broadcast of them holds for small tables only: texts are moved once at every
    size, and meet a table of the labels of their partition, so that no text is sorted.
    """
    given = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.join(_marks(labels, label, key).hint("shuffle_hash"), key)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most `most` labelled documents of each class.

    The lowest hashes of the keys are taken, so the choice is repeatable. The classes are counted
    first, so that only about as many keys as are taken get ordered. The sample's size is bounded
    by the parameter, so its keys are broadcast and no text is shuffled.
    """
    marks = _marks(labels, label, key)
    sizes = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}

    def lowest(label: int) -> DataFrame:
        share = min(1.0, 1.1 * most / max(1, sizes.get(label, 0)))  # of the range of the hash
        low = F.xxhash64(key) <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
        return marks.filter((F.col("label") == label) & low).orderBy(F.xxhash64(key), key).limit(most)

    chosen = [lowest(label) for label in (0, 1)]
    keys = chosen[0].unionByName(chosen[1])
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(keys), key)
