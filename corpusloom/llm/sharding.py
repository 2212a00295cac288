"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for every key; the shard with the best draw keeps the row. The draw
depends on the key and the shard alone, so a further shard takes rows into itself only, and a
heavier shard wins proportionally more keys.

Defined cases: a null key is a key of its own, a null text has one byte of size and the checksum
of an empty text, repeated rows share their shard and get slots of their own, extra columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..settings import materialise

_BITS = 52  # of the draw; 13 hexadecimal digits


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard only."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}"))), 1, _BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def stable_key(column: Column) -> Column:
    """The key as text; null differs from every value."""
    return F.coalesce(F.concat(F.lit("k"), column.cast("string")), F.lit("n"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(draw) / weight; ties go to the lowest number."""
    bids = [
        F.struct((-F.log(draw(key, shard)) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))
        for shard, weight in enumerate(weights)
    ]
    return F.array_min(F.array(*bids))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str) -> DataFrame:
    """Number the rows of each shard from 0, in `order`, without gathering a shard in one task.

    The rows are range-partitioned by shard and order, so a row's slot is its rank inside its
    partition plus the rows of the shard in the partitions before. Only the counts by partition
    are summed over a whole shard.
    """
    keys = [shard, *order]
    ranged = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    placed = materialise(ranged, "slots")
    counts = placed.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_part").orderBy(*order)
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    numbered = ranked.join(starts, [shard, "_part"]).withColumn(slot, (F.col("_start") + F.col("_rank")).cast("long"))
    return numbered.drop("_part", "_rank", "_start")


def shard_documents(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    `grown_shard` is the shard once one more of weight `grown_weight` exists. Only sizes and
    checksums of the texts are moved.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    name = stable_key(F.col(key))
    rows = docs.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        rendezvous(name, weights).alias("shard"),
        rendezvous(name, [*weights, grown_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    return with_slots(rows, "shard", [key, "text_crc32", "_seq"], "slot").drop("_seq")
