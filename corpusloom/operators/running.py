"""Running totals over long ordered groups.

A window over one source puts that source into one task. Here a group is cut into blocks of
consecutive sequence numbers; each block is totalled on its own, the (few) block totals are
accumulated per group, and every row adds the total of the blocks before its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..settings import RUNNING_BLOCK, materialise

_MERGE = {"sum": lambda a, b: a + b, "max": F.greatest}
_AGG = {"sum": F.sum, "max": F.max}


def running(
    df: DataFrame,
    key: str,
    seq: str,
    columns: dict[str, tuple[str, Column]],
    block: int = RUNNING_BLOCK,
) -> DataFrame:
    """Add running values per `key` in the order of the whole number `seq` (unique per key).

    `columns` maps a new column to ("sum" | "max", expression).
    """
    inputs = {name: f"_in_{name}" for name in columns}
    rows = df.withColumn("_block", F.floor(F.col(seq) / block)).withColumns(
        {inputs[name]: value for name, (_, value) in columns.items()}
    )
    totals = rows.groupBy(key, "_block").agg(
        *[_AGG[kind](inputs[name]).alias(f"_total_{name}") for name, (kind, _) in columns.items()]
    )
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        key,
        "_block",
        *[_AGG[kind](f"_total_{name}").over(earlier).alias(f"_before_{name}") for name, (kind, _) in columns.items()],
    )
    within = W.partitionBy(key, "_block").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    local = rows.join(offsets, [key, "_block"]).withColumns(
        {name: _AGG[kind](inputs[name]).over(within) for name, (kind, _) in columns.items()}
    )
    merged = {
        name: F.coalesce(_MERGE[kind](F.col(name), F.col(f"_before_{name}")), F.col(name), F.col(f"_before_{name}"))
        for name, (kind, _) in columns.items()
    }
    helper = ["_block", *inputs.values(), *[f"_before_{name}" for name in columns]]
    return local.withColumns(merged).drop(*helper)


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """`df`, written once, with `name`: the place of each row from 1 in the total order of its key's rows.

    Rows are dealt by ranges of the order; each range numbers its own rows, and the few counts of the
    ranges before it are added. So no key is ordered in one task.
    """
    ranged = df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    stored = materialise(ranged, "numbered")
    counts = stored.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(key, "_range").orderBy(*order)
    placed = stored.withColumn("_in_range", F.row_number().over(within)).join(starts, [key, "_range"])
    return placed.withColumn(name, F.col("_before") + F.col("_in_range")).drop("_range", "_in_range", "_before")
