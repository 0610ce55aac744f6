"""Dense row numbers, term blocks and explicit repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition below this bit


def doc_index(df: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """``(key, idx)``: dense 0-based numbers in key order, for a unique key.

    One range shuffle; the running offset is over one row per partition.
    """
    keys = df.select(key)
    ranged = (
        keys.repartitionByRange(partitions, key) if partitions else keys.repartitionByRange(key)
    )
    placed = cut_lineage(
        ranged.sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    ).select(
        key,
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition, so the broadcast is bounded by the partition count.
    return placed.join(F.broadcast(offsets), "_part").select(
        key, (F.col("_offset") + F.col("_row")).alias("idx")
    )


def block_count(size: int, block_size: int, bounded: bool = True) -> int:
    """Number of near-equal blocks for ``size`` ids; at least 1."""
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    if bounded:
        return max(1, -(-size // block_size))
    return max(1, (2 * size + block_size) // (2 * block_size))


def term_block(
    term_id: Column, size: int, block_size: int = 1000, bounded: bool = True, start: int = 0
) -> Column:
    """Block of an id in ``[start, start + size)``; bounded blocks never exceed ``block_size``."""
    splits = block_count(size, block_size, bounded)
    scaled = (term_id.cast("long") - start) * splits
    return ((scaled - scaled % size) / size).cast("int")


def repartition_documents(df: DataFrame, partitions: int = 336, key: str = "doc_id") -> DataFrame:
    """Spread documents evenly over ``partitions`` by their key."""
    return df.repartition(partitions, key)
