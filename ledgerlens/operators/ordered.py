"""Ordered operators over groups of any size.

One group may hold a large part of all rows, so no window runs over a whole group. Rows are cut into
blocks, windows run inside a block, and what precedes a block is added from the blocks' totals: one row
per block, so the only window over a whole group sees few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.config import BLOCK_ROWS
from ledgerlens.durable import pin


def block_of(row_no: str | Column, rows: int | None = None) -> Column:
    number = F.col(row_no) if isinstance(row_no, str) else row_no
    return F.floor((number - 2) / F.lit(rows or BLOCK_ROWS)).cast("bigint")


def before(df: DataFrame, groups: list[str], block: str, totals: dict[str, Column]) -> DataFrame:
    """Per (group, block): the sums of ``totals`` over all earlier blocks of the group."""
    per = df.groupBy(*groups, block).agg(*[F.sum(c).alias(name) for name, c in totals.items()])
    earlier = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*groups, block, *[F.sum(name).over(earlier).alias(name) for name in totals])


def running_sum(
    df: DataFrame, groups: list[str], row_no: str, value: Column, name: str, rows: int | None = None
) -> DataFrame:
    """Adds the running sum of a DECIMAL or BIGINT by row number; needs rows numbered 2, 3, ... per group."""
    df = df.withColumns({"_block": block_of(row_no, rows), "_value": value})
    kind = df.select("_value").schema[0].dataType.simpleString()
    kind = kind if kind == "bigint" else "decimal(37,10)"
    offsets = before(df, groups, "_block", {"_offset": F.col("_value")})
    inside = Window.partitionBy(*groups, "_block").orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum("_value").over(inside).cast(kind))
        .join(offsets, [*groups, "_block"])
        .withColumn(name, F.col("_inside") + F.coalesce(F.col("_offset").cast(kind), F.lit(0).cast(kind)))
        .drop("_block", "_value", "_inside", "_offset")
    )


def in_ordered_parts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Range-partitions by all ``keys`` and records the part, so that a large group spans many parts.

    The rows are pinned: the ranges come from a sample, and every later branch must see the same parts.
    """
    return pin(df.repartitionByRange(*keys).withColumn(name, F.spark_partition_id().cast("bigint")))


def number_rows(
    df: DataFrame, groups: list[str], order_keys: list[str], name: str = "row_no", first: int = 1
) -> DataFrame:
    """Numbers the rows of every group in the order of ``order_keys``, which must be unique in the group."""
    ranged = in_ordered_parts(df, [*groups, *order_keys], "_part")
    offsets = before(ranged, groups, "_part", {"_offset": F.lit(1).cast("bigint")})
    inside = Window.partitionBy(*groups, "_part").orderBy(*order_keys)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*groups, "_part"])
        .withColumn(name, F.col("_inside") + F.coalesce(F.col("_offset"), F.lit(0)) + F.lit(first - 1))
        .drop("_part", "_inside", "_offset")
    )


def in_middle(numbers: DataFrame, groups: list[str]) -> DataFrame:
    """Per group the numbers at the two middle ranks, as a and b; ``numbers``: distinct ``number`` (of any type that sorts) with its ``cnt``.

    Row counts are cumulated in the order of the numbers. A group may have any number of them, so they are cut into ordered parts,
    and only the parts that hold a middle rank are looked into.
    """
    ranged = in_ordered_parts(numbers, [*groups, "number"], "_part")
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("cnt").alias("in_part"))
    over_parts = Window.partitionBy(*groups).orderBy("_part")
    # Few rows: one per group and part.
    located = (
        parts.withColumns(
            {
                "upto_part": F.sum("in_part").over(over_parts.rowsBetween(Window.unboundedPreceding, 0)),
                "n": F.sum("in_part").over(Window.partitionBy(*groups)),
            }
        )
        .withColumn("before_part", F.col("upto_part") - F.col("in_part"))
        .filter((F.col("upto_part") >= F.floor((F.col("n") + 1) / 2)) & (F.col("before_part") < F.floor(F.col("n") / 2) + 1))
        .select(*groups, "_part", "n", "before_part")
    )
    inside = Window.partitionBy(*groups, "_part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(located, [*groups, "_part"]).withColumn("upto", F.sum("cnt").over(inside) + F.col("before_part"))
    holds = lambda rank: (F.col("upto") - F.col("cnt") < rank) & (F.col("upto") >= rank)
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return ranked.groupBy(*groups).agg(
        F.max(F.when(holds(lower), F.col("number"))).alias("a"), F.max(F.when(holds(upper), F.col("number"))).alias("b")
    )
