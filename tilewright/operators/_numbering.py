"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators._tables import written

#: Bits of a generated id that hold the place in its partition.
PLACE = 33


def numbered(rows: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """rows with a gapless number from 0 in the order of the columns. Partitions are ranges of the order, each sorted by its own task; a row's number is its place in its partition behind the counts of those before it."""
    kept = rows.columns
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # Written, as bounds of ranges come from a sample that another run might draw otherwise.
    placed = written(parts, "numbered")
    part = F.shiftright("_at", PLACE)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row a partition.
    before = counts.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    met = placed.join(before, part == F.col("_part"))
    return met.select(*kept, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE) - 1))).alias(name))


def running(rows: DataFrame, order: list[str], value: str, name: str, how: str = "sum") -> DataFrame:
    """rows with the sum, or the max, of value over all rows up to each, itself included, in the order of the columns, which must be a total one. As numbered(): within ranges of the order, behind what the ranges before add."""
    kept = rows.columns
    over = {"sum": F.sum, "max": F.max}[how]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_at", PLACE))
    whole = placed.groupBy("_part").agg(over(value).alias("_own"))
    # A row a partition.
    before = whole.select("_part", over("_own").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = over(value).over(Window.partitionBy("_part").orderBy("_at"))
    met = placed.withColumn("_upto", own).join(before, "_part")
    both = F.col("_upto") + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_upto", "_before")
    return met.select(*kept, both.alias(name))
