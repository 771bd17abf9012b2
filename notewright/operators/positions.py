"""Row numbers over a whole table, and within keys, without a task for a whole key.

Rows are dealt into ranges of the sort columns, so that a key with very many rows is spread
over tasks; each row's place in its range is known where it is sorted, and the ranges' sizes,
one row a range, give the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: the partition above, the row below


def with_position(df: DataFrame, *order: str | Column, name: str = "position", label: str = "positions") -> DataFrame:
    """``df`` with ``name``: 1 for the first row in the order, 2 for the next, and so on. Nulls
    come first; equal rows are numbered in any order. The rows are written before they are
    sorted, as finding the ranges reads them once more, and after it, so that numbers stay as
    they are when a task is repeated."""
    part, row = f"_{name}_part", f"_{name}_row"
    number = F.monotonically_increasing_id()
    ranged = materialize(df, label).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn(row, number)
    placed = materialize(
        placed.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND(F.lit(IN_PARTITION))), label
    )
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    # one row a range of the sort: as many as shuffle partitions
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), part)
    return joined.select(*df.columns, (F.col(row) + F.col("_before") + 1).alias(name))


def numbered_within(df: DataFrame, key: str, *order: str | Column, name: str = "n", label: str = "numbered") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each ``key`` by ``order``. Null keys are one key. Only
    a key's first position is joined back, and a join splits the partitions of large keys."""
    position, first, of = f"_{name}_position", f"_{name}_first", f"_{name}_of"
    placed = materialize(with_position(df, key, *order, name=position, label=label), label)
    firsts = materialize(placed.groupBy(F.col(key).alias(of)).agg(F.min(position).alias(first)), label)
    joined = placed.join(firsts, F.col(key).eqNullSafe(F.col(of)))
    return joined.select(*df.columns, (F.col(position) - F.col(first) + 1).alias(name))
