"""Ranks within groups of any size: two levels instead of one window a group.

Rows are dealt into ranges of (group, order) and sorted there, so a group that holds a third of all rows spans many
tasks. A row's rank is its place in its part plus the sizes of the group's earlier parts; only these sizes, one
row for each part of each group, go through a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def ranked(rows: DataFrame, group: list[str], order: list[str | Column], into: str = "rank", size: str = "", write: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """rows with `into`, from 0 within each group in this order (nulls first); with `size`, also the group's number of rows.

    Ties are numbered in any order, but each row gets a number of its own, and it stays: the sorted rows are a written
    table. Rows are spread over tasks even if all are tied.
    """
    names = [f"__by{k}" for k in range(len(order))]
    keyed = rows.select("*", *(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(order, names, strict=True)), F.monotonically_increasing_id().alias("__tie"))
    by = [*group, *names, "__tie"]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names, "__tie")
    placed = write(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*group).orderBy("__part")
    parts = parts.withColumn("__before", F.sum("__n").over(earlier) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(*group)))
    parts = parts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__part").alias("__p"), "__first", "__before", "__all")
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    found = placed.join(parts, same)
    more = [F.col("__all").alias(size)] if size else []
    return found.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(into), *more)
