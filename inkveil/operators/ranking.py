"""Numbers without gaps and running sums over a whole table, equal in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unused
from ..storage import stored


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """df with `name`: 0, 1, ... in `order` within each group; size: also a column with the group's number of rows.

    Rows are dealt by ranges of group and order, and the number of the range is written with them: so a
    task that is run again, or another plan, can't deal them differently. A rank is the row's
    place in its range plus the sizes of the ranges before; no task sees a whole group. Rows
    alike in all of `order` share a range and may swap numbers, so the order should
    end with what tells rows apart. An empty table gives an empty result.
    """
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, rows, before, whole, place = (unused(c, [*df.columns, name, size or ""]) for c in ("_range", "_rows", "_before", "_whole", "_place"))
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    dealt = stored(df.repartitionByRange(n, *keys).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*group, part).agg(F.count("*").alias(rows))
    of_group = Window.partitionBy(*group)
    sizes = sizes.withColumn(before, F.sum(rows).over(of_group.orderBy(part)) - F.col(rows)).withColumn(whole, F.sum(rows).over(of_group)).drop(rows)
    at = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, part]]
    both = dealt.withColumn(place, at).alias("a").join(sizes.alias("b"), same)
    out = [F.col(f"a.{c}") for c in df.columns] + [(F.col(place) + F.col(before)).cast("long").alias(name)]
    return both.select(*out, *([F.col(whole).alias(size)] if size else []))


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over all rows before, in `order`; by stored ranges, as `ranked`."""
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, sums, before, own = (unused(c, [*df.columns, name]) for c in ("_range", "_sum", "_before", "_own"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.sum(value).alias(sums))
    sizes = sizes.select(part, (F.sum(sums).over(Window.orderBy(part)) - F.col(sums)).alias(before))  # a row for each range
    upto = F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn(own, upto - F.col(value)).join(sizes, part).select(*df.columns, (F.col(own) + F.col(before)).cast("long").alias(name))
