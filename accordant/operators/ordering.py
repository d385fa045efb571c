"""Numbers of rows in an order, by range: no task holds more than a part of the rows, whatever the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accordant.sources.scratch import Tables

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = (1 << 33) - 1


def laid_out(df: DataFrame, order: Sequence[str], tables: Tables, name: str) -> DataFrame:
    """The rows, written in the order of these columns, with ``_part`` and, within it, ``_row``."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return tables.write(laid.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("_row")), name)


def before_parts(laid: DataFrame, group: Sequence[str], amount: Column, name: str) -> DataFrame:
    """(_part, group..., name, name_all): the sum of ``amount`` over a group's rows in the parts before, and over all. A group has a row for each part at most."""
    parts = laid.groupBy("_part", *group).agg(F.sum(amount).alias("_sum"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("_part", *group, before.alias(name), F.sum("_sum").over(whole).alias(f"{name}_all"))


def numbered(df: DataFrame, order: Sequence[str], tables: Tables, name: str = "numbered") -> DataFrame:
    """The rows with ``number``, their place in the order from 0, and ``rows``, how many there are."""
    laid = laid_out(df, order, tables, name)
    parts = before_parts(laid, [], F.lit(1), "_before")
    joined = laid.join(parts, "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_row")).alias("number"), F.col("_before_all").alias("rows"))
