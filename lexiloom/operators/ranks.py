"""Places, running counts and ranks in an order over any number of rows, worked out by ranges side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Ranges that the values of a group are cut into, lines of a block of a file, and rows of a group that are sorted as one.
RANGES, BLOCK, GROUP = 256, 65_536, 1_000_000


def _ranged(rows: DataFrame, by: list[str], value: Column, ranges: int) -> DataFrame:
    """rows with range_, the number of borders below the value: borders cut the values of each group into about equal parts. Equal
    values are in one range, nulls in the first."""
    shares = [k / ranges for k in range(1, ranges)]
    borders = rows.select(*by, value.alias("v")).groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, 100 * ranges))).alias("borders_"))
    rows = rows.withColumn("value_", value)
    if by:
        same = [rows[c].eqNullSafe(F.col(f"{c}__")) for c in by]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        joined = rows.join(borders.select(*[F.col(c).alias(f"{c}__") for c in by], "borders_"), condition).drop(*[f"{c}__" for c in by])
    else:
        joined = rows.crossJoin(F.broadcast(borders))
    below = F.coalesce(F.size(F.filter("borders_", lambda b: b < F.col("value_"))), F.lit(0))
    return joined.withColumn("range_", F.when(F.col("value_").isNull() | F.col("borders_").isNull(), 0).otherwise(below)).drop("borders_")


def _before(rows: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """(by, range_, before_): the amount in all lower ranges of a group, of which there are few."""
    totals = rows.groupBy(*by, "range_").agg(F.sum(amount).alias("amount_"))
    upto = Window.partitionBy(*by or [F.lit(0)]).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "range_", F.coalesce(F.sum("amount_").over(upto), F.lit(0)).alias("before_"))


def _with_before(rows: DataFrame, by: list[str], before: DataFrame) -> DataFrame:
    names = [*by, "range_"]
    condition = rows[names[0]].eqNullSafe(F.col(f"{names[0]}__"))
    for c in names[1:]:
        condition = condition & rows[c].eqNullSafe(F.col(f"{c}__"))
    return rows.join(before.select(*[F.col(c).alias(f"{c}__") for c in names], "before_"), condition).drop(*[f"{c}__" for c in names])


def numbered(rows: DataFrame, by: list[str], value: Column, order: list[Column | str], ranges: int = RANGES) -> DataFrame:
    """rows with place, from 1 in each group of `by`, in `order`. value is a number that does not fall along the order and that few
    rows share; rows are ranked range by range of it."""
    cut = _ranged(rows, by, value, ranges)
    inside = F.row_number().over(Window.partitionBy(*by, "range_").orderBy(*order))
    return _with_before(cut.withColumn("inside_", inside), by, _before(cut, by, F.lit(1))).withColumn("place", F.col("inside_") + F.col("before_")).drop("inside_", "before_", "range_", "value_")


def counts_below(points: DataFrame, by: list[str], value: str, count: str, ranges: int = RANGES) -> DataFrame:
    """points (by, value, count), a row for each value of a group, with below: the count of all lower values; nulls are lowest."""
    cut = _ranged(points, by, F.col(value), ranges)
    inside = F.coalesce(F.sum(count).over(Window.partitionBy(*by, "range_").orderBy(F.col("value_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _with_before(cut.withColumn("inside_", inside), by, _before(cut, by, F.col(count))).withColumn("below", F.col("inside_") + F.col("before_")).drop("inside_", "before_", "range_", "value_")


def average_ranks(rows: DataFrame, value: str, name: str, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """rows with average ranks: equal values (to 12 digits) share the mean of their places; nulls are equal and lowest.

    Values are counted first, so that ties are one row wherever ranges end, and ranks are joined back by value. The counts are
    written, as ranges are found from them and then filled with them.
    """
    by = by or []
    keyed = rows.withColumn("key_", F.round(value, 12))
    points, _ = shared.written(keyed.groupBy(*by, "key_").agg(F.count("*").alias("c_")))
    ranked = counts_below(points, by, "key_", "c_", ranges)
    found = ranked.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("key_").alias("key__"), (F.col("below") + (F.col("c_") + 1) / 2).alias(name))
    condition = keyed["key_"].eqNullSafe(F.col("key__"))
    for c in by:
        condition = condition & keyed[c].eqNullSafe(F.col(f"{c}__"))
    return keyed.join(found, condition).drop("key_", "key__", *[f"{c}__" for c in by])


def grouped_ranks(rows: DataFrame, columns: dict[str, str], by: list[str]) -> DataFrame:
    """rows with average_ranks() of several columns, given by the names of their ranks, in groups of at most GROUP rows: each group is
    sorted by each of them, and all sorts share one shuffle. Larger groups are left to average_ranks()."""
    for name, value in columns.items():
        order = Window.partitionBy(*by).orderBy("key_")
        ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        rows = rows.withColumn("key_", F.round(value, 12)).withColumn(name, F.rank().over(order) + (ties - 1) / 2).drop("key_")
    return rows


def running(rows: DataFrame, line: str, value: Column, how: str, name: str, block: int = BLOCK, levels: int = 2) -> DataFrame:
    """rows with a running value along whole numbers `line`: how = "last" is the last value that is not null up to a row, "count" the
    number of values that are not null before it.

    Every block of lines is scanned by itself and then takes what the blocks before it hand on, which is found in the same way from a
    row for each block; so 10**12 lines end in a table of some hundred rows.
    """
    rows = rows.withColumn("given_", value).withColumn("block_", F.floor(F.col(line) / block)) if levels else rows.withColumn("given_", value).withColumn("block_", F.lit(0))
    inside = Window.partitionBy("block_").orderBy(line)
    last = how == "last"
    here = F.last("given_", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)) if last else F.count("given_").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn(name, here)
    if levels:
        known = F.col("given_").isNotNull()
        ends = rows.groupBy("block_").agg((F.max_by("given_", F.when(known, F.col(line))) if last else F.count("given_")).alias("end_"))
        handed = _handed(ends, last, block, levels - 1).select(F.col("block_").alias("block__"), "handed_")
        out = out.join(handed, out["block_"] == F.col("block__"))
        out = out.withColumn(name, F.coalesce(name, "handed_") if last else F.col(name) + F.col("handed_")).drop("handed_", "block__")
    return out.drop("given_", "block_")


def _handed(ends: DataFrame, last: bool, block: int, levels: int) -> DataFrame:
    """(block_, handed_): what the blocks before each hand on."""
    upto = Window.partitionBy("up_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    rows = ends.withColumn("up_", F.floor(F.col("block_") / block) if levels else F.lit(0))
    out = rows.withColumn("handed_", F.last("end_", ignorenulls=True).over(upto) if last else F.coalesce(F.sum("end_").over(upto), F.lit(0)))
    if levels:
        tops = rows.groupBy("up_").agg((F.max_by("end_", F.when(F.col("end_").isNotNull(), F.col("block_"))) if last else F.sum("end_")).alias("end_"))
        above = _handed(tops.select(F.col("up_").alias("block_"), "end_"), last, block, levels - 1).select(F.col("block_").alias("up__"), F.col("handed_").alias("above_"))
        out = out.join(above, out["up_"] == F.col("up__")).withColumn("handed_", F.coalesce("handed_", "above_") if last else F.col("handed_") + F.col("above_"))
    return out.select("block_", "handed_")
