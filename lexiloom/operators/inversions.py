"""Concordant less discordant pairs of points, by counting inversions range by range."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct points that one task counts by itself.
LOCAL = 100_000


def local_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Sum over pairs of points of sign(x2 - x1) sign(y2 - y1) c1 c2.

    Two points of different x part at one bit of x's rank, the highest in which they differ. So for each bit, points that have it are
    set against those that lack it and agree above, by their places in the order of y.
    """
    _, xr = np.unique(x, return_inverse=True)
    _, yr = np.unique(y, return_inverse=True)
    height = int(yr.max(initial=0)) + 1
    whole = 0
    for bit in range(int(xr.max(initial=0)).bit_length()):
        place = (xr >> (bit + 1)) * height + yr
        low = (xr >> bit) & 1 == 0
        order = np.argsort(place[low], kind="stable")
        keys, sums = place[low][order], np.concatenate([[0], np.cumsum(c[low][order])])
        mine = place[~low]
        base = (mine // height) * height
        edges = [sums[np.searchsorted(keys, at, side)] for at, side in ((base, "left"), (mine, "left"), (mine, "right"), (base + height, "left"))]
        more = (edges[1] - edges[0]) - (edges[3] - edges[2])  # lower y less higher y
        whole += sum(int(a) * int(b) for a, b in zip(c[~low], more, strict=True))
    return whole


def _cut(points: DataFrame, n: int, name: str, ranges: int) -> tuple[DataFrame, Column]:
    """(points with the range of a column, whether a range may hold different values). A value that fills ranges is one of its own."""
    borders = points.agg(F.array_sort(F.array_distinct(F.percentile_approx(name, [k / ranges for k in range(1, ranges)], 100 * ranges))).alias("borders_"))
    below = F.size(F.filter("borders_", lambda b: b < F.col(name)))
    return points.crossJoin(F.broadcast(borders)).withColumn(f"{name}_range", 2 * below + F.array_contains("borders_", F.col(name)).cast("int")).drop("borders_"), F.col(f"{name}_range") % 2 == 0


def signed_pairs(points: DataFrame, local: int = LOCAL) -> DataFrame:
    """(s): a row with the sum over all pairs of points (x, y, c) of sign(x2 - x1) sign(y2 - y1) c1 c2, as a double; points are distinct,
    those with a null are in no pair; 0 without points.

    x and y are cut into ranges of about `local` points. A pair is in the same range of x and counted there; or in the same range of y
    but not of x, and counted there by y and the range of x, of which equal ones are one point first; or in neither, and counted
    between the cells of two ranges, which are points of the same kind and fewer. A range of a single value has no pair that counts,
    so a frequent value makes no large group. Every task works through about `local` points.
    """
    points = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("c").cast("long").alias("c")).where("x IS NOT NULL AND y IS NOT NULL")
    return _signed(points, local).agg(F.coalesce(F.sum("s"), F.lit(0).cast("decimal(38,0)")).cast("double").alias("s"))


def _signed(points: DataFrame, local: int) -> DataFrame:
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [str(local_pairs(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["c"].to_numpy()))]})

    counted = lambda rows, by: rows.groupBy(by).applyInPandas(count, "s string").select(F.col("s").cast("decimal(38,0)").alias("s"))
    n = points.count()
    ranges = math.ceil(n / local)
    if ranges <= 1:
        return counted(points.withColumn("one", F.lit(0)), "one")
    rows, mixed_x = _cut(points, n, "x", ranges)
    rows, mixed_y = _cut(rows, n, "y", ranges)
    same_x = counted(rows.where(mixed_x).select("x_range", "x", "y", "c"), "x_range")
    in_y = rows.where(mixed_y).groupBy("y_range", F.col("x_range").cast("double").alias("x"), "y").agg(F.sum("c").alias("c"))
    same_y = counted(in_y, "y_range")
    cells = rows.groupBy(F.col("x_range").cast("double").alias("x"), F.col("y_range").cast("double").alias("y")).agg(F.sum("c").alias("c"))
    return same_x.unionByName(same_y).unionByName(_signed(cells, max(local, 4 * ranges)))
