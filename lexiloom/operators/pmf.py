"""Ranked sparse distributions p(w2 | w1) in long form: (w1, w2, p, rk)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which scores count as equal, so that ties fall to the word and not to the order of a sum.
DIGITS = 12


def _order(value: str, tie: list[Column | str] | None = None) -> list[Column | str]:
    return [F.round(value, DIGITS).desc(), *(tie or ["w2"])]


def ranked(scores: DataFrame, value: str = "score", tie: list[Column | str] | None = None, by: list[str] | None = None) -> DataFrame:
    """scores with rk, from 1 for each w1 (or `by`): larger first, ties by word (or by `tie`)."""
    return scores.withColumn("rk", F.row_number().over(Window.partitionBy(*by or ["w1"]).orderBy(*_order(value, tie))))


def normalised(scores: DataFrame, value: str = "score") -> DataFrame:
    """(w1, w2, p): scores divided by their sum; words whose scores sum to 0 have no row."""
    total = F.sum(value).over(Window.partitionBy("w1"))
    return scores.withColumn("t", total).where("t <> 0").select("w1", "w2", (F.col(value) / F.col("t")).alias("p"))


def min_shifted(scores: DataFrame, value: str = "score") -> DataFrame:
    """(w1, w2, p): scores less their minimum, divided by the sum of that; equal scores give no rows."""
    least = F.min(value).over(Window.partitionBy("w1"))
    return normalised(scores.select("w1", "w2", (F.col(value) - least).alias("score")))


def truncated(pmf: DataFrame, mass: float, most: int | None = None, renormalise: bool = True, given_order: bool = False, by: list[str] | None = None) -> DataFrame:
    """(w1 or by, w2, p, rk): the shortest prefix whose mass reaches `mass`, the crossing element too, at most `most`; then divided by its
    sum unless that is 0. With given_order the column rk says the order, else larger p come first."""
    by = by or ["w1"]
    rows = pmf if given_order else ranked(pmf, "p", by=by)
    # the same order as the rank's, so that rows are sorted once
    order = Window.partitionBy(*by).orderBy("rk") if given_order else Window.partitionBy(*by).orderBy(*_order("p"))
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = rows.withColumn("before", before).where(F.round("before", DIGITS) < mass)
    if most is not None:
        kept = kept.where(F.col("rk") <= most)
    if renormalise:
        total = F.sum("p").over(Window.partitionBy(*by))
        kept = kept.withColumn("t", total).withColumn("p", F.when(F.col("t") != 0, F.col("p") / F.col("t")).otherwise(F.col("p")))
    return kept.select(*by, "w2", "p", "rk")


def cumulative_cut(pmf: DataFrame, mass: float) -> DataFrame:
    """(w1, w2, p, rk): the shortest prefix whose mass exceeds `mass`, as it is."""
    rows = ranked(pmf, "p")
    before = F.coalesce(F.sum("p").over(Window.partitionBy("w1").orderBy(*_order("p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("before", before).where(F.round("before", DIGITS) <= mass).select("w1", "w2", "p", "rk")


def of_scores(scores: DataFrame, mass: float, most: int | None = None) -> DataFrame:
    """Scores as a truncated pmf."""
    return truncated(normalised(scores), mass, most)


def cut_rows(scores: np.ndarray, mass: float, most: int | None = None, beyond: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, p, rk) of what of_scores(), or with `beyond` cumulative_cut() of the normalised scores, keeps of a matrix of scores of
    source words by target words in the order of their names."""
    total = scores.sum(1)
    rows = np.flatnonzero(total != 0)
    p = scores[rows] / total[rows, None]
    by = np.argsort(-np.round(p, DIGITS), axis=1, kind="stable")
    p = np.take_along_axis(p, by, 1)
    before = np.round(np.cumsum(p, 1) - p, DIGITS)
    kept = before <= mass if beyond else before < mass
    if most is not None:
        kept[:, most:] = False
    if not beyond:
        whole = np.where(kept, p, 0.0).sum(1)
        p = p / np.where(whole != 0, whole, 1.0)[:, None]
    row, rank = np.nonzero(kept)
    return rows[row], by[row, rank], p[row, rank], (rank + 1).astype(np.int32)


def on_words(pmf: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose source word is in a list (column word)."""
    return pmf.join(words.select(F.col("word").alias("w1")).distinct(), "w1", "left_semi")
