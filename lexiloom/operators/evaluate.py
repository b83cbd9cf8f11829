"""Retrieval and correlation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..sources import shared
from . import inversions, ranks


def word_metrics(pmf: DataFrame, gold: DataFrame, v2: int | DataFrame, cutoffs: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(w1, rr, n_gold, n_hit, pres1, pres5, prec1, prec5, rprec) of every word of pmf that gold (w1, w2) has.

    rr is 1 over the rank of the first gold candidate, or 1/v2 if there is none; v2 may be a table of one count.
    """
    gold = gold.select("w1", "w2").distinct()
    sizes = gold.groupBy("w1").agg(F.count("*").alias("n_gold"))
    words = pmf.select("w1").distinct().join(sizes, "w1")
    found = pmf.join(gold, ["w1", "w2"]).join(sizes, "w1")
    at = [F.sum((F.col("rk") <= k).cast("long")).alias(f"h{k}") for k in cutoffs]
    hits = found.groupBy("w1").agg(F.min("rk").alias("best"), F.count("*").alias("n_hit"), F.sum((F.col("rk") <= F.col("n_gold")).cast("long")).alias("hr"), *at)
    zero = F.lit(0)
    if isinstance(v2, int):
        rows = words.join(hits, "w1", "left").withColumn("v2", F.lit(v2))
    else:
        rows = words.join(hits, "w1", "left").crossJoin(F.broadcast(v2.select(F.col(v2.columns[0]).alias("v2"))))
    rr = F.when(F.col("best").isNotNull(), 1.0 / F.col("best")).otherwise(1.0 / F.col("v2"))
    return rows.select("w1", rr.alias("rr"), "n_gold", F.coalesce("n_hit", zero).alias("n_hit"), *[(F.coalesce(f"h{k}", zero) > 0).cast("int").alias(f"pres{k}") for k in cutoffs], *[(F.coalesce(f"h{k}", zero) / k).alias(f"prec{k}") for k in cutoffs], (F.coalesce("hr", zero) / F.col("n_gold")).alias("rprec"))


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(mrr, p1, p5, n) over all words, or over those of each group."""
    return metrics.groupBy(*(by or [])).agg(F.avg("rr").alias("mrr"), F.avg("pres1").alias("p1"), F.avg("pres5").alias("p5"), F.count("*").alias("n"))


def union_support(p: DataFrame, q: DataFrame) -> DataFrame:
    """(w1, w2, p, q) on the candidates of either, for words that both have; 0 where one lacks it."""
    words = p.select("w1").distinct().join(q.select("w1").distinct(), "w1")
    both = p.select("w1", "w2", "p").join(q.select("w1", "w2", F.col("p").alias("q")), ["w1", "w2"], "full_outer").join(words, "w1", "left_semi")
    return both.select("w1", "w2", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def jensen_shannon(both: DataFrame) -> DataFrame:
    """(w1, jsd) to base 2 of union_support(); terms of p up to 1e-7 are left out."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 1e-7, F.col(x) * (F.log(F.col(x)) - F.log(m))).otherwise(0.0)
    return both.groupBy("w1").agg((F.sum(part("p") + part("q")) / 2 / F.log(F.lit(2.0))).alias("jsd"))


def _correlation(x: str, y: str) -> Column:
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(spread, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, spearman, n): Pearson's correlation of average ranks; null where one side has no spread."""
    # written once, as groups are counted first, or each column is ranked by itself and then joined to all rows
    rows, _ = shared.written(rows.select(*(by or []), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)))
    if by and rows.groupBy(*by).count().where(F.col("count") > ranks.GROUP).isEmpty():
        both = ranks.grouped_ranks(rows, {"rx": x, "ry": y}, by)
    else:
        both = ranks.average_ranks(ranks.average_ranks(rows, x, "rx", by), y, "ry", by)
    return both.groupBy(*(by or [])).agg(_correlation("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def pearson(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, pearson, n); null where one side has no spread."""
    return rows.groupBy(*(by or [])).agg(_correlation(x, y).alias("pearson"), F.count("*").alias("n"))


def kendall(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(kendall, n): tau-b over all pairs of rows, from counts of equal (x, y); concordant and discordant pairs are counted as
    inversions, in n log n steps. Rows with a null are in no pair."""
    points = rows.groupBy(F.round(x, 12).alias("x"), F.round(y, 12).alias("y")).agg(F.count("*").alias("c"))
    s = inversions.signed_pairs(points)
    n = points.agg(F.sum("c").alias("n"))
    tied = lambda col: points.groupBy(col).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{col}"))
    row = s.crossJoin(n).crossJoin(tied("x")).crossJoin(tied("y"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return row.select(F.try_divide(F.col("s"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("kendall"), "n")


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(measure, value, p, n): Spearman's, Pearson's and Kendall's correlation of two columns with two-sided p-values.

    Three numbers reach the driver, where p-values are worked out. A correlation without value has none.
    """
    found = [("spearman", spearman(rows, x, y)), ("pearson", pearson(rows, x, y)), ("kendall", kendall(rows, x, y))]
    out = []
    for name, row in ((name, df.first()) for name, df in found):
        p = None if row[name] is None else (tails.kendall_p if name == "kendall" else tails.correlation_p)(row[name], row["n"])
        out.append((name, row[name], p, row["n"]))
    return rows.sparkSession.createDataFrame(out, "measure string, value double, p double, n long")


def score_pairs(gold: DataFrame, method: DataFrame) -> DataFrame:
    """(w1, w2, gold, score) of pairs that both tables (w1, w2, score) have."""
    return method.join(gold.select("w1", "w2", F.col("score").alias("gold")), ["w1", "w2"]).select("w1", "w2", "gold", "score")
