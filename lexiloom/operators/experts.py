"""Several distributions combined: through a third language, by weights, by categories, by a gate on word features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def pivot(source_pivot: DataFrame, pivot_target: DataFrame, target_vocab: DataFrame) -> DataFrame:
    """(w1, w2, p): sum over pivot words a of p(w2 | a) p(a | w1).

    A pivot word without row in pivot_target spreads its mass evenly over that table's target words; targets outside them have
    no mass. Source words without a row have none here either. Only that even share touches the whole target vocabulary.
    """
    targets = pivot_target.select("w2").distinct()
    size = targets.agg(F.count("*").alias("v"))
    shared = target_vocab.select(F.col("word").alias("w2")).distinct().join(targets, "w2", "left_semi")
    left = source_pivot.select("w1", F.col("w2").alias("a"), F.col("p").alias("pa"))
    right = pivot_target.select(F.col("w1").alias("a"), "w2", F.col("p").alias("pt"))
    direct = left.join(right, "a").join(shared, "w2", "left_semi").groupBy("w1", "w2").agg(F.sum(F.col("pt") * F.col("pa")).alias("p"))
    lost = left.join(right.select("a").distinct(), "a", "left_anti").groupBy("w1").agg(F.sum("pa").alias("mass"))
    even = lost.crossJoin(F.broadcast(size)).crossJoin(shared).select("w1", "w2", (F.col("mass") / F.col("v")).alias("p"))
    return direct.unionByName(even).groupBy("w1", "w2").agg(F.sum("p").alias("p"))


def pivot_unseen(source_pivot: DataFrame, pivot_target: DataFrame, target_vocab: DataFrame, words: DataFrame) -> DataFrame:
    """pivot() for words that source_pivot has never seen: every one of its pivot words is as likely."""
    pivots = source_pivot.select(F.col("w2").alias("w2")).distinct()
    size = pivots.agg(F.count("*").alias("n"))
    even = pivots.crossJoin(F.broadcast(size)).select(F.lit("").alias("w1"), "w2", (1.0 / F.col("n")).alias("p"))
    unseen = words.select(F.col("word").alias("w1")).distinct().join(source_pivot.select("w1").distinct(), "w1", "left_anti")
    # one distribution serves all such words
    return unseen.crossJoin(pivot(even, pivot_target, target_vocab).select("w2", "p"))


def union_of(experts: Sequence[DataFrame]) -> DataFrame:
    """(j, w1, w2, p) of pmfs numbered from 0."""
    out = None
    for j, pmf in enumerate(experts):
        part = pmf.select(F.lit(j).alias("j"), "w1", "w2", "p")
        out = part if out is None else out.unionByName(part)
    return out


def expert_vocabularies(experts: DataFrame) -> DataFrame:
    """(j, v, inv_v): target words of each expert."""
    return experts.groupBy("j").agg(F.countDistinct("w2").alias("v")).withColumn("inv_v", 1.0 / F.col("v"))


def mixture(experts: DataFrame, weights: DataFrame, sources: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, w1, w2, p): sum of e_j p_j(w2 | w1) with weights (by, j, e), or per word (by, w1, j, e), for sources (by, word).

    An expert that has never seen w1 gives 1/v to each of its v target words. Those back-offs are expert tables joined once per
    word that lacks the expert, not a cross of vocabularies.
    """
    by = by or []
    key = [*by, "w1"]
    words = sources.select(*by, F.col("word").alias("w1")).distinct()
    if "w1" in weights.columns:
        e = weights.join(words, key, "left_semi").select(*key, "j", "e")
    else:
        e = (words.join(F.broadcast(weights), by) if by else words.crossJoin(F.broadcast(weights))).select(*key, "j", "e")
    seen = experts.join(e, ["w1", "j"]).select(*key, "w2", (F.col("p") * F.col("e")).alias("p"))
    unseen = e.join(experts.select("w1", "j").distinct(), ["w1", "j"], "left_anti")
    targets = experts.select("j", "w2").distinct().join(F.broadcast(expert_vocabularies(experts).select("j", "inv_v")), "j")
    even = unseen.join(targets, "j").select(*key, "w2", (F.col("e") * F.col("inv_v")).alias("p"))
    return seen.unionByName(even).groupBy(*key, "w2").agg(F.sum("p").alias("p"))


def collapsed(eps: DataFrame, theta: DataFrame) -> DataFrame:
    """(j, e): weights of experts over all categories, from (k, j, e) and (k, p)."""
    return eps.join(F.broadcast(theta), "k").groupBy("j").agg(F.sum(F.col("e") * F.col("p")).alias("e"))


def distance(x: Column, mu: Column) -> Column:
    """Squared distance of two vectors."""
    return F.aggregate(F.zip_with(x, mu, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)


def gate(features: DataFrame, gauss: DataFrame, eps: DataFrame) -> DataFrame:
    """(w1, j, e): sum over clusters k of pi exp(-|x - mu|^2 / 2 sigma^2) / sigma * eps_kj, for words with features (word, x)."""
    g = F.col("pi") * F.exp(-distance(F.col("x"), F.col("mu")) / (2 * F.col("sigma") * F.col("sigma"))) / F.col("sigma")
    weights = features.crossJoin(F.broadcast(gauss)).select(F.col("word").alias("w1"), "k", g.alias("g"))
    return weights.join(F.broadcast(eps), "k").groupBy("w1", "j").agg(F.sum(F.col("g") * F.col("e")).alias("e"))


def best_expert(gold: DataFrame, experts: DataFrame, names: DataFrame) -> DataFrame:
    """(w1, w2, expert, p): for each gold pair the expert that gives it most, the first of equals, 0 where none has it. Of the experts only
    rows of gold pairs are shuffled."""
    every = gold.crossJoin(F.broadcast(names))
    mine = experts.join(shared.hinted(gold, ["w1", "w2"]), ["w1", "w2"], "left_semi")
    p = every.join(mine, ["j", "w1", "w2"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return p.groupBy("w1", "w2").agg(F.max(F.struct(F.round("p", 12).alias("r"), (-F.col("j")).alias("o"), "expert", "p")).alias("b")).select("w1", "w2", F.col("b.expert").alias("expert"), F.col("b.p").alias("p"))
