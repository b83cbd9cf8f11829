"""Article titles to write next, and labels translated through a pmf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _first(pmf: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """(w1, suggestions): the first n candidates that are titles (column title); words without any are left out."""
    hits = pmf.join(titles.select(F.col("title").alias("w2")).distinct(), "w2", "left_semi")
    top = hits.withColumn("i", F.row_number().over(Window.partitionBy("w1").orderBy("rk"))).where(F.col("i") <= n)
    return top.groupBy("w1").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w2"))), lambda x: x["w2"]).alias("suggestions"))


def for_missing_titles(pmf: DataFrame, source_titles: DataFrame, target_titles: DataFrame, n: int) -> DataFrame:
    """Suggestions for source words that are not titles."""
    return _first(pmf.join(source_titles.select(F.col("title").alias("w1")).distinct(), "w1", "left_anti"), target_titles, n)


def for_unlinked_titles(pmf: DataFrame, source_titles: DataFrame, links: DataFrame, target_titles: DataFrame, n: int) -> DataFrame:
    """Suggestions for source titles (id, title) whose id no link (column id) names."""
    open_ = source_titles.join(links.select("id").distinct(), "id", "left_anti")
    return _first(pmf.join(open_.select(F.col("title").alias("w1")).distinct(), "w1", "left_semi"), target_titles, n)


def translated_labels(blocks: DataFrame, pmf: DataFrame) -> DataFrame:
    """(block, translated) for blocks (block, l1_labels, l2_labels): as many different words as l2_labels has.

    Labels of l1 take turns, each giving its best candidate not yet used; labels without a row are passed by. When all are used
    up, l2_labels not yet used fill what is missing. A block's labels and their candidates are bounded lists, folded in one row.
    """
    best = pmf.groupBy("w1").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "w2"))), lambda x: x["w2"]).alias("cands"))
    labels = blocks.select("block", F.posexplode("l1_labels").alias("pos", "w1")).join(best, "w1")
    per = labels.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cands"))), lambda x: x["cands"]).alias("lists"))
    rows = blocks.join(per, "block", "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<array<string>>"))).withColumn("k", F.size(F.array_distinct("l2_labels")))
    empty = F.array().cast("array<string>")
    # turn r of list i; there are never more rounds than words wanted
    def take(used, cands):
        left = F.filter(cands, lambda c: ~F.array_contains(used, c))
        return F.when((F.size(used) < F.col("k")) & (F.size(left) > 0), F.concat(used, F.slice(left, 1, 1))).otherwise(used)

    found = F.aggregate(F.flatten(F.array_repeat(F.col("lists"), F.col("k"))), empty, take)
    rows = rows.withColumn("found", found)
    spare = F.filter(F.array_distinct("l2_labels"), lambda x: ~F.array_contains(F.col("found"), x))
    return rows.select("block", F.concat("found", F.slice(spare, F.lit(1), F.greatest(F.lit(0), F.col("k") - F.size("found")))).alias("translated"))
