"""Agreement of annotators: observed agreement, S, pi, kappa, alpha, from (coder, item, labels array<string>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import DISTANCES, binary

Distance = Callable[[Column, Column], Column]


def annotations(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(coder, item, labels) with labels as sorted sets; only or without some coders."""
    out = rows.select(F.col("coder").cast("string").alias("coder"), F.col("item").cast("string").alias("item"), F.array_sort(F.array_distinct("labels")).alias("labels"))
    if include:
        out = out.where(F.col("coder").isin(include))
    return out.where(~F.col("coder").isin(exclude)) if exclude else out


def of_numbers(rows: DataFrame) -> DataFrame:
    """Annotations of coders a and b from (item, x, y): numbers are floored to labels."""
    label = lambda c: F.array(F.floor(c).cast("string"))
    return rows.select(F.col("item").cast("string").alias("item"), F.explode(F.array(F.struct(F.lit("a").alias("coder"), label("x").alias("labels")), F.struct(F.lit("b").alias("coder"), label("y").alias("labels")))).alias("r")).select("r.coder", "item", "r.labels")


def of_strings(rows: DataFrame, separator: str = ":") -> DataFrame:
    """Annotations from strings coder_item_label:label (column value)."""
    part = F.split("value", "_")
    return annotations(rows.select(part[0].alias("coder"), part[1].alias("item"), F.split(part[2], F.lit(separator)).alias("labels")))


def sanitised(data: DataFrame) -> DataFrame:
    """Without items whose records are not as many as there are coders."""
    coders = data.agg(F.countDistinct("coder").alias("coders"))
    whole = data.groupBy("item").agg(F.count("*").alias("c")).crossJoin(F.broadcast(coders)).where("c = coders").select("item")
    return data.join(whole, "item", "left_semi")


def pair_agreement(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """(c1, c2, ao): mean of 1 - distance over the items of each pair of coders."""
    a = data.select("item", F.col("coder").alias("c1"), F.col("labels").alias("l1"))
    b = data.select("item", F.col("coder").alias("c2"), F.col("labels").alias("l2"))
    return a.join(b, "item").where("c1 < c2").groupBy("c1", "c2").agg(F.avg(1 - distance(F.col("l1"), F.col("l2"))).alias("ao"))


def observed(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """(ao): mean over pairs of coders."""
    return pair_agreement(data, distance).agg(F.avg("ao").alias("ao"))


def _chance(data: DataFrame, ae: DataFrame, distance: Distance, name: str) -> DataFrame:
    return observed(data, distance).crossJoin(ae).select(F.try_divide(F.col("ao") - F.col("ae"), 1 - F.col("ae")).alias(name))


def s(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """Chance agreement is 1 over the number of different label sets."""
    return _chance(data, data.agg((1.0 / F.countDistinct("labels")).alias("ae")), distance, "s")


def pi(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """Chance agreement from label shares of all records; meant for two coders."""
    items = data.agg(F.countDistinct("item").alias("items"))
    ae = data.groupBy("labels").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("nn")).crossJoin(items).select((F.col("nn") / (4.0 * F.col("items") * F.col("items"))).alias("ae"))
    return _chance(data, ae, distance, "pi")


def kappa_pairs(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """(c1, c2, kappa)."""
    items = data.agg(F.countDistinct("item").alias("items"))
    shares = data.groupBy("coder", "labels").agg(F.count("*").alias("n")).crossJoin(F.broadcast(items)).select("coder", "labels", (F.col("n") / F.col("items")).alias("share"))
    a, b = shares.toDF("c1", "labels", "s1"), shares.toDF("c2", "labels", "s2")
    ae = a.join(b, "labels").where("c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("s1") * F.col("s2")).alias("ae"))
    both = pair_agreement(data, distance).join(ae, ["c1", "c2"], "left").withColumn("ae", F.coalesce("ae", F.lit(0.0)))
    return both.select("c1", "c2", F.try_divide(F.col("ao") - F.col("ae"), 1 - F.col("ae")).alias("kappa"))


def kappa(data: DataFrame, distance: Distance = binary) -> DataFrame:
    return kappa_pairs(data, distance).agg(F.avg("kappa").alias("kappa"))


def alpha(data: DataFrame, distance: Distance = binary) -> DataFrame:
    """1 less observed over expected disagreement; 1 where nobody disagrees."""
    sizes = data.agg(F.countDistinct("item").alias("items"), F.countDistinct("coder").alias("coders"))
    kinds = data.groupBy("labels").agg(F.count("*").alias("n"))
    a, b = kinds.toDF("l1", "n1"), kinds.toDF("l2", "n2")
    de = a.crossJoin(F.broadcast(b)).agg(F.sum(F.col("n1") * F.col("n2") * distance(F.col("l1"), F.col("l2"))).alias("de"))
    per = data.groupBy("item", "labels").agg(F.count("*").alias("n"))
    do = per.toDF("item", "l1", "n1").join(per.toDF("item", "l2", "n2"), "item").agg(F.sum(F.col("n1") * F.col("n2") * distance(F.col("l2"), F.col("l1"))).alias("do"))
    records = F.col("items") * F.col("coders")
    row = de.crossJoin(do).crossJoin(sizes).select((F.col("do") / (records * (F.col("coders") - 1))).alias("do"), (F.col("de") / (records * (records - 1))).alias("de"))
    return row.select(F.when(F.col("do") == 0, 1.0).otherwise(1 - F.try_divide("do", "de")).alias("alpha"))


def average_distance(sets: DataFrame, distance: Distance) -> DataFrame:
    """(avg_distance, n) over all pairs i < j of label sets (i, labels).

    Distances are taken between different sets only, each weighted by the pairs in that order: for every two kinds of sets the
    rows of both are put in order of i, and each row counts the ones of the other kind before it.
    """
    kinds = sets.groupBy("labels").agg(F.count("*").alias("n"))
    rows = sets.select("i", F.col("labels").alias("l2")).crossJoin(kinds.select(F.col("labels").alias("l1")))
    pair = F.when(F.struct("l1") <= F.struct("l2"), F.struct(F.col("l1").alias("a"), F.col("l2").alias("b"))).otherwise(F.struct(F.col("l2").alias("a"), F.col("l1").alias("b")))
    rows = rows.withColumn("pair", pair)
    # rows of the other kind before this one: all before it but those of its own kind
    own = F.row_number().over(Window.partitionBy("pair", "l2").orderBy("i")) - 1
    rows = rows.withColumn("c", F.when(F.col("l1") == F.col("l2"), own).otherwise(F.row_number().over(Window.partitionBy("pair").orderBy("i")) - 1 - own))
    pairs = rows.groupBy("l1", "l2").agg(F.sum("c").alias("c"))
    return pairs.agg((F.sum(distance(F.col("l1"), F.col("l2")) * F.col("c")) / F.sum("c")).alias("avg_distance"), F.sum("c").alias("n"))


COEFFICIENTS = {"ao": observed, "s": s, "pi": pi, "kappa": kappa, "alpha": alpha}


def coefficient(name: str, data: DataFrame, distance: str = "binary") -> DataFrame:
    """A coefficient and a distance by name."""
    return COEFFICIENTS[name](data, DISTANCES[distance])
