"""Evaluation runs as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def sections(lines: DataFrame) -> DataFrame:
    """(key, mrr, p1, p5, n) from lines (line, value): a line of one field opens a section, others are runs; # lines are skipped.

    The section of a line is handed on from block to block of lines, so that a report of any length is read side by side.
    """
    rows = lines.where("NOT startswith(value, '#') AND trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    runs = ranks.running(rows, "line", F.when(F.size("f") == 1, F.col("f")[0]), "last", "key").where("size(f) >= 4")
    return runs.select("key", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("mrr", "p1", "p5"))], F.col("f")[3].cast("long").alias("n"))


def by_key(runs: DataFrame) -> DataFrame:
    """(key, mrr, p1, p5): means."""
    return runs.groupBy("key").agg(*[F.avg(c).alias(c) for c in ("mrr", "p1", "p5")])


def pair_table(runs: DataFrame, metric: str, languages: list[str]) -> DataFrame:
    """(l1, one column per language): population deviations of a metric over the runs (l1, l2, ...) of each language pair, null
    where there is none."""
    rows = runs.groupBy("l1").pivot("l2", languages).agg(F.stddev_pop(metric))
    langs = runs.sparkSession.createDataFrame([(x,) for x in languages], "l1 string")
    return langs.join(rows, "l1", "left")


def pair_list(runs: DataFrame) -> DataFrame:
    """(l1, l2, mean and population deviation of each metric)."""
    return runs.groupBy("l1", "l2").agg(*[f(c).alias(f"{name}_{c}") for c in ("mrr", "p1", "p5") for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def by_frequency(details: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, cf, df, adc, rr, pres1, pres5): repeated measures of a word averaged, with its counts."""
    means = details.groupBy(F.col("w1").alias("word")).agg(*[F.avg(c).alias(c) for c in ("rr", "pres1", "pres5")])
    return stats.select("word", "cf", "df", "adc").join(means, "word")
