"""Polylingual topic models as tables, and word scores that go through topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import pmf

#: Words up to which a vocabulary with its topics may be broadcast; bytes up to which one may be sent whole as numbers, and pairs of
#: words that are scored at once.
BROADCAST_WORDS, BROADCAST_BYTES, BLOCK_CELLS = 200_000, 64 << 20, 2_000_000


def topic_words(state: DataFrame) -> DataFrame:
    """(lang, topic, word, n)."""
    return state.groupBy("lang", "topic", "word").agg(F.count("*").alias("n"))


def phi(counts: DataFrame, beta: float = 0.01) -> DataFrame:
    """(lang, topic, word, p): smoothed word distributions on the dense grid of topics and each language's words."""
    words = counts.select("lang", "word").distinct()
    topics = counts.select("topic").distinct()
    grid = words.crossJoin(F.broadcast(topics)).join(counts, ["lang", "topic", "word"], "left").select("lang", "topic", "word", F.coalesce("n", F.lit(0)).alias("n"))
    sums = grid.groupBy("lang", "topic").agg(F.sum("n").alias("total"), F.count("*").alias("v"))
    b = F.lit(float(beta))
    return grid.join(F.broadcast(sums), ["lang", "topic"]).select("lang", "topic", "word", ((F.col("n") + b) / (F.col("total") + F.col("v") * b)).alias("p"))


def topics_of(table: DataFrame) -> list[int]:
    """The topics of a model: a parameter of bounded size."""
    return sorted(r[0] for r in table.select("topic").distinct().collect())


def _wide(table: DataFrame, lang: str, topics: list[int], value: str, name: str, prefix: str) -> DataFrame:
    """(name, prefix0, prefix1, ...): one row per word with its value for each topic, so that scores are flat arithmetic."""
    wide = table.where(F.col("lang") == lang).groupBy("word").pivot("topic", topics).agg(F.first(value))
    return wide.select(F.col("word").alias(name), *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"{prefix}{i}") for i, t in enumerate(topics)])


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def cue(phi: DataFrame, l1: str, l2: str, sources: DataFrame | None = None, topics: list[int] | None = None) -> DataFrame:
    """(w1, w2, score) of every source word with every target word: sum of phi2 * phi1 over topics, over the sum of phi1."""
    topics = topics or topics_of(phi)
    return _scored(_wide(phi, l1, topics, "p", "w1", "a"), _wide(phi, l2, topics, "p", "w2", "b"), len(topics), sources, lambda n: _sum([F.col(f"b{i}") * F.col(f"a{i}") for i in range(n)]) / _sum([F.col(f"a{i}") for i in range(n)]))


def ti_vectors(counts: DataFrame) -> DataFrame:
    """(lang, topic, word, p): n / topic total * log10(topics / topics of the word), of unit length per word.

    A word in all topics counts as in all but one; with a single topic nothing can be weighed and there are no rows.
    """
    n_topics = counts.agg(F.countDistinct("topic").alias("t"))
    totals = counts.groupBy("lang", "topic").agg(F.sum("n").alias("total"))
    rows = counts.join(F.broadcast(totals), ["lang", "topic"]).crossJoin(F.broadcast(n_topics))
    word = Window.partitionBy("lang", "word")
    rows = rows.withColumn("nt", F.least(F.count("*").over(word), F.col("t") - 1)).where("nt > 0")
    rows = rows.withColumn("x", F.col("n") * F.log10(F.col("t") / F.col("nt")) / F.col("total"))
    return rows.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(word))).select("lang", "topic", "word", F.try_divide("x", "norm").alias("p"))


def ti(counts: DataFrame, l1: str, l2: str, sources: DataFrame | None = None, topics: list[int] | None = None) -> DataFrame:
    """(w1, w2, score): cosine of ti_vectors()."""
    topics = topics or topics_of(counts)
    v = ti_vectors(counts)
    return _scored(_wide(v, l1, topics, "p", "w1", "a"), _wide(v, l2, topics, "p", "w2", "b"), len(topics), sources, lambda n: _sum([F.col(f"a{i}") * F.col(f"b{i}") for i in range(n)]))


def _scored(left: DataFrame, right: DataFrame, n: int, sources: DataFrame | None, score) -> DataFrame:
    if sources is not None:
        left = left.join(sources.select(F.col("word").alias("w1")).distinct(), "w1", "left_semi")
    # every pair counts, by definition; dealt by w1, pairs need no further shuffle to be ranked. A vocabulary too large to be sent
    # whole is crossed by shuffling
    if right.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        right = F.broadcast(right)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, "w1").crossJoin(right).select("w1", "w2", score(n).alias("score"))


def ti_cue(counts: DataFrame, l1: str, l2: str, weight: float = 10.0, beta: float = 0.01, sources: DataFrame | None = None) -> DataFrame:
    """(w1, w2, score): ti + weight * cue, both over one pass of word pairs."""
    topics = topics_of(counts)
    n = len(topics)
    p, v = phi(counts, beta), ti_vectors(counts)
    left = _wide(p, l1, topics, "p", "w1", "a").join(_wide(v, l1, topics, "p", "w1", "c"), "w1")
    right = _wide(p, l2, topics, "p", "w2", "b").join(_wide(v, l2, topics, "p", "w2", "d"), "w2")
    by_cue = _sum([F.col(f"b{i}") * F.col(f"a{i}") for i in range(n)]) / _sum([F.col(f"a{i}") for i in range(n)])
    by_ti = _sum([F.col(f"c{i}") * F.col(f"d{i}") for i in range(n)])
    return _scored(left, right, n, sources, lambda _: by_ti + F.lit(float(weight)) * by_cue)


def cue_pmf(phi: DataFrame, l1: str, l2: str, mass: float, most: int | None = None, topics: list[int] | None = None, beyond: bool = False) -> DataFrame:
    """pmf.of_scores() of cue(), or with `beyond` pmf.cumulative_cut() of its normalised scores, by blocks of source words."""
    topics = topics or topics_of(phi)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _products(a, b) / _folded(list(a.T))[:, None]

    found = _top_lists(_wide(phi, l1, topics, "p", "w1", "a"), _wide(phi, l2, topics, "p", "w2", "b"), score, mass, most, beyond)
    if found is not None:
        return found
    scores = cue(phi, l1, l2, topics=topics)
    return pmf.cumulative_cut(pmf.normalised(scores), mass) if beyond else pmf.of_scores(scores, mass, most)


def ti_cue_pmf(counts: DataFrame, l1: str, l2: str, mass: float, most: int | None = None, weight: float = 10.0, beta: float = 0.01, topics: list[int] | None = None) -> DataFrame:
    """pmf.of_scores() of ti_cue(), by blocks of source words."""
    topics = topics or topics_of(counts)
    n = len(topics)
    p, v = phi(counts, beta), ti_vectors(counts)
    left = _wide(p, l1, topics, "p", "w1", "a").join(_wide(v, l1, topics, "p", "w1", "c"), "w1")
    right = _wide(p, l2, topics, "p", "w2", "b").join(_wide(v, l2, topics, "p", "w2", "d"), "w2")

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _products(a[:, n:], b[:, n:]) + weight * (_products(a[:, :n], b[:, :n]) / _folded(list(a[:, :n].T))[:, None])

    found = _top_lists(left, right, score, mass, most)
    return pmf.of_scores(ti_cue(counts, l1, l2, weight, beta), mass, most) if found is None else found


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda a, b: a + b, parts)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all rows of a and b, topic by topic as flat arithmetic has it, so that digits are the same."""
    return _folded([np.multiply.outer(a[:, t], b[:, t]) for t in range(a.shape[1])])


def _top_lists(left: DataFrame, right: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], mass: float, most: int | None, beyond: bool = False) -> DataFrame | None:
    """(w1, w2, p, rk): pmf.of_scores(), or with `beyond` pmf.cumulative_cut() of the normalised scores, of every row of left (w1, values) with every row of right (w2, values), without the pairs that the
    cut drops ever leaving a task: a block of source words is scored, summed, ordered and cut at once. None where right has more than
    BROADCAST_BYTES and so cannot be sent whole.
    """
    width = len(right.columns) - 1
    limit = BROADCAST_BYTES // (8 * width + 32)
    table = right.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    names = table.column("w2").to_pylist()
    order = sorted(range(len(names)), key=lambda k: names[k].encode())  # ties go by word
    values = np.stack([table.column(c).to_numpy() for c in right.columns if c != "w2"], 1)[order] if names else np.zeros((0, width))
    held = left.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()).take(pa.array(order, pa.int64())), values))
    columns = [c for c in left.columns if c != "w1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, b = held.value
        step = max(1, BLOCK_CELLS // max(1, len(b)))
        for batch in batches:
            every = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1) if batch.num_rows else np.zeros((0, len(columns)))
            for at in range(0, batch.num_rows if len(b) else 0, step):
                row, column, p, rk = pmf.cut_rows(score(every[at : at + step], b), mass, most, beyond)
                yield pa.RecordBatch.from_arrays([batch.column("w1").take(pa.array(at + row, pa.int64())), targets.take(pa.array(column, pa.int64())), pa.array(p), pa.array(rk)], ["w1", "w2", "p", "rk"])

    # a few rows are much work, so that small partitions must not be put together: dealt by what no join before them is dealt by, since a
    # shuffle by w1 would be left out behind a join by w1, and that join's small partitions are put together
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, F.xxhash64("w1")).mapInArrow(run, "w1 string, w2 string, p double, rk int")


def word_features(stats: DataFrame, phi: DataFrame, lang: str) -> DataFrame:
    """(word, x): the six word statistics, then phi(topic, word) over its sum over topics; words without statistics are dropped.
    The words of the model are few and sent to the statistics, which have all words and are not shuffled then."""
    post = phi.where(F.col("lang") == lang).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("tp"), F.sum("p").alias("total"))
    six = ["cf", "df", "adc", "idf", "cfidf", "tcfidf"]
    return stats.where(F.col("lang") == lang).join(shared.hinted(post), "word").select("word", F.concat(F.array(*[F.col(c).cast("double") for c in six]), F.transform("tp", lambda x: x["p"] / F.col("total"))).alias("x"))
