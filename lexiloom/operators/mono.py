"""Relatedness of words of one language: co-occurrence, pointwise mutual information, document vectors, a taxonomy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import pmf


#: Rows of a key that one task sets against all rows of the key on the other side.
ROWS_A_TASK = 1_000


def met(left: DataFrame, right: DataFrame, key: str, most: int = ROWS_A_TASK) -> DataFrame:
    """left joined with right by key, where a key may stand on very many rows of both. The rows of left with one key are dealt into parts
    of about `most`; those of right go to each part of their key. So a long document, or the root of a taxonomy, is the work of
    many tasks, and keys of few rows travel once."""
    parts = left.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("parts_")).where("parts_ > 1")
    n = F.coalesce("parts_", F.lit(1))
    dealt = left.join(parts, key, "left").withColumn("part_", F.pmod(F.xxhash64(*left.columns), n).cast("int")).drop("parts_")
    copied = right.join(parts, key, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts_")
    # dealt anew, as rows that lie by key alone would do for the join
    return dealt.repartition(key, "part_").join(copied.repartition(key, "part_"), [key, "part_"]).drop("part_")


def cooccurrence(postings: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(w1, w2, n12): documents that have both words, a word with itself included; only pairs that meet."""
    left = postings.select(F.col("word").alias("w1"), "doc_id")
    if sources is not None:
        left = left.join(sources.select(F.col("word").alias("w1")).distinct(), "w1", "left_semi")
    return met(left, postings.select(F.col("word").alias("w2"), "doc_id"), "doc_id").groupBy("w1", "w2").agg(F.count("*").alias("n12"))


def pmi(postings: DataFrame, sources: DataFrame, vocab: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """(w1, w2, score) of every source word with every word of the vocabulary: n ln(n N / (n1 n2)), n = common documents + epsilon.

    Pairs that never meet count too (a pmf is shifted by their score), so the word lists are crossed; only the counts are joined.
    """
    df = postings.groupBy("word").agg(F.count("*").alias("df"))
    n_docs = postings.agg(F.countDistinct("doc_id").alias("n_docs"))
    left = sources.select("word").distinct().join(df, "word").select(F.col("word").alias("w1"), F.col("df").alias("n1"))
    right = vocab.select("word").distinct().join(df, "word").select(F.col("word").alias("w2"), F.col("df").alias("n2"))
    met = cooccurrence(postings.join(vocab.select("word").unionByName(sources.select("word")).distinct(), "word", "left_semi"), sources)
    n = F.coalesce(F.col("n12"), F.lit(0)) + F.lit(epsilon)
    every = left.crossJoin(right).join(met, ["w1", "w2"], "left").crossJoin(F.broadcast(n_docs))
    return every.select("w1", "w2", (F.log(n * F.col("n_docs") / (F.col("n1") * F.col("n2"))) * n).alias("score"))


def document_vectors(tfidf: DataFrame, window: int = 100, least: float = 0.05) -> DataFrame:
    """(word, doc_id, s): each word's documents by weight, cut where a window over them gets flat, of unit length.

    Weights fall along i = 0, 1, ...; for i from 1 to m - window - 1 the sweep stops at the first i where weight i less weight
    i + window is under `least` of weight 0, and i + window - 1 documents stay. Without a stop the last i counts; without any i
    all stay. Words whose weights are all 0 (in every document) have no vector.
    """
    by_weight = Window.partitionBy("word").orderBy(F.round("score", 12).desc(), "doc_id")
    word = Window.partitionBy("word")
    rows = tfidf.select("word", "doc_id", "score", (F.row_number().over(by_weight) - 1).alias("i"), F.lead("score", window).over(by_weight).alias("far"), F.first("score").over(by_weight).alias("top"), F.count("*").over(word).alias("m"))
    flat = (F.col("i") >= 1) & (F.col("i") < F.col("m") - window) & (F.col("score") - F.col("far") < least * F.col("top"))
    stop = F.coalesce(F.min(F.when(flat, F.col("i"))).over(word), F.col("m") - window - 1)
    rows = rows.withColumn("keep", F.when(F.col("m") - window > 1, stop + window - 1).otherwise(F.col("m"))).where(F.col("i") < F.col("keep"))
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(word))
    return rows.withColumn("norm", norm).where("norm > 0").select("word", "doc_id", (F.col("score") / F.col("norm")).alias("s"))


def vector_similarity(vectors: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(w1, w2, score): dot products of document_vectors(), of pairs that share a document."""
    left = vectors.select(F.col("word").alias("w1"), "doc_id", F.col("s").alias("s1"))
    if sources is not None:
        left = left.join(sources.select(F.col("word").alias("w1")).distinct(), "w1", "left_semi")
    return met(left, vectors.select(F.col("word").alias("w2"), "doc_id", F.col("s").alias("s2")), "doc_id").groupBy("w1", "w2").agg(F.sum(F.col("s1") * F.col("s2")).alias("score"))


#: Bytes up to which vectors may be sent whole, cells of scores worked out at once, and pairs added up at once.
BROADCAST_BYTES, BLOCK_CELLS, PAIRS_AT_ONCE = 64 << 20, 2_000_000, 4_000_000


def vector_pmf(vectors: DataFrame, mass: float, most: int | None = None) -> DataFrame:
    """(w1, w2, p, rk): vector_similarity() of all words with all, zeros too, less each word's least, as a pmf cut at `mass`.

    A word has some two thousand documents at most (a sweep of document_vectors() without a stop falls by a twentieth of the top in each
    window), and words are a vocabulary, so that vectors are bounded however many documents there are: as numbers they are sent
    whole, and a block of source words is multiplied, ordered and cut inside a task. Only what stays leaves it. Vectors of more than
    BROADCAST_BYTES are joined by document instead.
    """
    words = vectors.select("word").distinct()
    if vectors.count() * 16 > BROADCAST_BYTES or words.count() > BLOCK_CELLS:
        return pmf.truncated(pmf.min_shifted(with_zeros(vector_similarity(vectors), words, words)), mass, most)
    names = sorted((r[0] for r in words.collect()), key=str.encode)  # ties go by word
    spark = vectors.sparkSession
    coded = spark.createDataFrame(pa.table({"word": pa.array(names, pa.string()), "code": pa.array(range(len(names)), pa.int32())}))
    table = vectors.where("doc_id IS NOT NULL").join(F.broadcast(coded), "word").select("code", "doc_id", "s").toArrow()
    doc = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)[1].astype(np.int32)
    held = spark.sparkContext.broadcast((pa.array(names, pa.string()), table.column("code").to_numpy(), doc, table.column("s").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, code, doc, s = held.value
        v = len(targets)
        of_word, of_doc = np.lexsort((doc, code)), np.lexsort((code, doc))
        words_at, docs_at = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]) for x, n in ((code, v), (doc, int(doc.max(initial=-1)) + 1)))
        by_code, by_s = code[of_doc].astype(np.int64), s[of_doc]
        step = max(1, BLOCK_CELLS // max(1, v))
        for batch in batches:
            mine = batch.column("code").to_numpy()
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                scores = np.zeros(len(some) * v)
                rows = np.concatenate([of_word[words_at[c] : words_at[c + 1]] for c in some.tolist()])
                line = np.repeat(np.arange(len(some)), words_at[some + 1] - words_at[some])
                n = docs_at[doc[rows] + 1] - docs_at[doc[rows]]
                parts = np.searchsorted(np.cumsum(n), np.arange(PAIRS_AT_ONCE, int(n.sum()) + 1, PAIRS_AT_ONCE), "right")
                for r, i, k in zip(np.split(rows, parts), np.split(line, parts), np.split(n, parts), strict=True):
                    met_at = np.repeat(docs_at[doc[r]] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                    scores += np.bincount(np.repeat(i * v, k) + by_code[met_at], np.repeat(s[r], k) * by_s[met_at], len(scores))
                scores = scores.reshape(len(some), v)
                row, column, p, rk = pmf.cut_rows(scores - scores.min(1)[:, None], mass, most)
                yield pa.RecordBatch.from_arrays([targets.take(pa.array(some[row])), targets.take(pa.array(column, pa.int64())), pa.array(p), pa.array(rk)], ["w1", "w2", "p", "rk"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return coded.select("code").repartition(parts, F.xxhash64("code")).mapInArrow(run, "w1 string, w2 string, p double, rk int")


def with_zeros(scores: DataFrame, sources: DataFrame, vocab: DataFrame) -> DataFrame:
    """scores of every source word with every word of the vocabulary, 0 where there was none."""
    every = sources.select(F.col("word").alias("w1")).distinct().crossJoin(vocab.select(F.col("word").alias("w2")).distinct())
    return every.join(scores, ["w1", "w2"], "left").select("w1", "w2", F.coalesce("score", F.lit(0.0)).alias("score"))


def hypernym_distances(edges: DataFrame, longest: int = 20) -> DataFrame:
    """(node, up, d): every ancestor of each node (itself at 0) of child, parent edges with its least distance, by a join for each level.
    Levels are written, so that none is worked out twice; the result is a written table."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    found, paths = [], []
    level = nodes.select("node", F.col("node").alias("up"), F.lit(0).alias("d"))
    for d in range(1, longest + 2):
        level, path = shared.written(level)
        paths.append(path)
        if d > 1 and level.isEmpty():
            break
        found.append(level)
        level = level.join(edges.select(F.col("child").alias("up"), "parent"), "up").select("node", F.col("parent").alias("up"), F.lit(d).alias("d")).distinct()
    out, _ = shared.written(reduce(DataFrame.unionByName, found).groupBy("node", "up").agg(F.min("d").alias("d")))
    for path in paths:
        shared.deleted(edges.sparkSession, path)
    return out


def taxonomy_similarity(senses: DataFrame, edges: DataFrame, words: DataFrame) -> DataFrame:
    """(w1, w2, p): 1 / (1 + shortest path over a common ancestor), the best pair of senses, above 0, of sum 1 per word.

    senses are (word, node); a word without senses gets itself with p 1.
    """
    up = hypernym_distances(edges)
    at = senses.join(up, "node").select("word", "up", "d")
    listed = words.select("word").distinct()
    a = at.join(listed, "word", "left_semi").select(F.col("word").alias("w1"), "up", F.col("d").alias("d1"))
    b = at.select(F.col("word").alias("w2"), "up", F.col("d").alias("d2"))
    best = met(a, b, "up").groupBy("w1", "w2").agg((1.0 / (1 + F.min(F.col("d1") + F.col("d2")))).alias("score"))
    known = best.withColumn("t", F.sum("score").over(Window.partitionBy("w1"))).select("w1", "w2", (F.col("score") / F.col("t")).alias("p"))
    alone = listed.join(senses.select("word").distinct(), "word", "left_anti").select(F.col("word").alias("w1"), F.col("word").alias("w2"), F.lit(1.0).alias("p"))
    return known.unionByName(alone)
