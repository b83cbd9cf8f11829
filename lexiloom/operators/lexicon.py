"""Bilingual dictionaries as pairs (w1, w2), and joins over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reverse(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"))


def loaded(pairs: DataFrame) -> DataFrame:
    """(w1, w2): trimmed at the end, in lower case, without repeats."""
    return pairs.select(F.lower(F.rtrim("w1")).alias("w1"), F.lower(F.rtrim("w2")).alias("w2")).distinct()


def pivoted(first: DataFrame, second: DataFrame) -> DataFrame:
    """(w1, w2): words of the outer languages of (w1, w) and (w, w2) that share a word of the common one."""
    left, right = first.select("w1", F.col("w2").alias("w")), second.select(F.col("w1").alias("w"), "w2")
    return left.join(right, "w").select("w1", "w2").distinct()


def common_language(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str, str]:
    """(outer, common, outer) of two language pairs that share exactly one."""
    both = set(a) & set(b)
    if len(both) != 1:
        raise ValueError(f"{a} and {b} must share one language")
    (mid,) = both
    return next(x for x in a if x != mid), mid, next(x for x in b if x != mid)


def on_vocabularies(lexicon: DataFrame, v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Pairs both of whose words are in the vocabularies (column word)."""
    return lexicon.join(v1.select(F.col("word").alias("w1")), "w1", "left_semi").join(v2.select(F.col("word").alias("w2")), "w2", "left_semi").select("w1", "w2")


def ids_on(links: DataFrame, ids1: DataFrame, ids2: DataFrame) -> DataFrame:
    """Links (id1, id2) both of whose ids are listed (column id)."""
    return links.join(ids1.select(F.col("id").alias("id1")), "id1", "left_semi").join(ids2.select(F.col("id").alias("id2")), "id2", "left_semi").select("id1", "id2")


def title_pairs(links: DataFrame, titles1: DataFrame, titles2: DataFrame) -> DataFrame:
    """(t1, t2): titles of linked ids, where both are single words; titles are (id, title)."""
    single = lambda t: F.size(F.split(F.trim(t), r"\s+")) == 1
    both = links.join(titles1.select(F.col("id").alias("id1"), F.col("title").alias("t1")), "id1").join(titles2.select(F.col("id").alias("id2"), F.col("title").alias("t2")), "id2")
    return both.where(single("t1") & single("t2")).select("t1", "t2")


def fan_out(lexicon: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, n): translations of each query word that are in the other vocabulary; 0 for words without any."""
    hits = lexicon.join(vocab.select(F.col("word").alias("w2")).distinct(), "w2", "left_semi").groupBy(F.col("w1").alias("word")).agg(F.count("*").alias("n"))
    return queries.select("word").join(hits, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def bidirectional(pairs: DataFrame, forward: DataFrame, backward: DataFrame, scale: str | None = None) -> DataFrame:
    """(w1, w2, score): the larger of p(w2 | w1) and p(w1 | w2), 0 where neither has the pair; scale='max' divides by the largest
    p of the word first."""
    if scale == "max":
        top = Window.partitionBy("w1")
        forward, backward = (x.withColumn("p", F.col("p") / F.max("p").over(top)) for x in (forward, backward))
    f = forward.select("w1", "w2", F.col("p").alias("f"))
    b = backward.select(F.col("w1").alias("w2"), F.col("w2").alias("w1"), F.col("p").alias("b"))
    zero = F.lit(0.0)
    return pairs.join(f, ["w1", "w2"], "left").join(b, ["w1", "w2"], "left").select("w1", "w2", F.greatest(F.coalesce("f", zero), F.coalesce("b", zero)).alias("score"))


def first_pairs(forward: DataFrame, backward: DataFrame, n: int) -> DataFrame:
    """(w1, w2): best candidates of the first n words of the forward pmf, then of the first n words of the backward one whose pair
    is new; words come in the order of column line, or by word."""
    def best(pmf: DataFrame) -> DataFrame:
        order = "line" if "line" in pmf.columns else "w1"
        return pmf.where("rk = 1").select("w1", "w2", F.col(order).alias("line"))

    left = best(forward).orderBy("line").limit(n).select("w1", "w2")
    right = reverse_with_line(best(backward)).join(left, ["w1", "w2"], "left_anti").orderBy("line").limit(n).select("w1", "w2")
    return left.unionByName(right).distinct()


def reverse_with_line(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "line")


def docs_by_ids(lines: DataFrame, docs: DataFrame, column: str = "ids", concat: bool = False) -> DataFrame:
    """(line, text): the last document that each line's comma-separated ids name; with concat all of them, joined by line feeds."""
    named = lines.select("line", F.posexplode(F.split(column, ",")).alias("pos", "id")).join(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "id")
    if concat:
        return named.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return named.groupBy("line").agg(F.max_by("text", "pos").alias("text"))
