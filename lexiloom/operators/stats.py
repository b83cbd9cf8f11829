"""Counts and statistics of words and documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from .text import SPACES_TO_ONE, split_words


def postings(tokens: DataFrame) -> DataFrame:
    """(lang, word, doc_id, tf): the inverted index. Everything else is aggregated from it."""
    return tokens.groupBy("lang", "word", "doc_id").agg(F.count("*").alias("tf"))


def document_counts(postings: DataFrame) -> DataFrame:
    """(lang, n_docs)."""
    return postings.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_docs"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """(lang, word, df)."""
    return postings.groupBy("lang", "word").agg(F.count("*").alias("df"))


def word_stats(postings: DataFrame) -> DataFrame:
    """(lang, word, cf, df, adc, idf, cfidf, tcfidf); idf is ln of the whole quotient of documents and df."""
    return statistics(postings.groupBy("lang", "word").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")), document_counts(postings))


def _cutter() -> Callable[[pa.Array], tuple[pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """texts to (words, row of each, its place in the row): split_words(), by single spaces, which all other white space is made first. A
    function that executors need not have."""
    def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, SPACES_TO_ONE, " "), " ")
        words, row = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
        return words, row, np.arange(len(row)) - np.searchsorted(row, np.arange(len(texts)))[row]

    return cut


def _fields(docs: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in by)


def row_counts(docs: DataFrame, period: int = 1, only: list[str] | None = None, keys: list[Column | str] | None = None) -> DataFrame:
    """(all columns of docs but its text, place, word, cf, df) of documents (..., text), each a row of its own: tokens and rows of every
    word, apart by the remainder of its place in the text by `period`. A row counts in df at the least such remainder of a word only, so
    that df, like cf, adds up over places. The other columns are few values and stand for a language, a source or the like. With `only`,
    a vocabulary, other words are left out before anything is counted. With `keys`, columns made of the others and place, which stand in
    their stead, tasks add up what has the same keys before anything is shuffled.

    Words of an Arrow batch are numbered, and numbers are counted: one text is cut once, and only counts are shuffled.
    """
    by = [c for c in docs.columns if c != "text"]
    cut = _cutter()
    listed = None if only is None else docs.sparkSession.sparkContext.broadcast(pa.array(only, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, at_place = cut(batch.column("text"))
            n, size, codes = max(1, len(words.dictionary)), batch.num_rows, words.indices.to_numpy()
            if listed is not None:
                kept = np.flatnonzero(pc.is_in(words.dictionary, listed.value).to_numpy(zero_copy_only=False)[codes])
                row, at_place, codes = row[kept], at_place[kept], codes[kept]
            each, tf = np.unique((row * n + codes) * period + at_place % period, return_counts=True)
            pair, place = np.divmod(each, period)
            fresh = np.diff(pair, prepend=-1) != 0
            # rows of the same values in the other columns are one group
            group = np.zeros(size, np.int64)
            for c in by:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (size + 1) + codes, return_inverse=True)[1]
            at, code = np.divmod(pair, n)
            found, start, inverse = np.unique((group[at] * period + place) * n + code, return_index=True, return_inverse=True)
            cf, df = (np.bincount(inverse, x, len(found)).astype(np.int64) for x in (tf, fresh))
            where = pa.array(at[start])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in by), pa.array(found // n % period), words.dictionary.take(pa.array(found % n)), pa.array(cf), pa.array(df)], [*by, "place", "word", "cf", "df"])

    parts = docs.select(*by, F.lower("text").alias("text")).mapInArrow(run, f"{_fields(docs, by)}, place long, word string, cf long, df long").where("word <> ''")
    return parts.groupBy(*([*by, "place"] if keys is None else keys), "word").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


#: Postings that leave a task at once.
ROWS_AT_ONCE = 200_000


def row_postings(docs: DataFrame) -> DataFrame:
    """(all columns of docs but its text, word, tf) of documents (..., text), each a row of its own: postings() counted inside tasks. Nothing
    is shuffled."""
    by, cut = [c for c in docs.columns if c != "text"], _cutter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, _ = cut(batch.column("text"))
            each, tf = np.unique(row * max(1, len(words.dictionary)) + words.indices.to_numpy(), return_counts=True)
            at, code = np.divmod(each, max(1, len(words.dictionary)))
            for k in range(0, len(each), ROWS_AT_ONCE):
                some = slice(k, k + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at[some])) for c in by), words.dictionary.take(pa.array(code[some])), pa.array(tf[some])], [*by, "word", "tf"])

    return docs.select(*by, F.lower("text").alias("text")).mapInArrow(run, f"{_fields(docs, by)}, word string, tf long").where("word <> ''")


def document_counts_of(docs: DataFrame, counted: Callable[[Column, Column], Column]) -> DataFrame:
    """document_counts() of documents (lang, text), each a row of its own: those with a word for which counted(word, lang) holds."""
    words = F.filter(split_words(F.lower("text")), lambda w: w != "")
    return docs.where(F.exists(words, lambda w: counted(w, F.col("lang")))).groupBy("lang").agg(F.count("*").alias("n_docs"))


def statistics(words: DataFrame, n_docs: DataFrame) -> DataFrame:
    """word_stats() from (lang, word, cf, df) and document_counts()."""
    words = words.join(F.broadcast(n_docs), "lang").withColumn("idf", F.expr("ln(n_docs div df)"))
    return words.select("lang", "word", "cf", "df", (F.col("cf") / F.col("df")).alias("adc"), "idf", (F.col("cf") * F.col("idf")).alias("cfidf"), (F.log("cf") * F.col("idf")).alias("tcfidf"))


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, nchars, ntokens, ntypes) of the raw text, without lower-casing."""
    words = F.filter(split_words(F.col(text_col)), lambda x: x != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).cast("long").alias("nchars"), F.size(words).cast("long").alias("ntokens"), F.size(F.array_distinct(words)).cast("long").alias("ntypes"))


def tfidf(postings: DataFrame) -> DataFrame:
    """(lang, word, doc_id, score): (1 + ln tf) * ln(documents / df), a true quotient here."""
    df = document_frequency(postings).join(F.broadcast(document_counts(postings)), "lang")
    return postings.join(df, ["lang", "word"]).select("lang", "word", "doc_id", ((1 + F.log("tf")) * F.log(F.col("n_docs") / F.col("df"))).alias("score"))


def useful_words(stats: DataFrame, n_docs: DataFrame, min_cf: int = 20, max_df_share: float = 0.1, most: int = 5000, valid: DataFrame | None = None) -> DataFrame:
    """(lang, word, cf, df, adc): words frequent enough, in few enough documents, the `most` of highest adc per language.

    The cut comes after the filters; a list of valid words filters before the cut is taken.
    """
    kept = stats.join(F.broadcast(n_docs), "lang").where((F.col("cf") >= min_cf) & (F.col("df") <= F.floor(F.col("n_docs") * F.lit(max_df_share))))
    if valid is not None:
        kept = kept.join(valid.select("word").distinct(), "word", "left_semi")
    order = Window.partitionBy("lang").orderBy(F.round("adc", 12).desc(), "word")
    return kept.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most).select("lang", "word", "cf", "df", "adc")


def useful_docs(stats: DataFrame, min_types: int = 10, min_tokens: int = 30) -> DataFrame:
    return stats.where((F.col("ntypes") >= min_types) & (F.col("ntokens") >= min_tokens))


def pair_profile(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row over linked documents (d1, d2): their count, mean and deviation of tokens on either side and of the larger/smaller ratio."""
    sizes = state.groupBy("doc_id").agg(F.count("*").alias("n"))
    both = pairs.join(sizes.withColumnsRenamed({"doc_id": "d1", "n": "n1"}), "d1").join(sizes.withColumnsRenamed({"doc_id": "d2", "n": "n2"}), "d2")
    ratio = F.greatest("n1", "n2") / F.least("n1", "n2")
    return both.agg(F.count("*").alias("n_docs"), F.avg("n1").alias("mean1"), F.stddev_pop("n1").alias("std1"), F.avg("n2").alias("mean2"), F.stddev_pop("n2").alias("std2"), F.avg(ratio).alias("mean_ratio"), F.stddev_pop(ratio).alias("std_ratio"))


def assigned_ids(items: DataFrame, order: list[Column | str], start: int = 0, by: list[str] | None = None, name: str = "id") -> DataFrame:
    """items with ids start, start+1, ... in the given order, within each group of `by`.

    Rows are sorted by ranges and numbered within them; a range's first number comes from the counts of the ranges before it, a
    group's from its first row. No task sees all rows of a table or group.
    """
    place, rank, part = "_place", "_rank", "_part"
    rows = items.sort(*(by or []), *order).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)).cache()
    ranges = rows.groupBy(part).agg(F.count("*").alias("n"), F.min(place).alias("first"))  # a row for each task
    ranges = ranges.select(part, "first", F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(ranges.withColumnsRenamed({"first": "_first", "before": "_before"})), part).withColumn(rank, F.col("_before") + F.col(place) - F.col("_first"))
    if by:
        firsts = rows.groupBy(*by).agg(F.min(rank).alias("_least"))
        rows = rows.join(firsts, by).withColumn(rank, F.col(rank) - F.col("_least"))
    return rows.withColumn(name, (F.col(rank) + F.lit(start)).cast("long")).select(*items.columns, name)


def sparse_matrix(postings: DataFrame, word_ids: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(wid, did, n): word and document ids with counts, for words and documents that have ids. Ids of a vocabulary are sent whole."""
    return postings.join(shared.hinted(word_ids), ["lang", "word"]).join(doc_ids, "doc_id").select("wid", "did", F.col("tf").alias("n"))


def conditional_probability(postings: DataFrame, queries: DataFrame, full_numerator: bool = False) -> DataFrame:
    """(query, p) for queries (query, ord, lang, word): the chain of p(word | words after it), each with add-one smoothing in the
    documents that have all words after it.

    A word without condition, or whose condition holds in no document, counts by its share of its language's tokens. With
    full_numerator the numerator counts a word over its whole corpus, not only over those documents.
    """
    words = postings.groupBy("lang", "word").agg(F.sum("tf").alias("cf"))
    corpus = postings.groupBy("lang").agg(F.sum("tf").alias("total"), F.countDistinct("word").alias("v"))
    sizes = postings.groupBy("lang", "doc_id").agg(F.sum("tf").alias("size"))
    q = queries.join(words, ["lang", "word"], "left").join(F.broadcast(corpus), "lang").select("query", "ord", "lang", "word", F.coalesce("cf", F.lit(0)).alias("cf"), "total", "v")
    later = queries.select("query", F.col("ord").alias("o2"), F.col("lang").alias("lang2"), F.col("word").alias("word2"))
    conditions = queries.select("query", "ord").join(later, "query").where("o2 > ord")
    needed = conditions.groupBy("query", "ord").agg(F.count("*").alias("k"))
    hits = conditions.join(postings.select(F.col("lang").alias("lang2"), F.col("word").alias("word2"), "doc_id"), ["lang2", "word2"]).groupBy("query", "ord", "doc_id").agg(F.count("*").alias("c"))
    docs = hits.join(needed, ["query", "ord"]).where("c = k").select("query", "ord", "doc_id")
    at = docs.join(q.select("query", "ord", "lang", "word"), ["query", "ord"])
    restricted = at.join(sizes, ["lang", "doc_id"], "left").join(postings, ["lang", "word", "doc_id"], "left").groupBy("query", "ord").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("ntok"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_in"))
    top = F.col("cf") if full_numerator else F.col("n_in")
    p = F.when(F.col("ntok").isNotNull(), (top + 1) / (F.col("ntok") + F.col("v"))).otherwise(F.col("cf") / F.col("total"))
    logs = q.join(restricted, ["query", "ord"], "left").select("query", F.log(p).alias("lp"), p.alias("p"))
    return logs.groupBy("query").agg(F.when(F.min("p") > 0, F.exp(F.sum("lp"))).otherwise(F.lit(0.0)).alias("p"))
