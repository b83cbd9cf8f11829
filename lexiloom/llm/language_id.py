"""Language identification with bit-sliced n-gram Bloom filters: one lookup gives the mask of all languages that hold an n-gram."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, bounded_batches, mixed, steps, written

#: Byte n-gram lengths; n-grams kept per language and length; filter slots (a power of two); hash functions.
LENGTHS, KEPT, SLOTS, HASHES = (3, 5), 4_000, 1 << 20, 3
#: Labelled documents that the filters are fitted on at most, per language.
FIT_DOCS = 2_000
#: An n-gram belongs to a language if it is at least this share as frequent there as where it is most frequent.
SHARE = 0.5
#: Least share of a document's n-grams that its language must hold beyond chance; identified() rejects the others.
EVIDENCE = 0.1
#: Bytes that make letters of a word: ASCII letters and all bytes of non-ASCII characters. The rest becomes one blank.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, FOLD, 32).astype(np.uint8)


@dataclass
class Filters:
    """languages by bit; masks: a slot's languages, 64 in each row; rates: of the slots that an unrelated n-gram hits by chance, per language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    slots: int


def _grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, their document) over folded bytes; n-grams stay in their document and hold a letter."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    folded = _FOLD[data]
    x = np.zeros(count, np.uint64)
    letters = np.zeros(count, bool)
    for k in range(n):
        part = folded[k : k + count]
        x = (x << np.uint64(8)) | part
        letters |= part != 32
    sizes = np.diff(offsets)
    at = np.flatnonzero(letters)
    owner = np.repeat(np.arange(len(sizes)), sizes)[at]
    inside = at + n <= offsets[1:][owner]
    return x[at[inside]] | np.uint64(n << 56), owner[inside]


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mixed(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order_col: str = "doc_id", docs_per_language: int = FIT_DOCS) -> Filters | None:
    """Filters from at most docs_per_language documents of each language, those of smallest hash; None where there are none.

    What reaches the driver is KEPT n-grams per language and length, whatever the corpus. Rows without text or language don't
    count. All languages are learned; each 64 of them take 8 bytes a slot.
    """
    rows = bounded_batches(labelled).where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(5), F.col(order_col), F.col(text_col)).alias("h"))
    seen = written(rows.groupBy("lang").count(), "lang-names")
    names = sorted(r["lang"] for r in seen.select("lang").collect())
    if not names:
        return None
    bit = {x: k for k, x in enumerate(names)}
    # cut by hash first (about twice the bound, so that no sort sees a whole language), then exactly
    share = (F.least(F.lit(1.0), F.lit(2.0 * docs_per_language) / F.col("count")) * F.lit(float(2**53))).cast("long")
    few = rows.join(F.broadcast(seen), "lang").where(F.shiftrightunsigned("h", 11) <= share)
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= docs_per_language).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch, "text", 1 << 18):
                langs = np.array([bit[x] for x in batch.column("lang")[a:b].to_pylist()])
                for n in LENGTHS:
                    grams, owner = _grams(data, offsets, n)
                    for k in np.unique(langs[owner]):
                        g, c = np.unique(grams[langs[owner] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), n, np.int32)), pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["n", "k", "gram", "c"])

    counts = written(few.mapInArrow(counted, "n int, k int, gram long, c long").groupBy("n", "k", "gram").agg(F.sum("c").alias("c")), "lang-grams")
    totals = counts.groupBy("n", "k").agg(F.sum("c").alias("total"))
    rates = counts.join(F.broadcast(totals), ["n", "k"]).withColumn("rate", F.col("c") / F.col("total"))
    best = rates.groupBy("n", "gram").agg(F.max("rate").alias("best"))
    own = rates.where("c >= 2").join(best, ["n", "gram"]).where(F.col("rate") >= SHARE * F.col("best"))
    top = own.withColumn("i", F.row_number().over(Window.partitionBy("n", "k").orderBy(F.desc("c"), "gram"))).where(F.col("i") <= KEPT).select("n", "k", "gram")
    kept = top.toPandas()  # at most languages * lengths * KEPT rows
    masks = np.zeros((-(-len(names) // 64), SLOTS), np.uint64)
    grams, k = kept["gram"].to_numpy().astype(np.int64).view(np.uint64), kept["k"].to_numpy().astype(np.int64)
    bits = np.uint64(1) << (k % 64).astype(np.uint64)
    for s in _slots(grams, SLOTS):
        np.bitwise_or.at(masks, (k // 64, s), bits)
    filled = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / SLOTS for k in range(len(names))])
    return Filters(names, masks, filled**HASHES, SLOTS)


def scored(data: np.ndarray, offsets: np.ndarray, f: Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the likeliest language, score 0 to 1, evidence 0 to 1) of each document.

    The score is the language's share of all languages' corrected counts, 0 where no n-gram says anything; the evidence is the
    share of the document's n-grams that the language holds beyond chance.
    """
    docs, kinds = len(offsets) - 1, len(f.languages)
    hits, total = np.zeros((docs, kinds)), np.zeros(docs)
    for n in LENGTHS:
        grams, owner = _grams(data, offsets, n)
        a, b, c = _slots(grams, f.slots)
        mask = [m[a] & m[b] & m[c] for m in f.masks]
        total += np.bincount(owner, minlength=docs)
        for k in range(kinds):
            hits[:, k] += np.bincount(owner[(mask[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=docs)
    # of t n-grams a language that holds h of them shows h + (t - h) * rate
    real = np.clip((hits - total[:, None] * f.rates) / (1 - f.rates), 0, None)
    sums = real.sum(axis=1)
    best = real.argmax(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(sums > 0, real[np.arange(docs), best] / sums, 0.0)
        evidence = np.where(total > 0, real[np.arange(docs), best] / total, 0.0)
    return best, score, evidence


def predicted(docs: DataFrame, filters: Filters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, from its whole text alone.

    lang_pred is `und`, score 0, where the text is null or has no letter, or nothing could be learned. Popcounts tie towards the
    language that sorts first. Rows that are wholly alike get the same answers; an empty table gives no rows; other columns are
    ignored. A text is worked on whole, so a worker's memory is bounded by its longest text (8 bytes for each).
    """
    packed = pickle.dumps(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(packed)
        for batch in batches:
            for a, b, names, score, _ in _named(batch, "text", f):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, filters: Filters | None, text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """The rows of docs whose language the filters can tell, with all their columns: at least `evidence` of their n-grams are in the
    filter of their language beyond chance. Those that predicted() calls `und` are left out too; without filters, all are."""
    packed = pickle.dumps(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(packed)
        for batch in batches:
            keep = [name != "und" and e >= evidence for _, _, names, _, held in _named(batch, text_col, f) for name, e in zip(names, held.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def _named(batch: pa.RecordBatch, column: str, f: Filters | None) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, languages, scores, evidence) of stretches of a batch."""
    texts = batch.column(column)
    for a, b, data, offsets in steps(batch, column, 1 << 18):
        best, score, evidence = scored(data, offsets, f) if f else (np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a))
        # ASCII letters first; other letters need the characters
        ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
        has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        names = [f.languages[k] if f and (h or any(map(str.isalpha, texts[a + i].as_py() or ""))) else "und" for i, (k, h) in enumerate(zip(best.tolist(), has.tolist(), strict=True))]
        yield a, b, names, np.where([x == "und" for x in names], 0.0, score), evidence


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0):
    """Column: crc32 of the id as text leaves the held-out remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def learned(docs: DataFrame) -> Filters | None:
    """Filters from the documents that are not held out."""
    return fit(docs.where(~held_out()))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learned from the documents that are not held out."""
    return predicted(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

