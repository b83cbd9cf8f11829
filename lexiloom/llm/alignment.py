"""Alignment of two tokenizers: token groups between the byte offsets at which tokens of both end."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, most_frequent, written
from .token_counts import PRE_TOKEN

#: Vocabulary files of tokenizer A (byte-level BPE) and B (pieces).
VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Words and linked pairs that a worker remembers; links of a word above which equal tokens are counted first.
REMEMBERED, REMEMBERED_PAIRS, MANY_LINKS = 300_000, 8_000_000, 4_096
#: Pairs of ids whose counts are broadcast, 16 bytes each; those of all others are joined.
FREQUENT = 500_000

#: Characters up to which words are learned together.
SHORT = 64

#: Labels of bytes, and a stretch of them that ends where tokens of both end.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
GROUP = re.compile(rb"[\x00-\x02]*\x03")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, of a few MB, from the driver's disk or from any store that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Token groups of texts, from a bounded memory of words.

    Both tokenizers cut a text in front of a single space between two other characters: A's pre-tokens begin there, and B has no
    piece in which a space follows another character (else texts are not cut). So a text's groups are those of its words.
    """

    def __init__(self, vocabulary_a: bytes, vocabulary_b: bytes):
        model, alphabet = json.loads(vocabulary_a)["model"], byte_alphabet()
        special = {x["content"] for x in json.loads(vocabulary_a).get("added_tokens", ())}
        ranks = {bytes(map(alphabet.__getitem__, word)): k for word, k in model["vocab"].items() if word not in special}
        merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the entries of vocabulary A must be numbered in the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for word, k in ranks.items():
            self.bytes_a[k] = word
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabulary_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        self.n_b = len(pieces)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.text_a = [f"{k}{end}" for k in range(len(self.bytes_a)) for end in ",|"]
        self.text_b = [f"{k}{end}" for k in range(self.n_b) for end in ",;"]
        self.cuts = not any(re.search("[^▁]▁", x) for x in pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: bytes differ, so that a text with this word has no tokens
        self.sums = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """text cut at spaces that both tokenizers cut at; a space belongs in front of each word."""
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        # alike only if all white space is single spaces between words
        return parts if parts == text.split() else re.split(r"(?<=\S) (?=\S)", text)

    def align(self, a: list[int], b: list[int], raw: bytes) -> list[tuple[list[int], list[int]]] | None:
        """Groups of the ids of A and of B that spell raw; None where they don't."""
        spelled_a, spelled_b = [self.bytes_a[k] for k in a], [self.bytes_b[k] for k in b]
        if b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            return None
        labels = bytearray(len(raw))
        for end in accumulate(map(len, spelled_a)):
            labels[end - 1] = A_END
        for end in accumulate(map(len, spelled_b)):
            labels[end - 1] |= B_END
        out, i, j = [], 0, 0
        for span in GROUP.findall(labels):
            both = span.count(BOTH)
            n, m = i + span.count(A_END) + both, j + span.count(B_END) + both
            out.append((a[i:n], b[j:m]))
            i, j = n, m
        return out

    def _many_links(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """(linked id pairs, how often each is linked) of a large group, equal tokens counted first."""
        (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        return np.add.outer(x * self.n_b, y).ravel().tolist(), np.multiply.outer(n, m).ravel().tolist()

    def learn(self, words: set[str]) -> None:
        """Remembers words, with their groups, as rows of flat arrays."""
        short = sorted(x for x in words if 0 < len(x) <= SHORT and len(x.split()) == 1 and not x[0].isspace() and not x[-1].isspace()) if self.cuts else []
        if not self._learn_together(short):
            short = []
        self._learn_alone(sorted(words.difference(short)))

    def _remembered(self, words: list[str], groups: list[str | None], sums: np.ndarray, ends: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        first = len(self.groups)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.groups += groups
        self.sums = np.concatenate([self.sums, sums])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def _learn_alone(self, words: list[str]) -> None:
        sums, pairs, times, ends, texts = [], [], [], [], []
        encode_a, encode_b = self.a.encode_ordinary, self.b.encode  # their calls for lists start threads
        for word in words:
            a, b = encode_a(" " + word), encode_b(word)
            groups = self.align(a, b, (" " + word).encode())
            for x, y in groups or ():
                if len(x) * len(y) <= MANY_LINKS:
                    pairs += [k * self.n_b + m for k in x for m in y]
                else:
                    times += [1] * (len(pairs) - len(times))
                    keys, counts = self._many_links(x, y)
                    pairs += keys
                    times += counts
            texts.append(None if groups is None else ";".join([",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups]))
            sums.append((0, 0, 0, 0) if groups is None else (len(a), len(b), len(groups), sum([len(x) * len(y) for x, y in groups])))
            ends.append(len(pairs))
        times += [1] * (len(pairs) - len(times))
        self._remembered(words, texts, np.array(sums, np.int64).reshape(-1, 4), np.array(ends, np.int64), np.array(pairs, np.int64), np.array(times, np.int64))

    def _learn_together(self, words: list[str]) -> bool:
        """Learns words that have no white space as one text, as a space cuts it for both tokenizers; False if the bytes of a word differ."""
        if not words:
            return True
        text = " ".join(words)
        raw = (" " + text).encode()
        a, b = np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text), np.int64)
        if b"".join([self.bytes_a[k] for k in a.tolist()]) != raw or b"".join([self.bytes_b[k] for k in b.tolist()]) != raw:
            return False
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        labels = np.zeros(len(raw), np.uint8)
        labels[end_a - 1] = A_END
        labels[end_b - 1] |= B_END
        # bytes without a label count for nothing
        spans = GROUP.findall(labels.tobytes().translate(None, bytes([NONE])))
        n = {x: (x.count(A_END) + x.count(BOTH), x.count(B_END) + x.count(BOTH)) for x in set(spans)}
        n_a, n_b = np.array([n[x] for x in spans], np.int64).T
        links = n_a * n_b
        upto_a, upto_b, upto = np.cumsum(n_a), np.cumsum(n_b), np.cumsum(links)
        group = np.repeat(np.arange(len(links)), links)
        inside = np.arange(upto[-1]) - (upto - links)[group]
        pairs = a[(upto_a - n_a)[group] + inside // n_b[group]] * self.n_b + b[(upto_b - n_b)[group] + inside % n_b[group]]
        # the last group of each word ends where the word does
        word_ends = np.cumsum([1 + len(x.encode()) for x in words])
        last = np.searchsorted(end_a[upto_a - 1], word_ends)
        sums = np.diff(np.stack([upto_a[last], upto_b[last], last + 1, upto[last]], 1), axis=0, prepend=0)
        # each token's number and what follows it, in the order of the groups' text
        place_a = np.arange(len(a)) + np.repeat(upto_b - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(upto_a, n_b)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[upto_a - 1] = 1
        ends_b[upto_b - 1] = 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = 2 * a + ends_a, len(self.text_a) + 2 * b + ends_b
        shown = list(map((self.text_a + self.text_b).__getitem__, codes.tolist()))
        cuts = (upto_a + upto_b)[last].tolist()
        groups = ["".join(shown[i:j])[:-1] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
        self._remembered(words, groups, sums, upto[last], pairs, np.ones(len(pairs), np.int64))
        return True

    def texts(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """((n_a, n_b, n_groups, n_links), groups, linked pairs, times) of each text."""
        if len(self.known) > REMEMBERED or len(self.pairs) > REMEMBERED_PAIRS:
            self._forget()
        cut = [self.words(x) if x else [] for x in texts]
        unknown = set().union(*cut).difference(self.known)
        if unknown:
            self.learn(unknown)
        none = np.zeros(0, np.int64)
        for words in cut:
            at = [self.known[x] for x in words]
            held = [self.groups[k] for k in at]
            if not held or None in held:
                yield (0, 0, 0, 0), "", none, none
                continue
            k = np.array(at)
            start, size = self.starts[k], self.starts[k + 1] - self.starts[k]
            ends = np.cumsum(size)
            flat = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            yield tuple(self.sums[k].sum(0).tolist()), ";".join(held), *merged_counts(self.pairs[flat], self.times[flat])


def merged_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sums of their counts)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


@lru_cache(2)
def aligner(vocabulary_a: bytes, vocabulary_b: bytes) -> Aligner:
    """One aligner a worker process."""
    return Aligner(vocabulary_a, vocabulary_b)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """ALIGNED of every row of docs: how many tokens, groups and links a text has, its groups as `a1,a2|b1;a3|b2,b3` in order, and
    its linked pairs of ids (A's id times B's number of pieces, plus B's id), each with how often it is linked.

    Both tokenizers read a space and the whole text, without special tokens. Null and empty texts, and texts whose tokens of A or
    B join to other bytes, have no tokens: zeros, an empty string, empty arrays. Null and repeated ids are kept; rows that are
    wholly alike get the same answers; an empty table gives no rows; other columns are ignored. Nothing is shuffled; a worker
    holds one batch of texts at a time. The files' bytes, some MB, go to the executors by broadcast.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((file_bytes(spark, vocabulary_a), file_bytes(spark, vocabulary_b)))
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*held.value)
        for batch in batches:
            sums, groups, pairs, times = zip(*align.texts(batch.column("text").to_pylist()), strict=True) if batch.num_rows else ([],) * 4
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())) for x in (pairs, times)]
            counts = np.array(sums, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists], names)

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def link_counts(docs: DataFrame, n_b: int, frequent: int = FREQUENT) -> DataFrame:
    """docs, a written table with ALIGNED's pairs and times, with n_best and count_sum instead of them. A pair's count is the number of
    rows that hold it; n_best counts a row's links whose pair's count is the highest of its A id, count_sum adds up all its links'.

    The `frequent` pairs of greatest counts are broadcast and answered in place; all other pairs, each of which stands in few rows
    then, are joined. The highest count of each A id is broadcast too, a number for each entry of A's vocabulary.
    """
    spark = docs.sparkSession
    counts = written(docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("c")), "alignment-counts")
    a_of = F.expr(f"pair div {n_b}")
    top = counts.groupBy(a_of.alias("a")).agg(F.max("c").alias("best")).toPandas()  # at most A's entries
    best = np.zeros(int(top["a"].max()) + 1 if len(top) else 1, np.int64)
    best[top["a"].to_numpy(np.int64)] = top["best"].to_numpy(np.int64)
    keys, often = most_frequent(counts, "pair", frequent)
    keys = keys.view(np.int64)
    all_frequent = counts.count() == len(keys)
    held = spark.sparkContext.broadcast((keys, often.astype(np.int64), best))
    kept = [c for c in docs.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    more = "n_best long, count_sum long" + ("" if all_frequent else ", rest array<struct<pair: long, times: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often, best = held.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            c = np.where(here, often[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            total, won = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row, c * times)
            np.add.at(won, row, np.where(here & (c == best[pairs // n_b]), times, 0))
            out = [*(batch.column(x) for x in kept), pa.array(won), pa.array(total)]
            names = [*kept, "n_best", "count_sum"]
            if not all_frequent:
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[~here], minlength=batch.num_rows))])
                left = pa.StructArray.from_arrays([pa.array(pairs[~here]), pa.array(times[~here])], ["pair", "times"])
                out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(out, names)

    first = docs.mapInArrow(run, f"{fields}, {more}")
    if all_frequent:
        return first
    first = written(first.withColumn("row", F.monotonically_increasing_id()), "alignment-first")
    named = counts.join(F.broadcast(spark.createDataFrame([(k, int(b)) for k, b in enumerate(best) if b], "a long, best long")), a_of == F.col("a")).select("pair", "c", "best")
    rest = first.select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.times").join(named, "pair")
    added = rest.groupBy("row").agg(F.sum(F.when(F.col("c") == F.col("best"), F.col("times")).otherwise(0)).alias("won"), F.sum(F.col("c") * F.col("times")).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.join(added, "row", "left").select(*kept, (F.col("n_best") + zero("won")).alias("n_best"), (F.col("count_sum") + zero("total")).alias("count_sum"))


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, frequent: int = FREQUENT) -> DataFrame:
    """aligned() of every row with n_best and count_sum by link_counts(), and a digest of the groups in place of them: (doc_id, n_a,
    n_b, n_groups, n_links, groups_sha256, n_best, count_sum). Nulls, empty texts and repeats as there; a row counts as a document."""
    spark = docs.sparkSession
    found = aligned(docs, id_col, text_col, vocabulary_a, vocabulary_b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    table = written(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "alignment-docs")
    n_b = sentencepiece.SentencePieceProcessor(model_proto=file_bytes(spark, vocabulary_b)).get_piece_size()
    return link_counts(table, n_b, frequent)
