"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only what it touches."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Vocabulary of ranks for byte-level BPE, and the rule that cuts text into pre-tokens (a fixed public format).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past its end that may decide where a pre-token ends.
LOOKAHEAD = 3
#: Leaves of a block, at which the tree ends; pre-tokens whose counts a worker remembers; characters in one step of a long text.
BLOCK, REMEMBERED, STRETCH = 64, 500_000, 1 << 20

#: An edit: characters start..stop of the text as it then is become text.
EDITS = "array<struct<start: long, stop: long, text: string>>"
COUNTS = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_pre_tokens long, n_reencoded long"


class Counter:
    """Tokens of pre-tokens, from a bounded memory."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PRE_TOKEN):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def sizes(self, pre_tokens: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, pre_tokens))
        except KeyError:
            pass
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for x in pre_tokens:
            if x not in self.known:
                self.known[x] = len(self.encoding.encode_ordinary(x))
        return list(map(self.known.__getitem__, pre_tokens))


@lru_cache(2)
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One counter a worker process."""
    return Counter(vocabulary)


class TokenTree:
    """A text's pre-tokens as leaves with their characters and tokens, in blocks under a segment tree of sums."""

    def __init__(self, text: str, count: Counter):
        self.text, self.count = text, count
        self.reencoded = 0
        self._build(*self._leaves(text))

    def _leaves(self, text: str) -> tuple[list[int], list[int]]:
        found = self.count.pattern.findall(text)
        return list(map(len, found)), self.count.sizes(found)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i : i + BLOCK] for i in range(0, len(chars), BLOCK)] or [[]]
        self.tokens = [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)] or [[]]
        self.width = 1 << (len(self.chars) - 1).bit_length()
        # node i sums nodes 2i and 2i+1; blocks are nodes width, width+1, ...
        self.char_sum, self.token_sum = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (a, b) in enumerate(zip(self.chars, self.tokens, strict=True)):
            self.char_sum[self.width + k], self.token_sum[self.width + k] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.char_sum[i] = self.char_sum[2 * i] + self.char_sum[2 * i + 1]
            self.token_sum[i] = self.token_sum[2 * i] + self.token_sum[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.token_sum[1]

    @property
    def n_pre_tokens(self) -> int:
        return sum(map(len, self.chars))

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, leaf in it, first character) of the leaf that holds character `at`; the last leaf if that is the end."""
        node, base = 1, 0
        at = min(at, max(0, self.char_sum[1] - 1))
        while node < self.width:
            node *= 2
            if at - base >= self.char_sum[node]:
                base += self.char_sum[node]
                node += 1
        block = min(node - self.width, len(self.chars) - 1)
        for leaf, n in enumerate(self.chars[block]):
            if at < base + n:
                return block, leaf, base
            base += n
        return block, len(self.chars[block]), base

    def _changed(self, block: int) -> None:
        node = self.width + block
        self.char_sum[node], self.token_sum[node] = sum(self.chars[block]), sum(self.tokens[block])
        node //= 2
        while node:
            self.char_sum[node] = self.char_sum[2 * node] + self.char_sum[2 * node + 1]
            self.token_sum[node] = self.token_sum[2 * node] + self.token_sum[2 * node + 1]
            node //= 2

    def replace(self, start: int, stop: int, text: str) -> None:
        """Characters start..stop become text. Bounds outside the text are moved to its ends.

        Cutting starts anew at the last pre-token that could not see the edit, and stops where a new pre-token ends on an old
        boundary behind the edit: from there on the text, and so its cuts, are as before.
        """
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        old_end, self.text = len(self.text), self.text[:start] + text + self.text[stop:]
        shift = len(self.text) - old_end
        block, leaf, at = self._find(max(0, start - LOOKAHEAD))
        # a leaf that ends less than LOOKAHEAD before the edit may have looked at it; the one found is the first such
        first, begin = (block, leaf), at
        chars: list[int] = []
        found: list[str] = []
        old_at, now = begin, begin
        for m in self.count.pattern.finditer(self.text, begin):
            found.append(m.group())
            chars.append(m.end() - m.start())
            now = m.end()
            while old_at + shift < now and block < len(self.chars):
                if leaf >= len(self.chars[block]):
                    block, leaf = block + 1, 0
                    continue
                old_at += self.chars[block][leaf]
                leaf += 1
            if now >= start + len(text) and old_at >= stop and old_at + shift == now:
                break
        else:
            block, leaf = len(self.chars) - 1, len(self.chars[-1])
        self.reencoded += len(found)
        tokens = self.count.sizes(found)
        b0, l0 = first
        if block >= len(self.chars):
            block, leaf = len(self.chars) - 1, len(self.chars[-1])
        if b0 == block:
            self.chars[b0][l0:leaf], self.tokens[b0][l0:leaf] = chars, tokens
        else:
            self.chars[b0][l0:], self.tokens[b0][l0:] = chars, tokens
            for k in range(b0 + 1, block):
                self.chars[k], self.tokens[k] = [], []
                self._changed(k)
            del self.chars[block][:leaf], self.tokens[block][:leaf]
            self._changed(block)
        if len(self.chars[b0]) > 8 * BLOCK:
            self._build([x for b in self.chars for x in b], [x for b in self.tokens for x in b])
        else:
            self._changed(b0)


def _stretches(text: str, pattern: regex.Pattern) -> Iterator[str]:
    """text in stretches that can be cut alone: they end before a blank that follows a letter or digit."""
    at = 0
    while len(text) - at > STRETCH:
        m = regex.search(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])", text, pos=at + STRETCH)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs: byte-level BPE tokens of the whole text.

    Null and empty texts have 0 tokens; rows that are wholly alike count alike; null ids are kept; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            n = [sum(sum(c.sizes(c.pattern.findall(x))) for x in _stretches(t or "", c.pattern)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def edited_counts(docs: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """COUNTS of every row of docs before and after its edits: (doc_id, n_tokens, n_edits, n_tokens_edited, n_pre_tokens, n_reencoded).

    edits is a column of type EDITS, or a function from a text to its edits as (start, stop, text) in characters. They apply in
    turn, each to the text that the one before left; bounds outside the text are moved to its ends. n_tokens_edited equals a
    full recount of the edited text; n_reencoded counts the pre-tokens that were encoded again for it, n_pre_tokens those of
    the edited text.

    Null texts count as empty and null edits as none; an edit's null text deletes, null bounds are the text's ends. Rows that
    are wholly alike count alike; null ids are kept; an empty table gives no rows; other columns are ignored. A worker holds one
    text's tree at a time; texts without edits are only counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in batches:
            out = []
            given = batch.column("edits").to_pylist() if isinstance(edits, str) else None
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                text = text or ""
                if given is None:
                    todo = edits(text)
                else:
                    todo = [(x["start"] or 0, len(text) + (1 << 40) if x["stop"] is None else x["stop"], x["text"] or "") for x in given[k] or () if x is not None]
                if not todo:
                    sizes = [c.sizes(c.pattern.findall(x)) for x in _stretches(text, c.pattern)]
                    n = sum(map(sum, sizes))
                    out.append((doc_id, n, 0, n, sum(map(len, sizes)), 0))
                    continue
                tree = TokenTree(text, c)
                before = tree.n_tokens
                for edit in todo:
                    tree.replace(*edit)
                out.append((doc_id, before, len(todo), tree.n_tokens, tree.n_pre_tokens, tree.reencoded))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if isinstance(edits, str):
        columns.append(F.col(edits).cast(EDITS).alias("edits"))
    return bounded_batches(docs).select(*columns).mapInArrow(run, COUNTS)


_PRIVATE = regex.compile(
    r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.-]+\w)|(?P<phone>\+?\d{1,3}[ -]?\(\d{3}\) ?\d{3}-\d{4})|(?P<ip>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<secret>\b[0-9a-f]{32,}\b)|(?P<card>\b\d{16}\b)"
)


def private_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a name in place of mail addresses, phone and card numbers, IP addresses and keys, last one first."""
    if not any(map(str.isdigit, text)) and "@" not in text:
        return []
    return [(m.start(), m.end(), f"[{m.lastgroup}]") for m in _PRIVATE.finditer(text)][::-1]
