"""Benchmark decontamination by greedy string tiling: test passages found in documents in any order, by coverage."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, powers, shingle_hashes, steps, word_hashes, word_spans

#: Tokens of a seed and least tokens of a tile; share of an item's tokens that tiles must cover; least tokens they cover.
SEED, COVERAGE, LEAST = 4, 0.6, 8
#: Bytes of benchmark text that one block broadcasts at most (a longer item makes a block of its own).
BLOCK_BYTES = 8 << 20

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[97:123] = _TOKEN[128:] = True


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets of the texts in them). Tokens are runs of ASCII letters, digits and non-ASCII characters, in lower case."""
    raw = [(x or "").lower().encode("utf-8", "replace") for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, firsts = word_spans(data, offsets, ~_TOKEN)
    return word_hashes(data, starts, ends), firsts


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in item, start in text, length) of marked tiles.

    Running Karp-Rabin rounds look for matches of a search length, the longest at which unmarked runs of both sides still
    have equal hashes: the item's runs of that length are looked up among the text's, checked token by token and marked (ties:
    earlier in the item, then in the text). The search length then falls to the longest match that is left, until that is below
    least. Marked tokens are never used twice, on either side.
    """
    done_a, done_b = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    search = _next_length(item, text, done_a, done_b, min(len(item), len(text)) + 1, least)
    while search >= least:
        starts_a, starts_b = _open_runs(done_a, search), _open_runs(done_b, search)
        rolled_a, rolled_b = _rolled(item, search)[starts_a], _rolled(text, search)[starts_b]
        order = np.argsort(rolled_b, kind="stable")
        left, right = np.searchsorted(rolled_b[order], rolled_a, "left"), np.searchsorted(rolled_b[order], rolled_a, "right")
        for i, lo, hi in zip(starts_a.tolist(), left.tolist(), right.tolist(), strict=True):
            for j in starts_b[order[lo:hi]].tolist():
                # a longer match cannot be left here, so each match is as long as the search
                if not done_a[i : i + search].any() and not done_b[j : j + search].any() and (item[i : i + search] == text[j : j + search]).all():
                    done_a[i : i + search] = done_b[j : j + search] = True
                    out.append((i, j, search))
        search = _next_length(item, text, done_a, done_b, search, least)
    return sorted(out)


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n tokens: prefix sums of a polynomial modulo 2**64, moved to the power 0."""
    p = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x)), out=p[1:])
    return mixed((p[n:] - p[:-n]) * powers(len(x) + 1, True)[: len(x) - n + 1])


def _open_runs(done: np.ndarray, n: int) -> np.ndarray:
    """Starts of runs of n tokens none of which is marked."""
    marked = np.concatenate([[0], np.cumsum(done)])
    return np.flatnonzero(marked[n:] == marked[:-n]) if n <= len(done) else np.zeros(0, int)


def _longest_run(done: np.ndarray) -> int:
    at = np.flatnonzero(np.concatenate([[True], done, [True]]))
    return int(np.diff(at).max()) - 1


def _next_length(item: np.ndarray, text: np.ndarray, done_a: np.ndarray, done_b: np.ndarray, below: int, least: int) -> int:
    """The longest length under `below` at which unmarked runs of both sides still agree (their hashes meet), or 0."""
    low, high = least, min(below - 1, _longest_run(done_a), _longest_run(done_b))
    best = 0
    while low <= high:
        n = (low + high) // 2
        if np.isin(_rolled(item, n)[_open_runs(done_a, n)], _rolled(text, n)[_open_runs(done_b, n)]).any():
            best, low = n, n + 1
        else:
            high = n - 1
    return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded bytes, streamed to the driver one partition at a time."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        if block and held + len(row[1]) * 4 > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1]) * 4
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, seed: int = SEED, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, n_tiles, coverage) of every document and test item whose tiles cover enough.

    A document is compared with an item if they share a seed of `seed` successive tokens (or all tokens of a shorter item), and
    kept if its tiles cover at least `coverage` of the item's tokens; an item with fewer than `least` tokens must be covered
    whole. Passages in another order, case or punctuation are caught, as tiles may lie anywhere in the document.

    Null and empty texts on either side match nothing. Repeated documents and items give repeated rows; null ids are kept.
    Empty tables give no rows; other columns are ignored.

    The benchmark is the stated query set: it passes by in blocks of BLOCK_BYTES, each broadcast, over all documents, which are
    read once a block and never shuffled. A text is tokenised whole; memory is bounded by the longest text and a block.
    """
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, item_tokens int, covered int, n_tiles int, coverage double"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(_index(block, seed)))
        part = rows.mapInArrow(_scan(sent, coverage, seed, least), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def _index(block: list[tuple[int, str]], seed: int) -> tuple:
    """(ids, item tokens, seed lengths, and by length the sorted seeds with the item of each)."""
    tokens, firsts = _tokens([x for _, x in block])
    items = [tokens[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
    by_length: dict[int, tuple[list, list]] = {}
    for k, x in enumerate(items):
        if len(x):
            n = min(seed, len(x))
            keys = np.unique(shingle_hashes(x, n))
            by_length.setdefault(n, ([], []))[0].append(keys)
            by_length[n][1].append(np.full(len(keys), k))
    seeds = {}
    for n, (keys, owner) in by_length.items():
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        seeds[n] = (keys[order], owner[order])
    return [i for i, _ in block], items, seeds


def _scan(sent, coverage: float, seed: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, seeds = pickle.loads(sent.value)
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
            out = []
            for a, b, _, _ in steps(batch, "text"):
                tokens, firsts = _tokens(texts[a:b].to_pylist())
                pairs = set()
                for n, (keys, owner) in seeds.items():
                    rolled = shingle_hashes(tokens, n)
                    left = np.searchsorted(keys, rolled, "left")
                    hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == rolled)
                    doc = np.searchsorted(firsts, hit, "right") - 1
                    inside = hit + n <= firsts[doc + 1]
                    hit, doc = hit[inside], doc[inside]
                    lo, hi = left[hit], np.searchsorted(keys, rolled[hit], "right")
                    for d, i, j in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        pairs.update((d, int(k)) for k in owner[i:j])
                for d, k in sorted(pairs):
                    item, text = items[k], tokens[firsts[d] : firsts[d + 1]]
                    need = len(item) if len(item) < least else max(least, int(np.ceil(coverage * len(item))))
                    # only tokens that the item has can lie in a tile: enough of them must be there, and the others are cut down
                    if np.isin(item, text).sum() < need:
                        continue
                    found = tiles(item, _near(item, text, min(seed, len(item))), min(seed, len(item)))
                    covered = sum(n for _, _, n in found)
                    if covered >= need:
                        out.append((doc_ids[a + d], ids[k], len(item), covered, len(found), covered / len(item)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "item_tokens", "covered", "n_tiles", "coverage"])

    return run


def _near(item: np.ndarray, text: np.ndarray, seed: int) -> np.ndarray:
    """text without the tokens that are in no seed of the item; one stranger stands for each stretch left out, so no tile crosses it."""
    if len(text) < seed:
        return text
    hit = np.isin(shingle_hashes(text, seed), shingle_hashes(item, seed))
    edge = np.zeros(len(text) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + seed, -1)
    keep = np.cumsum(edge[:-1]) > 0
    stranger = np.uint64(0)
    gap = ~keep & np.concatenate([[True], keep[:-1]])
    out = np.where(keep, text, stranger)
    return out[keep | gap]
