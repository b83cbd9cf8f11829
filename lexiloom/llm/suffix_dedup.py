"""Repeated 200-byte strings removed by suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, deleted, ids_hint, lanes, mixed, most_frequent, steps, written

#: Bytes of a repeated string, of the grams that anchor it, and the depth at which quicksort hands over to blind tries.
LENGTH, GRAM, SHALLOW = 200, 32, 16
#: Bytes that one step of the anchor scan works on (a longer text is cut into pieces), and suffixes that one sort holds.
PIECE, SORTED = 1 << 20, 1 << 20

#: Anchors counted together before they leave a task, the count from which one is told, the count from which it is frequent, and
#: frequent ones at most.
COUNTED, TOLD, FREQUENT, RANKED = 1_000_000, 16, 1_000, 1 << 16
#: Slots of a task's memory of contexts, and bits of an anchor's hash that say whether it is frequent.
REMEMBERED, FREQUENT_BITS = 1 << 20, 22

OCCURRENCE = "told boolean, h long, ctx long, ctx2 long, k1 long, k2 long, p int, lo int, hi int"

_factors = np.random.default_rng(20240608).integers(1, 2**63, (2, 96), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, text): k1, k2 name a row by its id and text; rows that are wholly alike share them and all answers."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return bounded_batches(docs).select(F.coalesce(doc_id, F.lit(0)).alias("k1"), F.xxhash64(doc_id, text).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, frequent: np.ndarray | None = None, contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(hash, text, position, first start, last start, and two context hashes) of the anchors of texts that lie one behind another.

    The anchor of a window of `length` bytes is its gram of smallest hash, the first of them; grams whose hash starts with bits
    that `frequent` marks come after all others. Equal windows have equal grams at equal offsets, so they meet under the anchor's
    hash; successive windows mostly share theirs. The context is all bytes of the windows that an anchor stands for. Hashes mix
    eight bytes at a time and are no polynomials, so that no pattern of bytes cancels; a context has 128 bits. All texts are
    worked on at once, windows over their ends left out; positions are those in data, which has less than 2**24 bytes.
    """
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(7 if contexts else 5))
    eight = mixed(np.array(lanes(data)[: len(data) - 7]))
    count, n = len(data) - gram + 1, len(data) - length + 1
    h = np.zeros(count, np.uint64)
    for k in range(gram // 8):
        h += eight[8 * k : 8 * k + count] * _factors[0, k]
    h = mixed(h)
    key = h >> np.uint64(1)
    if frequent is not None:
        key |= frequent[(h >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    w = length - gram + 1
    # sliding minima: running minima from the left and from the right of blocks of w, joined
    size = -(-count // w) * w
    block = np.full(size, ~np.uint64(0))
    block[:count] = (key & ~np.uint64((1 << 24) - 1)) | np.arange(count, dtype=np.uint64)
    right = np.minimum.accumulate(block.reshape(-1, w), axis=1).ravel()
    left = np.minimum.accumulate(block.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    # windows inside a text, and runs of those with one anchor
    doc = np.repeat(np.arange(len(sizes)), starts)
    window = offsets[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
    best = best[window]
    head = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
    tail = np.append(head[1:], len(best)) - 1
    at, first, last, doc = best[head], window[head], window[tail], doc[head]
    if not contexts:
        return h[at], doc, at, first, last
    end = last + length
    place = (at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    names = [mixed(place + np.uint64(k)) + eight[end - 8] * _factors[k, 0] for k in range(2)]
    for j in range(-(-(2 * length - gram) // 8)):
        on = np.flatnonzero(first + 8 * j + 8 <= end)
        part = eight[first[on] + 8 * j]
        for k in range(2):
            names[k][on] += part * _factors[k, 1 + j]
    return h[at], doc, at, first, last, mixed(names[0]), mixed(names[1])


def _pieces(batch: pa.RecordBatch, frequent: np.ndarray | None = None, contexts: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, row, position in its text, lo, hi, and two context hashes) of the anchors of stretches of a batch."""
    for a, _, data, offsets in steps(batch, "text", PIECE):
        # a text longer than PIECE is a stretch of its own
        for base in range(0, max(1, len(data) - LENGTH + 1), PIECE) if len(offsets) == 2 else (0,):
            part = data[base : base + PIECE + LENGTH - 1] if len(offsets) == 2 else data
            at_ = np.array([0, len(part)]) if len(offsets) == 2 else offsets
            h, doc, at, first, last, *names = anchors(part, at_, frequent=frequent, contexts=contexts)
            if len(h):
                yield h, a + doc, at - at_[doc] + base, at - last, at - first, *names


def frequent_anchors(keyed: DataFrame) -> np.ndarray | None:
    """Which first FREQUENT_BITS bits of a gram's hash stand for frequent anchors, or None where there are none.

    Any order of grams gives right results; one that puts frequent grams last keeps a line that many documents share, in all its
    different surroundings, out of one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def tell() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= TOLD].view(np.int64)), pa.array(c[c >= TOLD].astype(np.int64))], ["h", "c"])

        for batch in batches:
            for h, *_ in _pieces(batch, contexts=False):
                held.append(h)
                size += len(h)
            if size >= COUNTED:
                yield tell()
                held, size = [], 0
        if held:
            yield tell()

    counts = written(keyed.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "suffix-counts")
    found, _ = most_frequent(counts, "h", RANKED, FREQUENT)
    deleted(counts)
    if not len(found):
        return None
    out = np.zeros(1 << FREQUENT_BITS, bool)
    out[(found >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)] = True
    return out


class _Seen:
    """How often a task has met each context before, up to two, in a memory of fixed size; what is overwritten counts anew."""

    def __init__(self) -> None:
        self.keys, self.times = np.zeros((3, REMEMBERED), np.uint64), np.zeros(REMEMBERED, np.int64)

    def before(self, h: np.ndarray, ctx: np.ndarray, ctx2: np.ndarray) -> np.ndarray:
        order = np.lexsort((ctx2, ctx, h))
        key = np.stack([h, ctx, ctx2])[:, order]
        heads = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        sizes = np.diff(np.append(heads, len(h)))
        slot = (key[2, heads] % np.uint64(REMEMBERED)).astype(np.int64)
        known = np.where((self.keys[:, slot] == key[:, heads]).all(0), self.times[slot], 0)
        self.keys[:, slot], self.times[slot] = key[:, heads], np.minimum(2, known + sizes)
        # of two runs in one slot the later one stays, with its own number of times
        out = np.zeros(len(h), np.int64)
        out[order] = np.repeat(known, sizes) + np.arange(len(h)) - np.repeat(heads, sizes)
        return out


def _scan(frequent: np.ndarray | None):
    """All anchors of all texts as OCCURRENCE rows; lo and hi are the least and greatest offset of the anchor in its windows.

    told: the task has sent the same context twice before, so that this one is a repeat and needs no comparison.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for h, rows, at, lo, hi, ctx, ctx2 in _pieces(batch, frequent):
                told = seen.before(h, ctx, ctx2) >= 2
                longs = [pa.array(x.view(np.int64)) for x in (h, ctx, ctx2)]
                yield pa.RecordBatch.from_arrays([pa.array(told), *longs, pa.array(k1[rows]), pa.array(k2[rows]), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))], [x.split()[0] for x in OCCURRENCE.split(", ")])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From occurrences in order of (told, h, ctx, ctx2): a kind 0 row for each one whose whole context stands elsewhere too, and a
    kind 1 row for one occurrence of each context under an anchor that has several contexts.

    Holds one batch and, between batches, the first row of the last context, with whether that context came twice (it is told
    then) and whether its anchor had another one before.
    """
    tail, twice, other = None, False, False
    for batch in batches:
        told_before = batch.column("told").to_numpy(zero_copy_only=False)
        if told_before.any():
            yield from _of_kind(pa.Table.from_batches([batch.filter(pa.array(told_before))]), 0)
            batch = batch.filter(pa.array(~told_before))
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        carried = tail is not None
        if carried:
            table = pa.concat_tables([tail, table]).combine_chunks()
        h, ctx, ctx2 = (table.column(c).to_numpy() for c in ("h", "ctx", "ctx2"))
        same = (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1]) & (ctx2[1:] == ctx2[:-1])
        several = np.zeros(len(h), bool)
        several[1:] |= same
        several[:-1] |= same
        several[0] |= carried and twice
        told = several.copy()
        told[0] &= not (carried and twice)
        runs = np.flatnonzero(np.concatenate([[True], ~same]))
        after = np.concatenate([h[runs[1:]] == h[runs[:-1]], [False]])
        before = np.concatenate([[carried and other], after[:-1]])
        tail, twice, other = table.slice(runs[-1], 1), bool(several[runs[-1]]), bool(before[-1])
        # the last context may go on in the next batch
        for at, kind in ((np.flatnonzero(told), 0), (runs[:-1][(after | before)[:-1]], 1)):
            if len(at):
                yield from _of_kind(table.take(pa.array(at)), kind)
    if tail is not None and other:
        yield from _of_kind(tail, 1)


MET = "h long, k1 long, k2 long, p int, lo int, hi int, kind int"


def _of_kind(table: pa.Table, kind: int) -> list[pa.RecordBatch]:
    return table.select(["h", "k1", "k2", "p", "lo", "hi"]).append_column("kind", pa.array(np.full(table.num_rows, kind, np.int32))).combine_chunks().to_batches()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k1, k2, p, lo, hi, bytes) for the wanted occurrences of each document."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            raw = batch.column("text")[row].as_py().encode()
            k1, k2 = batch.column("k1")[row].as_py(), batch.column("k2")[row].as_py()
            for x in batch.column("wanted")[row].as_py():
                out.append((x["h"], k1, k2, x["p"], x["lo"], x["hi"], raw[x["p"] - x["hi"] : x["p"] - x["lo"] + LENGTH]))
            if len(out) >= 4096:
                yield _context_rows(out)
                out = []
        if out:
            yield _context_rows(out)


def _context_rows(out: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "k1", "k2", "p", "lo", "hi", "bytes"])


def _words(data: np.ndarray) -> np.ndarray:
    """At every byte the big-endian integer of the eight bytes from there on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, twin): strings data[s:s+length] in order within each bucket, and which equal another one of their bucket.

    Multikey quicksort on characters of eight bytes runs on all groups at once: each group is cut into smaller, equal and larger
    than the character of its middle string, and the equal part moves on by a character. Groups that still agree at the shallow
    depth go to a blind trie: one string is the path, every other one hangs at the byte where it leaves the path, and those that
    leave at one byte with one letter make the next group. Strings that never leave the path are equal to it.
    """
    words = _words(data)
    order = np.argsort(bucket, kind="stable")
    twin = np.zeros(len(starts), bool)
    group = _run_heads(bucket[order])
    slots = np.flatnonzero(_shared(group))
    depth = np.zeros(len(starts), np.int64)
    deep = np.zeros(len(starts), bool)
    while len(slots):
        item, g = order[slots], group[slots]
        key = words[starts[item] + depth[item]]
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(heads, len(g)))
        pivot = np.repeat(key[heads + sizes // 2], sizes)
        part = (key > pivot).astype(np.int64) - (key < pivot) + 1
        turn = np.lexsort((part, g))
        order[slots], part, g = item[turn], part[turn], g[turn]
        item = order[slots]
        depth[item[part == 1]] += 8
        group[slots] = slots[_run_heads(g * 3 + part)]
        deep[slots] = depth[item] >= shallow
        slots = slots[_shared(group[slots]) & ~deep[slots]]
    slots = np.flatnonzero(deep)
    slots = slots[_shared(group[slots])]
    while len(slots):
        item, g = order[slots], group[slots]
        heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(heads, len(g)))
        path = np.repeat(item[heads], sizes)
        left, letter, less = np.full(len(item), length), np.zeros(len(item), np.int64), np.zeros(len(item), bool)
        open_ = np.arange(len(item))
        for d in range(int(depth[item].min()) // 8 * 8, length, 8):
            a, b = words[starts[item[open_]] + d], words[starts[path[open_]] + d]
            away = a != b
            at = open_[away]
            if len(at):
                a, b = a[away], b[away]
                byte = _first_byte(a ^ b)
                left[at] = np.minimum(d + byte, length)
                letter[at] = (a >> (np.uint64(56) - np.uint64(8) * byte.astype(np.uint64)) & np.uint64(255)).astype(np.int64)
                less[at] = a < b
            open_ = open_[~away]
            if not len(open_):
                break
        equal = left >= length
        place = np.where(equal, 1, np.where(less, 0, 2))
        far = np.where(equal, 0, np.where(less, left, length - left))
        turn = np.lexsort((letter * ~equal, far, place, g))
        order[slots] = item[turn]
        twin[item[equal & (np.repeat(np.add.reduceat(equal.astype(np.int64), heads), sizes) > 1)]] = True
        depth[item] = np.maximum(depth[item], np.where(equal, length, left // 8 * 8))
        label = ((g * 3 + place) * (length + 1) + far) * 256 + letter * ~equal
        group[slots] = slots[_run_heads(label[turn])]
        slots = slots[_shared(group[slots]) & ~equal[turn]]
    return order, twin


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Index of the first byte, from the most significant, that is not 0."""
    out = np.zeros(len(x), np.int64)
    for half in (32, 16, 8):
        empty = x >> np.uint64(64 - half) == 0
        out += np.where(empty, half // 8, 0)
        x = np.where(empty, x << np.uint64(half), x)
    return out


def _run_heads(x: np.ndarray) -> np.ndarray:
    """For each place the first place of its run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))


def _shared(group: np.ndarray) -> np.ndarray:
    """Places whose group has more than one (groups are contiguous)."""
    out = np.zeros(len(group), bool)
    same = group[1:] == group[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def _sorted_group(rows: list[tuple], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, s, e) of the repeated strings in whole anchor groups; rows are (h, k1, k2, p, lo, hi) in order of h."""
    offsets = np.cumsum([0] + [len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, k1, k2, p, lo, hi = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    # a window can only equal one of the same offset from the anchor: offsets are buckets, and may be sorted block by block
    block = max(1, min(LENGTH, SORTED // len(rows)))
    for first in range(0, LENGTH, block):
        a, b = np.maximum(lo, first), np.minimum(hi, first + block - 1)
        counts = np.maximum(0, b - a + 1)
        owner = np.repeat(np.arange(len(rows)), counts)
        offset = a[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        _, twin = deep_shallow(data, offsets[owner] + hi[owner] - offset, group[owner] * LENGTH + offset)
        at = np.flatnonzero(twin)
        if not len(at):
            continue
        # offsets rise within an owner, so that starts fall; runs of successive starts make one span
        owner, start = owner[at], p[owner[at]] - offset[at]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] - 1)]))
        last = np.append(head[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[owner[head]], k2[owner[head]], start[last], start[head] + LENGTH)], ["k1", "k2", "s", "e"])


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated strings from contexts in order of h; whole anchor groups are sorted together, small ones many at a time."""
    rows, texts = [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("h", "k1", "k2", "p", "lo", "hi", "bytes")]
        for *row, text in zip(*cols, strict=True):
            if len(rows) >= 4096 and rows[-1][0] != row[0]:
                yield from _sorted_group(rows, texts)
                rows, texts = [], []
            rows.append(row)
            texts.append(text)
    if rows:
        yield from _sorted_group(rows, texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            raw = batch.column("text")[row].as_py().encode()
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in batch.column("spans")[row].as_py() or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            out.append((batch.column("k1")[row].as_py(), batch.column("k2")[row].as_py(), batch.column("doc_id")[row].as_py(), len(raw), sum(e - s for s, e in merged), len(merged), digest.hexdigest()))
        if out:
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(keyed: DataFrame, single: DataFrame) -> DataFrame:
    """(k1, k2, s, e): byte ranges that together cover every byte of a repeated string; they overlap. single has each (k1, k2) once."""
    found = keyed.select("k1", "k2", "text").mapInArrow(_scan(frequent_anchors(keyed)), OCCURRENCE)
    # what is told already may go anywhere
    deal = F.when(F.col("told"), F.xxhash64("k2", "p")).otherwise(F.col("h"))
    met = written(found.repartition(deal).sortWithinPartitions("told", "h", "ctx", "ctx2").mapInArrow(_met, MET), "suffix-met")
    whole = met.where("kind = 0").select("k1", "k2", (F.col("p") - F.col("hi")).cast("long").alias("s"), (F.col("p") - F.col("lo") + LENGTH).cast("long").alias("e"))
    wanted = met.where("kind = 1").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "p", "lo", "hi")).alias("wanted"))
    contexts = single.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).mapInArrow(_contexts, "h long, k1 long, k2 long, p long, lo int, hi int, bytes binary")
    return whole.unionByName(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sort, "k1 long, k2 long, s long, e long"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs.

    Texts are UTF-8 bytes (null: empty). Every byte that is covered by a 200-byte string which also starts anywhere else, in the
    same or another document, is removed; strings are judged on the input. n_spans counts maximal removed runs; kept_sha256 is
    the digest of the remaining bytes. Texts under 200 bytes lose nothing. Rows that are wholly alike are copies of each other
    and lose everything from 200 bytes on; they are cut once. Null ids are kept. An empty table gives no rows; other columns are
    ignored.

    Suffixes are dealt by content: the anchor of a 200-byte window is its 32-byte gram of smallest hash, so that equal windows
    meet in one bucket. Before they are sorted, equal contexts of an anchor are merged by 64 bits of the anchor and 128 of the
    context, those that a task has met twice already in the task itself, so that a passage that many documents share sends few
    rows; a merged context is a repeat as it is. The windows of all different contexts of a bucket are put in order by
    deep_shallow() on their bytes. Grams that are frequent anchors are the last choice, so that a line that many documents share
    does not gather its surroundings in one bucket. Long texts are scanned in pieces. A task streams its buckets; it holds the
    different contexts of one bucket, some 300 bytes each, and sorts a large bucket offset by offset.
    """
    keyed = _keyed(docs, id_col, text_col)
    alike = written(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "suffix-alike")
    single = keyed
    if not alike.isEmpty():
        hot = ids_hint(alike.select("k1", "k2"))
        single = keyed.join(hot, ["k1", "k2"], "left_anti").unionByName(keyed.join(hot, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select(*keyed.columns))
    spans = repeated_spans(keyed, single).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    cut = single.join(spans, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "spans").mapInArrow(_cut, "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if single is not keyed:
        cut = cut.join(ids_hint(alike), ["k1", "k2"], "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB: the same answers, from all windows of all texts, written as hexadecimal digits.
SUFFIX_SQL = r"""
WITH b AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, hex(encode(coalesce(text, ''))) AS hx FROM documents),
     q AS MATERIALIZED (SELECT rid, n_bytes, base, substr(hx, 2 * base + 1, 654) AS piece FROM (SELECT rid, n_bytes, hx, unnest(range(0, n_bytes - 199, 128)) AS base FROM b)),
     w AS MATERIALIZED (SELECT rid, base + o AS s, md5_number(substr(piece, 2 * o + 1, 400)) AS m FROM (SELECT rid, base, piece, unnest(range(least(128, n_bytes - 199 - base))) AS o FROM q)),
     d AS (SELECT rid, s, s - lag(s) OVER (PARTITION BY rid ORDER BY s) AS gap FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
     i AS (SELECT rid, s, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS i FROM d),
     r AS (SELECT rid, min(s) AS s, max(s) + 200 AS e FROM i GROUP BY rid, i),
     p AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM r),
     k AS (SELECT rid, sum(e - s)::bigint AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(hx, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept FROM p JOIN b USING (rid) GROUP BY rid)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN k USING (rid)
"""
