"""Periodic runs of words: Lyndon arrays over an ordered alphabet in linear time, with matched extensions used again."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Words and periods that a run has at least.
LEAST, EXPONENT = 6, 4
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_array(w: list, falling: bool = False) -> tuple[list[int], list[int]]:
    """(nss, lce): for each position the start of the next smaller suffix, behind which its longest Lyndon word ends, and how many
    letters the two suffixes share. The end of w is smaller than any letter; falling turns the order of letters.

    Suffixes l < r are compared for each r with l = r-1 and then along previous smaller suffixes. No letter is matched twice:
    (a) where the comparison before, of a with r, and the known one of l with a agree in different numbers of letters, the smaller
    number is the answer; (b) otherwise l and r share what a and r share; (c) the matched stretch that reaches furthest right,
    w[a:a+m] = w[b:b+m], holds a copy of the comparison if l is in it; if that ends before the stretch does, so does this one;
    (d) in all other cases l and r match up to the end of that stretch, and letters are compared from there on only.
    """
    n = len(w)
    nss, lce, pss, pss_lce = [n] * n, [0] * n, [-1] * n, [0] * n
    first, second, end = 0, 0, 0  # w[first : first + end - second] == w[second : end]
    for r in range(1, n):
        l = r - 1  # noqa: E741
        c = w[r]
        if r >= end and w[l] != c:
            if (w[l] < c) != falling:
                pss[r] = l
                continue
            nss[l] = r
            before, m, l = l, 0, pss[l]  # noqa: E741
        else:
            before, m = -1, 0
        while l >= 0:
            known = pss_lce[before] if before >= 0 else m
            if known != m:
                if known < m:
                    pss[r], pss_lce[r] = l, known
                    break
            else:
                at = r + m
                copied = False
                if at < end:
                    at = end
                    if l >= second:
                        d = second - first
                        if nss[l - d] == r - d:
                            m, smaller = lce[l - d], False
                        else:
                            m, smaller = pss_lce[r - d], True
                        copied = r + m < end
                if not copied:
                    i = at - r + l
                    while at < n and w[i] == w[at]:
                        i += 1
                        at += 1
                    m = at - r
                    if at > end:
                        first, second, end = l, r, at
                    smaller = at < n and (w[i] < w[at]) != falling
                if smaller:
                    pss[r], pss_lce[r] = l, m
                    break
            nss[l], lce[l] = r, m
            before, l = l, pss[l]  # noqa: E741
    for k in range(n - 1, -1, -1):  # suffixes whose next smaller one is the empty one share no letter with it
        if nss[k] == n:
            lce[k] = 0
    return nss, lce


def left_extensions(w: list, nss: list[int], lce: list[int]) -> list[int]:
    """For each position l how many letters in front of l and of nss[l] agree.

    From right to left; no letter is matched twice. A Lyndon word that follows itself has the extension of its next copy less its
    length. Otherwise, inside the matched stretch that reaches furthest left, the same Lyndon word stands in the stretch's other
    copy with its answer.
    """
    n = len(w)
    out = [0] * n
    end, first, second = n, n, n  # w[end : first] == w[end + second - first : second]
    for l in range(n - 1, -1, -1):  # noqa: E741
        r = nss[l]
        if lce[l] >= r - l:
            out[l] = out[r] - (r - l)
            continue
        i = l
        if l > end:
            known = out[l + second - first]
            if l - known > end:
                out[l] = known
                continue
            i = end
        j = i + r - l
        while i > 0 and w[i - 1] == w[j - 1]:
            i -= 1
            j -= 1
        out[l] = l - i
        if i < end:
            end, first, second = i, l, r
    return out


def runs(w: list, least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches of w that repeat with that smallest period, have at least `exponent` periods
    (2 or more) and `least` letters; by start, then period. Letters need order and equality only.

    Every run has, in one of the two orders, a Lyndon word of its period's length from which it extends to both sides. The first
    such word of a run is less than a period behind the start.
    """
    found = set()
    for falling in (False, True):
        nss, lce = lyndon_array(w, falling)
        # what lies in front of the first Lyndon word is shorter than a period
        some = [k for k, m in enumerate(lce) if m and m > (exponent - 2) * (nss[k] - k)]
        if not some:
            continue
        left = left_extensions(w, nss, lce)
        for k in some:
            period = nss[k] - k
            length = left[k] + period + lce[k]
            if left[k] < period and length >= max(least, exponent * period):
                found.add((k - left[k], length, period))
    return sorted(found)


def text_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """runs() of words, looked for between words that occur fewer than `exponent` times: no run holds such a word."""
    times = Counter(words)
    found, at = [], 0
    for k in [k for k, x in enumerate(words) if times[x] < exponent] + [len(words)]:
        if k - at >= least:
            found += [(at + s, n, q) for s, n, q in runs(words[at:k], least, exponent)]
        at = k + 1
    return found


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    if not found:
        return words
    out, at = [], 0
    for start, stop in sorted((s + q, s + n) for s, n, q in found):
        if start > at:
            out += words[at:start]
        at = max(at, stop)
    return out + words[at:]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """RUNS of every row of docs: words, all runs of at least `least` words and `exponent` periods as (start, length, period) by start,
    then period, and the text without the words that a run holds after its first period, words joined by one space.

    Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, in the order of
    their UTF-8 bytes. Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or repeated; rows
    that are wholly alike get the same answers; an empty table gives no rows; other columns are ignored.

    Nothing is shuffled. A worker holds the words of one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, where, kept = [], [], []
            for text in batch.column("text"):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                found = text_runs(words, least, exponent)
                size.append(len(words))
                where.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(b" ".join(collapsed(words, found)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(where, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """docs with repeats in the texts of a tenth of them, told by the checksum h of the id: of n words, those from a = h/10 mod n on
    repeat with period 1 + (n-a) / (3 + h/10 mod 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", F.size("words"))
    a = F.col("g") % F.col("n")
    rest = F.col("n") - a
    p = F.lit(1) + F.floor(rest / (F.lit(3) + F.col("g") % 8))
    whole = lambda x: x.cast("int")
    head, period = F.slice("words", F.lit(1), whole(a)), F.slice("words", whole(a + 1), whole(p))
    tail = F.slice(F.flatten(F.array_repeat(period, whole(F.ceil(rest / p)))), F.lit(1), whole(rest))
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """periodic_runs() with the longest run (ties: smallest start, then period) in columns and digests of runs and collapsed text."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
    milli = F.expr("(1000 * best.length) div (-best.q)")
    return out.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
