"""Periodic runs against their definition: Lyndon arrays by comparing suffixes, runs by trying all periods."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import queries
from lexiloom.llm.periodic_runs import collapsed, left_extensions, lyndon_array, periodic_runs, planted, run_digests, runs, text_runs


def brute_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_lyndon(w, falling):
    """Next smaller suffixes and shared letters; the end is smaller than any letter."""
    key = lambda i: [-ord(c) if falling else ord(c) for c in w[i:]]
    nss, lce = [], []
    for i in range(len(w)):
        j = next((j for j in range(i + 1, len(w)) if key(j) < key(i)), len(w))
        m = 0
        while j + m < len(w) and w[i + m] == w[j + m]:
            m += 1
        nss.append(j)
        lce.append(m)
    return nss, lce


def words_like(rng):
    letters = "abcd"[: rng.choice([1, 2, 2, 3, 4])]
    n = rng.randint(0, rng.choice([8, 20, 60]))
    w = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        unit = w[: rng.randint(1, 7)]
        w = (unit * n)[:n]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(n)] = rng.choice(letters)
    return w


def test_arrays_and_runs_against_definition():
    rng = random.Random(11)
    for _ in range(4000):
        w = words_like(rng)
        for falling in (False, True):
            nss, lce = lyndon_array(w, falling)
            assert (nss, lce) == brute_lyndon(w, falling)
            for k, (m, r) in enumerate(zip(left_extensions(w, nss, lce), nss, strict=True)):
                assert w[k - m : k] == w[r - m : r] and (k == m or w[k - m - 1] != w[r - m - 1])
        assert runs(w) == brute_runs(w, 2, 2)
        for least, exponent in ((6, 4), (1, 3)):
            assert runs(w, least, exponent) == text_runs(w, least, exponent) == brute_runs(w, least, exponent)


class Letter:
    """A letter that counts how often it is compared."""

    asked = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Letter.asked += 1
        return self.v == other.v

    def __lt__(self, other):
        Letter.asked += 1
        return self.v < other.v

    __hash__ = None


def test_comparisons_grow_with_the_text():
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    rng = random.Random(3)
    for w in (b, "a" * 20_000, "ab" * 10_000, "aab" * 5_000 + "c" + "aab" * 5_000, [rng.choice("ab") for _ in range(20_000)]):
        Letter.asked = 0
        runs([Letter(c) for c in w])
        assert Letter.asked < 12 * len(w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_collapsed_drops_what_runs_repeat(w):
    found = brute_runs(w, 6, 4)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    assert collapsed(w, found) == [x for i, x in enumerate(w) if i not in gone]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 6, 4)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf_dir):
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 900}
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).select(COLUMNS).collect()}
    assert len(got) >= len(want) > 100
    assert all(got[k] == v for k, v in want.items())
    assert sum(v[1] for v in got.values()) > 20


def test_odd_rows(spark):
    long = " ".join(["x y z"] * 30_000 + [str(k) for k in range(20_000)] + ["q"] * 20_000)
    rows = [(None, "a a a a a a", 1), (1, None, 2), (2, "", 3), (3, " \t\n ", 4), (4, "a\x0ba\x0ca\ra\ta a", 5), (4, "a\x0ba\x0ca\ra\ta a", 5), (5, "é é é é é é ü", 6), (6, "\xa0 \xa0 \xa0 \xa0 \xa0 \xa0", 7), (7, long, 8), (8, "a a a a a", 9), (10, "b a b a b a b a", 1), (11, "one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((tuple(r) for r in run_digests(periodic_runs(planted(docs))).select(COLUMNS).collect()), key=str)
    want = [expected(i, t) for i, t, _ in rows if i != 7]
    assert [r for r in got if r[0] != 7] == sorted(want, key=str)
    assert next(r for r in got if r[0] == 7)[1:6] == (2, 0, 90_000, 3, 30_000_000)
    out = periodic_runs(docs).where("doc_id = 4").first()
    assert (out["n_words"], [tuple(r) for r in out["runs"]], out["collapsed"]) == (6, [(0, 6, 1)], "a")
    assert run_digests(periodic_runs(planted(docs.where("false")))).count() == 0


@pytest.mark.parametrize("least,exponent", [(2, 2), (5, 3)])
def test_other_thresholds(spark, least, exponent):
    rng = random.Random(least)
    texts = [" ".join(words_like(rng)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in periodic_runs(docs, least=least, exponent=exponent).collect():
        assert [tuple(x) for x in r["runs"]] == brute_runs(texts[r["doc_id"]].split(), least, exponent)
