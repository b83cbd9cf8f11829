"""Exact, near and substring deduplication, and mixing, against brute force, with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import exact_dedup, jaccard_join, mixing
from lexiloom.llm.common import components
from lexiloom.llm.suffix_dedup import deep_shallow, suffix_dedup

SCHEMA = "doc_id long, text string, cls string, token long, n long, size long, source string"
random.seed(5)
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(random.choice(WORDS) for _ in range(120))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(WORDS) + "x"
    return " ".join(words)


def _odd_rows():
    texts = [None, "", "  \t\n", "a", "A", "a b c d", "A  b\tc d", "a b c d e", "word " * 400, BASE, BASE.upper(), BASE + " ", "ü é   x y z", "x\u0000y", " ".join(WORDS * 60)]
    texts += [edited(BASE, k % 5) for k in range(40)]
    texts += [BASE[:300] + " ".join(random.choice(WORDS) for _ in range(80)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, BASE), (None, "alone in here is this text"), (3, "a"), (9, BASE), (9, "other text under the same id again")]
    return [(i, t, "cls", 1, 2, 3, (None if k % 7 == 0 else f"s{k % 3}")) for k, (i, t) in enumerate(rows)]


ODD = _odd_rows()


def odd_rows():
    return ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for i, t in members:
            out.append((i, keep[0], len(members), i == keep[0] and len(t) == len(keep[1]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_odd_rows(docs):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert collected(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def test_exact_dedup_frequent_route(docs):
    """A sketch of one counter still gives the same answers."""
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert collected(exact_dedup.exact_dedup(docs, frequent=1, tracked=8), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute_exact(rows)


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((part[a], part[b]))
                part = [lo if p == hi else p for p in part]
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(least.get(part[k], i), i)
    return sorted(((i, len(sets[k]), least.get(part[k])) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_odd_rows(docs):
    assert collected(jaccard_join.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == brute_groups([(r[0], r[1]) for r in odd_rows()])


def test_jaccard_large_family(spark):
    """A family over several blocks, with stragglers, against all pairs."""
    random.seed(9)
    rows = [(k, edited(BASE, random.choice([0, 1, 2, 3, 5, 8]))) for k in range(620)]
    got = collected(jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(rows)


def test_jaccard_families_share_ids(spark):
    """Two families of near copies, and strangers, under one id or none: each text has its own links, in any order of rows."""
    random.seed(11)
    bases = [" ".join(random.choice(WORDS) + random.choice("abc") for _ in range(120)) for _ in range(2)]
    rows = [(i, edited(base, k)) for k in range(1, 4) for i in (7, None) for base in bases]
    rows += [(20 + f, base) for f, base in enumerate(bases)] + [(i, " ".join(random.choice(WORDS) + "z" for _ in range(90))) for i in (7, None, 7, None)]
    rows += [rows[0], rows[2], rows[2]]
    want = brute_groups(rows)
    assert len({c for *_, c in want}) > 1
    for order in (rows, rows[::-1]):
        got = jaccard_join.jaccard_groups(spark.createDataFrame(order, "doc_id long, text string").repartition(3))
        assert collected(got, "doc_id", "n_shingles", "component_id") == want


def test_jaccard_class_texts_are_single(spark):
    """As many texts as classes, however many rows share an id."""
    rows = jaccard_join._owned(spark.createDataFrame([(None, f"text number {k % 9}") for k in range(30)], "doc_id long, text string"), "doc_id", "text")
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    classes = jaccard_join.shingle_classes(jaccard_join.signatures(rows, none))
    assert collected(jaccard_join.class_texts(rows, classes), "text") == [(f"text number {k}",) for k in range(9)]


def test_jaccard_few_ids_and_none(spark):
    """Rows under few ids or none, in every order, have the links of their own texts."""
    random.seed(21)
    bases = [" ".join(random.choice(WORDS) + random.choice("abcde") for _ in range(60)) for _ in range(12)]
    for ids in (lambda k: k % 25, lambda k: None):
        rows = [(ids(k), edited(random.choice(bases), random.choice([0, 1, 1, 2, 4]))) for k in range(180)]
        got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert collected(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows)


def test_jaccard_patterned_words(spark):
    """Words that are each other's complement, of any length, are different words."""
    rows = []
    for n in (64, 200, 1024, 4096):
        bits = [bin(k).count("1") & 1 for k in range(n)]
        rows += [(len(rows), "".join("ab"[b] for b in bits)), (len(rows) + 1, "".join("ba"[b] for b in bits))]
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collected(got, "doc_id", "component_id") == sorted(((i, i) for i, _ in rows), key=str)


def test_jaccard_names_apart(spark):
    """Sets whose names agree in 64 bits but not in 128 are different classes."""
    rows = [(k, 7, 5, k % 3, 4, [1], []) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, digest long, cls long, cls2 long, n long, toks array<long>, hot array<long>")
    prefixes, classes = jaccard_join.named_apart(df)
    assert classes.count() == 3 and prefixes.groupBy("cls").agg({"cls2": "min"}).count() == 3


def test_jaccard_blocks_ask_other_labels_only(spark, monkeypatch):
    """With small blocks, large families and bridges between them still give the components of all pairs; a family of copies of
    one text with small edits is not compared all against all."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "LARGE", 4)
    random.seed(31)
    other = edited(BASE, 9)
    rows = [(k, edited(random.choice([BASE, other]), random.choice([0, 1, 2, 3, 4, 5]))) for k in range(260)]
    dealt = []
    monkeypatch.setattr(jaccard_join, "_dealt", lambda table, *rest, real=jaccard_join._dealt: dealt.append(table.count()) or real(table, *rest))
    got = collected(jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(rows)
    near = [(k, edited(BASE, k % 3)) for k in range(260)]
    dealt.clear()
    got = collected(jaccard_join.jaccard_groups(spark.createDataFrame(near, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups(near) and sum(dealt) < 5 * len(near)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 5)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 4), (8, 4), (9, 4)}


def brute_suffix(rows):
    raw = [((t or "").encode(), i) for i, t in rows]
    seen = collections.Counter(b[s : s + 200] for b, _ in raw for s in range(len(b) - 199))
    out = []
    for b, i in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_odd_rows(docs, spark):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert collected(suffix_dedup(docs), *columns) == brute_suffix([(r[0], r[1]) for r in odd_rows()])
    random.seed(3)
    p = "".join(random.choice("ab ") for _ in range(450))
    rows = [(1, "x" * 1000), (2, None), (4, "abcd" * 100), (5, p), (6, p[100:350] + "zz" + p[10:260]), (7, "é" * 150), (8, "é" * 160), (None, p), (9, p), (9, p), (10, "q" * 199), (11, "q" * 200)]
    assert collected(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), *columns) == brute_suffix(rows)


def test_suffix_long_text_shared_line_and_alike_rows(spark):
    """A text over several pieces with repeats at their joint, a line in many surroundings, a passage in many documents, and many
    alike rows, against all windows."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passage, line = word(700), word(150)
    joint = (1 << 20) - 300
    long = word(joint) + passage + word(300_000) + passage[50:600] + word(500)
    rows = [(1, long), (2, word(300) + passage[:400] + word(100)), (3, long[joint - 1000 : joint + 900])]
    rows += [(10 + k, word(r.randrange(150, 400)) + line + word(r.randrange(150, 400))) for k in range(150)]
    rows += [(500 + k, word(60) + passage + word(60)) for k in range(60)]
    seen = collections.Counter(hash(t[s : s + 200]) for _, t in rows for s in range(len(t) - 199))  # all ASCII
    few = [(900, word(500))] * 300
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, np.int64)
        for s in range(len(t) - 199):
            if seen[hash(t[s : s + 200])] > 1:
                gone[s] += 1
                gone[s + 200] -= 1
        want.append((i, len(t), int((np.cumsum(gone[:-1]) > 0).sum())))
    got = suffix_dedup(spark.createDataFrame(rows + few, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed) for x in got if x.doc_id != 900) == sorted(want)
    assert [(x.n_removed, x.n_spans) for x in got if x.doc_id == 900] == [(500, 1)] * 300


def test_frequent_grams_are_last_choice():
    """Windows around a frequent line are anchored outside it, and equal windows still agree."""
    from lexiloom.llm import suffix_dedup as sd

    r = np.random.default_rng(1)
    line = r.integers(97, 123, 120).astype(np.uint8)
    texts = [np.concatenate([r.integers(97, 123, 300).astype(np.uint8), line, r.integers(97, 123, 300).astype(np.uint8)]) for _ in range(30)]
    plain = collections.Counter(h for t in texts for h in sd.anchors(t, np.array([0, len(t)]))[0].tolist())
    marks = np.zeros(1 << sd.FREQUENT_BITS, bool)
    marks[[h >> (64 - sd.FREQUENT_BITS) for h, c in plain.items() if c > 5]] = True
    assert marks.any()
    again = collections.Counter(h for t in texts for h in sd.anchors(t, np.array([0, len(t)]), frequent=marks)[0].tolist())
    assert all(again[h] < plain[h] for h in plain if plain[h] > 5)


def test_seen_contexts():
    from lexiloom.llm import suffix_dedup as sd

    seen, counts, r = sd._Seen(), collections.Counter(), np.random.default_rng(2)
    for _ in range(5):
        x = r.integers(0, 20, 50).astype(np.uint64)
        times = collections.Counter()
        want = []
        for v in x.tolist():
            want.append(min(2, counts[v]) + times[v])
            times[v] += 1
        counts.update(times)
        assert seen.before(x, x + np.uint64(1), x).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 59), min_size=0, max_size=6), st.integers(0, 2**32))
def test_deep_shallow_sorts(changes, seed):
    r = np.random.default_rng(seed)
    base = r.integers(97, 99, 60).astype(np.uint8)
    parts = [base]
    for c in changes:
        x = base.copy()
        x[c] = r.integers(97, 103)
        parts.append(x)
    data = np.concatenate([*parts, r.integers(97, 99, 50).astype(np.uint8)])
    starts = r.choice(len(data) - 40, size=min(len(data) - 40, 90), replace=False)
    bucket = r.integers(0, 3, len(starts))
    order, twin = deep_shallow(data, starts, bucket, length=40, shallow=16)
    strings = [(int(b), data[s : s + 40].tobytes()) for s, b in zip(starts, bucket)]
    assert [strings[i] for i in order] == sorted(strings)
    counts = collections.Counter(strings)
    assert [counts[x] > 1 for x in strings] == twin.tolist()


def fill(sizes, weights=(3, 1, 2), share=1.5, copies=2):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(copies * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > copies * sizes[s]}
        if not over:
            return {s: copies * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mixing_odd_rows(docs):
    rows = odd_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[6]] += size(r[1])
    want = fill(sizes)
    got = mixing.mixed_sample(docs).collect()
    assert sorted(((r.doc_id, r["size"], r.source) for r in got), key=str) == sorted(((r[0], size(r[1]), r[6]) for r in rows), key=str)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6
    again = mixing.mixed_sample(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_pareto(rows, seed=17):
    """(doc_id, taken, probability) of rows (doc_id, text, source), by sorting each source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal, out = fill(sizes), []
    for s, total in sizes.items():
        whole = int(goal[s] // total) if total else 0
        due = goal[s] - whole * total
        docs = []
        for i, t, x in rows:
            if x == s:
                h = int(hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16)
                docs.append([size(t), (h + 0.5) / 2**52, h, i])
        certain = set()
        while True:  # the rate of inclusion in proportion to size, the largest documents certain
            open_ = [d for d in docs if d[0] and d[0] not in certain]
            rate = (due - sum(d[0] for d in docs if d[0] in certain)) / sum(d[0] ** 2 for d in open_) if open_ else 0
            if not open_ or rate * max(d[0] for d in open_) <= 1:
                break
            certain.add(max(d[0] for d in open_))
        rest = due - sum(d[0] for d in docs if d[0] in certain)
        p = lambda n: rate * n
        odds = lambda d: 0 if p(d[0]) >= 1 else d[1] / (1 - d[1]) / (p(d[0]) / (1 - p(d[0])))
        before = 0
        for d in sorted((d for d in docs if p(d[0]) > 0 and d[0] not in certain), key=lambda d: (odds(d), d[2], d[3] is not None, d[3] or 0)):
            extra = before + d[0] / 2 <= rest
            before += d[0]
            out.append((d[3], (whole + extra) * d[0], p(d[0])))
        out += [(d[3], (whole + (d[0] in certain)) * d[0], 1.0 if d[0] in certain else 0.0) for d in docs if not p(d[0]) > 0 or d[0] in certain]
    return out


def test_mixing_is_a_pareto_sample(docs, spark, sf_dir):
    """The same documents as a sort of each source by odds, on odd rows and on the test table; targets are met to half a document."""
    got = sorted(((r.doc_id, r.taken) for r in mixing.mixed_sample(docs).collect()), key=str)
    assert got == sorted(((i, t) for i, t, _ in brute_pareto([(r[0], r[1], r[6]) for r in odd_rows()])), key=str)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    found = mixing.mixed_sample(table).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((i, t) for i, t, _ in brute_pareto(rows))
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for some in by.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r["size"] for r in some) / 2 + 1e-6


def test_mixing_probabilities():
    """Over 200 seeds documents are drawn about as often as their inclusion probabilities say, which differ within a source."""
    r = random.Random(6)
    rows = [(k, "w " * r.choice([3, 5, 8, 13, 21, 34]), "ab"[k % 2]) for k in range(120)]
    sizes = {i: len(t.split()) for i, t, _ in rows}
    drawn, chance = collections.Counter(), {}
    for seed in range(200):
        for i, taken, p in brute_pareto(rows, seed):
            drawn[i] += taken // sizes[i]
            chance[i] = p
    certain = {i: round(drawn[i] / 200 - chance[i]) for i in drawn}
    assert len({round(p, 6) for p in chance.values()}) > 4
    assert all(abs(drawn[i] / 200 - certain[i] - p) < 0.17 for i, p in chance.items())
    assert abs(sum(drawn.values()) / 200 - sum(chance[i] + certain[i] for i in chance)) < 1


def test_mixing_odds_and_alike_rows(spark):
    """Odds change the result; a sample that ends among rows wholly alike takes some of them; long texts and null sources count whole."""
    r = random.Random(7)
    rows = [(k, "w " * r.randrange(1, 60), None if k % 2 else "s") for k in range(300)] + [(900, "x y z", "t")] * 101 + [(901, "long " * 300_000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mixed_sample(df).collect()
    assert len(got) == len(rows) and sorted((x.doc_id, x.taken) for x in got if x.doc_id < 900) == sorted((i, t) for i, t, _ in brute_pareto(rows) if i < 900)
    alike = [x for x in got if x.doc_id == 900]
    assert len(alike) == 101 and abs(sum(x.taken for x in alike) - alike[0].target) <= 1.5
    some = mixing.mixed_sample(df.where("doc_id < 900"), share=1.2).where("source = 's'").collect()
    by_hash = sorted(some, key=lambda x: hashlib.md5(f"17:{x.doc_id}:{'w ' * x['size']}".encode()).hexdigest()[:13])
    extra = [x.n_copies for x in by_hash]
    assert set(extra) == {1, 2} and extra != sorted(extra, reverse=True)  # equal odds would take the smallest random numbers


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup.exact_dedup, jaccard_join.jaccard_groups, mixing.mixed_sample, suffix_dedup):
        assert f(empty).count() == 0


def test_all_null_texts(spark):
    nulls = spark.createDataFrame([(1, None), (2, None), (None, None)], "doc_id long, text string").selectExpr("*", "CAST(NULL AS string) AS source")
    assert exact_dedup.exact_dedup(nulls).where("kept").count() == 1
    assert jaccard_join.jaccard_groups(nulls).where("n_shingles = 0").count() == 3
    assert mixing.mixed_sample(nulls).where("taken = 0").count() == 3
    assert suffix_dedup(nulls).where("n_bytes = 0").count() == 3
