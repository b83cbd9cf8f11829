"""License scan, decontamination, language, tokens, chat and toxicity, with odd rows."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexiloom.llm import chat_format, decontamination, language_id, license_scan, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, score double, label int"
ODD = [(1, None, "en", 1.0, 1), (2, "", None, 1.0, 1), (3, "123 !!", "en", 1.0, 1), (None, "the house and the tree", "en", 1.0, 1), (5, "日本語のテキスト", None, 1.0, 1), (6, "word " * 50_000, "en", 1.0, 1), (6, "word " * 50_000, "en", 1.0, 1), (7, "\x00�", None, 1.0, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_tiles(a, b, least):
    used_a, used_b, out = [0] * len(a), [0] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and not used_a[i + n] and not used_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n and n == best:
                    found.append((i, j))
        if best < least:
            return sorted(out)
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [1] * best
                out.append((i, j, best))


def test_tiles_are_greedy():
    r = np.random.default_rng(0)
    for _ in range(150):
        a, b = r.integers(0, 3, r.integers(1, 18)).astype(np.uint64), r.integers(0, 3, r.integers(1, 30)).astype(np.uint64)
        assert decontamination.tiles(a, b, 3) == brute_tiles(a, b, 3)


def test_decontamination(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    half = item.split()
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(half[8:] + ["zz"] + half[:8])), (3, item.upper().replace(" ", "!! ")), (4, " ".join(half[:7])), (5, "nothing of it at all"), (6, None), (7, " ".join(half[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "tiny one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.matches(docs, bench).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 1.0, (3, 10): 1.0}
    assert decontamination.matches(odd, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    assert decontamination.matches(docs.limit(0), bench).count() == 0


def test_decontamination_blocks(spark, documents, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.matches(documents, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    assert sorted(map(tuple, decontamination.matches(documents, bench).collect())) == whole
    texts = {r.doc_id: r.text for r in documents.collect()}
    held = {(i, b.item_id) for b in bench.collect() for i, t in texts.items() if t and b.text in t}
    assert held <= {(r[0], r[1]) for r in whole}


def test_language_accuracy(documents, odd):
    langs = {r.doc_id: r.lang for r in documents.collect()}
    rows = language_id.language_id(documents).collect()
    assert len(rows) == len(langs)
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) / len(out) >= 0.95
    model = language_id.learned(documents)
    got = [(r.doc_id, r.lang_pred) for r in language_id.predicted(odd, model).collect()]
    assert [x for x in got if x[1] == "und"] == [(1, "und"), (2, "und"), (3, "und"), (7, "und")]
    # the filters know nothing of Japanese, so that the row goes
    assert [r.doc_id for r in language_id.identified(odd, model).collect()] == [None, 6, 6]
    assert language_id.predicted(odd, None).where("lang_pred = 'und'").count() == len(ODD)
    assert language_id.language_id(documents.limit(0)).count() == 0


def test_more_languages_than_bits(spark):
    """Every one of 70 languages is learned and told, also the rarest."""
    r = random.Random(8)
    vocabulary = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for _ in range(70)]
    rows = [(k * 10 + i, " ".join(r.choice(vocabulary[k]) for _ in range(40)), f"l{k:02}") for k in range(70) for i in range(2 + (k < 64))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang_pred for x in language_id.predicted(df, language_id.fit(df)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_bloom_finds_all_kept_grams():
    """A Bloom filter has no false negatives: an n-gram's mask holds every language that keeps it."""
    masks = np.zeros(language_id.SLOTS, np.uint64)
    grams = np.arange(1000, dtype=np.uint64)
    for s in language_id._slots(grams, language_id.SLOTS):
        np.bitwise_or.at(masks, s, np.uint64(1) << (grams % np.uint64(3)))
    a, b, c = language_id._slots(grams, language_id.SLOTS)
    assert ((masks[a] & masks[b] & masks[c]) >> (grams % np.uint64(3)) & np.uint64(1)).all()


ALPHABET = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "1", "22", "é", "!", "?!", " x", "ll", "\t", "日", "٣"]


def test_edits_equal_a_recount():
    c = token_counts.counter()
    random.seed(1)
    for t in range(400):
        tree = token_counts.TokenTree("".join(random.choice(ALPHABET) for _ in range(random.randint(0, 400 if t % 10 == 0 else 40))), c)
        for _ in range(random.randint(1, 6)):
            a = random.randint(0, len(tree.text))
            b = min(len(tree.text), a + random.randint(0, 5 if random.random() < 0.8 else 300))
            new = "".join(random.choice(ALPHABET) for _ in range(random.randint(0, 4)))
            want = tree.text[:a] + new + tree.text[b:]
            tree.replace(a, b, new)
            found = c.pattern.findall(want)
            assert tree.text == want and [n for block in tree.chars for n in block] == list(map(len, found))
            assert tree.n_tokens == len(c.encoding.encode_ordinary(want))


def test_small_edit_reencodes_little():
    c = token_counts.counter()
    tree = token_counts.TokenTree("some words here " * 5000, c)
    tree.replace(40_000, 40_004, "other")
    assert tree.reencoded < 10


def test_stretches(monkeypatch):
    c = token_counts.counter()
    monkeypatch.setattr(token_counts, "STRETCH", 20)
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(ALPHABET) for _ in range(random.randint(0, 200)))
        assert sum(sum(c.sizes(c.pattern.findall(x))) for x in token_counts._stretches(text, c.pattern)) == len(c.encoding.encode_ordinary(text))


def test_token_counts_odd_rows(spark, odd):
    c = token_counts.counter()
    want = [len(c.encoding.encode_ordinary(t or "")) for _, t, *_ in ODD]
    assert [r.n_tokens for r in token_counts.token_counts(odd).collect()] == want
    assert [r.n_tokens for r in token_counts.edited_counts(odd, token_counts.private_edits).collect()] == want
    rows = [(1, "mail a@b.org or 4111111111111111", [(5, 12, "X"), (None, 0, "start ")]), (2, None, [(0, 5, "hello")]), (3, "plain", None), (4, "cut", [(0, None, None)])]
    got = token_counts.edited_counts(spark.createDataFrame(rows, f"doc_id long, text string, e {token_counts.EDITS}"), "e").collect()
    assert [r.n_tokens_edited for r in got] == [len(c.encoding.encode_ordinary(x)) for x in ("start mail X or 4111111111111111", "hello", "plain", "")]
    assert token_counts.private_edits("call +1 (017) 555-5036 or 126.57.31.34") == [(26, 38, "[ip]"), (5, 22, "[phone]")]


def test_license_scan(spark, odd):
    rows = [(1, "prose\nLicensed under CC BY-NC 4.0.\nmore prose"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 2."), (4, "my driving licence was lost"), (5, "x\n" + license_scan.TEMPLATES[1][1].replace("free of charge", "at no cost")), (2, "Released under the MIT License."), (None, "All rights reserved.")]
    got = [(r.doc_id, r.block, r.license, r.n_missing) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, 1, "CC-BY-NC-4.0", 0), (2, 0, "MIT", 0), (3, 0, "GPL-2.0", 0), (5, 1, "MIT", 3), (2, 0, "MIT", 0), (None, 0, "proprietary", 0)]
    assert license_scan.license_scan(odd).count() == 0
    long = "copyright notice " * 3000 + " Licensed under the Apache License, Version 2.0. " + "copyright words " * 300
    assert "Apache-2.0" in {r.license for r in license_scan.license_scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()}


def test_license_notices_over_lines(spark):
    """Verbatim notices wrapped at 60 characters behind comment marks, and with cue words split by a line end."""
    rows, want = [], []
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        lines = textwrap.wrap(text, 60, break_long_words=False, break_on_hyphens=False)
        rows.append((k, "int x;\n\n" + "\n".join(" * " + x for x in lines) + "\n\nint y;"))
        want.append((k, 2, name, 0, 0))
    rows.append((50, "All rights\n# reserved.\nThis is free and unencumbered software released into the public\ndomain."))
    want += [(50, 0, "proprietary", 0, 0), (50, 2, "Unlicense", 0, 0)]
    got = [(r.doc_id, r.block, r.license, r.n_missing, r.n_added) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == want


def test_license_notices_in_long_lines(documents):
    """Every short notice is found in a long line of prose, also with a word changed, and next to others."""
    scanner = license_scan.Scanner()
    prose = [w for r in documents.where("lang = 'en'").select("text").collect() for w in (r.text or "").split() if not license_scan.words(w) or license_scan.words(w)[0].isalpha()]
    prose = [w for w in prose if not any(c in w.lower() for c in ("licen", "reserved", "copyright"))]
    r = random.Random(1)
    for name, text in license_scan.TEMPLATES:
        for _ in range(3):
            at = r.randrange(len(prose) - 400)
            line = " ".join([*prose[at : at + 200], text, *prose[at + 200 : at + 400]])
            assert [(n[1], n[4]) for n in scanner.notices(line) if n[4] == 0] == [(name, 0)]
    line = " ".join([*prose[:300], "Licenced under CC BY-SA 4.0.", *prose[300:600]])
    assert [(n[1], n[4], n[5], n[6]) for n in scanner.notices(line)] == [("CC-BY-SA-4.0", 1, 0, "-licensed")]
    both = "Licensed under CC BY 4.0.\nReleased under the MIT License. All rights reserved.\n" + "copyright words " * 4000 + "All rights reserved."
    assert [(n[0], n[1]) for n in scanner.notices(both)] == [(0, "CC-BY-4.0"), (1, "MIT"), (1, "proprietary"), (2, "proprietary")]


def test_license_versions_and_denials():
    """Another version or name, or a denial, is not a template's notice; alike names side by side are told apart."""
    scanner = license_scan.Scanner()
    said = lambda text: [n[1] for n in scanner.notices(text)]
    assert said("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    long = license_scan.TEMPLATES[5][1]
    for text in ("This work is licensed under the GNU General Public License, version 1.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 3.0.", "Licensed under CC BY-NC-SA 4.0.", "This is not licensed under the MIT License.", "It was never released under the MIT License.", "This work is licensed under the GNU Lesser General Public License, version 2.", long.replace("version 3", "version 1")):
        assert said(text) == [], text
    assert said("Do not worry. Released under the MIT License.") == ["MIT"]
    assert said(long.replace("version 3", "version 2")) == ["GPL-2.0"] and said(long) == ["GPL-3.0"]
    for name, text in license_scan.TEMPLATES:
        assert said(text) == [name] and said("Intro words here; " + text.upper()) == [name]


def test_license_short_forms_and_more_denials():
    scanner = license_scan.Scanner()
    said = lambda text: [n[1] for n in scanner.notices(text)]
    forms = [("SPDX-License-Identifier: MIT", "MIT"), ("This project is MIT licensed.", "MIT"), ("This project is licensed under the MIT License.", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Licensed under the BSD 3-Clause License.", "BSD")]
    forms += [("License: GPLv3", "GPL-3.0"), ("Licensed under the GNU GPL v3", "GPL-3.0"), ("Licensed under CC-BY-4.0.", "CC-BY-4.0"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0")]
    for text, name in forms:
        assert said(text) == [name] and said(f"// {text}\nint main;") == [name], text
    for text in ("This is no longer released under the MIT License.", "No rights reserved. All rights reserved by nobody without notice.".replace("All rights reserved", "No rights reserved"), "Released without the MIT License."):
        assert said(text) == [], text


def test_license_savings_decide(documents):
    """Winners are those that save most: with equal savings for all, or none, answers change; planted notices are found."""
    scanner = license_scan.Scanner()
    r = random.Random(4)
    prose = [w for x in documents.where("lang = 'en'").select("text").collect() for w in (x.text or "").split() if license_scan.CUES.isdisjoint(license_scan.words(w))]
    texts, found = [], 0
    for k in range(3 * len(license_scan.TEMPLATES)):
        name, text = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        at, w = r.randrange(len(prose) - 300), text.split()
        if len(w) > 12 and k >= len(license_scan.TEMPLATES):
            w[1] = "changed"
        texts.append((" ".join([*prose[at : at + 150], *w, *prose[at + 150 : at + 300]]), name))
    right = [[n[1] for n in scanner.notices(t)] for t, _ in texts]
    found = sum(a == [name] for a, (_, name) in zip(right, texts, strict=True))
    assert found >= 0.95 * len(texts), [(a, n) for a, (_, n) in zip(right, texts, strict=True) if a != [n]]
    for constant in (0, 1000):
        same = license_scan.Scanner()
        same.savings = lambda own, some, v=constant: [v] * len(some)
        assert [[n[1:3] for n in same.notices(t)] for t, _ in texts] != [[n[1:3] for n in scanner.notices(t)] for t, _ in texts]
    assert [n for t, _ in texts for n in (lambda s: setattr(s, "savings", lambda own, some: [0] * len(some)) or s)(license_scan.Scanner()).notices(t)] == []


def test_license_scan_empty(spark):
    assert license_scan.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_counts_are_popcounts():
    """Scores are the corrected counts of n-grams whose slots all have a language's bit, counted one by one."""
    r = np.random.default_rng(3)
    f = language_id.Filters([f"l{k}" for k in range(70)], r.integers(0, 2**63, (2, 256), dtype=np.uint64), np.full(70, 0.2), 256)
    texts = ["some words of text", "a", "", "é ü 12", "more words, and more of them " * 5]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    best, score, evidence = language_id.scored(np.frombuffer(b"".join(data), np.uint8), offsets, f)
    for i, raw in enumerate(data):
        low = bytes(int(language_id._FOLD[c]) for c in raw)
        grams = [low[k : k + n] for n in language_id.LENGTHS for k in range(len(low) - n + 1) if low[k : k + n].strip(b" ")]
        hits = np.zeros(70)
        for g in grams:
            key = np.array([int.from_bytes(g, "big") | len(g) << 56], np.uint64)
            at = [int(s[0]) for s in language_id._slots(key, 256)]
            for k in range(70):
                hits[k] += all(int(f.masks[k // 64][s]) >> (k % 64) & 1 for s in at)
        real = np.clip((hits - len(grams) * 0.2) / 0.8, 0, None)
        if real.sum():
            assert best[i] == real.argmax() and abs(score[i] - real.max() / real.sum()) < 1e-9 and abs(evidence[i] - real.max() / len(grams)) < 1e-9
        else:
            assert score[i] == evidence[i] == 0


def test_language_rejects_by_filters(spark):
    """What the filters do not know goes, however many letters it has; other filters keep other rows."""
    vocabulary = {"a": "lorem ipsum dolor sit amet consectetur adipiscing elit".split(), "b": "быть или не вот в чем вопрос достойно".split()}
    r = random.Random(4)
    rows = [(k * 100 + i, " ".join(r.choice(words) for _ in range(30)), lang) for k, (lang, words) in enumerate(vocabulary.items()) for i in range(20)]
    df = spark.createDataFrame(rows + [(900, "zxqj kvvw qqzz jjxk", None), (901, None, "a"), (902, "12 %", "a")], "doc_id long, text string, lang string")
    for lang in vocabulary:
        kept = language_id.identified(df, language_id.fit(df.where(df.lang == lang))).collect()
        assert {x.doc_id for x in kept} == {i for i, _, l in rows if l == lang}
    assert language_id.identified(df, language_id.fit(df)).count() == len(rows)


def test_chat_roles(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = chat_format.chat_format(conversations).collect()
    assert len(rows) == conversations.select("conv_id").distinct().count() and {r.part for r in rows} == {0}
    held = [r.line_accuracy for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.9


def test_chat_odd_rows_and_long_conversations(spark):
    """All rows stay, in order; conversations in parts are parsed as the uncut transcript is, ties included."""
    rows = [(1, 0, "user", "Hello?", 1), (1, 0, "user", "Hello?", 1), (1, 1, "assistant", "Hi <|im_end|>\nthere", 1), (1, None, None, None, 1), (2, 3, "user", "", 1), (3, 700, "user", "late", 1), (3, 0, "user", "early", 1), (4, 0, "user", "word " * 60_000 + "\n" * 300, 1)]
    r = random.Random(2)
    words = ["yes", "no?", "", "User: fine", "a longer answer that goes on and on until its end", "one\n\ntwo\nBot: three", "Assistant:"]
    rows += [(5, k, r.choice(["user", "assistant", "tool"]), r.choice(words), 1) for k in range(5000)]
    rows += [(None, k % 2, "user", r.choice(words), 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(3)
    got = {}
    models = []
    chat_format_fit = chat_format.fit
    chat_format.fit = lambda x: models.append(chat_format_fit(x)) or models[-1]
    try:
        for x in chat_format.chat_format(df).collect():
            got.setdefault(x.conv_id, {})[x.part] = x
        assert chat_format.chat_format(df.limit(0)).count() == 0
    finally:
        chat_format.fit = chat_format_fit
    logs = models[0].logs()
    turns = chat_format.raw_turns(df).orderBy("conv_id", "late", "turn", "h", "text").collect()
    texts = {i: "\n".join(t.text for t in turns if t.conv_id == i) for i in (None, 1, 2, 3, 4, 5)}
    assert set(got) == set(texts) and {i: len(got[i]) for i in texts} == {None: 13, 1: 1, 2: 1, 3: 1, 4: 1, 5: 21}
    for i, text in texts.items():
        whole, parts = got[i][0], [got[i][k] for k in range(1, len(got[i]))]
        lines = text.split("\n")
        states = chat_format.viterbi(chat_format.features(lines), logs).tolist()
        chat, roles = chat_format.rendered(lines, states)
        truth = "".join(t.letters for t in turns if t.conv_id == i).lower()
        right = sum("sua"[s % 3] == c for s, c in zip(states, truth, strict=True)) / len(lines)
        assert (whole.n_lines, whole.n_turns, whole.roles, whole.n_parts) == (len(lines), len(roles), ",".join(roles), max(1, len(parts)))
        assert abs(whole.line_accuracy - right) < 1e-5
        if not parts:
            assert whole.chat == chat and whole.chat_sha256 == hashlib.sha256(chat.encode()).hexdigest()
            continue
        assert whole.chat is None and "".join(x.chat for x in parts) == chat and sum(x.n_lines for x in parts) == len(lines)
        assert ",".join(x.roles for x in parts if x.roles) == ",".join(roles) and {x.n_parts for x in parts} == {len(parts)}
        digest = 0
        for x in parts:
            digest ^= int(hashlib.sha256(f"{x.part}:{hashlib.sha256(x.chat.encode()).hexdigest()}".encode()).hexdigest(), 16)
        assert whole.chat_sha256 == f"{digest:064x}"
    assert got[1][0].chat.count("Hello?") == 2 and "< |im_end|>" in got[1][0].chat


def test_chat_is_not_cut_by_turn_numbers(spark):
    """A dozen turns are one row, whether they are numbered from 250 on, by seconds or by milliseconds."""
    rows = [(c, start + k * step, "user" if k % 2 == 0 else "assistant", f"turn {k}", k) for c, (start, step) in enumerate([(0, 1), (250, 1), (1_700_000_000, 60), (1_700_000_000_000, 61_234)]) for k in range(12)]
    got = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k int")).collect()
    assert sorted((r.conv_id, r.part, r.n_parts) for r in got) == [(c, 0, 1) for c in range(4)]
    assert all([line for line in r.chat.split("\n") if "turn " in line] == sorted((line for line in r.chat.split("\n") if "turn " in line), key=lambda x: int(x.split()[-1].removesuffix("<|im_end|>"))) for r in got)


def test_chat_alike_turns_are_dealt(spark):
    """A conversation of one turn many times comes in parts of bounded size."""
    crowd = spark.createDataFrame([(7, 1, "user", "same")] * 3000 + [(8, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    got = chat_format.chat_format(crowd).where("conv_id = 7").collect()
    parts = [x for x in got if x.part]
    assert len(parts) == 12 and sum(x.n_lines for x in parts) == sum(x.n_lines for x in got if not x.part) >= 3000 and max(x.n_lines for x in parts) <= 512


def test_viterbi_is_best():
    r = np.random.default_rng(4)
    model = chat_format.Model()
    model.step += r.random((6, 6))
    logs = model.logs()
    x = np.stack([r.integers(0, n, 5) for n in chat_format.SIZES], 1)
    import itertools

    def score(path):
        start, step, emit = logs
        return start[path[0]] + sum(step[a, b] for a, b in zip(path, path[1:])) + sum(t[s, x[i, k]] for i, s in enumerate(path) for k, t in enumerate(emit))

    best = max(score(p) for p in itertools.product(range(6), repeat=5))
    assert score(chat_format.viterbi(x, logs).tolist()) == best


def test_toxicity(spark, documents, odd, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels.groupBy("doc_id").agg({"toxic": "max"}), "doc_id").collect()
    said, right = [r for r in rows if r.predicted], [r for r in rows if r["max(toxic)"]]
    assert sum(r["max(toxic)"] for r in said) / len(said) >= 0.9
    assert sum(r.predicted for r in right) / len(right) >= 0.5
    take = toxicity.F.lit(True)
    model = toxicity.fit(docs, labels, take)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and not got[0].predicted
    untrained = toxicity.fit(docs.limit(0), labels.limit(0), take)
    assert toxicity.scored(odd, untrained).where("predicted = 1").count() == 0


def test_toxicity_repeated_ids(spark, sf_dir, monkeypatch):
    """A labelled id on many rows gives one row to learn from; repeated and null ids, and empty tables, are scored row by row."""
    docs = spark.createDataFrame([(1, f"text number {k} you idiot") for k in range(3000)] + [(2, "all is well"), (None, "no id"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.learning_rows(docs, labels, "doc_id", "text", toxicity.F.lit(True)).count() == 2
    assert toxicity.toxicity(docs, labels).count() == 3003
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pattern_voters():
    voters = toxicity.Voters(np.full(toxicity.BUCKETS, -1, np.int16), np.full(toxicity.BUCKETS, -1, np.int16), np.zeros(toxicity.BUCKETS, bool), np.sort(np.array([toxicity.bucket_of(a) << 20 | toxicity.bucket_of(b) for a, b in (("shut", "up"), ("te", "odio"))])), len(toxicity.LEXICONS) + 3)
    voters.lexicon[[toxicity.bucket_of("idiot"), toxicity.bucket_of("trash")]] = 0
    voters.address[toxicity.bucket_of("you")] = True
    texts = ["You are an IDIOT", "idiot, trash", "you go far away from the idiot", "please shut up now", "shut", "up you", "Te odio"]
    data = [t.encode() for t in texts]
    hits, _ = toxicity._counts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]), voters)
    at = len(toxicity.LEXICONS)
    assert hits[:, at : at + 3].tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0], [0, 0, 1]]


def test_labelled_rows_vote_once(spark, sf_dir, monkeypatch):
    """The labelled rows and the rows elsewhere are together all rows to learn from, and no more."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen = {}
    made, patterns = toxicity.label_model, toxicity.vote_patterns
    monkeypatch.setattr(toxicity, "label_model", lambda votes, known, more: seen.update(votes=votes, known=known) or made(votes, known, more))

    def counted(*x):
        found = patterns(*x)
        seen["elsewhere"] = [tuple(r) for r in found.collect()]
        return found

    monkeypatch.setattr(toxicity, "vote_patterns", counted)
    take = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    voters, _ = toxicity.fit(docs, labels, take)
    rows = docs.where(take).where("text IS NOT NULL").select("text")
    every = {bytes(v): n for v, n in patterns(rows, voters).collect()}
    mine = {}
    for v in np.packbits(seen["votes"].astype(np.uint8), axis=1):
        mine[v.tobytes()] = mine.get(v.tobytes(), 0) + 1
    assert len(seen["known"]) == labels.where(take).where("toxic IS NOT NULL").select("doc_id").distinct().join(docs.where("text IS NOT NULL"), "doc_id").select("doc_id").distinct().count()
    for v, n in seen["elsewhere"]:
        mine[bytes(v)] = mine.get(bytes(v), 0) + n
    assert mine == every and sum(every.values()) == rows.count()


def test_label_model_counts_patterns_elsewhere(spark):
    """Rows that come as patterns from a table count as they do in memory."""
    r = np.random.default_rng(1)
    x = (r.random((600, 5)) < np.where(r.random(600)[:, None] < 0.3, 0.7, 0.1)).astype(bool)
    known = np.concatenate([r.integers(0, 2, 200), np.full(400, -1)])
    found, n = np.unique(np.packbits(x[200:], axis=1), axis=0, return_counts=True)
    patterns = spark.createDataFrame([(bytearray(v.tobytes()), int(c)) for v, c in zip(found, n)], "votes binary, n long").repartition(3)
    q = toxicity.label_model(x[:200], known[:200], toxicity._elsewhere(patterns, 5))
    first = toxicity._posteriors(x[200:].astype(float), None, None)
    assert np.allclose(toxicity._posteriors(x[200:].astype(float), known[200:], None), first)
    assert np.allclose(q, toxicity.label_model(x, known)[:200], atol=1e-6)


def test_label_model_finds_good_voters():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    good = (r.random((4000, 4)) < np.where(y[:, None], 0.6, 0.02)).astype(bool)
    noise = r.random((4000, 4)) < 0.1
    noise[:, 1:] = noise[:, :1]  # a family that always speaks together
    known = np.where(r.random(4000) < 0.3, y.astype(int), -1)
    q = toxicity.label_model(np.hstack([good, noise]), known)
    assert ((q > 0.5) == y).mean() > 0.95
