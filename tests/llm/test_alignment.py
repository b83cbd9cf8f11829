"""Token groups against both tokenizers run over whole texts, counts against loops."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexiloom.llm import alignment, queries
from lexiloom.llm.alignment import VOCABULARY_A, VOCABULARY_B, aligned, alignment_counts


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY_B)
    alphabet = alignment.byte_alphabet()
    vocabulary = {k: bytes(alphabet[c] for c in x) for x, k in a.get_vocab().items() if all(c in alphabet for c in x)}

    def groups(text):
        """Groups of ids by the offsets at which tokens of both end, whole texts at once."""
        if not text:
            return []
        raw = (" " + text).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        piece = lambda x: bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") else x.replace("▁", " ").encode()
        spelled = [vocabulary[k] for k in ids[0]], [piece(b.id_to_piece(k)) for k in ids[1]]
        if b"".join(spelled[0]) != raw or b"".join(spelled[1]) != raw:
            return []
        ends = []
        for x in spelled:
            at, out = 0, []
            for token in x:
                at += len(token)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last = [0, 0]
        found = []
        for cut in cuts:
            now = [ends[s].index(cut, last[s]) + 1 for s in (0, 1)]
            found.append(tuple(ids[s][last[s] : now[s]] for s in (0, 1)))
            last = now
        return found

    return groups


def text_of(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def expected(rows, groups):
    held = [(i, groups(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in held]
    count = Counter(p for one in links for p in one)
    best = {}
    for (x, _), c in count.items():
        best[x] = max(c, best.get(x, 0))
    out = []
    for (i, g), one in zip(held, links, strict=True):
        digest = hashlib.sha256(text_of(g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()), sum(n for p, n in one.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in one.items()), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (None, "alike"), (None, "alike"), (1, None), (2, ""), (3, " "), (4, "  two  spaces \t\n\n tabs \r\n x"), (5, "日本語 текст नमस्ते 😀🏽 é e\u0301"), (6, "a▁b c"), (6, "plain again"),
    (7, "<|endoftext|> <s> </s> <unk> <0x41> <pad>"), (8, "zero\x00 byte \x1c \x85 \xa0 \u2003 \u3000x"), (9, "don't we'll I'M 12345678901234567890 ---- ===="), (10, "\ufeffbom \u200b zero width"), (11, "x \n y \n\n z\n \n w"),
    (12, "ﬁ ligature Å ½ Ⅷ"), (13, "-" * 3000), (14, "ab" * 4000), (15, " leading and trailing "), (16, "\n"), (17, "tab\tonly\there"), (18, "a \u2003b"), (19, "\x1c \x1c x"),
]


def test_odd_texts(spark, both):
    docs = spark.createDataFrame([(i, t, 5) for i, t in ODD], "doc_id long, text string, pairs int")
    got = {(r["doc_id"], r["groups"]) for r in aligned(docs).collect()}
    assert got == {(i, text_of(both(t))) for i, t in ODD}
    assert sorted((tuple(r) for r in alignment_counts(docs).select(COLUMNS).collect()), key=str) == expected(ODD, both)
    assert alignment_counts(docs.where("false")).count() == 0


def test_query_against_loops(spark, sf_dir, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_token_alignment(spark, sf_dir).select(COLUMNS).collect()), key=str) == expected(rows, both)


@pytest.mark.parametrize("frequent", [0, 1, 300])
def test_rare_pairs_are_joined(spark, sf_dir, both, frequent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in alignment_counts(docs, frequent=frequent).select(COLUMNS).collect()), key=str) == expected(rows, both)


def test_long_texts_and_forgetting(spark, both, monkeypatch):
    a, b = (open(p, "rb").read() for p in (VOCABULARY_A, VOCABULARY_B))
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    monkeypatch.setattr(alignment, "MANY_LINKS", 3)
    held = alignment.Aligner(a, b)
    assert held.cuts
    texts = ["one two three four five six seven", "", "one two " * 20_000 + "end", "日本" * 2000, "two\u2581 x"]
    for _ in range(2):
        for text, (sums, groups, pairs, times) in zip(texts, held.texts(texts), strict=True):
            want = both(text)
            links = Counter(x * held.n_b + y for i, j in want for x in i for y in j)
            assert groups == text_of(want) and sums == (sum(len(i) for i, _ in want), sum(len(j) for _, j in want), len(want), sum(links.values()))
            assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == links


def test_texts_are_not_cut_where_pieces_go_over_spaces(both):
    a, b = (open(p, "rb").read() for p in (VOCABULARY_A, VOCABULARY_B))
    held = alignment.Aligner(a, b)
    held.cuts = False
    text = "Words that go on, and on; and \n on"
    assert held.words(text) == [text]
    assert next(iter(held.texts([text])))[1] == text_of(both(text))


@pytest.mark.parametrize("text", [" x\ty", "x\ty ", "a  b\tc", " OPEN\n4\u5c5e", "a  b c\u2028d", "  two\n\nlines\tx "])
def test_other_white_space_does_not_make_up_for_empty_words(both, text):
    held = alignment.Aligner(*(open(p, "rb").read() for p in (VOCABULARY_A, VOCABULARY_B)))
    want = both(text)
    assert want
    assert next(iter(held.texts([text])))[1] == text_of(want)
