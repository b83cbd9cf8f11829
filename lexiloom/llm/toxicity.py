"""Toxicity by weak supervision: word and pattern voters, a generative label model over them, a linear classifier on its posteriors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, bounded_batches, deleted, mixed, powers, prefix_hash, steps, word_spans, written

#: Labelled documents of either label that the classifier is fitted on at most; voters mined at most.
FIT_TOXIC, FIT_CLEAN, MINED = 4_000, 8_000, 96
#: Rounds of the label model at most, those after which correlations are estimated anew, and the change of rates that ends it.
ROUNDS, CORRELATED, SETTLED = 16, (3, 7), 1e-3
#: Vote patterns that a task of a round reads at least.
PATTERN_ROWS = 100_000
BUCKETS = 1 << 20
#: Bytes of a word that make its stems, besides the whole word (0).
STEMS = (0, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: Word lists: each is one voter.
LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid dumb imbecile dunce halfwit dimwit dullard fool brainless",
    "worth": "worthless pathetic loser losers useless hopeless failure nobody deadbeat",
    "disgust": "disgusting gross vile repulsive revolting filthy nasty sickening",
    "refuse": "trash garbage scum filth rubbish dirtbag scumbag lowlife",
    "mockery": "clown clowns joke freak weirdo buffoon laughable",
    "beasts": "pig pigs vermin rat rats cockroach swine parasite maggot",
    "threats": "kill hurt punch strangle hang burn die murder beat",
    "abuse": "bastard jerk creep ugly hate shut despise",
    "de": "idiot idioten dumm dummkopf trottel abschaum versager widerlich ekelhaft depp blöd müll",
    "fr": "idiot imbécile stupide crétin ordure minable dégoûtant nul abruti débile salaud raclure",
    "es": "idiota imbécil estúpido basura escoria patético asqueroso inútil tonto payaso",
}

#: Words that address somebody, and phrases, for the pattern voters: an addressed insult, two insults close by, a phrase.
ADDRESS = "you your youre ur du dein deine ihr tu toi vous votre usted eres tus"
PHRASES = "shut up;go die;drop dead;get lost;hate you;go away;nobody likes;kill yourself;hurt yourself;halt maul;ta gueule;ferme la;cállate ya;te odio"
PATTERNS, CLOSE = 3, 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Voters:
    """lexicon: a bucket's list by whole word, or -1; mined: a bucket's mined voter, or -1; address: whether a bucket addresses
    somebody; phrases: pairs of buckets, sorted; count of all voters: lists, patterns, mined ones."""

    lexicon: np.ndarray
    mined: np.ndarray
    address: np.ndarray
    phrases: np.ndarray
    count: int


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ASCII and Latin-1 letters in lower case, starts, ends, document of each word); words are runs of letters."""
    low = FOLD[data]
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    low = np.where(lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + np.uint8(32), low).astype(np.uint8)
    starts, ends, firsts = word_spans(low, offsets, ~_LETTER)
    return low, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))


def _buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, their documents, stem length) for whole words, then for each stem length over the words that are as long."""
    p, inverse = prefix_hash(low), powers(len(low) + 1, True)
    for n in STEMS:
        s, e, o = (starts, ends, owner) if not n else (starts[w := ends - starts >= n], starts[w] + n, owner[w])
        h = mixed((p[e] - p[s]) * inverse[s] + np.uint64(n + 1))
        yield (h >> np.uint64(44)).astype(np.int64), o, n


def bucket_of(word: str) -> int:
    low, starts, ends, owner = _words(data := np.frombuffer(word.encode(), np.uint8), np.array([0, len(data)]))
    return int(next(_buckets(low, starts, ends, owner))[0][0])


def _patterns(bucket: np.ndarray, doc: np.ndarray, v: Voters) -> Iterator[np.ndarray]:
    """The documents of each pattern's hits: insults CLOSE behind an addressing word, insults CLOSE behind an insult, phrases."""
    insult = v.lexicon[bucket] >= 0
    for before in (v.address[bucket], insult):
        near = np.zeros(len(bucket), bool)
        for k in range(1, CLOSE + 1):
            near[k:] |= before[:-k] & (doc[k:] == doc[:-k])
        yield doc[insult & near]
    pair = (bucket[:-1] << 20 | bucket[1:])[doc[:-1] == doc[1:]]
    at = np.minimum(np.searchsorted(v.phrases, pair), len(v.phrases) - 1)
    yield doc[:-1][doc[:-1] == doc[1:]][v.phrases[at] == pair]


def _counts(data: np.ndarray, offsets: np.ndarray, v: Voters) -> tuple[np.ndarray, np.ndarray]:
    """(hits of each voter in each document, words of each document)."""
    docs = len(offsets) - 1
    low, starts, ends, owner = _words(data, offsets)
    hits = np.zeros(docs * v.count, np.int64)
    for bucket, doc, n in _buckets(low, starts, ends, owner):
        for table in (v.lexicon, v.mined) if not n else (v.mined,):
            voter = table[bucket]
            at = np.flatnonzero(voter >= 0)
            hits += np.bincount(doc[at] * v.count + voter[at], minlength=len(hits))
        if not n:
            for k, found in enumerate(_patterns(bucket, doc, v)):
                hits += np.bincount(found * v.count + len(LEXICONS) + k, minlength=len(hits))
    return hits.reshape(docs, v.count), np.bincount(owner, minlength=docs)


def _features(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each voter its hits on a log scale and their rate in 100 words."""
    rate = 100 * hits / np.maximum(words, 1)[:, None]
    return np.hstack([np.log1p(np.minimum(hits, 20)), np.minimum(rate, 5.0), np.ones((len(hits), 1))])


def _votes(hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A voter speaks up where it hits twice, or once in a short text, and in at least every 250th word."""
    return ((hits >= 2) | ((hits >= 1) & (words < 150)[:, None])) & (hits * 250 >= words[:, None])


def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, take: object) -> DataFrame:
    """(text, label) of the labelled rows that the models learn from, at most FIT_TOXIC and FIT_CLEAN of either label.

    Only ids for which the column take holds count, those of smallest hash; a document labelled twice is toxic if any label says
    so. An id gives one row: where it stands on several texts, the one of smallest hash.
    """
    marks = labels.where(take & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rank = F.xxhash64(F.lit(11), "doc_id")
    few = marks.where("label = 1").orderBy(rank, "doc_id").limit(FIT_TOXIC).unionByName(marks.where("label = 0").orderBy(rank, "doc_id").limit(FIT_CLEAN))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # `few` has at most FIT_TOXIC + FIT_CLEAN rows, and the result no more
    known = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("b"))
    return known.select("b.text", "b.label")


def mine(rows: DataFrame) -> Voters:
    """The word lists, and up to MINED stems that are far more frequent in toxic than in clean labelled rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch, "text", 1 << 18):
                labels = batch.column("label")[a:b].to_numpy()
                low, starts, ends, owner = _words(data, offsets)
                for bucket, doc, n in _buckets(low, starts, ends, owner):
                    key, c = np.unique(doc * BUCKETS + bucket, return_counts=True)
                    label, bucket = labels[key // BUCKETS], key % BUCKETS
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(label.astype(np.int32)), pa.array(np.full(len(c), n, np.int32)), pa.array(c.astype(np.int64))], ["bucket", "label", "n", "c"])

    part = lambda label, what: F.sum(F.when(F.col("label") == label, what).otherwise(0))
    sums = rows.where("label >= 0").mapInArrow(counted, "bucket long, label int, n int, c long").groupBy("bucket", "n").agg(part(1, F.col("c")).alias("toxic"), part(0, F.col("c")).alias("clean"), part(1, F.lit(1)).alias("docs"))
    totals = sums.where("n = 0").agg(F.sum("toxic"), F.sum("clean")).first()
    lexicon, mined, address = np.full(BUCKETS, -1, np.int16), np.full(BUCKETS, -1, np.int16), np.zeros(BUCKETS, bool)
    address[[bucket_of(x) for x in ADDRESS.split()]] = True
    phrases = np.sort(np.array([bucket_of(a) << 20 | bucket_of(b) for a, b in map(str.split, PHRASES.split(";"))]))
    for k, words in enumerate(LEXICONS.values()):
        for word in words.split():
            lexicon[bucket_of(word)] = k
    found = []
    if totals[0] and totals[1]:
        ratio = (F.col("toxic") + 0.5) / F.lit(float(totals[0])) / ((F.col("clean") + 0.5) / F.lit(float(totals[1])))
        found = sums.withColumn("ratio", ratio).where("docs >= 5 AND ratio >= 4").orderBy(F.desc(F.col("docs") * F.log("ratio")), "bucket").limit(MINED).select("bucket").collect()
    for k, row in enumerate(found):
        mined[row["bucket"]] = len(LEXICONS) + PATTERNS + k
    return Voters(lexicon, mined, address, phrases, len(LEXICONS) + PATTERNS + len(found))


def _posteriors(x: np.ndarray, known: np.ndarray | None, rates: tuple | None) -> np.ndarray:
    """Probabilities of being toxic of rows of votes, under the rates of a round, or a first guess."""
    if rates is None:
        guess = np.where(x.sum(1) >= 2, 0.8, 0.1)
        return guess if known is None else np.where(known >= 0, 0.05 + 0.9 * (known == 1), guess)
    prior, t1, t0, share, a1, a0 = rates
    odds = prior + x @ (share * np.log(t1 / t0)) + (1 - x) @ (share * np.log((1 - t1) / (1 - t0)))
    if known is not None:
        odds += np.where(known == 1, np.log(a1 / (1 - a0)), np.where(known == 0, np.log((1 - a1) / a0), 0))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _moments(x: np.ndarray, q: np.ndarray, n: np.ndarray, pairs: bool) -> list[np.ndarray]:
    """For either class its weight, the sum of votes, and with pairs the sum of their products; n rows stand for each row."""
    out = []
    for p in (q * n, (1 - q) * n):
        out += [np.array(p.sum()), x.T @ p, (x * p[:, None]).T @ x if pairs else np.zeros(0)]
    return out


def label_model(votes: np.ndarray, known: np.ndarray, more: Callable | None = None) -> np.ndarray:
    """Posterior probability of being toxic for each row of votes (0/1); known: a label voter's 1, 0 or -1 (silent).

    Every voter has a rate of speaking for either class, the label voter an accuracy of its own, all found by EM. Voters that
    hit the same words are not independent: within-class correlations are estimated from the posteriors, and each voter's
    evidence is divided by the sum of its correlations, so that a family of voters counts about once. more(rates, pairs) gives
    the moments of rows that are elsewhere, so that they count as well.
    """
    x, one = votes.astype(float), np.ones(len(votes))
    share, rates = np.ones(x.shape[1]), None
    for turn in range(ROUNDS):
        q = _posteriors(x, known, rates)
        pairs = turn in CORRELATED
        sums = _moments(x, q, one, pairs)
        if more:
            sums = [a + b for a, b in zip(sums, more(rates, pairs), strict=True)]
        n1, s1, m1, n0, s0, m0 = sums
        t1, t0 = (s1 + 1) / (n1 + 2), (s0 + 0.2) / (n0 + 2)
        said = known >= 0
        a1 = (q[said & (known == 1)].sum() + 9) / (q[said].sum() + 10)
        a0 = ((1 - q)[said & (known == 0)].sum() + 9) / ((1 - q)[said].sum() + 10)
        if pairs:
            c = sum((m - np.outer(t, s) - np.outer(s, t) + n * np.outer(t, t)) / max(float(n), 1e-9) * 0.5 for n, s, m, t in ((n1, s1, m1, t1), (n0, s0, m0, t0)))
            sd = np.sqrt(np.maximum(np.diag(c), 1e-9))
            rho = np.abs(c / np.outer(sd, sd))
            share = 1 / np.maximum(1, np.where(rho > 0.15, np.minimum(rho, 1), 0).sum(1))
        before, rates = rates, (np.log((n1 + 2) / (n0 + 2)), t1, t0, share, a1, a0)
        if turn > max(CORRELATED) and max(np.abs(t1 - before[1]).max(), np.abs(t0 - before[2]).max()) < SETTLED:
            break
    return _posteriors(x, known, rates)


def linear(x: np.ndarray, target: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on soft targets, by Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def vote_patterns(docs: DataFrame, voters: Voters, text_col: str = "text", but: DataFrame | None = None) -> DataFrame:
    """(votes, n), written: how often each pattern of votes, packed into bits, stands in docs; null texts don't vote. `but` (text) are
    rows of docs that are counted elsewhere; their votes are taken off again."""
    packed = pickle.dumps(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(packed)
        for batch in batches:
            for _, _, data, offsets in steps(batch, "text", 1 << 18):
                found, n = np.unique(np.packbits(_votes(*_counts(data, offsets, v)), axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(n.astype(np.int64))], ["votes", "n"])

    rows = bounded_batches(docs).select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInArrow(run, "votes binary, n long")
    if but is not None:
        found = found.unionByName(but.select("text").mapInArrow(run, "votes binary, n long").select("votes", (-F.col("n")).alias("n")))
    return written(found.groupBy("votes").agg(F.sum("n").alias("n")).where("n > 0"), "toxic-votes")


def _elsewhere(patterns: DataFrame, count: int) -> Callable:
    """more() of label_model() over a table of vote patterns: a task sends its moments, a few numbers for each pair of voters."""
    rows = patterns.coalesce(max(1, patterns.count() // PATTERN_ROWS))

    def more(rates: tuple | None, pairs: bool) -> list[np.ndarray]:
        sent = pickle.dumps(rates)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = pickle.loads(sent), None
            for batch in batches:
                if batch.num_rows:
                    bits = np.frombuffer(b"".join(batch.column("votes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    x = np.unpackbits(bits, axis=1)[:, :count].astype(float)
                    found = _moments(x, _posteriors(x, None, own), batch.column("n").to_numpy().astype(float), pairs)
                    sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], ["sums"])

        out = _moments(np.zeros((0, count)), np.zeros(0), np.zeros(0), pairs)
        for row in rows.mapInArrow(run, "sums binary").toLocalIterator():
            out = [a + b for a, b in zip(out, pickle.loads(bytes(row["sums"])), strict=True)]
        return out

    return more


def fit(docs: DataFrame, labels: DataFrame, take: object, id_col: str = "doc_id", text_col: str = "text") -> tuple[Voters, np.ndarray]:
    """The voters and the classifier's weights, learned from rows for which take holds.

    Voters are mined from, and the classifier is fitted on, the posteriors of labelled rows, bounded by the FIT_ parameters. The
    label model sees the votes of all rows, each once: with its label where the row is one of those, without it elsewhere.
    """
    rows = written(learning_rows(docs, labels, id_col, text_col, take), "toxic-fit")
    voters = mine(rows)
    packed = pickle.dumps(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pickle.loads(packed)
        for batch in batches:
            for a, b, data, offsets in steps(batch, "text", 1 << 18):
                hits, words = _counts(data, offsets, v)
                yield pa.RecordBatch.from_arrays([batch.column("label")[a:b], pa.array(words.astype(np.int64)), pa.array([x.astype(np.int32).tobytes() for x in hits], pa.binary())], ["label", "words", "hits"])

    # at most FIT_TOXIC + FIT_CLEAN rows of a few hundred bytes
    got = rows.mapInArrow(run, "label int, words long, hits binary").toPandas()
    if not len(got):
        return voters, np.append(np.zeros(2 * voters.count), -3.0)
    hits = np.stack([np.frombuffer(bytes(x), np.int32) for x in got["hits"]]).astype(np.int64)
    words, known = got["words"].to_numpy(), got["label"].to_numpy()
    patterns = vote_patterns(docs.where(take), voters, text_col, rows)
    target = label_model(_votes(hits, words), known, _elsewhere(patterns, voters.count))
    deleted(rows, patterns)
    return voters, linear(_features(hits, words), target)


def scored(docs: DataFrame, model: tuple[Voters, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its whole text alone.

    Null and empty texts have no hits and get the intercept's score. Rows that are wholly alike get the same answers; an empty
    table gives no rows; other columns are ignored. Without any labelled row the word lists alone decide nothing: the score is
    then the intercept's.
    """
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, weights = pickle.loads(packed)
        for batch in batches:
            for a, b, data, offsets in steps(batch, "text", 1 << 18):
                score = 1 / (1 + np.exp(-np.clip(_features(*_counts(data, offsets, v)) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; held out are ids whose crc32 leaves 2 modulo 4."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored(docs, fit(docs, labels, ~out)).select("doc_id", out.alias("held_out"), "score", "predicted")
