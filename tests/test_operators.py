"""Hand-computed cases of the operators."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import tails, vectors
from lexiloom.operators import agreement, evaluate, experts, jobs, learn, lexicon, mono, pmf, reports, stats, suggest, text, topics
from lexiloom.plans.fixtures import Fixtures
from lexiloom.sources import files
from lexiloom.streaming import postings as stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pmf_of(spark, rows):
    return frame(spark, rows, "w1 string, w2 string, p double")


def shown(df, *columns, digits=9):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_truncation(spark):
    rows = pmf_of(spark, [("s", "a", 0.5), ("s", "b", 0.3), ("s", "c", 0.2), ("z", "a", 0.0), ("z", "b", 0.0)])
    got = shown(pmf.truncated(rows, 0.8), "w1", "w2", "p")
    assert got == [("s", "a", 0.625), ("s", "b", 0.375), ("z", "a", 0.0), ("z", "b", 0.0)]
    assert shown(pmf.truncated(rows.where("w1 = 's'"), 1.0), "p") == [(0.2,), (0.3,), (0.5,)]
    assert shown(pmf.truncated(rows.where("w1 = 's'"), 1.0, most=1), "w2", "p") == [("a", 1.0)]
    assert shown(pmf.cumulative_cut(rows.where("w1 = 's'"), 0.5), "w2") == [("a",), ("b",)]
    assert pmf.min_shifted(frame(spark, [("s", "a", 2.0), ("s", "b", 2.0)], "w1 string, w2 string, score double")).count() == 0


def test_statistics(spark):
    tokens = frame(spark, [("en", d, "w") for d in (1, 2)] + [("en", d, f"o{d}") for d in range(1, 8)], "lang string, doc_id int, word string")
    p = stats.postings(tokens)
    row = stats.word_stats(p).where("word = 'w'").first()
    assert (row.cf, row.df, row.adc) == (2, 2, 1.0) and math.isclose(row.idf, math.log(3)) and math.isclose(row.tcfidf, math.log(2) * math.log(3))
    assert math.isclose(stats.tfidf(p).where("word = 'w'").first().score, math.log(3.5))
    assert stats.useful_words(stats.word_stats(p), stats.document_counts(p), 1, 1.0, 3).count() == 3
    ids = stats.assigned_ids(frame(spark, [("b",), ("a",)], "word string"), ["word"], start=7)
    assert shown(ids, "word", "id") == [("a", 7), ("b", 8)]


def test_conditional_probability(spark):
    p = frame(spark, [("en", "a", 1, 2), ("en", "b", 1, 1), ("en", "a", 2, 1), ("hi", "c", 1, 5)], "lang string, word string, doc_id int, tf long")
    q = frame(spark, [("q", 0, "en", "a"), ("q", 1, "hi", "c"), ("r", 0, "en", "b")], "query string, ord int, lang string, word string")
    got = dict(shown(stats.conditional_probability(p, q), "query", "p"))
    assert got == {"q": round((2 + 1) / (3 + 2) * 1.0, 9), "r": 0.25}


def test_topics(spark):
    counts = frame(spark, [("en", 0, "a", 3), ("en", 0, "b", 1), ("en", 1, "c", 1)], "lang string, topic int, word string, n long")
    got = {(t, w): p for _, t, w, p in topics.phi(counts).select("lang", "topic", "word", "p").collect()}
    assert math.isclose(got[0, "a"], 3.01 / 4.03) and math.isclose(got[0, "b"], 1.01 / 4.03) and math.isclose(got[0, "c"], 0.01 / 4.03)
    everywhere = frame(spark, [("en", t, "a", 1) for t in range(4)] + [("en", 0, "b", 1)], "lang string, topic int, word string, n long")
    vectors_ = topics.ti_vectors(everywhere)
    assert vectors_.where("word = 'a'").count() == 4
    assert all(math.isclose(r[0], 1.0) for r in vectors_.groupBy("word").agg(F.sum(F.col("p") * F.col("p"))).select("sum((p * p))").collect())


def test_mixtures(spark):
    e = experts.union_of([pmf_of(spark, [("s", "t", 0.5), ("s", "u", 0.5)]), pmf_of(spark, [("x", f"t{i}" if i else "t", 0.1) for i in range(10)])])
    w = frame(spark, [(0, 0.4), (1, 0.6)], "j int, e double")
    got = dict(shown(experts.mixture(e, w, frame(spark, [("s",)], "word string")), "w2", "p"))
    assert got["t"] == 0.26 and got["u"] == 0.2 and got["t3"] == 0.06
    pas, pta = pmf_of(spark, [("s", "a", 0.6), ("s", "b", 0.4)]), pmf_of(spark, [("a", "t", 0.5), *[("q", f"v{i}", 0.1) for i in range(9)]])
    vocab = frame(spark, [("t",), ("v1",), ("outside",)], "word string")
    assert dict(shown(experts.pivot(pas, pta, vocab), "w2", "p")) == {"t": 0.34, "v1": 0.04}
    unseen = experts.pivot_unseen(pas, pta, vocab, frame(spark, [("s",), ("new",)], "word string"))
    assert shown(unseen, "w1", "w2", "p") == [("new", "t", 0.3), ("new", "v1", 0.05)]


def test_em_matches_numpy(spark):
    r = np.random.default_rng(0)
    b = r.random((30, 3))
    table = frame(spark, [(f"s{i}", "t", row.tolist()) for i, row in enumerate(b)], "w1 string, w2 string, b array<double>").cache()
    eps = np.full(3, 1 / 3)
    last = -1e9
    for _ in range(4):
        share = b * eps / (b @ eps)[:, None]
        likelihood = learn.log_likelihood(table, eps.tolist())
        assert math.isclose(likelihood, np.log(b @ eps).sum()) and likelihood >= last
        last, eps = likelihood, share.sum(0) / share.sum()
    assert np.allclose(learn.learn_em(table, 3, steps=4), eps)
    assert np.allclose(sum(learn.learn_em(table, 3, restarts=1, most=5)), 1)


def test_cluster_em_matches_numpy(spark):
    r = np.random.default_rng(1)
    b, x = r.random((12, 2)), r.random((12, 3))
    table = frame(spark, [(bb.tolist(), xx.tolist()) for bb, xx in zip(b, x)], "b array<double>, x array<double>")
    eps, pi, mu, sigma = np.full((2, 2), 0.5), np.full(2, 0.5), np.array([[2.0, 0, 0], [0, 2.0, 0]]), np.full(2, 5e6)
    for _ in range(2):
        g = np.stack([pi[k] * np.exp(-((x - mu[k]) ** 2).sum(1) / (2 * sigma[k] ** 2)) / sigma[k] for k in range(2)], 1)
        t = g[:, :, None] * eps[None] * b[:, None, :]
        t /= t.sum((1, 2), keepdims=True)
        tk = t.sum((0, 2))
        eps, pi = t.sum(0) / tk[:, None], tk / len(b)
        mu = np.stack([(x * t.sum(2)[:, [k]]).sum(0) / tk[k] for k in range(2)])
        sigma = np.array([math.sqrt((((x - mu[k]) ** 2).sum(1) * t.sum(2)[:, k]).sum() / tk[k]) for k in range(2)])
    got = learn.learn_cluster(table, 2, 2, 3, steps=2)
    for mine, want in zip(got, (eps, pi, mu, sigma)):
        assert np.allclose(mine, want)
    with pytest.raises(ValueError):
        learn.learn_cluster(table, 4, 2, 3)


def test_grid(spark):
    assert [len(learn.grid(n)) for n in (2, 3, 4, 5)] == [11, 66, 286, 1001]
    cands = frame(spark, [("s", "t", [0.1, 0.9]), ("s", "u", [0.9, 0.1])], "w1 string, w2 string, b array<double>")
    assert learn.learn_grid(cands, frame(spark, [("s", "t")], "w1 string, w2 string"), 2, 5) == [0.0, 1.0]


def test_splits(spark):
    pairs = frame(spark, [(f"a{i}", f"b{i}") for i in range(10)], "w1 string, w2 string")
    got = learn.splits(pairs, 4, 3).groupBy("split_id", "part").count().collect()
    assert {(r.split_id, r.part): r["count"] for r in got} == {(s, p): n for s in range(3) for p, n in (("train", 4), ("test", 6))}
    assert learn.splits(pairs, 40, 1).where("part = 'train'").count() == 5


def test_metrics(spark):
    ranked = frame(spark, [("a", "x", 1), ("a", "y", 2), ("a", "t", 3), ("b", "q", 1), ("c", "q", 1)], "w1 string, w2 string, rk int")
    gold = frame(spark, [("a", "t"), ("a", "y2"), ("b", "none")], "w1 string, w2 string")
    got = {r.w1: r for r in evaluate.word_metrics(ranked, gold, 200).collect()}
    assert set(got) == {"a", "b"} and math.isclose(got["a"].rr, 1 / 3) and (got["a"].pres1, got["a"].pres5) == (0, 1) and got["b"].rr == 0.005
    assert got["a"].prec5 == 0.2 and got["a"].rprec == 0
    both = evaluate.union_support(pmf_of(spark, [("s", "a", 1.0)]), pmf_of(spark, [("s", "b", 1.0)]))
    assert math.isclose(evaluate.jensen_shannon(both).first().jsd, 1.0)
    rows = frame(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (3.0, 4.0)], "x double, y double")
    assert math.isclose(evaluate.spearman(rows, "x", "y").first().spearman, np.corrcoef([1, 2, 3.5, 3.5], [1, 3, 2, 4])[0, 1])
    assert math.isclose(evaluate.kendall(rows, "x", "y").first().kendall, 3 / math.sqrt(5 * 6))
    assert math.isclose(tails.correlation_p(0.5, 10), 0.14111328125, rel_tol=1e-6)
    assert 0 < tails.kendall_p(0.5, 10) < 0.1 and math.isclose(sum(tails.dirichlet(4)), 1)


def test_divergences(spark):
    row = spark.range(1).select(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)).alias("q"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("p"), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("r"))
    got = row.select(vectors.smoothed(F.col("q")).alias("s"), vectors.js_divergence(F.slice("p", 1, 2), F.slice("r", 1, 2)).alias("j"), vectors.p_norm(F.col("q"), 3).alias("n"), vectors.kl_divergence(F.col("p"), F.col("r")).alias("k")).first()
    assert np.allclose(got.s, np.array([0.505, 0.505, 0.005]) / 1.015) and math.isclose(got.j, 1.0) and math.isclose(got.n, 0.25 ** (1 / 3)) and got.k > 4


def test_agreement(spark):
    same = [(c, str(i), [str(i % 2)]) for i in range(6) for c in "ab"]
    data = frame(spark, same, "coder string, item string, labels array<string>")
    for name in ("ao", "s", "pi", "kappa", "alpha"):
        assert math.isclose(agreement.coefficient(name, data).first()[0], 1.0)
    assert agreement.sanitised(frame(spark, same[1:], "coder string, item string, labels array<string>")).count() == 10
    sets = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("x"), F.array(F.lit("b"), F.lit("c"), F.lit("d")).alias("y"), F.array(F.lit("stat")).alias("s"), F.array(F.lit("chck")).alias("c"))
    x, y = F.col("x"), F.col("y")
    got = sets.select(vectors.masi(x, y), vectors.interval(x, y), vectors.interval(y, x), vectors.binary(x, y), vectors.example(F.col("s"), F.col("c"))).first()
    assert np.allclose(got, [1 - 1 / 3, 1, 4, 1, 0.5])
    strings = agreement.of_strings(frame(spark, [("a_1_x:y:x",)], "value string")).first()
    assert (strings.coder, strings.item, strings.labels) == ("a", "1", ["x", "y"])


def test_filters(spark):
    words = frame(spark, [("hi", "कख"), ("hi", "abcक"), ("de", "größe"), ("en", "don't"), ("en", "abc1"), ("xx", "a1!")], "lang string, word string")
    assert [r.word for r in words.transform(text.in_script(lang_col="lang")).collect()] == ["कख", "größe", "a1!"]
    assert words.transform(text.in_script(script="Latin")).count() == 1 and words.transform(text.in_script()).count() == 6
    assert words.transform(text.at_least(4)).count() == 4
    lines = frame(spark, [(1, "The big dog of it", "en"), (2, "of", "en")], "k int, text string, lang string")
    assert shown(text.preprocessed(lines, frame(spark, [("of",)], "word string"), "k"), "k", "text") == [(1, "The big dog"), (2, "")]


def test_document_vectors(spark):
    rows = [("w", d, float(300 - d)) for d in range(200)] + [("short", d, 1.0) for d in range(101)] + [("zero", d, 0.0) for d in range(5)]
    got = dict(shown(mono.document_vectors(frame(spark, rows, "word string, doc_id int, score double"), least=0.0).groupBy("word").count(), "word", "count"))
    assert got == {"w": 198, "short": 101}
    flat = [("f", d, 10.0 if d < 5 else 9.9) for d in range(200)]
    assert mono.document_vectors(frame(spark, flat, "word string, doc_id int, score double")).count() == 100


def test_dictionaries(spark):
    a, b = frame(spark, [("x", "h1"), ("x", "h2")], "w1 string, w2 string"), frame(spark, [("h1", "b"), ("h2", "b")], "w1 string, w2 string")
    assert shown(lexicon.pivoted(a, b), "w1", "w2") == [("x", "b")]
    assert lexicon.common_language(("en", "hi"), ("hi", "bn")) == ("en", "hi", "bn")
    f, g = pmf_of(spark, [("s", "t", 0.2), ("s", "u", 0.8)]), pmf_of(spark, [("t", "s", 0.7)])
    pairs = frame(spark, [("s", "t"), ("s", "q")], "w1 string, w2 string")
    assert shown(lexicon.bidirectional(pairs, f, g), "w2", "score") == [("q", 0.0), ("t", 0.7)]
    assert shown(lexicon.bidirectional(pairs, f, g, scale="max"), "w2", "score") == [("q", 0.0), ("t", 1.0)]


def test_suggestions(spark):
    p = frame(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "w1 string, w2 string, rk int")
    titles, targets = frame(spark, [("1", "b")], "id string, title string"), frame(spark, [("x",), ("y",)], "title string")
    assert shown(suggest.for_missing_titles(p, titles, targets, 1), "w1", "suggestions") == [("a", ["x"])]
    none = frame(spark, [], "id string")
    assert shown(suggest.for_unlinked_titles(p, titles, none, targets, 5), "w1", "suggestions") == [("b", ["x"])]
    blocks = frame(spark, [(0, ["a", "b", "oov"], ["k", "x", "m", "n"]), (1, ["oov"], ["k"])], "block int, l1_labels array<string>, l2_labels array<string>")
    assert shown(suggest.translated_labels(blocks, p), "block", "translated") == [(0, ["x", "y", "k", "m"]), (1, ["k"])]


def test_files(spark, tmp_path):
    (tmp_path / "words").write_text("# note\nb\n\n a \nb\n")
    assert [r.word for r in files.word_list(spark, str(tmp_path / "words")).orderBy("ord").collect()] == ["b", "a", "b"]
    (tmp_path / "map").write_text("#x\ty\na\t1\nbad line\na\t2\n")
    assert [tuple(r) for r in files.name_values(spark, str(tmp_path / "map")).collect()] == [("a", "2")]
    (tmp_path / "dict").write_text("House\tHaus \nhouse\thaus\nbad\n")
    assert [tuple(r) for r in files.dictionary(spark, str(tmp_path / "dict")).collect()] == [("house", "haus")]
    p = frame(spark, [("s", "b", 0.25, 2), ("s", "a", 0.75, 1)], "w1 string, w2 string, p double, rk int")
    files.write_pmf(p, str(tmp_path / "pmf"))
    assert shown(files.pmf(spark, str(tmp_path / "pmf")), "w1", "w2", "p", "rk") == [("s", "a", 0.75, 1), ("s", "b", 0.25, 2)]
    replaced = frame(spark, [(0, "s\ta 0.5"), (1, "s\tb 0.5\tb 0.25")], "line int, value string")
    assert shown(files.pmf_lines(replaced), "w2", "p") == [("b", 0.25)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d1.txt").write_text("One two\ntwo ")
    (tmp_path / "docs" / "skip.md").write_text("no")
    assert [r.word for r in files.token_folder(spark, str(tmp_path / "docs"), "en", r"\.txt$").collect()] == ["One", "two", "two"]
    (tmp_path / "state").write_text("#doc lang pos id word topic\n7 0 0 3 haus 2\n7 9 1 4 skip 2\n")
    assert [tuple(r) for r in files.topic_state(spark, str(tmp_path / "state"), {"0": "de"}).collect()] == [("7", "de", 0, 3, "haus", 2)]
    (tmp_path / "labels").write_text("\nen one\na b\nc d\n\n\nen two\ne\nf\n")
    assert shown(files.label_blocks(spark, str(tmp_path / "labels")), "block", "l1_labels", "l2_labels") == [(0, ["a", "b"], ["c", "d"]), (1, ["e"], ["f"])]
    (tmp_path / "feat").write_text("w\t1 2.5\n")
    assert files.features(spark, str(tmp_path / "feat")).first().x == [1.0, 2.5]
    (tmp_path / "eps").write_text("0.25 0.75\n")
    assert shown(files.weights(spark, str(tmp_path / "eps")), "j", "e") == [(0, 0.25), (1, 0.75)]
    (tmp_path / "stats").write_text("#NUM_DOCS=9\n#word\nw\t2\t1\t2.0\t1.0\t1.0\t1.0\n")
    assert files.word_stats_documents(spark, str(tmp_path / "stats")).first().n_docs == 9 and files.word_stats(spark, str(tmp_path / "stats")).first().cf == 2.0
    files.write_splits(frame(spark, [(0, "train", "a", "b")], "split_id int, part string, w1 string, w2 string"), str(tmp_path / "splits"))
    assert spark.read.text(str(tmp_path / "splits")).first().value == "a\tb"
    assert files.gauss_text([[1.0]], [1.0], [[2.0]], [3.0], 4)[0] == "N=4\tK=1\tE=1"


def test_more_files(spark, tmp_path):
    """Writers and what reads them back, and the readers of small formats."""
    weights = frame(spark, [(0, 0.25), (1, 0.75)], "j int, e double")
    files.write_weights(weights, str(tmp_path / "w"))
    assert shown(files.weights(spark, str(tmp_path / "w")), "j", "e") == [(0, 0.25), (1, 0.75)]
    latent = ([[0.5, 0.5], [0.1, 0.9]], [0.3, 0.7])
    files.write_latent(spark, *latent, str(tmp_path / "latent"))
    assert files.latent(spark, str(tmp_path / "latent")) == latent
    gauss = ([[0.5, 0.5], [0.1, 0.9]], [0.4, 0.6], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.5]], [1.5, 2.5])
    files.write_gauss(spark, *gauss, 9, str(tmp_path / "gauss"))
    assert files.gauss(spark, str(tmp_path / "gauss")) == gauss
    files.write_features(frame(spark, [("a", [1.0, 2.5])], "word string, x array<double>"), str(tmp_path / "feats"))
    assert [tuple(r) for r in files.features(spark, str(tmp_path / "feats")).collect()] == [("a", [1.0, 2.5])]
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert shown(files.words_of(spark, write("vocab", "a b\n c\tb \n")), "word", "ord") == [("a", 0), ("b", 1), ("b", 3), ("c", 2)]
    assert shown(files.doc_stats(spark, write("ds", "#id\tc\td\te\nd1\t9\t3\t2\n")), "doc_id", "nchars", "ntokens", "ntypes") == [("d1", 9, 3, 2)]
    assert shown(files.column(spark, write("col", "a b c\nd\n e f\n"), 2), "word", "ord") == [("b", 0), ("f", 2)]
    assert shown(files.titles(spark, write("t", "1\tOne Title\n2\tTwo\n")), "id", "title") == [("1", "One Title"), ("2", "Two")]
    assert shown(files.links(spark, write("l", "1\t7\n2\t8\n"), 2), "id") == [("7",), ("8",)]
    assert shown(files.scores(spark, write("s", "a b 0.5\nbad\n")), "w1", "w2", "score") == [("a", "b", 0.5)]
    assert shown(files.annotation_rows(spark, write("a", "c1 i1 x:y\n")), "coder", "item", "labels") == [("c1", "i1", ["x", "y"])]
    assert shown(files.number_annotations(spark, write("n", "1.5 2\n3 4\n")), "item", "x", "y") == [(0, 1.5, 2.0), (1, 3.0, 4.0)]
    assert shown(files.word_list(spark, write("raw", " b\n#c \n b\na|x\n"), comments=False), "word") == [(" b",), ("#c",), ("a|x",)]
    files.write_docs(frame(spark, [("d1", "some text"), ("d2", "more")], "doc_id string, text string"), str(tmp_path / "docs2"))
    assert sorted((r.doc_id, r.value) for r in spark.read.text(str(tmp_path / "docs2")).collect()) == [("d1", "some text"), ("d2", "more")]
    files.write_table(frame(spark, [("a", 1)], "x string, y int"), str(tmp_path / "table"))
    assert shown(files.table(spark, str(tmp_path / "table"), "x string, y int"), "x", "y") == [("a", 1)]
    assert shown(files.word_stats_text(frame(spark, [("w", 2, 1, 2.0, 0.5, 1.0, 0.34657)], "word string, cf long, df long, adc double, idf double, cfidf double, tcfidf double")), "cf", "adc", "tcfidf") == [("2", "2.0000", "0.3466")]


def test_lines_of_large_files(spark, tmp_path):
    """Lines keep their numbers where a file is read in several blocks."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    (tmp_path / "many").write_text("".join(f"line {k}{'x' * (k % 50)}\r\n" if k % 7 else "\n" for k in range(2000)))
    spark.conf.set(key, "4096")
    try:
        got = files.lines(spark, str(tmp_path / "many")).orderBy("line").collect()
    finally:
        spark.conf.set(key, before)
    assert [(r.line, r.value) for r in got] == [(k, f"line {k}{'x' * (k % 50)}" if k % 7 else "") for k in range(2000)]


def test_jobs(spark, tmp_path):
    """A job list: weights by either learner, applied to the test words and written."""
    e = experts.union_of([pmf_of(spark, [("s", "t", 0.9), ("s", "u", 0.1), ("v", "t", 1.0)]), pmf_of(spark, [("s", "t", 0.2), ("s", "u", 0.8)])])
    vocab = frame(spark, [("t",), ("u",)], "word string")
    (tmp_path / "train").write_text("s t\nv t\n")
    (tmp_path / "test").write_text("x s\ny v\n")
    (tmp_path / "jobs").write_text(f"# test col train l1 l2 out params\n{tmp_path}/test 2 {tmp_path}/train en de {tmp_path}/out0 {tmp_path}/eps0\n")
    for learner, least in (("EM", 0.9), ("GRID", 0.0), ("anything", 0.0)):
        target = str(tmp_path / "jobs") if learner == "EM" else str(tmp_path / f"jobs-{learner}")
        (tmp_path / f"jobs-{learner}").write_text((tmp_path / "jobs").read_text().replace("out0", f"out-{learner}").replace("eps0", f"eps-{learner}"))
        done = jobs.run(spark, target, lambda a, b: (e, 2, vocab), learner, mass=1.0)
        assert len(done) == 1 and math.isclose(sum(done[0][1]), 1) and done[0][1][0] >= least
    assert {r.w1 for r in files.pmf(spark, str(tmp_path / "out0")).collect()} == {"s", "v"}
    assert math.isclose(sum(r.e for r in files.weights(spark, str(tmp_path / "eps0")).collect()), 1)
    train = frame(spark, [(0, "s", "t"), (1, "s", "u")], "split_id int, w1 string, w2 string")
    words = frame(spark, [(0, "s"), (1, "s")], "split_id int, word string")
    got = jobs.splits_run(train, words, e, 2, vocab, "GRID", 1.0).where("rk = 1").collect()
    assert {(r.split_id, r.w2) for r in got} == {(0, "t"), (1, "u")}


def test_learners_settle(spark):
    """EM from an even start stops where an own loop does."""
    r = np.random.default_rng(5)
    b, phi = r.random((20, 2)), r.random((20, 3))
    table = frame(spark, [(bb.tolist(), *pp.tolist()) for bb, pp in zip(b, phi)], "b array<double>, f0 double, f1 double, f2 double")
    eps = np.full(2, 0.5)
    while True:
        before, share = eps, b * eps / (b @ eps)[:, None]
        eps = share.sum(0) / share.sum()
        if np.linalg.norm(eps - before) < 1e-3:
            break
    assert np.allclose(learn.learn_em(table, 2, start=[0.5, 0.5]), eps)
    e, t = np.full((3, 2), 0.5), np.full(3, 1 / 3)
    while True:
        x = b[:, None, :] * phi[:, :, None] * e[None] * t[None, :, None]
        s = (x / x.sum((1, 2), keepdims=True)).sum(0)
        before, e, t = e, s / s.sum(1, keepdims=True), s.sum(1) / s.sum()
        if np.linalg.norm(e - before) < 1e-3:
            break
    got = learn.learn_fine(table, [F.col(f"f{k}") for k in range(3)], 2)
    assert np.allclose(got[0], e) and np.allclose(got[1], t)
    steps = learn.learn_fine(table, [F.col(f"f{k}") for k in range(3)], 2, steps=2)
    for a, b in zip(steps, learn.learn_fine(table, [F.col(f"f{k}") for k in range(3)], 2, steps=2)):
        assert np.allclose(a, b)


def test_top_lists_in_blocks(spark, monkeypatch):
    """Cut inside blocks as by sorting all pairs, also where a vocabulary is too large to be sent."""
    r = np.random.default_rng(3)
    rows = [(lang, t, f"{lang}{'é' if k % 7 == 0 else ''}{k}", int(n)) for lang, size in (("en", 23), ("de", 31)) for k in range(size) for t, n in enumerate(r.integers(0, 6, 4)) if n]
    counts = frame(spark, rows, "lang string, topic int, word string, n long").cache()
    p = topics.phi(counts)
    keep = lambda df: shown(df, "w1", "w2", "p", "rk")
    want = keep(pmf.of_scores(topics.cue(p, "en", "de"), 0.4)), keep(pmf.of_scores(topics.ti_cue(counts, "en", "de"), 0.4, 3))
    monkeypatch.setattr(topics, "BLOCK_CELLS", 100)
    assert (keep(topics.cue_pmf(p, "en", "de", 0.4)), keep(topics.ti_cue_pmf(counts, "en", "de", 0.4, 3))) == want
    monkeypatch.setattr(topics, "BROADCAST_BYTES", 64)
    assert (keep(topics.cue_pmf(p, "en", "de", 0.4)), keep(topics.ti_cue_pmf(counts, "en", "de", 0.4, 3))) == want
    assert topics.cue_pmf(p.where("lang = 'en'"), "en", "de", 0.4, topics=[0, 1, 2, 3]).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """Related words cut inside blocks as by joining words by document, also where vectors are too large to be sent."""
    r = np.random.default_rng(8)
    rows = [(f"{'é' if k % 5 == 0 else 'w'}{k}", int(d), float(r.random())) for k in range(29) for d in {int(x) for x in r.integers(0, 12, 4)}]
    v = frame(spark, [*rows, ("alone", 99, 1.0), ("nowhere", None, 1.0)], "word string, doc_id int, s double")
    words = v.select("word").distinct()
    keep = lambda df: shown(df, "w1", "w2", "p", "rk")
    for most in (None, 2):
        want = keep(pmf.truncated(pmf.min_shifted(mono.with_zeros(mono.vector_similarity(v), words, words)), 0.6, most))
        assert {"alone"} < {x[0] for x in want} and "nowhere" not in {x[0] for x in want}
        with monkeypatch.context() as m:
            m.setattr(mono, "vector_similarity", None)  # no pair leaves a task
            for cells, pairs in ((2_000_000, 4_000_000), (70, 5)):
                m.setattr(mono, "BLOCK_CELLS", cells)
                m.setattr(mono, "PAIRS_AT_ONCE", pairs)
                assert keep(mono.vector_pmf(v, 0.6, most)) == want
        with monkeypatch.context() as m:
            m.setattr(mono, "BROADCAST_BYTES", 64)
            assert keep(mono.vector_pmf(v, 0.6, most)) == want
    assert mono.vector_pmf(v.where("false"), 0.6).count() == 0


def test_crowded_keys_are_dealt(spark):
    """A join by a key of many rows is the plain join, whatever the size of parts; taxonomies with a crowded root too."""
    r = np.random.default_rng(6)
    a = frame(spark, [(f"a{k}", int(d)) for k in range(40) for d in {0, *r.integers(0, 9, 2).tolist()}], "w1 string, doc_id int")
    b = frame(spark, [(f"b{k}", int(d)) for k in range(30) for d in {0, *r.integers(0, 9, 2).tolist()}], "w2 string, doc_id int")
    want = shown(a.join(b, "doc_id"), "doc_id", "w1", "w2")
    for most in (1, 7, 1000):
        assert shown(mono.met(a, b, "doc_id", most), "doc_id", "w1", "w2") == want
    assert mono.met(a, b.where("false"), "doc_id", 2).count() == 0
    edges = frame(spark, [("x", "root"), ("y", "root"), ("z", "y"), ("w", "z"), ("w", "x")], "child string, parent string")
    assert dict(shown(mono.hypernym_distances(edges).where("node = 'w'"), "up", "d")) == {"w": 0, "z": 1, "x": 1, "y": 2, "root": 2}


def test_ids_and_distances(spark):
    """Ids in order within groups, over many ranges; average distances of ordered pairs, also of a distance that is not symmetric."""
    r = np.random.default_rng(8)
    rows = [("abc"[k % 3], int(v)) for k, v in enumerate(r.permutation(500))]
    got = stats.assigned_ids(frame(spark, rows, "g string, v int").repartition(4), [F.desc("v")], start=5, by=["g"], name="no").collect()
    for g in "abc":
        assert [x.v for x in sorted((x for x in got if x.g == g), key=lambda x: x.no)] == sorted((v for h, v in rows if h == g), reverse=True)
        assert sorted(x.no for x in got if x.g == g) == list(range(5, 5 + sum(h == g for h, _ in rows)))
    kinds = [["a"], ["a", "b"], ["b", "c", "d"], ["b"]]
    sets = [(i, kinds[k]) for i, k in enumerate(r.integers(0, 4, 60))]
    d = lambda a, b: len(set(a) - set(b)) ** 2
    want = [d(a, b) for i, a in sets for j, b in sets if i < j]
    got = agreement.average_distance(frame(spark, sets, "i int, labels array<string>"), vectors.interval).first()
    assert math.isclose(got.avg_distance, sum(want) / len(want)) and got.n == len(want)


def test_p_values(spark):
    rows = frame(spark, [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (5.0, 4.0)], "x double, y double")
    got = {r.measure: r for r in evaluate.correlations(rows, "x", "y").collect()}
    assert math.isclose(got["pearson"].value, 0.8) and math.isclose(got["pearson"].p, 0.10408803866182788, rel_tol=1e-6) and got["kendall"].n == 5
    flat = evaluate.correlations(frame(spark, [(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").collect()
    assert [r.p for r in flat if r.measure == "spearman"] == [None]


def test_sections(spark):
    lines = frame(spark, list(enumerate(["# c", "ende", "0.5 1 0 3", "", "0.25 0 1 4", "deen", "1 1 1 1"])), "line int, value string")
    assert shown(reports.sections(lines), "key", "mrr", "n") == [("deen", 1.0, 1), ("ende", 0.25, 4), ("ende", 0.5, 3)]


def test_streamed_postings(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    query = stream.in_memory(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), "streamed")
    query.awaitTermination()
    batch = stats.postings(text.tokens(spark.read.parquet(str(tmp_path / "in"))))
    assert spark.table("streamed").exceptAll(batch).count() == 0 and spark.table("streamed").count() == batch.count()


ODD_SPACE = [(1, "en", "src1", " One one\ttwo\x1cthree  ONE　two x "), (2, "en", "src2", None), (3, None, "src1", "two İi ΑΣ two"), (4, "de", "src3", ""), (5, "de", "src1", "\x85a\xa0b᠎c​d e a 12 straße"), (6, "en", "src2", "\n"), (7, "en", None, "123 456 one")]


def test_row_counts_like_postings(spark):
    docs = spark.createDataFrame(ODD_SPACE, "doc_id long, lang string, source string, text string")
    words = {tuple(r) for r in stats.row_counts(docs.select("lang", "text")).select("lang", "word", "cf", "df").collect()}
    assert words == {tuple(r) for r in stats.postings(text.tokens(docs)).groupBy("lang", "word").agg(F.sum("tf"), F.count("*")).collect()}
    places = {tuple(r) for r in stats.row_counts(docs.select("lang", "source", "text"), 3).select("lang", "source", "place", "word", "cf").collect()}
    assert places == {tuple(r) for r in text.tokens(docs, keep=["source"]).groupBy("lang", "source", F.col("pos") % 3, "word").agg(F.count("*")).collect()}
    assert stats.row_counts(docs.select("lang", "text").where("false")).count() == 0
    found = stats.document_counts_of(docs.select("lang", "text"), lambda w, lang: (F.length(w) >= 3) & ~text.foreign(w, lang))
    clean = text.tokens(docs).transform(text.at_least(3)).transform(text.in_script(lang_col="lang"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in stats.document_counts(stats.postings(clean)).collect()}


def test_document_counts_of_places_add_up(spark):
    """df adds up over places, a vocabulary is picked before counting, and documents are judged by their first fitting word."""
    docs = spark.createDataFrame([*ODD_SPACE, (8, "de", "src1", "ab x1y c.d"), (9, "hi", "src2", "abc कखग"), (10, "hi", "src2", "abc")], "doc_id long, lang string, source string, text string")
    summed = stats.row_counts(docs.select("lang", "source", "text"), 3).groupBy("lang", "word").agg(F.sum("cf"), F.sum("df"))
    assert {tuple(r) for r in summed.collect()} == {tuple(r) for r in stats.postings(text.tokens(docs)).groupBy("lang", "word").agg(F.sum("tf"), F.count("*")).collect()}
    some = {tuple(r) for r in stats.row_counts(docs.select("lang", "source", "text"), 3, ["two", "one"]).collect()}
    assert some == {tuple(r) for r in stats.row_counts(docs.select("lang", "source", "text"), 3).where("word IN ('two', 'one')").collect()}
    found = docs.where(text.has_word(F.lower("text"), F.col("lang"), 3)).groupBy("lang").agg(F.count("*"))
    clean = text.tokens(docs).transform(text.at_least(3)).transform(text.in_script(lang_col="lang"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in stats.document_counts(stats.postings(clean)).collect()}


def test_postings_of_rows(spark, sf_dir):
    docs = spark.createDataFrame(ODD_SPACE, "doc_id long, lang string, source string, text string")
    rows = lambda df: sorted(map(repr, df.select("lang", "word", "doc_id", "tf").collect()))
    found = stats.row_postings(docs.select("lang", "doc_id", "text"))
    assert rows(found) == rows(stats.postings(text.tokens(docs)))
    x = Fixtures(spark, sf_dir)
    found = x.vocab_postings()
    assert rows(found) == rows(stats.postings(x.state()))
    assert not re.search(r"Aggregate \[[^\]]*doc_id", found._jdf.queryExecution().analyzed().toString())


def test_white_space_is_the_same_everywhere(spark):
    every = "".join(f"{chr(c)}x" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)
    docs = spark.createDataFrame([("en", every)], "lang string, text string")
    assert {r["word"] for r in stats.row_counts(docs).collect()} == {r["word"] for r in text.tokens(docs.withColumn("doc_id", F.lit(1))).collect()}


def test_vocabulary_counts_texts_without_grouping_by_document(spark, sf_dir, tmp_path):
    """Rows that share or lack a doc_id are counted as one document, in another plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(str(tmp_path / "single" / "documents.parquet"))
    shared_ids = docs.where("doc_id % 9 = 0").withColumn("source", F.lit("src5")).unionByName(docs.where("doc_id % 50 = 1").withColumn("doc_id", F.lit(None).cast("long")))
    docs.unionByName(shared_ids).write.parquet(str(tmp_path / "shared" / "documents.parquet"))
    for name in ("single", "shared"):
        x = Fixtures(spark, str(tmp_path / name))
        assert x.single() == (name == "single")
        by_document = re.search(r"Aggregate \[[^\]]*doc_id", x.vocab()._jdf.queryExecution().analyzed().toString())
        assert (by_document is None) == x.single()
        got = {tuple(r) for r in x.word_stats().select("lang", "word", "cf", "df").collect()}
        p = x.postings()
        assert got == {tuple(r) for r in stats.word_stats(p).select("lang", "word", "cf", "df").collect()}
        for step, n in ((3, 8), (5, 6)):
            want = x.clean().join(x.vocab().select("lang", "word"), ["lang", "word"], "left_semi").join(x.table("documents").select("doc_id", F.substring("source", 4, 9).cast("int").alias("s")), "doc_id")
            want = want.groupBy("lang", ((F.col("s") + F.col("pos") % step) % n).alias("topic"), "word").agg(F.count("*").alias("n"))
            assert {tuple(r) for r in x.counts(step, n).select("lang", "topic", "word", "n").collect()} == {tuple(r) for r in want.collect()}


def test_few_pairs_are_sent_to_the_experts(spark):
    pairs, pmfs = frame(spark, [("a", "x"), ("a", "x"), ("b", "y")], "w1 string, w2 string"), experts.union_of([pmf_of(spark, [("a", "x", 0.5), ("c", "x", 1.0)]), pmf_of(spark, [("a", "x", 0.25)])])
    best = experts.best_expert(pairs, pmfs, frame(spark, [(0, "p"), (1, "q")], "j int, expert string"))
    assert {tuple(r) for r in best.collect()} == {("a", "x", "p", 0.5), ("b", "y", "p", 0.0)}
    train = learn.training_table(pairs, pmfs, 2)
    for df in (best.select("w1"), train):
        assert "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString().replace("BroadcastHint", "")
    assert [tuple(r) for r in train.collect()] == [("a", "x", [1.0, 0.5])]


def test_source_words_are_dealt_over_tasks(spark):
    """Behind a join by source word too, whose small partitions are put together."""
    counts = frame(spark, [(lang, t, f"{lang}{w}", (w * 7 + t * 3) % 5 + 1) for lang in ("en", "de") for t in range(3) for w in range(40)], "lang string, topic int, word string, n long")
    whole = pmf.of_scores(topics.ti_cue(counts, "en", "de"), 0.5)
    found = topics.ti_cue_pmf(counts, "en", "de", 0.5)
    assert found.select("w1", F.spark_partition_id().alias("k")).select("k").distinct().count() > 1
    rows = lambda df: {(r["w1"], r["w2"], r["rk"], round(r["p"], 9)) for r in df.collect()}
    assert rows(found) == rows(whole)


def test_statistics_of_all_words_are_not_shuffled_for_features(spark):
    phi = frame(spark, [("en", t, w, p) for t, (a, b) in enumerate([(0.25, 0.75), (0.5, 0.5)]) for w, p in (("a", a), ("b", b))], "lang string, topic int, word string, p double")
    all_words = frame(spark, [("en", w, 4, 2, 2.0, 0.5, 2.0, 1.0) for w in "abcd"] + [("de", "a", 1, 1, 1.0, 0.0, 0.0, 0.0)], "lang string, word string, cf long, df long, adc double, idf double, cfidf double, tcfidf double")
    found = topics.word_features(all_words, phi, "en")
    assert "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()
    assert {r["word"]: list(r["x"]) for r in found.collect()} == {"a": [4.0, 2.0, 2.0, 0.5, 2.0, 1.0, 1 / 3, 2 / 3], "b": [4.0, 2.0, 2.0, 0.5, 2.0, 1.0, 0.6, 0.4]}


def test_cuts_beyond_a_mass_in_blocks(spark):
    counts = frame(spark, [(lang, t, f"{lang}{w}", (w * 7 + t * 3) % 5 + 1) for lang in ("en", "de") for t in range(3) for w in range(9)], "lang string, topic int, word string, n long")
    phi = topics.phi(counts)
    rows = lambda df: {(r["w1"], r["w2"], r["rk"], round(r["p"], 9)) for r in df.collect()}
    whole = pmf.normalised(topics.cue(phi, "en", "de"))
    assert rows(topics.cue_pmf(phi, "en", "de", 0.3, beyond=True)) == rows(pmf.cumulative_cut(whole, 0.3))
    assert rows(topics.cue_pmf(phi, "en", "de", 0.8)) == rows(pmf.truncated(whole, 0.8))


def test_topic_counts_are_added_up_by_topics_inside_tasks(spark, tmp_path):
    """Not by source and place, of which there are 24 * 15 here for every word."""
    docs = spark.createDataFrame([(i, f"one two three {'one ' * i}" * 8, "en", f"src{i}") for i in range(24)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    x = Fixtures(spark, str(tmp_path))
    for step, n in ((3, 8), (5, 6)):
        want = x.state(step, n).groupBy("lang", "topic", "word").agg(F.count("*").alias("n"))
        assert {tuple(r) for r in x.counts(step, n).select("lang", "topic", "word", "n").collect()} == {tuple(r) for r in want.collect()}
    assert x._places.groupBy("word").count().agg(F.max("count")).first()[0] <= 8 * 6
    assert "place" not in x._places.columns
