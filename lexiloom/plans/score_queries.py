"""Queries over word scores, distributions, mixtures and learners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, vectors
from ..functions.tails import dirichlet
from ..operators import experts, learn, lexicon, mono, pmf, stats, suggest, topics
from ..sources import shared
from .fixtures import TRUNCATE, Fixtures, of_scores_sql, truncated_sql
from .register import Register

query = Register()
QUERIES, SQL = query.queries, query.sql


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


SHOWN = "SELECT w1, w2, round(p, 6) AS p, rk FROM "


@query("SELECT w1, w2, round(score, 9) AS score FROM cue_ende")
def cue_score(x):
    return rounded(x.cue(), "score", digits=9)


@query("SELECT w1, w2, round(score, 9) AS score FROM ti_ende")
def ti_score(x):
    return rounded(topics.ti(x.counts(), "en", "de", topics=list(range(8))), "score", digits=9)


@query("SELECT w1, w2, round(score, 9) AS score FROM ticue_ende")
def ticue_score(x):
    return rounded(topics.ti_cue(x.counts(), "en", "de"), "score", digits=9)


@query(SHOWN + "pmf_ende")
def cue_pmf(x):
    """Flagship: topic words, smoothed topics, scores of all word pairs, truncated distributions."""
    return rounded(x.cue_pmf(), "p")


@query(SHOWN + "res_v", res_v=of_scores_sql("ticue_ende"))
def ticue_pmf(x):
    return rounded(topics.ti_cue_pmf(x.counts(), "en", "de", TRUNCATE), "p")


WHOLE = "(SELECT w1, w2, score / sum(score) OVER (PARTITION BY w1) AS p FROM cue_ende)"


def cut_cue(x: Fixtures, mass: float, beyond: bool = False) -> DataFrame:
    """The distributions of all scores, cut inside blocks of source words."""
    return topics.cue_pmf(topics.phi(x.counts()), "en", "de", mass, topics=list(range(8)), beyond=beyond)


@query(SHOWN + "res_v", res_v=truncated_sql(WHOLE, 0.8))
def pmf_truncate(x):
    return rounded(cut_cue(x, 0.8), "p")


@query(SHOWN + "res_v", res_v=truncated_sql("pmf_ende", 0.9, 10, "rk"))
def pmf_truncate_cap(x):
    """A given pmf cut again in its own order, ten candidates at most."""
    return rounded(pmf.truncated(x.cue_pmf(), 0.9, most=10, given_order=True), "p")


@query(SHOWN + """(SELECT *, coalesce(sum(p) OVER (PARTITION BY w1 ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY round(p, 12) DESC, w2) AS rk FROM res_v)) WHERE round(before, 12) <= 0.3""", res_v=WHOLE)
def cumu_cutoff(x):
    return rounded(cut_cue(x, 0.3, beyond=True), "p")


# ---- one language


EN = "SELECT word, doc_id, tf FROM postings SEMI JOIN vocab USING (lang, word) WHERE lang = 'en'"


def english(x: Fixtures) -> DataFrame:
    """Written, as everything over it reads it more than once."""
    return shared.written(x.vocab_postings("en").select("lang", "word", "doc_id", "tf"))[0]


@query("SELECT a.word AS w1, b.word AS w2, count(*) AS n12 FROM en_post a JOIN en_post b USING (doc_id) GROUP BY ALL", en_post=EN)
def cooc(x):
    return mono.cooccurrence(english(x))


PMI = """SELECT a.word AS w1, b.word AS w2, ln((coalesce(n12, 0) + 1e-4::double) * nd / (a.df * b.df)) * (coalesce(n12, 0) + 1e-4::double) AS score
    FROM en_df a CROSS JOIN en_df b CROSS JOIN (SELECT count(DISTINCT doc_id) AS nd FROM en_post)
    LEFT JOIN (SELECT a.word AS w1, b.word AS w2, count(*) AS n12 FROM en_post a JOIN en_post b USING (doc_id) GROUP BY ALL) c ON c.w1 = a.word AND c.w2 = b.word"""
EN_DF = "SELECT word, count(*) AS df FROM en_post GROUP BY word"


def english_pmi(x: Fixtures) -> DataFrame:
    v = x.vocab("en")
    return mono.pmi(english(x), v, v)


@query("SELECT w1, w2, round(score, 6) AS score FROM en_pmi", en_post=EN, en_df=EN_DF, en_pmi=PMI)
def pmi_score(x):
    return rounded(english_pmi(x), "score")


def _shifted(view: str) -> str:
    return truncated_sql(f"""(SELECT w1, w2, s / sum(s) OVER (PARTITION BY w1) AS p FROM (SELECT w1, w2, score - min(score) OVER (PARTITION BY w1) AS s FROM {view})
        QUALIFY sum(s) OVER (PARTITION BY w1) <> 0)""", TRUNCATE)


@query(SHOWN + "res_v", en_post=EN, en_df=EN_DF, en_pmi=PMI, res_v=_shifted("en_pmi"))
def pmi_pmf(x):
    return rounded(pmf.truncated(pmf.min_shifted(english_pmi(x)), TRUNCATE), "p")


VECTORS = """SELECT word, doc_id, s / norm AS s FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY word)) AS norm FROM (
    SELECT *, CASE WHEN m - 100 > 1 THEN coalesce(min(CASE WHEN i >= 1 AND i < m - 100 AND s - far < 0.05::double * top THEN i END) OVER (PARTITION BY word), m - 101) + 99 ELSE m END AS keep FROM (
    SELECT word, doc_id, s, row_number() OVER w - 1 AS i, lead(s, 100) OVER w AS far, first_value(s) OVER w AS top, count(*) OVER (PARTITION BY word) AS m FROM (
    SELECT word, doc_id, (1 + ln(tf)) * ln((SELECT count(DISTINCT doc_id) FROM en_post) / df) AS s FROM en_post JOIN en_df USING (word))
    WINDOW w AS (PARTITION BY word ORDER BY round(s, 12) DESC, doc_id))) WHERE i < keep) WHERE norm > 0"""


def english_vectors(x: Fixtures) -> DataFrame:
    return mono.document_vectors(stats.tfidf(english(x)))


@query("SELECT word, doc_id, round(s, 6) AS s FROM vec", en_post=EN, en_df=EN_DF, vec=VECTORS)
def esa_vectors(x):
    return rounded(english_vectors(x), "s")


ESA = "SELECT a.word AS w1, b.word AS w2, sum(a.s * b.s) AS score FROM vec a JOIN vec b USING (doc_id) GROUP BY ALL"


@query("SELECT w1, w2, round(score, 6) AS score FROM esa", en_post=EN, en_df=EN_DF, vec=VECTORS, esa=ESA)
def esa_score(x):
    return rounded(mono.vector_similarity(english_vectors(x)), "score")


ESA_ALL = """SELECT a.w1, b.w2, coalesce(score, 0) AS score FROM (SELECT DISTINCT word AS w1 FROM vec) a CROSS JOIN (SELECT DISTINCT word AS w2 FROM vec) b LEFT JOIN esa e ON e.w1 = a.w1 AND e.w2 = b.w2"""


@query(SHOWN + "res_v", en_post=EN, en_df=EN_DF, vec=VECTORS, esa=ESA, esa_all=ESA_ALL, res_v=_shifted("esa_all"))
def esa_pmf(x):
    return rounded(mono.vector_pmf(shared.written(english_vectors(x))[0], TRUNCATE), "p")


@query("""SELECT w1, w2, round(s / sum(s) OVER (PARTITION BY w1), 6) AS p FROM (
    SELECT w1, w2, 1.0::double / (1 + min(d)) AS s FROM (SELECT a.word AS w1, b.word AS w2, CASE WHEN a.node = b.node THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END AS d FROM senses a CROSS JOIN senses b) GROUP BY ALL)""",
    senses="""SELECT word, n_name AS node, n_regionkey FROM (SELECT word, c_nationkey, row_number() OVER (PARTITION BY word ORDER BY c DESC, c_nationkey) AS i
        FROM (SELECT c_mktsegment AS word, c_nationkey, count(*) AS c FROM customer GROUP BY ALL)) JOIN nation ON n_nationkey = c_nationkey WHERE i <= 3""")
def taxonomy_sim(x):
    """Market segments by nation, region and world; a segment's senses are its three most frequent nations."""
    nation, region = x.table("nation"), x.table("region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), "n_name").alias("child"), F.concat(F.lit("r:"), "r_name").alias("parent")).unionByName(region.select(F.concat(F.lit("r:"), "r_name").alias("child"), F.lit("world").alias("parent")))
    counts = x.table("customer").groupBy(F.col("c_mktsegment").alias("w1"), F.col("c_nationkey").alias("w2")).agg(F.count("*").alias("score"))
    top = pmf.ranked(counts).where("rk <= 3").join(nation, F.col("w2") == F.col("n_nationkey"))
    senses = top.select(F.col("w1").alias("word"), F.concat(F.lit("n:"), "n_name").alias("node"))
    return rounded(mono.taxonomy_similarity(senses, edges, senses.select("word")), "p")


# ---- through a third language, and mixtures

FREQUENT = "SELECT word FROM vocab WHERE cf >= 40"
PIVOT = """SELECT w1, w2, sum(p) AS p FROM (
    SELECT s.w1, t.w2, t.p * s.p AS p FROM {0} s JOIN pta t ON s.w2 = t.w1
    UNION ALL SELECT w1, w2, mass / v AS p FROM (SELECT w1, sum(p) AS mass FROM {0} WHERE w2 NOT IN (SELECT w1 FROM pta) GROUP BY w1)
        CROSS JOIN (SELECT DISTINCT w2 FROM pta) CROSS JOIN (SELECT count(DISTINCT w2) AS v FROM pta)) GROUP BY ALL"""
PTA = "SELECT w1, w2, p FROM pmf_frde WHERE w1 IN (SELECT word FROM vocab WHERE lang = 'fr' AND cf >= 40)"


def frequent(x: Fixtures, lang: str) -> DataFrame:
    return x.vocab(lang).where("cf >= 40").select("word")


@query("SELECT w1, w2, round(p, 9) AS p FROM res_v", pta=PTA, res_v=PIVOT.format("pmf_enfr"))
def pivot_pmf(x):
    """English to German by way of French; rare French words have no row of their own and spread evenly."""
    return rounded(experts.pivot(x.cue_pmf("en", "fr"), pmf.on_words(x.cue_pmf("fr", "de"), frequent(x, "fr")), x.vocab("de")), "p", digits=9)


@query("""SELECT u.w1, res_v.w2, round(p, 9) AS p FROM (SELECT word AS w1 FROM vocab WHERE lang = 'en' AND cf < 40) u CROSS JOIN res_v""", pta=PTA,
    pas="SELECT w1, w2, p FROM pmf_enfr WHERE w1 IN (SELECT word FROM vocab WHERE lang = 'en' AND cf >= 40)",
    even="SELECT '' AS w1, w2, 1.0::double / count(*) OVER () AS p FROM (SELECT DISTINCT w2 FROM pas)", res_v=PIVOT.format("even"))
def pivot_pmf_unseen(x):
    pas = pmf.on_words(x.cue_pmf("en", "fr"), frequent(x, "en"))
    return rounded(experts.pivot_unseen(pas, pmf.on_words(x.cue_pmf("fr", "de"), frequent(x, "fr")), x.vocab("de"), x.vocab("en")), "p", digits=9)


#: The second expert knows only frequent words, so that the others fall back on its vocabulary.
SOME = "SELECT * FROM experts WHERE j = 0 OR w1 IN (SELECT word FROM vocab WHERE lang = 'en' AND cf >= 40)"


def some_experts(x: Fixtures) -> DataFrame:
    a, b = x.expert_list()
    return experts.union_of([a, pmf.on_words(b, frequent(x, "en"))])


def _mixture(weights: str, words: str = "SELECT word AS w1 FROM vocab WHERE lang = 'en'") -> str:
    return f"""SELECT w1, w2, sum(p) AS p FROM (SELECT w1, w2, p * e AS p FROM some_experts JOIN ({weights}) USING (j) WHERE w1 IN ({words})
        UNION ALL SELECT w1, w2, e / v AS p FROM (SELECT * FROM ({words}) CROSS JOIN ({weights}) WHERE (j, w1) NOT IN (SELECT (j, w1) FROM some_experts))
        JOIN (SELECT DISTINCT j, w2 FROM some_experts) USING (j) JOIN (SELECT j, count(DISTINCT w2) AS v FROM some_experts GROUP BY j) USING (j)) GROUP BY ALL"""


FIXED = "SELECT unnest([0, 1]) AS j, unnest([0.4, 0.6])::double AS e"


def fixed(x: Fixtures) -> DataFrame:
    return x.spark.createDataFrame([(0, 0.4), (1, 0.6)], "j int, e double")


@query("SELECT w1, w2, round(p, 9) AS p FROM res_v", some_experts=SOME, res_v=_mixture(FIXED))
def mixture_pmf(x):
    return rounded(experts.mixture(some_experts(x), fixed(x), x.vocab("en")), "p", digits=9)


TEST = "SELECT DISTINCT w1 FROM lex_ende"


@query(SHOWN + "cut_v", some_experts=SOME, res_v=_mixture(FIXED, TEST), cut_v=truncated_sql("res_v", TRUNCATE))
def mixture_fixed(x):
    """The words of the dictionary under given weights."""
    words = x.pairs("en", "de").select(F.col("w1").alias("word"))
    return rounded(pmf.truncated(experts.mixture(some_experts(x), fixed(x), words), TRUNCATE), "p")


def training(x: Fixtures) -> DataFrame:
    return learn.training_table(x.pairs("en", "de"), experts.union_of(x.expert_list()), 2)


#: Pairs with what either expert gives them; then the weights after each of five updates.
def _settled(v: str) -> str:
    """exact.settled()."""
    return f"({v} * {exact.SETTLE!r}::double - ({v} * {exact.SETTLE!r}::double - {v}))"


EM = {"train": f"SELECT w1, w2, {_settled('x0')} AS b0, {_settled('x1')} AS b1 FROM (SELECT w1, w2, sum(CASE WHEN j = 0 THEN p ELSE 0 END) AS x0, sum(CASE WHEN j = 1 THEN p ELSE 0 END) AS x1 FROM lex_ende JOIN experts USING (w1, w2) GROUP BY ALL)", "em_0": "SELECT 0.5::double AS e0, 0.5::double AS e1"}
for _k in range(1):
    EM[f"em_{_k + 1}"] = f"""SELECT s0 / (s0 + s1) AS e0, s1 / (s0 + s1) AS e1 FROM (SELECT sum(b0 * e0 / (b0 * e0 + b1 * e1)) AS s0, sum(b1 * e1 / (b0 * e0 + b1 * e1)) AS s1 FROM train, em_{_k})"""
#: The weights after every update, until they move by less than a thousandth.
EM["em_run"] = """SELECT 0 AS step, 0.5::double AS e0, 0.5::double AS e1, 1.0::double AS moved UNION ALL
    SELECT step + 1, s0 / (s0 + s1), s1 / (s0 + s1), sqrt((s0 / (s0 + s1) - e0) ** 2 + (s1 / (s0 + s1) - e1) ** 2) FROM (
    SELECT step, e0, e1, sum(b0 * e0 / (b0 * e0 + b1 * e1)) AS s0, sum(b1 * e1 / (b0 * e0 + b1 * e1)) AS s1 FROM em_run, train WHERE moved >= 1e-3 AND step < 500 GROUP BY ALL)"""
EM["em_end"] = "SELECT e0, e1 FROM em_run ORDER BY step DESC LIMIT 1"
EVEN = [0.5, 0.5]


def _weights(x: Fixtures, eps: list[float]) -> DataFrame:
    return x.spark.createDataFrame(list(enumerate(eps)), "j int, e double")


@query("SELECT 0 AS j, round(e0, 9) AS e FROM em_1 UNION ALL SELECT 1, round(e1, 9) FROM em_1", **EM)
def em_step(x):
    return rounded(_weights(x, learn.em_step(training(x), [0.5, 0.5])), "e", digits=9)


@query("SELECT 0 AS j, round(e0, 9) AS e FROM em_end UNION ALL SELECT 1, round(e1, 9) FROM em_end", **EM)
def em_mixture(x):
    """Weights learned from an even start until they settle."""
    return rounded(_weights(x, learn.learn_em(training(x), 2, start=EVEN)), "e", digits=9)


STARTS = ", ".join(f"({k}, '{e[0]!r}'::double, '{e[1]!r}'::double)" for k, e in enumerate(dirichlet(2, seed=k) for k in range(10)))
RESTARTS = {
    "train": EM["train"],
    "runs_v": f"""SELECT run, 0 AS step, e0, e1, 1.0::double AS moved FROM (VALUES {STARTS}) t(run, e0, e1) UNION ALL
        SELECT run, step + 1, s0 / (s0 + s1), s1 / (s0 + s1), sqrt((s0 / (s0 + s1) - e0) ** 2 + (s1 / (s0 + s1) - e1) ** 2) FROM (
        SELECT run, step, e0, e1, sum(b0 * e0 / (b0 * e0 + b1 * e1)) AS s0, sum(b1 * e1 / (b0 * e0 + b1 * e1)) AS s1 FROM runs_v, train WHERE moved >= 1e-3 AND step < 500 GROUP BY ALL)""",
    "ends_v": "SELECT run, arg_max(e0, step) AS e0, arg_max(e1, step) AS e1 FROM runs_v GROUP BY run",
    "best_v": "SELECT e0, e1 FROM ends_v, train GROUP BY ALL ORDER BY round(sum(ln(b0 * e0 + b1 * e1)), 9) DESC, min(run) LIMIT 1",
}


@query("SELECT 0 AS j, round(e0, 9) AS e FROM best_v UNION ALL SELECT 1, round(e1, 9) FROM best_v", **RESTARTS)
def em_restarts(x):
    """Weights of the highest likelihood among ten random starts, which are learned side by side."""
    return rounded(_weights(x, learn.learn_em(training(x), 2)), "e", digits=9)


@query("SELECT round(sum(ln(b0 * 0.5 + b1 * 0.5)), 6) AS loglik, count(*) AS n FROM train", train=EM["train"])
def loglik(x):
    with shared.held(training(x)) as (t,):
        return x.spark.createDataFrame([(round(learn.log_likelihood(t, [0.5, 0.5]), 6), t.count())], "loglik double, n long")


@query(SHOWN + "cut_v", some_experts=SOME, **EM, learned="SELECT 0 AS j, e0 AS e FROM em_end UNION ALL SELECT 1, e1 FROM em_end", res_v=_mixture("SELECT * FROM learned", TEST), cut_v=truncated_sql("res_v", TRUNCATE))
def mixture_learned(x):
    """Weights learned by EM until they settle, then applied to the dictionary's words."""
    weights = _weights(x, learn.learn_em(training(x), 2, start=EVEN))
    return rounded(pmf.truncated(experts.mixture(some_experts(x), weights, x.pairs("en", "de").select(F.col("w1").alias("word"))), TRUNCATE), "p")


def candidates(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    """(w1, w2, b) of all candidates of dictionary words under two experts, and the dictionary."""
    gold = x.pairs("en", "de")
    return learn.candidate_table(gold, experts.union_of(x.expert_list()), 2), gold


@query("""SELECT g AS grid_id, round(avg(coalesce(1.0::double / best, 1.0::double / v2)), 6) AS mrr FROM (SELECT DISTINCT w1 FROM lex_ende) CROSS JOIN range(11) t(g) CROSS JOIN (SELECT count(*) AS v2 FROM vocab WHERE lang = 'de')
    LEFT JOIN (SELECT g, w1, min(rk) AS best FROM (SELECT g, w1, w2, row_number() OVER (PARTITION BY g, w1 ORDER BY round(b0 * (g / 10) + b1 * ((10 - g) / 10), 12) DESC, w2) AS rk FROM cands CROSS JOIN range(11) t(g)) SEMI JOIN lex_ende USING (w1, w2) GROUP BY ALL) USING (g, w1) GROUP BY g""",
    cands="SELECT w1, w2, sum(CASE WHEN j = 0 THEN p ELSE 0 END) AS b0, sum(CASE WHEN j = 1 THEN p ELSE 0 END) AS b1 FROM experts WHERE w1 IN (SELECT w1 FROM lex_ende) GROUP BY ALL")
def grid_search(x):
    """Mean reciprocal rank at every point of the grid of weights."""
    cands, gold = candidates(x)
    return rounded(learn.grid_scores(cands, gold, 2, x.vocab("de").count()).select("grid_id", "mrr"), "mrr")


@query("SELECT j, count(DISTINCT w2) AS v, round(1.0::double / count(DISTINCT w2), 9) AS inv_v FROM experts GROUP BY j")
def expert_vocab(x):
    return rounded(experts.expert_vocabularies(experts.union_of(x.expert_list())), "inv_v", digits=9)


def fine_training(x: Fixtures) -> tuple[DataFrame, list[Column]]:
    """The training table with the chance of each source word in every topic, and those columns."""
    wide = topics.phi(x.counts()).where("lang = 'en'").groupBy(F.col("word").alias("w1")).pivot("topic", list(range(8))).agg(F.first("p"))
    t = training(x).join(wide.select("w1", *[F.col(f"`{k}`").alias(f"f{k}") for k in range(8)]), "w1")
    return t, [F.col(f"f{k}") for k in range(8)]


def _exact(v: str) -> str:
    """The sum of exact.units()."""
    units = f"({v}) * {1 / exact.HALF!r}::double"
    return f"(sum(floor({units})::bigint)::double + sum(floor(({units} - floor({units})) * {1 / exact.HALF!r}::double)::bigint)::double * {exact.HALF!r}::double) * {exact.HALF!r}::double"


#: A row for each update: eps (topic by topic) and theta, until eps moves by less than a thousandth.
FINE = {
    "train": EM["train"],
    "fine_in": "SELECT w1, w2, f.topic AS k, j, f.p * CASE WHEN j = 0 THEN b0 ELSE b1 END AS bf FROM train JOIN phi f ON f.lang = 'en' AND f.word = w1 CROSS JOIN range(2) g(j)",
    "fine_run": f"""SELECT 0 AS step, list_transform(generate_series(1, 16), lambda v: 0.5::double) AS e, list_transform(generate_series(1, 8), lambda v: 0.125::double) AS t, 1.0::double AS moved UNION ALL
        SELECT step + 1, e2, t2, sqrt(list_sum(list_transform(list_zip(e2, e), lambda v: (v[1] - v[2]) ** 2))) FROM (
        SELECT step, e, list(coalesce(s / nullif(ks, 0), 0) ORDER BY k, j) AS e2, list(ks / every ORDER BY k, j) FILTER (j = 0) AS t2 FROM (
        SELECT step, e, k, j, s, sum(s) OVER (PARTITION BY step, k) AS ks, sum(s) OVER (PARTITION BY step) AS every FROM (
        SELECT step, e, k, j, {_exact('x / total')} AS s FROM (SELECT *, list_reduce(list(x) OVER (PARTITION BY step, w1, w2 ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), lambda p, q: p + q) AS total FROM (
        SELECT step, e, w1, w2, k, j, bf * (e[k * 2 + j + 1] * t[k + 1]) AS x FROM fine_run, fine_in WHERE moved >= 1e-3 AND step < 500)) GROUP BY ALL)) GROUP BY step, e)""",
    "fine_end": "SELECT k, j, e[k * 2 + j + 1] AS e, t[k + 1] AS t FROM (SELECT e, t FROM fine_run ORDER BY step DESC LIMIT 1) CROSS JOIN range(8) a(k) CROSS JOIN range(2) b(j)",
}


@query("SELECT k, j, round(e, 6) AS e, round(t, 6) AS theta FROM fine_end", **FINE)
def em_fine(x):
    """Weights by topic category, and the categories' shares, learned until they settle."""
    t, cols = fine_training(x)
    eps, theta = learn.learn_fine(t, cols, 2)
    return x.spark.createDataFrame([(k, j, round(eps[k][j], 6), round(theta[k], 6)) for k in range(8) for j in range(2)], "k int, j int, e double, theta double")


@query(SHOWN + "cut_v", some_experts=SOME, **FINE, learned="SELECT j, sum(e * t) AS e FROM fine_end GROUP BY j", res_v=_mixture("SELECT * FROM learned", TEST), cut_v=truncated_sql("res_v", TRUNCATE))
def mixture_fine(x):
    """Weights by topic category, learned by EM until they settle, collapsed and applied."""
    table, cols = fine_training(x)
    eps, theta = learn.learn_fine(table, cols, 2)
    e = x.spark.createDataFrame([(k, j, v) for k, row in enumerate(eps) for j, v in enumerate(row)], "k int, j int, e double")
    t = x.spark.createDataFrame(list(enumerate(theta)), "k int, p double")
    words = x.pairs("en", "de").select(F.col("w1").alias("word"))
    return rounded(pmf.truncated(experts.mixture(some_experts(x), experts.collapsed(e, t), words), TRUNCATE), "p")


FEATURES = {
    "en_stats": "SELECT word, [cf, df, adc, idf, cfidf, tcfidf]::double[] AS six FROM word_stats WHERE lang = 'en'",
    "feats": "SELECT word, list_concat(any_value(six), list(p / total ORDER BY topic)) AS x FROM en_stats JOIN (SELECT word, topic, p, sum(p) OVER (PARTITION BY word) AS total FROM phi WHERE lang = 'en') USING (word) GROUP BY word",
    "tops": "SELECT " + ", ".join(f"max(x[{i + 1}]) AS m{i}" for i in range(6)) + " FROM feats",
    "scaled": "SELECT word, list_transform(list_concat([" + ", ".join(f"coalesce(x[{i + 1}] / nullif(m{i}, 0), 0)" for i in range(6)) + f"], x[7:]), lambda v: {_settled('v')}) AS x FROM feats, tops",
}


def features(x: Fixtures) -> DataFrame:
    """Of vocabulary words only, and cached, as a gate reads them for its maxima, its training and its use; the statistics of all words are
    read once for that."""
    return topics.word_features(x.word_stats(), topics.phi(x.counts()), "en").cache()


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("word", F.posexplode("x").alias("i", "x")).select("word", "i", F.round("x", 6).alias("x"))


EXPLODED = "SELECT word, unnest(generate_series(0, len(x) - 1)) AS i, round(unnest(x), 6) AS x FROM "


@query(EXPLODED + "feats", **FEATURES)
def word_features(x):
    return _exploded(features(x))


@query(EXPLODED + "scaled", **FEATURES)
def scale_features(x):
    return _exploded(learn.scaled_features(features(x)))


def cluster_training(x: Fixtures) -> DataFrame:
    return training(x).join(learn.scaled_features(features(x)).withColumnRenamed("word", "w1"), "w1")


def clusters(x: Fixtures, steps: int | None = None) -> tuple:
    return learn.learn_cluster(cluster_training(x), 2, 2, 14, steps=steps)


def _added(values: str) -> str:
    return f"list_reduce({values}, lambda p, q: p + q)"


def _far(mu: str) -> str:
    return _added(f"list_transform(list_zip(x, {mu}), lambda v: (v[1] - v[2]) * (v[1] - v[2]))")


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"'{v!r}'" for v in values) + "]::double[]"


def _decay(t: str) -> str:
    """exact.decay()."""
    series = f"'{exact.DECAY_SERIES[0]!r}'::double"
    for c in exact.DECAY_SERIES[1:]:
        series = f"({series} * s.f + '{c!r}'::double)"
    most = f"least(t, {exact.DECAYED}::double)"
    at = [f"({_list(exact.DECAY[k])})[{i} + 1]" for k, i in enumerate(("s.q // 1024", "s.q // 32 % 32", "s.q % 32"))]
    return f"""list_transform(list_transform([{t}], lambda t: {{'gone': t >= {exact.DECAYED}, 'q': floor({most} * 32)::bigint, 'f': {most} - floor({most} * 32) / 32}}),
        lambda s: CASE WHEN s.gone THEN 0::double ELSE {" * ".join(at)} * {series} END)[1]"""


def _gauss(k: int) -> str:
    return f"pi[{k}] * {_decay(_far(f'mu[{k}]') + f' / (2 * (sigma[{k}] * sigma[{k}]))')} / sigma[{k}]"


_PARTS = ["b0 * e[1] * g[1]", "b1 * e[2] * g[1]", "b0 * e[3] * g[2]", "b1 * e[4] * g[2]"]
#: A row for each update of eps (cluster by cluster), pi, mu and sigma, until eps moves by less than a thousandth. Clusters start so
#: wide that they part by the last digits of a sum: hence sums of whole numbers and an exp() of its own on both sides.
CLUSTER = {
    **FEATURES,
    "train": EM["train"],
    "gauss_in": f"SELECT b0, b1, x, {_added('list_transform(x, lambda v: v * v)')} AS xx FROM train JOIN scaled ON word = w1",
    "gauss_run": f"""SELECT 0 AS step, [0.5, 0.5, 0.5, 0.5]::double[] AS e, [0.5, 0.5]::double[] AS pi, list_transform([0, 1], lambda k: list_transform(generate_series(0, 13), lambda d: CASE WHEN d = k THEN 2.0::double ELSE 0.0::double END)) AS mu,
        [5e6, 5e6]::double[] AS sigma, 1.0::double AS moved UNION ALL
        SELECT step + 1, e2, pi2, mu2, sigma2, sqrt(list_sum(list_transform(list_zip(e2, e), lambda v: (v[1] - v[2]) ** 2))) FROM (
        SELECT step, e, flatten(list([s0 / tk, s1 / tk] ORDER BY k)) AS e2, list(tk / n ORDER BY k) AS pi2, list(m ORDER BY k) AS mu2,
            list(CASE WHEN spread > 0 THEN sqrt(spread) ELSE width END ORDER BY k) AS sigma2 FROM (
        SELECT *, q / tk - {_added("list_transform(m, lambda v: v * v)")} AS spread FROM (
        SELECT *, s0 + s1 AS tk, list_transform(sums, lambda v: v / (s0 + s1)) AS m FROM (
        SELECT step, e, k, count(*) AS n, any_value(sigma[k]) AS width, {_exact("r0")} AS s0, {_exact("r1")} AS s1, [{", ".join(_exact(f"(r0 + r1) * x[{d + 1}]") for d in range(14))}] AS sums, {_exact("(r0 + r1) * xx")} AS q FROM (
        SELECT step, e, sigma, k, x, xx, coalesce(parts[2 * k - 1] / nullif(total, 0), 0) AS r0, coalesce(parts[2 * k] / nullif(total, 0), 0) AS r1 FROM (
        SELECT *, parts[1] + parts[2] + parts[3] + parts[4] AS total FROM (
        SELECT *, [{", ".join(_PARTS)}] AS parts FROM (
        SELECT step, e, sigma, x, xx, b0, b1, [{_gauss(1)}, {_gauss(2)}] AS g FROM gauss_run, gauss_in WHERE moved >= 1e-3 AND step < STEPS))) CROSS JOIN (SELECT unnest([1, 2]) AS k)) GROUP BY step, e, k))) GROUP BY step, e)""",
    "gauss_end": "SELECT k - 1 AS k, e[2 * k - 1] AS e0, e[2 * k] AS e1, pi[k] AS pi, mu[k] AS mu, sigma[k] AS sigma FROM (SELECT * FROM gauss_run ORDER BY step DESC LIMIT 1) CROSS JOIN (SELECT unnest([1, 2]) AS k)",
}
CLUSTER, CLUSTER_STEPS = ({name: body.replace("STEPS", most) for name, body in CLUSTER.items()} for most in ("500", "2"))


def _cluster_rows(x: Fixtures, steps: int | None) -> DataFrame:
    eps, pi, mu, sigma = clusters(x, steps)
    return x.spark.createDataFrame([(k, *[round(v, 6) for v in (eps[k][0], eps[k][1], pi[k], sigma[k], sum(mu[k]))]) for k in range(2)], "k int, e0 double, e1 double, pi double, sigma double, mu_sum double")


CLUSTER_ROWS = "SELECT k, round(e0, 6) AS e0, round(e1, 6) AS e1, round(pi, 6) AS pi, round(sigma, 6) AS sigma, round(list_sum(mu), 6) AS mu_sum FROM gauss_end"


@query(CLUSTER_ROWS, **CLUSTER)
def em_cluster(x):
    """Weights by clusters of word features, and the clusters, learned until they settle."""
    return _cluster_rows(x, None)


@query(CLUSTER_ROWS, **CLUSTER_STEPS)
def em_cluster_steps(x):
    """The first two updates of em_cluster."""
    return _cluster_rows(x, 2)


def _gated(x: Fixtures, steps: int | None) -> DataFrame:
    eps, pi, mu, sigma = clusters(x, steps)
    gauss = x.spark.createDataFrame([(k, pi[k], mu[k], sigma[k]) for k in range(2)], "k int, pi double, mu array<double>, sigma double")
    e = x.spark.createDataFrame([(k, j, eps[k][j]) for k in range(2) for j in range(2)], "k int, j int, e double")
    gate = experts.gate(learn.scaled_features(features(x)), gauss, e)
    mix = experts.mixture(some_experts(x), gate, x.pairs("en", "de").select(F.col("w1").alias("word")))
    return rounded(pmf.truncated(pmf.normalised(mix, "p"), TRUNCATE), "p")


#: The gate of two clusters applied to the dictionary's words.
GATED = {
    "gated": """SELECT w1, 0 AS j, sum(g * e0) AS e FROM gate_v GROUP BY w1 UNION ALL SELECT w1, 1, sum(g * e1) FROM gate_v GROUP BY w1""",
    "gate_v": f"SELECT word AS w1, e0, e1, pi * exp(-{_far('mu')} / (2 * sigma * sigma)) / sigma AS g FROM scaled CROSS JOIN gauss_end WHERE word IN ({TEST})",
    "res_v": """SELECT w1, w2, sum(p) AS p FROM (SELECT w1, w2, p * e AS p FROM some_experts JOIN gated USING (j, w1)
        UNION ALL SELECT w1, w2, e / v AS p FROM (SELECT * FROM gated WHERE (j, w1) NOT IN (SELECT (j, w1) FROM some_experts)) JOIN (SELECT DISTINCT j, w2 FROM some_experts) USING (j) JOIN (SELECT j, count(DISTINCT w2) AS v FROM some_experts GROUP BY j) USING (j)) GROUP BY ALL""",
    "norm_v": "SELECT w1, w2, p / sum(p) OVER (PARTITION BY w1) AS p FROM res_v",
    "cut_v": truncated_sql("norm_v", TRUNCATE),
}


@query(SHOWN + "cut_v", some_experts=SOME, **CLUSTER, **GATED)
def mixture_cluster(x):
    """Weights gated by word features, learned by EM until they settle."""
    return _gated(x, None)


@query(SHOWN + "cut_v", some_experts=SOME, **CLUSTER_STEPS, **GATED)
def mixture_cluster_steps(x):
    """Weights gated by word features after two updates."""
    return _gated(x, 2)


# ---- use of pmfs

TITLES = {"en_titles": "SELECT r AS id, word AS title FROM vocab WHERE lang = 'en' AND cf >= 40", "de_titles": "SELECT word AS title FROM vocab WHERE lang = 'de' AND cf >= 30"}
SUGGEST = """SELECT w1, string_agg(w2, ' ' ORDER BY i) AS suggestions FROM (SELECT w1, w2, row_number() OVER (PARTITION BY w1 ORDER BY rk) AS i FROM pmf_ende WHERE w2 IN (SELECT title FROM de_titles) AND w1 {}) WHERE i <= 5 GROUP BY w1"""


def _titles(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    en = x.vocab("en").where("cf >= 40").select(F.col("r").alias("id"), F.col("word").alias("title"))
    return en, x.vocab("de").where("cf >= 30").select(F.col("word").alias("title"))


def _joined(df: DataFrame) -> DataFrame:
    return df.select("w1", F.array_join("suggestions", " ").alias("suggestions"))


@query(SUGGEST.format("NOT IN (SELECT title FROM en_titles)"), **TITLES)
def title_suggest(x):
    en, de = _titles(x)
    return _joined(suggest.for_missing_titles(x.cue_pmf(), en, de, 5))


@query(SUGGEST.format("IN (SELECT title FROM en_titles WHERE id NOT IN (SELECT r FROM vocab WHERE lang = 'en' AND cf >= 60))"), **TITLES)
def title_suggest_unlinked(x):
    en, de = _titles(x)
    links = x.vocab("en").where("cf >= 60").select(F.col("r").alias("id"))
    return _joined(suggest.for_unlinked_titles(x.cue_pmf(), en, links, de, 5))


@query("""SELECT w1, w2 FROM first_v UNION SELECT w1, w2 FROM (SELECT w2 AS w1, w1 AS w2 FROM pmf_deen WHERE rk = 1 AND (w2, w1) NOT IN (SELECT (w1, w2) FROM first_v) ORDER BY w1 LIMIT 50)""".replace("ORDER BY w1 LIMIT 50)", "ORDER BY pmf_deen.w1 LIMIT 50)"),
    first_v="SELECT w1, w2 FROM pmf_ende WHERE rk = 1 ORDER BY w1 LIMIT 50")
def top1_pairs(x):
    return lexicon.first_pairs(x.cue_pmf("en", "de"), x.cue_pmf("de", "en"), 50)


@query("""SELECT l.w1, l.w2, round(greatest(coalesce(f.p, 0), coalesce(b.p, 0)), 6) AS score FROM lex_ende l LEFT JOIN pmf_ende f ON f.w1 = l.w1 AND f.w2 = l.w2 LEFT JOIN pmf_deen b ON b.w1 = l.w2 AND b.w2 = l.w1""")
def bidir_score(x):
    return rounded(lexicon.bidirectional(x.pairs("en", "de"), x.cue_pmf("en", "de"), x.cue_pmf("de", "en")), "score")


@query("""SELECT block, array_to_string(list_concat(used, list_filter(l2, lambda v: NOT list_contains(used, v))[:k - len(used)]), ' ') AS translated FROM turns_run WHERE t = len(lists) * k""",
    top_v="SELECT * FROM (SELECT lang, topic, word, row_number() OVER (PARTITION BY lang, topic ORDER BY n DESC, word) AS rk FROM topic_word WHERE lang IN ('en', 'de')) WHERE rk <= 5",
    cands_v="SELECT w1, list(w2 ORDER BY rk) AS cands FROM pmf_ende GROUP BY w1",
    turns_in="""SELECT topic AS block, coalesce(lists, []) AS lists, l2, len(l2) AS k FROM (SELECT topic, list(word ORDER BY rk) AS l2 FROM top_v WHERE lang = 'de' GROUP BY topic)
        LEFT JOIN (SELECT topic, list(cands ORDER BY rk) AS lists FROM top_v JOIN cands_v ON w1 = word WHERE lang = 'en' GROUP BY topic) USING (topic)""",
    turns_run="""SELECT block, lists, l2, k, []::varchar[] AS used, 0 AS t FROM turns_in UNION ALL
        SELECT block, lists, l2, k, CASE WHEN len(used) < k AND len(free) > 0 THEN list_append(used, free[1]) ELSE used END, t + 1 FROM (
        SELECT *, list_filter(lists[t % len(lists) + 1], lambda v: NOT list_contains(used, v)) AS free FROM turns_run WHERE t < len(lists) * k)""")
def label_translate(x):
    """Labels of each topic: its five most frequent English words, put into German."""
    top = pmf.ranked(x.counts().where("lang IN ('en', 'de')").select(F.concat_ws(":", "lang", "topic").alias("w1"), F.col("word").alias("w2"), F.col("n").alias("score"), "lang", "topic")).where("rk <= 5")
    of = lambda lang: F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == lang, F.struct("rk", "w2")))), lambda v: v["w2"])
    blocks = top.groupBy(F.col("topic").alias("block")).agg(of("en").alias("l1_labels"), of("de").alias("l2_labels"))
    return suggest.translated_labels(blocks, x.cue_pmf()).select("block", F.array_join("translated", " ").alias("translated"))


@query("""SELECT w1, w2, expert, round(p, 6) AS p FROM (SELECT l.w1, l.w2, n.expert, coalesce(e.p, 0) AS p, row_number() OVER (PARTITION BY l.w1, l.w2 ORDER BY round(coalesce(e.p, 0), 12) DESC, n.j) AS i
    FROM (SELECT DISTINCT w1, w2 FROM lex_ende) l CROSS JOIN (SELECT unnest([0, 1]) AS j, unnest(['state', 'state_alt']) AS expert) n LEFT JOIN experts e ON e.j = n.j AND e.w1 = l.w1 AND e.w2 = l.w2) WHERE i = 1""")
def gold_by_expert(x):
    names = x.spark.createDataFrame([(0, "state"), (1, "state_alt")], "j int, expert string")
    return rounded(experts.best_expert(x.pairs("en", "de"), experts.union_of(x.expert_list()), names), "p")


POST = "SELECT lang, word, topic, p / sum(p) OVER (PARTITION BY lang, word) AS p FROM phi"


@query("""SELECT w1, w2, round(sum(CASE WHEN a.p > 1e-7 THEN a.p * ln(a.p / b.p) ELSE 0 END), 6) AS kl, round(sum((a.p - b.p) * ln(a.p / b.p)), 6) AS sym_kl,
    round((sum(CASE WHEN a.p > 1e-7 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END) + sum(CASE WHEN b.p > 1e-7 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END)) / 2 / ln(2), 6) AS jsd,
    round(sqrt(sum(a.p * a.p)), 6) AS l2, round(max(a.p), 6) AS l_inf
    FROM lex_ende JOIN post a ON a.lang = 'en' AND a.word = w1 JOIN post b ON b.lang = 'de' AND b.word = w2 AND b.topic = a.topic GROUP BY w1, w2""", post=POST)
def topic_divergence(x):
    """Divergences of the topics of dictionary pairs."""
    p = topics.phi(x.counts()).groupBy("lang", "word").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("tp"))
    p = p.select("lang", "word", vectors.unit(F.transform("tp", lambda v: v["p"]), 1).alias("v"))
    both = x.pairs("en", "de").distinct().join(p.where("lang = 'en'").select(F.col("word").alias("w1"), F.col("v").alias("a")), "w1").join(p.where("lang = 'de'").select(F.col("word").alias("w2"), F.col("v").alias("b")), "w2")
    a, b = F.col("a"), F.col("b")
    return rounded(both.select("w1", "w2", vectors.kl_divergence(a, b).alias("kl"), vectors.symmetric_kl(a, b).alias("sym_kl"), vectors.js_divergence(a, b).alias("jsd"), vectors.p_norm(a, 2).alias("l2"), vectors.p_norm(a, "INF").alias("l_inf")), "kl", "sym_kl", "jsd", "l2", "l_inf")
