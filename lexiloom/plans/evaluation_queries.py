"""Queries over metrics, correlations, agreement and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import agreement, evaluate, learn, reports, stats, topics
from ..sources import files, shared
from .fixtures import Fixtures
from .register import Register
from .score_queries import EM, rounded, training

query = Register()
QUERIES, SQL = query.queries, query.sql

#: Metrics of each English word that the dictionary has.
DETAILS = """SELECT w1, CASE WHEN best IS NOT NULL THEN 1.0::double / best ELSE 1.0::double / v2 END AS rr, n_gold, coalesce(n_hit, 0) AS n_hit, (coalesce(h1, 0) > 0)::int AS pres1, (coalesce(h5, 0) > 0)::int AS pres5,
    coalesce(h1, 0) / 1 AS prec1, coalesce(h5, 0) / 5 AS prec5, coalesce(hr, 0) / n_gold AS rprec
    FROM (SELECT DISTINCT w1 FROM pmf_ende) JOIN (SELECT w1, count(DISTINCT w2) AS n_gold FROM lex_ende GROUP BY w1) USING (w1) CROSS JOIN (SELECT count(*) AS v2 FROM vocab WHERE lang = 'de')
    LEFT JOIN (SELECT w1, min(rk) AS best, count(*) AS n_hit, sum((rk <= 1)::int) AS h1, sum((rk <= 5)::int) AS h5, sum((rk <= n_gold)::int) AS hr FROM pmf_ende SEMI JOIN lex_ende USING (w1, w2)
        JOIN (SELECT w1, count(DISTINCT w2) AS n_gold FROM lex_ende GROUP BY w1) USING (w1) GROUP BY w1) USING (w1)"""


def details(x: Fixtures) -> DataFrame:
    v2 = x.vocab("de").agg(F.count("*").alias("v2"))
    return evaluate.word_metrics(x.cue_pmf(), x.pairs("en", "de"), v2)


def _per_word(name: str, *columns: str) -> None:
    """A query of one or more metrics per word."""
    def f(x: Fixtures) -> DataFrame:
        return rounded(details(x).select("w1", *columns), *columns)

    f.__name__ = name
    query(f"SELECT w1, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM details_v", details_v=DETAILS)(f)


_per_word("eval_rr", "rr")
_per_word("eval_presence", "pres1", "pres5")
_per_word("eval_precision", "prec1", "prec5")
_per_word("eval_rprec", "rprec")
_per_word("eval_lexicon_det", "rr", "pres1", "pres5")

MEANS = "round(avg(rr), 6) AS mrr, round(avg(pres1), 6) AS p1, round(avg(pres5), 6) AS p5, count(*) AS n"


@query(f"SELECT {MEANS} FROM details_v", details_v=DETAILS)
def eval_lexicon_sum(x):
    return rounded(evaluate.summary(details(x)), "mrr", "p1", "p5")


SPLITS = """SELECT split_id, w1, w2, CASE WHEN i <= take THEN 'train' ELSE 'test' END AS part FROM (SELECT *, CASE WHEN 100 > n THEN n // 2 ELSE 100 END AS take FROM (
    SELECT s AS split_id, w1, w2, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || w1 || ':' || w2), w1, w2) AS i, count(*) OVER (PARTITION BY s) AS n FROM lex_ende CROSS JOIN range(3) t(s)))"""


def splits(x: Fixtures) -> DataFrame:
    return learn.splits(x.pairs("en", "de"), 100, 3)


@query("SELECT split_id, w1, w2, part FROM splits_v", splits_v=SPLITS)
def train_test_split(x):
    return splits(x)


@query("SELECT split_id, w1, w2, part FROM splits_v", splits_v=SPLITS)
def splits_roundtrip(x):
    """The splits as files <split>/en-de.tr.gold and .ts.gold, read again."""
    path = x.written("splits")
    files.write_split_files(splits(x), path, "en-de")
    return files.split_files(x.spark, path, "en-de")


@query("SELECT split_id, unnest([0, 1]) AS j, round(unnest([e0, e1]), 9) AS e FROM (SELECT split_id, arg_max(e0, step) AS e0, arg_max(e1, step) AS e1 FROM cv_run GROUP BY split_id)",
    train=EM["train"], splits_v=SPLITS, cv_train="SELECT split_id, b0, b1 FROM train JOIN splits_v USING (w1, w2) WHERE part = 'train'",
    cv_run="""SELECT split_id, 0 AS step, 0.5::double AS e0, 0.5::double AS e1, 1.0::double AS moved FROM (SELECT DISTINCT split_id FROM cv_train) UNION ALL
        SELECT split_id, step + 1, s0 / (s0 + s1), s1 / (s0 + s1), sqrt((s0 / (s0 + s1) - e0) ** 2 + (s1 / (s0 + s1) - e1) ** 2) FROM (
        SELECT split_id, step, e0, e1, sum(b0 * e0 / (b0 * e0 + b1 * e1)) AS s0, sum(b1 * e1 / (b0 * e0 + b1 * e1)) AS s1 FROM cv_run JOIN cv_train USING (split_id) WHERE moved >= 1e-3 AND step < 500 GROUP BY ALL)""")
def cv_weights(x):
    """Weights learned on the training pairs of every split, all splits at once; a split of whose pairs no expert has any has no row."""
    rows = training(x).join(splits(x).where("part = 'train'").select(F.col("split_id").alias("job"), "w1", "w2"), ["w1", "w2"])
    with shared.held(rows.select("job", "b")) as (rows,):
        jobs = sorted(r[0] for r in rows.select("job").distinct().collect())
        found = learn.learn_em_jobs(rows, 2, jobs, start=[0.5, 0.5])
    return rounded(x.spark.createDataFrame([(k, j, e) for k, w in found.items() for j, e in enumerate(w)], "split_id int, j int, e double"), "e", digits=9)


@query(f"SELECT split_id, {MEANS} FROM details_v JOIN (SELECT DISTINCT split_id, w1 FROM splits_v WHERE part = 'test') USING (w1) GROUP BY split_id", details_v=DETAILS, splits_v=SPLITS)
def cv_splits_eval(x):
    """The dictionary's test words of each split, all splits in one plan."""
    test = splits(x).where("part = 'test'").select("split_id", "w1").distinct()
    return rounded(evaluate.summary(details(x).join(test, "w1"), ["split_id"]), "mrr", "p1", "p5")


@query("""SELECT word, cf, df, round(adc, 6) AS adc, round(avg(rr), 6) AS rr, round(avg(pres1), 6) AS pres1, round(avg(pres5), 6) AS pres5 FROM details_v JOIN word_stats ON word = w1 AND lang = 'en' GROUP BY ALL""", details_v=DETAILS)
def perf_by_freq(x):
    s = x.word_stats().where("lang = 'en'")
    return rounded(reports.by_frequency(details(x), s), "adc", "rr", "pres1", "pres5")


UNION = """SELECT w1, w2, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM pmf_ende a FULL JOIN pmf_alt b USING (w1, w2) WHERE w1 IN (SELECT w1 FROM pmf_ende) AND w1 IN (SELECT w1 FROM pmf_alt)"""


def union(x: Fixtures) -> DataFrame:
    return evaluate.union_support(*x.expert_list())


@query("""SELECT w1, round(sum(CASE WHEN p > 1e-7 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 1e-7 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 / ln(2), 6) AS jsd FROM union_v GROUP BY w1""", union_v=UNION)
def eval_jsd(x):
    return rounded(evaluate.jensen_shannon(union(x)), "jsd")


def _ranks(rows: str, by: str, x: str, y: str) -> str:
    one = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY round({c}, 12)) + (count(*) OVER (PARTITION BY {by}, round({c}, 12)) - 1) / 2"
    return f"SELECT *, {one(x)} AS rx, {one(y)} AS ry FROM {rows}"


@query("SELECT w1, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) END AS spearman, count(*) AS n FROM ranks_v GROUP BY w1", union_v=UNION, ranks_v=_ranks("union_v", "w1", "p", "q"))
def eval_spearman(x):
    return rounded(evaluate.spearman(union(x), "p", "q", ["w1"]), "spearman")


#: Gold and method scores of dictionary pairs.
SCORES = "SELECT w1, w2, c.score AS gold, t.score AS score FROM (SELECT DISTINCT w1, w2 FROM lex_ende) JOIN cue_ende c USING (w1, w2) JOIN ti_ende t USING (w1, w2)"


def score_pairs(x: Fixtures) -> DataFrame:
    pairs = x.pairs("en", "de").distinct()
    return evaluate.score_pairs(x.cue().join(pairs, ["w1", "w2"], "left_semi"), topics.ti(x.counts(), "en", "de", topics=list(range(8))))


KENDALL = """SELECT s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS kendall, n FROM (SELECT count(*) AS n FROM scores_v)
    CROSS JOIN (SELECT coalesce(sum(sign(round(b.gold, 12) - round(a.gold, 12)) * sign(round(b.score, 12) - round(a.score, 12))), 0) AS s FROM scores_v a JOIN scores_v b ON round(a.gold, 12) < round(b.gold, 12))
    CROSS JOIN (SELECT sum(c * (c - 1) / 2) AS tx FROM (SELECT count(*) AS c FROM scores_v GROUP BY round(gold, 12))) CROSS JOIN (SELECT sum(c * (c - 1) / 2) AS ty FROM (SELECT count(*) AS c FROM scores_v GROUP BY round(score, 12)))"""


@query("SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM ranks_v", scores_v=SCORES, ranks_v=_ranks("scores_v", "0", "gold", "score"))
def corr_spearman(x):
    return rounded(evaluate.spearman(score_pairs(x), "gold", "score"), "spearman")


@query("SELECT round(corr(gold, score), 6) AS pearson, count(*) AS n FROM scores_v", scores_v=SCORES)
def corr_pearson(x):
    return rounded(evaluate.pearson(score_pairs(x), "gold", "score"), "pearson")


@query("SELECT round(kendall, 6) AS kendall, n FROM kendall_v", scores_v=SCORES, kendall_v=KENDALL)
def corr_kendall(x):
    return rounded(evaluate.kendall(score_pairs(x), "gold", "score"), "kendall")


@query("""SELECT round(kendall, 6) AS kendall, n, pearson, spearman FROM kendall_v CROSS JOIN (SELECT round(corr(gold, score), 6) AS pearson FROM scores_v) CROSS JOIN (SELECT round(corr(rx, ry), 6) AS spearman FROM ranks_v)""",
    scores_v=SCORES, kendall_v=KENDALL, ranks_v=_ranks("scores_v", "0", "gold", "score"))
def eval_scores(x):
    s = score_pairs(x)
    row = evaluate.kendall(s, "gold", "score").crossJoin(evaluate.pearson(s, "gold", "score").select("pearson")).crossJoin(evaluate.spearman(s, "gold", "score").select("spearman"))
    return rounded(row, "kendall", "pearson", "spearman")


@query()
def corr_p_values(x):
    """The three correlations with their p-values."""
    return rounded(evaluate.correlations(score_pairs(x), "gold", "score"), "value", "p")


# ---- agreement

AO = "SELECT a.coder AS c1, b.coder AS c2, avg((a.label = b.label)::int) AS ao FROM annotations a JOIN annotations b ON a.item = b.item AND a.coder < b.coder GROUP BY ALL"


@query("SELECT coder, item, label FROM (SELECT 'a' AS coder, doc_id::varchar AS item, q::varchar AS label FROM n_v UNION ALL SELECT 'b', doc_id::varchar, t::varchar FROM n_v)", n_v="SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id")
def annot_load(x):
    rows = x.table("labels").groupBy("doc_id").agg((F.max("quality") + 0.5).alias("x"), (F.max("toxic") + 0.25).alias("y"))
    return agreement.of_numbers(rows.withColumnRenamed("doc_id", "item")).select("coder", "item", F.col("labels")[0].alias("label"))


PARTLY = "SELECT * FROM annotations WHERE coder <> 'c' OR item IN (SELECT item FROM annotations WHERE coder = 'a' AND label = '1')"


def partly(x: Fixtures) -> DataFrame:
    """Coder c only saw what coder a likes."""
    data = x.annotations()
    liked = data.where("coder = 'a' AND labels[0] = '1'").select("item")
    return data.where("coder <> 'c'").unionByName(data.where("coder = 'c'").join(liked, "item", "left_semi").select("item", "coder", "labels"))


@query("SELECT coder, item, label FROM partly_v WHERE item IN (SELECT item FROM partly_v GROUP BY item HAVING count(*) = 3)", partly_v=PARTLY)
def annot_sanitize(x):
    return agreement.sanitised(partly(x)).select("coder", "item", F.col("labels")[0].alias("label"))


@query("SELECT round(avg(ao), 6) AS ao FROM ao_v", ao_v=AO)
def agree_observed(x):
    return rounded(agreement.observed(x.annotations()), "ao")


@query("SELECT round((ao - 1 / k) / (1 - 1 / k), 6) AS s FROM (SELECT avg(ao) AS ao FROM ao_v) CROSS JOIN (SELECT count(DISTINCT label) AS k FROM annotations)", ao_v=AO)
def agree_s(x):
    return rounded(agreement.s(x.annotations()), "s")


@query("""SELECT round((ao - ae) / (1 - ae), 6) AS pi FROM (SELECT avg(ao) AS ao FROM ao_v) CROSS JOIN (SELECT sum(n * n) / (4.0::double * i * i) AS ae FROM (SELECT count(*) AS n FROM two_v GROUP BY label) CROSS JOIN (SELECT count(DISTINCT item) AS i FROM two_v) GROUP BY i)""",
    two_v="SELECT * FROM annotations WHERE coder IN ('a', 'b')", ao_v=AO.replace("annotations", "two_v"))
def agree_pi(x):
    return rounded(agreement.pi(agreement.annotations(x.annotations(), include=["a", "b"])), "pi")


@query("""SELECT round(avg((ao - coalesce(ae, 0)) / (1 - coalesce(ae, 0))), 6) AS kappa FROM ao_v LEFT JOIN (SELECT a.coder AS c1, b.coder AS c2, sum(a.s * b.s) AS ae FROM share_v a JOIN share_v b ON a.label = b.label AND a.coder < b.coder GROUP BY ALL) USING (c1, c2)""",
    ao_v=AO, share_v="SELECT coder, label, count(*) / (SELECT count(DISTINCT item) FROM annotations) AS s FROM annotations GROUP BY ALL")
def agree_kappa(x):
    return rounded(agreement.kappa(x.annotations()), "kappa")


@query("""SELECT round(1 - (d_o / (i * c * (c - 1))) / (d_e / (i * c * (i * c - 1))), 6) AS alpha FROM (SELECT count(DISTINCT item) AS i, count(DISTINCT coder) AS c FROM annotations)
    CROSS JOIN (SELECT sum(a.n * b.n) AS d_e FROM kind_v a JOIN kind_v b ON a.label <> b.label) CROSS JOIN (SELECT sum(a.n * b.n) AS d_o FROM per_v a JOIN per_v b ON a.item = b.item AND a.label <> b.label)""",
    kind_v="SELECT label, count(*) AS n FROM annotations GROUP BY label", per_v="SELECT item, label, count(*) AS n FROM annotations GROUP BY ALL")
def agree_alpha(x):
    return rounded(agreement.alpha(x.annotations()), "alpha")


def _sets(x: Fixtures) -> DataFrame:
    q = x.table("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    return q.select(F.col("doc_id").alias("i"), F.array(F.concat(F.lit("q"), "q"), F.concat(F.lit("t"), "t")).alias("labels"))


SET = "SELECT doc_id AS i, ['q' || max(quality), 't' || max(toxic)] AS labels FROM labels GROUP BY doc_id"


@query("""SELECT count(*) AS n, round(avg(1 - len(list_intersect(a.labels, b.labels)) / greatest(len(a.labels), len(b.labels))), 6) AS masi, round(avg((list_sort(a.labels) <> list_sort(b.labels))::int), 6) AS binary,
    round(avg(power(len(list_filter(a.labels, lambda v: NOT list_contains(b.labels, v))), 2)), 6) AS interval FROM set_v a JOIN set_v b ON a.i < b.i""", set_v=SET)
def avg_label_distance(x):
    sets = _sets(x)
    out = None
    for name in ("masi", "binary", "interval"):
        one = agreement.average_distance(sets, vectors.DISTANCES[name]).withColumnRenamed("avg_distance", name)
        out = one if out is None else out.crossJoin(one.drop("n"))
    return rounded(out, "masi", "binary", "interval")


# ---- reports

RUNS = "SELECT r_name AS key, n_nationkey / 100 AS mrr, (n_nationkey % 7) / 10 AS p1, (n_nationkey % 9) / 10 AS p5, length(n_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey"


def section_lines(x: Fixtures) -> DataFrame:
    """A report with a section for each region and a run for each nation."""
    region, nation = x.table("region"), x.table("nation")
    heads = region.select((F.col("r_regionkey") * 1000).alias("line"), F.regexp_replace("r_name", " ", "_").alias("value"))
    key = F.col("n_nationkey")
    runs = nation.select((F.col("n_regionkey") * 1000 + 1 + key).alias("line"), F.concat_ws(" ", key / 100, (key % 7) / 10, (key % 9) / 10, F.length("n_name")).alias("value"))
    note = region.select((F.col("r_regionkey") * 1000 + 500).alias("line"), F.lit("# note").alias("value"))
    return heads.unionByName(runs).unionByName(note)


@query("SELECT replace(key, ' ', '_') AS key, mrr, p1, p5, n FROM runs_v", runs_v=RUNS)
def eval_sections(x):
    return reports.sections(section_lines(x))


@query("SELECT replace(key, ' ', '_') AS key, round(avg(mrr), 6) AS mrr, round(avg(p1), 6) AS p1, round(avg(p5), 6) AS p5 FROM runs_v GROUP BY key", runs_v=RUNS)
def eval_by_size(x):
    return rounded(reports.by_key(reports.sections(section_lines(x))), "mrr", "p1", "p5")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("SELECT l1, " + ", ".join(f"""round(stddev_pop(mrr) FILTER (r_name = '{r}'), 4) AS "{r}\"""" for r in REGIONS) + " FROM pair_v GROUP BY l1",
    pair_v="SELECT a.r_name AS l1, b.r_name, s_acctbal AS mrr FROM region a CROSS JOIN supplier JOIN nation ON n_nationkey = s_nationkey JOIN region b ON b.r_regionkey = n_regionkey WHERE a.r_regionkey <= b.r_regionkey")
def eval_pivot(x):
    """Deviations by language pair as a table; regions stand for languages here and balances for the metric."""
    return rounded(reports.pair_table(pair_runs(x), "mrr", REGIONS), *REGIONS, digits=4)


@query("SELECT a.r_name AS l1, b.r_name AS l2, " + ", ".join(f"round({f}({v}), 4) AS {n}_{m}" for m, v in (("mrr", "s_acctbal"), ("p1", "s_acctbal / 2"), ("p5", "s_suppkey")) for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + """
    FROM region a CROSS JOIN supplier JOIN nation ON n_nationkey = s_nationkey JOIN region b ON b.r_regionkey = n_regionkey WHERE a.r_regionkey <= b.r_regionkey GROUP BY ALL""")
def eval_list(x):
    """Means and deviations by language pair as a list."""
    found = reports.pair_list(pair_runs(x))
    return rounded(found, *[c for c in found.columns if c not in ("l1", "l2")], digits=4)


def pair_runs(x: Fixtures) -> DataFrame:
    """Runs (l1, l2, mrr, p1, p5) of pairs of regions, numbers of suppliers in place of metrics."""
    a = x.table("region").select(F.col("r_name").alias("l1"), F.col("r_regionkey").alias("k1"))
    b = x.table("region").select(F.col("r_name").alias("l2"), F.col("r_regionkey").alias("k2"))
    s = x.table("supplier").join(x.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(b, F.col("k2") == F.col("n_regionkey")).select("l2", "k2", F.col("s_acctbal").cast("double").alias("mrr"), (F.col("s_acctbal").cast("double") / 2).alias("p1"), F.col("s_suppkey").cast("double").alias("p5"))
    return s.join(F.broadcast(a), F.col("k1") <= F.col("k2"))
