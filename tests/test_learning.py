"""Learners in any partitioning, many jobs at once, places and running scans by ranges, inversions, named files."""

import gzip
import math
import os
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import exact
from lexiloom.operators import evaluate, experts, inversions, jobs, learn, ranks, reports
from lexiloom.plans import evaluation_queries
from lexiloom.sources import files, named, shared


def training(spark, n=300, jobs_n=1):
    r = np.random.default_rng(4)
    rows = [(k % jobs_n, f"s{k}", "t", r.random(2).tolist(), r.random(3).tolist(), r.random(3).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "job int, w1 string, w2 string, b array<double>, f array<double>, x array<double>")


def test_learners_do_not_depend_on_partitions(spark):
    """The same digits, not just nearly, from one partition and from seven in another order."""
    table = training(spark)
    one, other = table.coalesce(1), table.orderBy(F.rand(3)).repartition(7)
    assert learn.learn_em(one, 2, start=[0.5, 0.5]) == learn.learn_em(other, 2, start=[0.5, 0.5])
    phi = [F.col("f")[k] for k in range(3)]
    assert learn.learn_fine(one, phi, 2, steps=5) == learn.learn_fine(other, phi, 2, steps=5)
    assert learn.learn_cluster(one, 2, 2, 3, most=25) == learn.learn_cluster(other, 2, 2, 3, most=25)


def test_few_rows_take_all_steps_in_their_task(spark, monkeypatch):
    """No pass for each step where all rows are one task's, and the same digits as by passes."""
    table = training(spark)
    phi = [F.col("f")[k] for k in range(3)]
    learners = [lambda: learn.learn_fine(table, phi, 2), lambda: learn.learn_cluster(table, 2, 2, 3, most=25), lambda: learn.learn_cluster(table.where("false"), 2, 2, 3)]
    passes, before = [], learn.sums_of
    monkeypatch.setattr(learn, "sums_of", lambda *a: passes.append(1) or before(*a))
    together = [f() for f in learners]
    assert not passes
    monkeypatch.setattr(learn, "ROWS_A_TASK", 40)
    assert [f() for f in learners[:2]] == together[:2] and len(passes) > 20
    assert together[2][2] == [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0]]


def test_exact_arithmetic():
    r = np.random.default_rng(0)
    v = r.random(1000) * 10.0 ** r.integers(-12, 3, 1000)
    assert exact.units(v) == exact.units(v[r.permutation(1000)])
    assert math.isclose(exact.value(*exact.units(v)), math.fsum(v), rel_tol=1e-15)
    assert math.isclose(exact.value(*exact.units(-v)), -math.fsum(v), rel_tol=1e-15)
    t = np.concatenate([[0.0, 1e-13, 31.99999, 32.0, 699.9, 700.0, 1e12], r.random(2000) * 40, r.random(2000) * 1e-6])
    assert np.allclose(exact.decay(t[t < 700]), np.exp(-t[t < 700]), rtol=2e-15, atol=0) and (exact.decay(t[t >= 700]) == 0).all()
    assert exact.decay(np.array([1e-13]))[0] < 1.0


def test_many_jobs_are_one_run(spark, monkeypatch):
    """A step of many jobs is one pass, and each job's weights are those that it gets alone."""
    table = training(spark, 240, 8)
    steps = []
    before = learn.sums_of
    monkeypatch.setattr(learn, "sums_of", lambda rows, weights, values: steps.append(len(weights)) or before(rows, weights, values))
    together = learn.learn_em_jobs(table, 2, [*range(8), 9], restarts=3)
    passes = len(steps)
    assert together[9] == pytest.approx([sum(learn.dirichlet(2, seed=0)[j:j + 1]) for j in range(2)])  # no rows: as it started
    assert steps[0] == 27 and min(steps) < 24 < max(steps)  # settled runs drop out
    alone = []
    for k in range(2):
        steps.clear()
        assert learn.learn_em(table.where(F.col("job") == k), 2, restarts=3) == together[k]
        alone.append(len(steps))
    assert passes < 2 * max(alone)


def test_grid_counts_are_ranks(spark):
    """Ranks by counting against sorting all candidates at each point."""
    r = random.Random(1)
    rows = [(f"s{a}", f"t{b}", [r.randint(0, 4) / 10, r.randint(0, 4) / 10]) for a in range(6) for b in range(12)]
    gold = [(j, f"s{r.randint(0, 7)}", f"t{r.randint(0, 14)}") for j in range(3) for _ in range(9)]
    got = learn.grid_scores(spark.createDataFrame(rows, "w1 string, w2 string, b array<double>"), spark.createDataFrame(gold, "job int, w1 string, w2 string"), 2, 20, ["job"])
    seen = {(x["job"], x["grid_id"]): x["mrr"] for x in got.collect()}
    for job in range(3):
        for k, eps in learn.grid(2):
            rr = []
            for w in sorted({w1 for j, w1, _ in gold if j == job}):
                ranked = sorted((c for c in rows if c[0] == w), key=lambda c: (-round(c[2][0] * eps[0] + c[2][1] * eps[1], 12), c[1]))
                places = [i + 1 for i, c in enumerate(ranked) if (job, w, c[1]) in gold]
                rr.append(1 / places[0] if places else 1 / 20)
            assert math.isclose(seen[job, k], sum(rr) / len(rr), abs_tol=1e-9)


def test_places_and_ranks_by_ranges(spark):
    r = random.Random(7)
    rows = [(g, v, k) for g in ("a", None, "b") for k, v in enumerate([r.choice([1.0, 2.5, None, 2.5, r.random() * 9]) for _ in range(200)])]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = ranks.average_ranks(df, "v", "rank", ["g"], ranges=7).collect()
    assert len(got) == len(rows)
    for g in ("a", None, "b"):
        values = [-1.0 if v is None else v for h, v, _ in rows if h == g]
        want = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
        assert all(x["rank"] == want[-1.0 if x["v"] is None else x["v"]] for x in got if x["g"] == g)
    placed = ranks.numbered(df.where("v IS NOT NULL"), ["g"], F.col("v"), ["v", "k"], ranges=5).collect()
    for g in ("a", None, "b"):
        mine = sorted((x for x in placed if x["g"] == g), key=lambda x: x["place"])
        assert [x["place"] for x in mine] == list(range(1, len(mine) + 1)) and [(x["v"], x["k"]) for x in mine] == sorted((x["v"], x["k"]) for x in mine)
    plan = ranks.average_ranks(df, "v", "rank")._jdf.queryExecution().executedPlan().toString()
    assert ranks.average_ranks(df.where("false"), "v", "rank").count() == 0 and "SinglePartition, ENSURE" not in plan.split("Window")[0]


def test_ranks_of_small_groups_share_a_shuffle(spark, monkeypatch):
    """Correlations of groups that are sorted whole are those by ranges, with ties and nulls, and all sorts lie on one shuffle."""
    r = random.Random(11)
    rows = [(g, r.choice([None, 0.5, 0.5 + 1e-14, r.random()]), r.choice([1.0, 2.0, r.random()])) for g in ("a", None, "b") for _ in range(60)] + [("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    small = {x["g"]: (x["spearman"], x["n"]) for x in evaluate.spearman(df, "x", "y", ["g"]).collect()}
    plan = evaluate.spearman(df, "x", "y", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Join") == 0
    monkeypatch.setattr(ranks, "GROUP", 50)
    large = {x["g"]: (x["spearman"], x["n"]) for x in evaluate.spearman(df, "x", "y", ["g"]).collect()}
    assert small.keys() == large.keys() == {"a", None, "b", "c"} and small["c"] == (None, 1)
    assert all(n == large[g][1] and (v is None) == (large[g][0] is None) and (v is None or math.isclose(v, large[g][0], abs_tol=1e-12)) for g, (v, n) in small.items())


def test_scans_over_block_borders(spark, tmp_path):
    r = random.Random(3)
    lines = [r.choice(["en-de", "# x", "", "0.5 0.25 0.75 3", "0.1 0.2 0.3 4", "0.1 0.2 0.3 4"]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string").repartition(5)
    last = ranks.running(df, "line", F.when(F.length("value") == 5, F.concat_ws("", "value", "line")), "last", "key", block=7).collect()
    count = ranks.running(df, "line", F.when(F.col("value") != "", 1), "count", "i", block=7).collect()
    key, n, wanted = None, 0, {}
    for k, value in enumerate(lines):
        key = f"{value}{k}" if len(value) == 5 else key
        wanted[k] = (key, n)
        n += value != ""
    assert {x["line"]: x["key"] for x in last} == {k: v[0] for k, v in wanted.items()}
    assert {x["line"]: x["i"] for x in count} == {k: v[1] for k, v in wanted.items()}
    rows = reports.sections(df).collect()
    assert len(rows) == sum(len(x.split()) == 4 for x in lines)
    blocks = [x for k in range(300) for x in (f"b{k}", f"a{k} c{k}", "", f"d{k}")]
    got = files.label_block_lines(spark.createDataFrame(list(enumerate(blocks)), "line int, value string")).collect()
    assert sorted((x["block"], x["l1_labels"], x["l2_labels"]) for x in got) == [(k, [f"a{k}", f"c{k}"], [f"d{k}"]) for k in range(300)]


@pytest.mark.parametrize("local", [7, 60, 10_000])
def test_kendall_by_inversions(spark, local):
    """All pairs of points with frequent values, against a double loop; ranges of few points, of many and one of all."""
    r = random.Random(local)
    points = list({(r.choice([0.0, 0.5, r.randint(0, 20)]), r.choice([1.0, r.randint(-9, 9)])): r.randint(1, 5) for _ in range(180)}.items())
    df = spark.createDataFrame([(float(x), float(y), c) for (x, y), c in points] + [(None, 1.0, 3), (1.0, None, 2)], "x double, y double, c long")
    sign = lambda v: (v > 0) - (v < 0)
    want = sum(sign(a[0][0] - b[0][0]) * sign(a[0][1] - b[0][1]) * a[1] * b[1] for i, a in enumerate(points) for b in points[:i])
    assert inversions.signed_pairs(df, local).first()["s"] == want
    assert inversions.signed_pairs(df.where("false"), local).first()["s"] == 0


def test_kendall_of_many_points(spark):
    """Against the number of inversions of a permutation, which a merge sort counts."""
    n = 60_000
    y = np.random.default_rng(2).permutation(n)
    df = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate(y.tolist())], "x double, y double")

    def inverted(v):
        if len(v) < 2:
            return v, 0
        (a, i), (b, j) = inverted(v[: len(v) // 2]), inverted(v[len(v) // 2 :])
        return np.sort(np.concatenate([a, b])), i + j + int((len(a) - np.searchsorted(a, b)).sum())

    pairs = n * (n - 1) // 2
    assert math.isclose(evaluate.kendall(df, "x", "y").first()["kendall"], (pairs - 2 * inverted(y)[1]) / pairs, rel_tol=1e-12)


def test_named_files(spark, tmp_path):
    base = str(tmp_path / "out")
    files.write_document_files(spark.createDataFrame([("d1", "some text"), ("d 2", "more"), ("d3", None)], "doc_id string, text string"), base)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"d1": "some text\n", "d 2": "more\n", "d3": ""}
    splits = learn.splits(spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(10)], "w1 string, w2 string"), 4, 3)
    files.write_split_files(splits, base + "/splits", "en-de")
    assert {str(p.relative_to(tmp_path / "out" / "splits")) for p in (tmp_path / "out" / "splits").rglob("*.gold")} == {f"{k}/en-de.{e}.gold" for k in range(3) for e in ("tr", "ts")}
    assert sorted(map(tuple, files.split_files(spark, base + "/splits", "en-de").select(splits.columns).collect())) == sorted(map(tuple, splits.collect()))
    latent = ([[0.5, 0.5], [0.1, 0.9]], [0.3, 0.7])
    files.write_latent(spark, *latent, base + "/latent", ["arts", "law"])
    assert (tmp_path / "out" / "latent").read_text() == "E=2\tT=2\n0.5 0.5\n0.1 0.9\narts\t0.3\nlaw\t0.7\n"
    assert files.named_latent(spark, base + "/latent") == (*latent, ["arts", "law"]) and files.latent(spark, base + "/latent") == latent
    matrix = spark.createDataFrame([(2, "d", 3), (1, "e", 1), (1, "d", 2)], "wid long, did string, n long")
    files.write_matrix(matrix, base + "/matrix")
    assert (tmp_path / "out" / "matrix").read_text() == "1 d 2\n1 e 1\n2 d 3\n"
    assert sorted(map(tuple, files.matrix(spark, base + "/matrix").collect())) == sorted(map(tuple, matrix.collect()))
    pmfs = spark.createDataFrame([(base + "/x.gz", "s", "t", 0.75, 1), (base + "/x.gz", "s", "u", 0.25, 2), (base + "/y", "a", "t", 1.0, 1)], "path string, w1 string, w2 string, p double, rk int")
    files.write_pmfs(pmfs)
    assert gzip.decompress((tmp_path / "out" / "x.gz").read_bytes()).decode() == "s\tt 0.75\tu 0.25\n" and (tmp_path / "out" / "y").read_text() == "a\tt 1.0\n"
    assert sorted(map(tuple, files.pmf(spark, base + "/x.gz").select("w1", "w2", "p", "rk").collect())) == [("s", "t", 0.75, 1), ("s", "u", 0.25, 2)]


def test_matrix_is_one_sorted_file_in_pieces(spark, tmp_path, monkeypatch):
    """The writer gets pieces of many lines, not each line by itself, and the file is sorted by numbers all the same."""
    handed = []
    monkeypatch.setattr(files, "write_named", lambda rows, *order: (handed.append(rows.count()), named.write_named(rows, *order)))
    rows = spark.range(5000).selectExpr("id * 7919 % 1013 AS wid", "id AS did", "id % 3 AS n")
    files.write_matrix(rows.repartition(7), str(tmp_path / "matrix"))
    assert (tmp_path / "matrix").read_text() == "".join(f"{w} {d} {n}\n" for w, d, n in sorted(map(tuple, rows.collect())))
    assert 0 < handed[0] < 200


def test_failed_write_leaves_no_file(spark, tmp_path):
    """A row that cannot be written takes all files of the job with it, and what stood there before stays."""
    (tmp_path / "a").write_text("old")
    rows = spark.createDataFrame([(str(tmp_path / "a"), 0, "new"), (str(tmp_path / "b"), 0, "x"), (str(tmp_path / "a" / "under" / "a"), 0, "a file is no folder")], "path string, k int, value string")
    with pytest.raises(Exception):  # noqa: B017
        named.write_named(rows, "k")
    assert {p.name for p in tmp_path.iterdir()} == {"a"} and (tmp_path / "a").read_text() == "old"


def test_job_list_is_one_plan(spark, tmp_path):
    """Jobs that share files and words, each to its own paths; weights equal those of each job alone."""
    pmf = lambda rows: spark.createDataFrame(rows, "w1 string, w2 string, p double")
    e = experts.union_of([pmf([("s", "t", 0.9), ("s", "u", 0.1), ("v", "t", 1.0)]), pmf([("s", "t", 0.2), ("s", "u", 0.8)])])
    vocab = spark.createDataFrame([("t",), ("u",)], "word string")
    (tmp_path / "tr0").write_text("s t\nv t\n")
    (tmp_path / "tr 1").write_text("s u\n")
    (tmp_path / "ts").write_text("x s\ny v\nz\n")
    (tmp_path / "tr+1").write_text("s u\n")
    lines = [f"{tmp_path}/ts 2 {tmp_path}/{tr} {l1} de {tmp_path}/out{k}.gz {tmp_path}/eps{k}" for k, (tr, l1) in enumerate([("tr0", "en"), ("tr+1", "en"), ("tr0", "fr"), ("tr0", "en")])]
    (tmp_path / "jobs").write_text("\n".join(lines) + "\n")
    for learner in ("EM", "GRID"):
        done = dict(jobs.run(spark, str(tmp_path / "jobs"), lambda a, b: (e, 2, vocab), learner, mass=1.0))
        assert sorted(done) == [0, 1, 2, 3] and done[0] == done[2] == done[3] and done[1][1] > done[0][1]
        assert [float(x) for x in (tmp_path / "eps1").read_text().split()] == done[1]
        got = {k: sorted(map(tuple, files.pmf(spark, f"{tmp_path}/out{k}.gz").collect())) for k in range(4)}
        assert got[0] == got[2] == got[3] != got[1] and {r[0] for r in got[1]} == {"s", "v"}


def test_held_tables_go(spark):
    there = lambda: {x for x in os.listdir(shared.folder(spark).removeprefix("file://")) if x.startswith("written-")}
    with shared.held(spark.range(5), spark.range(3)) as (a, b):
        before = there()
        assert a.count() == 5 and b.count() == 3
    assert len(before - there()) == 2
    with pytest.raises(ZeroDivisionError), shared.held(spark.range(2)):
        before = there()
        1 / 0  # noqa: B018
    assert len(before - there()) == 1


def test_splits_without_training_rows_have_no_weights(spark):
    """As in SQL: the only pair that the experts have is trained on in some splits only."""
    pairs = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(12)], "w1 string, w2 string")
    trained = {}
    for r in learn.splits(pairs, 100, 3).where("part = 'train'").collect():
        trained.setdefault((r["w1"], r["w2"]), set()).add(r["split_id"])
    (w1, w2), want = next((k, v) for k, v in sorted(trained.items()) if len(v) < 3)
    one = lambda p: spark.createDataFrame([(w1, w2, p, 1)], "w1 string, w2 string, p double, rk int")
    x = types.SimpleNamespace(spark=spark, pairs=lambda *_: pairs, expert_list=lambda: [one(0.75), one(0.25)])
    rows = evaluation_queries.cv_weights(x).collect()
    assert {(r["split_id"], r["j"]) for r in rows} == {(k, j) for k in want for j in range(2)}
    assert all((r["e"] > 0.9) == (r["j"] == 0) for r in rows)
