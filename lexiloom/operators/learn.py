"""Learning the weights of experts: EM, grid search, EM with categories, EM with a gate; and train/test splits.

Training data is pivoted once to a row per pair with an array of the experts' probabilities, and written. A step of any number of
jobs is one pass over it (categories and clusters over rows of a single task take all their steps in it): tasks work on Arrow batches, and their sums, a few numbers for each job, are added up by key; only these
reach the driver. Sums are whole numbers of 2**-60, so that they and all that follows from them are the same in any order and
partitioning of the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.exact import HALF, settled
from ..functions.tails import dirichlet
from ..sources import shared
from . import ranks

def training_table(pairs: DataFrame, experts: DataFrame, n_experts: int, by: list[str] | None = None) -> DataFrame:
    """(by, w1, w2, b): b[j] is p_j(w2 | w1) to 27 bits, 0 where expert j lacks it; pairs that no expert has are dropped.
    Few pairs are sent to the experts, whose rows are not shuffled then."""
    p = [settled(F.coalesce(F.sum(F.when(F.col("j") == j, F.col("p"))), F.lit(0.0))) for j in range(n_experts)]
    return shared.hinted(pairs).join(experts, ["w1", "w2"]).groupBy(*(by or []), "w1", "w2").agg(F.array(*p).alias("b"))


#: Training rows that a task of a step reads at least.
ROWS_A_TASK = 50_000


@contextmanager
def _held(table: DataFrame) -> Iterator[tuple[DataFrame, bool]]:
    """(table held in as few tasks as its rows need, whether that is a single one)."""
    with shared.held(table) as (rows,):
        tasks = max(1, rows.count() // ROWS_A_TASK)
        yield rows.coalesce(tasks), tasks == 1


# ---- steps

#: What a step makes of its rows: their columns as matrices and the parameters go in, named vectors to be summed come out.
Values = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


#: Sums of a value of a run of a job in whole units, by (job, run, name).
Units = dict[tuple[int, int, str], list[int]]


def _units_in(batches: Iterable[pa.RecordBatch], weights: dict[tuple[int, int], list[float]], values: Values) -> Units:
    """The sums of values(columns, w) of each run of a job over batches (job, arrays...), and of their rows under the name ""."""
    runs: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (job, run), w in weights.items():
        runs.setdefault(job, []).append((run, np.array(w, float)))
    sums: Units = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        every = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.schema.names if c != "job"}
        jobs = batch.column("job").to_numpy()
        for job in np.unique(jobs).tolist():
            mine = jobs == job
            held = {c: v[mine] for c, v in every.items()}
            for run, w in runs.get(job, ()):
                for name, v in {"": np.full(int(mine.sum()), HALF), **values(held, w)}.items():
                    whole, rest = exact.units(v)
                    at = sums.setdefault((job, run, name), [0, 0])
                    at[0] += whole
                    at[1] += rest
    return sums


def _of_units(sums: Units) -> dict[tuple[int, int], tuple[int, dict[str, float]]]:
    """(number of rows, sums) of each run of a job."""
    out: dict[tuple[int, int], tuple[int, dict[str, float]]] = {}
    for (job, run, name), (whole, rest) in sums.items():
        n, found = out.get((job, run), (0, {}))
        if name:
            found[name] = exact.value(whole, rest)
        out[job, run] = (n if name else whole, found)
    return out


def sums_of(rows: DataFrame, weights: dict[tuple[int, int], list[float]], values: Values) -> dict[tuple[int, int], tuple[int, dict[str, float]]]:
    """(number of rows, sums of values(columns, w)) of each run of a job in rows (job, arrays...), all in one pass.

    A task sends its sums in whole units, two numbers for each run and value, which are added up by key: the digits of a sum are the
    same in any partitioning.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _units_in(batches, weights, values)
        if sums:
            names = [pa.array(c, t) for c, t in zip(zip(*sums, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(c, pa.int64()) for c in zip(*sums.values(), strict=True))], ["job", "run", "name", "whole", "rest"])

    # the jobs that are still open are as many as fit the driver's table of them
    jobs = sorted({job for job, _ in weights})
    found = rows.where(F.col("job").isin(jobs)).mapInArrow(step, "job int, run int, name string, whole long, rest long").groupBy("job", "run", "name").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest"))
    return _of_units({(r["job"], r["run"], r["name"]): [r["whole"], r["rest"]] for r in found.collect()})  # a row for each run and value


def _flat(x) -> list[float]:
    return [v for part in x for v in (_flat(part) if isinstance(part, list) else [part])]


def settle(rows: DataFrame, states: dict[tuple[int, int], tuple], weights: Callable, values: Values, update: Callable, change: float = 1e-3, most: int = 500, steps: int | None = None, together: bool = False) -> dict[tuple[int, int], tuple]:
    """The states of all runs of all jobs after updates until the first part of each moves by less than `change`, or after so many
    steps. Runs that have settled drop out of the next step. A job without rows stays as it is. Rows that lie together in one task
    take all their steps there, with the same sums; else every step is a pass of its own."""
    def taken(sums: Callable) -> dict[tuple[int, int], tuple]:
        open_, done = dict(states), {}
        for _ in range(most if steps is None else steps):
            if not open_:
                break
            found = sums({k: weights(*state) for k, state in open_.items()})
            for key, state in list(open_.items()):
                new = update(state, *found[key]) if key in found else state
                open_[key] = new
                if steps is None and math.dist(_flat(state[0]), _flat(new[0])) < change:
                    done[key] = open_.pop(key)
        return {**done, **open_}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        found = taken(lambda w: _of_units(_units_in(held, w, values)))
        columns = zip(*((job, run, json.dumps(state)) for (job, run), state in found.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["job", "run", "state"])

    if not together or not states:
        return taken(lambda w: sums_of(rows, w, values))
    found = rows.mapInArrow(run, "job int, run int, state string").collect()  # a row for each run
    return {**states, **{(r["job"], r["run"]): tuple(json.loads(r["state"])) for r in found}}


def _folded(parts: list):
    """The sum of numbers or vectors from the first to the last, each rounded; sum() corrects its roundings, which other engines don't."""
    return reduce(add, parts)


def _over(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x over whole, 0 where that is 0."""
    return np.divide(x, whole, out=np.zeros_like(x), where=whole != 0)


# ---- weights of experts


def _shares(held: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
    parts = [held["b"][:, j] * w[j] for j in range(len(w))]
    whole = _folded(parts)
    return {f"s{j}": _over(x, whole) for j, x in enumerate(parts)}


def _mean_shares(state: tuple, n: int, sums: dict[str, float]) -> tuple:
    shares = [sums[f"s{j}"] for j in range(len(sums))]
    whole = _folded(shares)
    return ([s / whole for s in shares],) if whole else state


def _one(table: DataFrame) -> DataFrame:
    return table.withColumn("job", F.lit(0))


def em_step(table: DataFrame, eps: list[float]) -> list[float]:
    """One update of the weights: the mean share of each expert in the pairs."""
    found = sums_of(_one(table.select("b")), {(0, 0): eps}, _shares)
    return _mean_shares((list(eps),), *found[0, 0])[0] if found else list(eps)


def _chances(held: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
    whole = _folded([held["b"][:, j] * w[j] for j in range(len(w))])
    return {"none": (whole <= 0).astype(float), "ln": np.log(np.where(whole > 0, whole, 1.0))}


def log_likelihoods(rows: DataFrame, weights: dict[tuple[int, int], list[float]]) -> dict[tuple[int, int], float]:
    """Sum of ln of the mixture's probability of each pair, for each run of a job; -99999 if a pair has none."""
    found = sums_of(rows, weights, _chances)
    return {k: (-99999.0 if found[k][1]["none"] else found[k][1]["ln"]) if k in found else 0.0 for k in weights}


def log_likelihood(table: DataFrame, eps: list[float]) -> float:
    """log_likelihoods() of one table and one list of weights."""
    return log_likelihoods(_one(table.select("b")), {(0, 0): eps})[0, 0]


def learn_em_jobs(table: DataFrame, n_experts: int, jobs: list[int], restarts: int = 10, change: float = 1e-3, most: int = 500, steps: int | None = None, start: list[float] | None = None, seed: int = 0) -> dict[int, list[float]]:
    """Weights of every job of table (job, b), all learned at once: of highest likelihood (to 9 digits, then the first) among the
    restarts; with `steps` so many updates, or until settled, from an even or the given start."""
    with _held(table.select("job", "b")) as (rows, _):
        fixed = steps is not None or start is not None
        starts = [start or [1.0 / n_experts] * n_experts] if fixed else [dirichlet(n_experts, seed=seed + k) for k in range(restarts)]
        states = settle(rows, {(job, run): (list(eps),) for job in jobs for run, eps in enumerate(starts)}, lambda eps: eps, _shares, _mean_shares, change, most, steps)
        if len(starts) == 1:
            return {job: states[job, 0][0] for job in jobs}
        found = log_likelihoods(rows, {k: state[0] for k, state in states.items()})
        return {job: states[job, max(range(len(starts)), key=lambda run: (round(found[job, run], 9), -run))][0] for job in jobs}


def learn_em(table: DataFrame, n_experts: int, restarts: int = 10, change: float = 1e-3, most: int = 500, steps: int | None = None, start: list[float] | None = None, seed: int = 0) -> list[float]:
    """learn_em_jobs() of one job."""
    return learn_em_jobs(_one(table), n_experts, [0], restarts, change, most, steps, start, seed)[0]


def grid(n_experts: int, tenths: int = 10) -> list[tuple[int, list[float]]]:
    """(number, weights) of all points of the simplex in steps of a tenth, ascending from the first weight on; whole tenths inside."""
    def points(left: int, n: int):
        if n == 1:
            yield [left]
        else:
            for x in range(left + 1):
                for rest in points(left - x, n - 1):
                    yield [x, *rest]

    return [(i, [x / tenths for x in p]) for i, p in enumerate(points(tenths, n_experts))]


def grid_scores(candidates: DataFrame, gold: DataFrame, n_experts: int, v2: int, by: list[str] | None = None) -> DataFrame:
    """(by, grid_id, eps, mrr) of every grid point: candidates (w1, w2, b), of all jobs alike, by the mixture; gold pairs (by, w1, w2).

    Nothing is ranked. At a grid point the first gold word of a source word is the one of highest score, then of least name, and its
    rank is one more than the number of candidates before it. The gold words' scores at all points are an array of a row per
    source word; candidates are counted against it, and only counts are shuffled.
    """
    by = by or []
    key = [*by, "w1"]
    points = F.broadcast(gold.sparkSession.createDataFrame(grid(n_experts), "grid_id int, eps array<double>"))
    score = lambda eps: F.round(F.aggregate(F.zip_with("b", eps, lambda x, e: x * e), F.lit(0.0), lambda a, x: a + x), 12)
    pairs = gold.select(*by, "w1", "w2").distinct()
    first = pairs.join(candidates, ["w1", "w2"]).crossJoin(points).groupBy(*key, "grid_id", "eps").agg(F.max(score(F.col("eps"))).alias("s"), F.min_by("w2", F.struct(-score(F.col("eps")), "w2")).alias("name"))
    tops = first.groupBy(*key).agg(F.collect_list(F.struct("grid_id", "eps", "s", "name")).alias("tops"))
    mine = score(F.col("t.eps"))
    ahead = (mine > F.col("t.s")) | ((mine == F.col("t.s")) & (F.col("w2") < F.col("t.name")))
    counts = candidates.join(tops, "w1").select(*key, "w2", "b", F.explode("tops").alias("t")).where(ahead).groupBy(*key, "t.grid_id").agg(F.count("*").alias("before"))
    reached = first.select(*key, "grid_id").join(counts, [*key, "grid_id"], "left").select(*key, "grid_id", (1.0 / (1 + F.coalesce("before", F.lit(0)))).alias("rr"))
    words = pairs.select(*key).distinct().crossJoin(points)
    return words.join(reached, [*key, "grid_id"], "left").groupBy(*by, "grid_id").agg(F.avg(F.coalesce("rr", F.lit(1.0 / v2))).alias("mrr"), F.first("eps").alias("eps")).select(*by, "grid_id", "eps", "mrr")


def learn_grid_jobs(candidates: DataFrame, gold: DataFrame, n_experts: int, v2: int) -> dict[int, list[float]]:
    """For each job of gold (job, w1, w2) the grid point of highest mean reciprocal rank, the first of equals."""
    best = grid_scores(candidates, gold, n_experts, v2, ["job"]).groupBy("job").agg(F.max_by("eps", F.struct(F.round("mrr", 12), -F.col("grid_id"))).alias("eps"))
    return {r["job"]: list(r["eps"]) for r in best.collect()}


def learn_grid(candidates: DataFrame, gold: DataFrame, n_experts: int, v2: int) -> list[float]:
    """learn_grid_jobs() of one job."""
    return learn_grid_jobs(candidates, _one(gold), n_experts, v2)[0]


def candidate_table(sources: DataFrame, experts: DataFrame, n_experts: int) -> DataFrame:
    """(w1, w2, b): what each expert gives every candidate of the source words (column w1), 0 where it lacks it."""
    p = [F.coalesce(F.sum(F.when(F.col("j") == j, F.col("p"))), F.lit(0.0)) for j in range(n_experts)]
    return experts.join(sources.select("w1").distinct(), "w1", "left_semi").groupBy("w1", "w2").agg(F.array(*p).alias("b"))


def _by_em(pairs: DataFrame, experts: DataFrame, n_experts: int, v2: int, jobs: list[int]) -> dict[int, list[float]]:
    return learn_em_jobs(training_table(pairs, experts, n_experts, ["job"]), n_experts, jobs)


def _by_grid(pairs: DataFrame, experts: DataFrame, n_experts: int, v2: int, jobs: list[int]) -> dict[int, list[float]]:
    found = learn_grid_jobs(candidate_table(pairs, experts, n_experts), pairs, n_experts, v2)
    return {job: found.get(job, grid(n_experts)[0][1]) for job in jobs}


#: Learners of all jobs' weights by name, from gold pairs (job, w1, w2), experts (j, w1, w2, p), their number, the size of the target
#: vocabulary and the jobs.
LEARNERS = {"EM": _by_em, "GRID": _by_grid}


def learned_weights(learner: str, pairs: DataFrame, experts: DataFrame, n_experts: int, v2: int, jobs: list[int]) -> dict[int, list[float]]:
    """Weights of each job by the learner of that name; any other name means the grid."""
    return LEARNERS.get(learner, LEARNERS["GRID"])(pairs, experts, n_experts, v2, jobs)


# ---- categories


def _fine(k_n: int, j_n: int) -> tuple[Callable, Values, Callable]:
    """(weights, values, update) of rows with b and f, f[k] being p(w1 | category k)."""
    def values(held: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
        parts = {f"s{k}_{j}": held["b"][:, j] * held["f"][:, k] * w[k * j_n + j] for k in range(k_n) for j in range(j_n)}
        whole = _folded(list(parts.values()))
        return {name: _over(x, whole) for name, x in parts.items()}

    def update(state: tuple, n: int, sums: dict[str, float]) -> tuple:
        s = [[sums[f"s{k}_{j}"] for j in range(j_n)] for k in range(k_n)]
        lines = [_folded(line) for line in s]
        everything = _folded(lines)
        return [[x / whole if whole else 0.0 for x in line] for line, whole in zip(s, lines, strict=True)], [whole / everything if everything else 0.0 for whole in lines]

    return lambda eps, theta: [e * t for line, t in zip(eps, theta, strict=True) for e in line], values, update


def fine_step(table: DataFrame, phi: list[Column], eps: list[list[float]], theta: list[float]) -> tuple[list[list[float]], list[float]]:
    """One update of category weights: table has b, phi[k] is the column of p(w1 | category k)."""
    weights, values, update = _fine(len(theta), len(eps[0]))
    found = sums_of(_one(table.select("b", F.array(*phi).alias("f"))), {(0, 0): weights(eps, theta)}, values)
    return update((eps, theta), *found[0, 0])


def learn_fine(table: DataFrame, phi: list[Column], n_experts: int, change: float = 1e-3, most: int = 500, steps: int | None = None) -> tuple[list[list[float]], list[float]]:
    """(eps[k][j], theta[k]) by EM from an even start, until eps moves by less than `change`, or for so many steps."""
    start = [[1.0 / n_experts] * n_experts for _ in phi], [1.0 / len(phi)] * len(phi)
    with _held(_one(table.select("b", F.array(*phi).alias("f")))) as (rows, together):
        return settle(rows, {(0, 0): start}, *_fine(len(phi), n_experts), change, most, steps, together)[0, 0]


# ---- clusters


def scaled_features(features: DataFrame, first: int = 6) -> DataFrame:
    """(word, x): the first features over their column's maximum (0 for a maximum of 0), the others as they are, all to 27 bits."""
    tops = features.agg(*[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(first)])
    rows = features.crossJoin(F.broadcast(tops))
    head = [F.coalesce(F.try_divide(F.when(F.col(f"m{i}") != 0, F.col("x")[i]), F.col(f"m{i}")), F.lit(0.0)) for i in range(first)]
    return rows.select("word", F.transform(F.concat(F.array(*head), F.slice("x", F.lit(first + 1), F.size("x"))), settled).alias("x"))


def _cluster(k_n: int, j_n: int, d_n: int) -> tuple[Callable, Values, Callable]:
    """(weights, values, update) of rows with b and the word's features x.

    A step is one pass: the spread of a cluster follows from its sums of |x|^2 and x. A cluster without weight keeps its place, one
    without spread its width; pairs without any probability weigh nothing.
    """
    size = 3 + d_n + j_n

    def weights(eps: list, pi: list, mu: list, sigma: list) -> list[float]:
        return [v for k in range(k_n) for v in (pi[k], 2.0 * (sigma[k] * sigma[k]), sigma[k], *mu[k], *eps[k])]

    def values(held: dict[str, np.ndarray], w: np.ndarray) -> dict[str, np.ndarray]:
        b, x, w = held["b"], held["x"], w.reshape(k_n, size)
        apart = [_folded([(x[:, d] - w[k, 3 + d]) * (x[:, d] - w[k, 3 + d]) for d in range(d_n)]) for k in range(k_n)]
        gates = [w[k, 0] * exact.decay(apart[k] / w[k, 1]) / w[k, 2] for k in range(k_n)]
        parts = {(k, j): b[:, j] * w[k, 3 + d_n + j] * gates[k] for k in range(k_n) for j in range(j_n)}
        whole = _folded(list(parts.values()))
        out = {f"s{k}_{j}": _over(v, whole) for (k, j), v in parts.items()}
        square = _folded([x[:, d] * x[:, d] for d in range(d_n)])
        for k in range(k_n):
            mine = _folded([out[f"s{k}_{j}"] for j in range(j_n)])
            out |= {f"x{k}_{d}": mine * x[:, d] for d in range(d_n)} | {f"q{k}": mine * square}
        return out

    def update(state: tuple, n: int, sums: dict[str, float]) -> tuple:
        _, _, mu, sigma = state
        out: tuple = ([], [], [], [])
        for k in range(k_n):
            s = [sums[f"s{k}_{j}"] for j in range(j_n)]
            t = _folded(s)
            centre = [sums[f"x{k}_{d}"] / t for d in range(d_n)] if t else mu[k]
            around = _folded([v * v for v in centre])
            spread = sums[f"q{k}"] / t - around if t else 0.0
            for part, value in zip(out, ([x / (t or 1.0) for x in s], t / n, centre, math.sqrt(spread) if spread > 0 else sigma[k]), strict=True):
                part.append(value)
        return out

    return weights, values, update


def cluster_step(table: DataFrame, eps: list[list[float]], pi: list[float], mu: list[list[float]], sigma: list[float]) -> tuple:
    """One update of (eps, pi, mu, sigma); table has b and the word's features x."""
    weights, values, update = _cluster(len(pi), len(eps[0]), len(mu[0]))
    state = (eps, pi, mu, sigma)
    return update(state, *sums_of(_one(table.select("b", "x")), {(0, 0): weights(*state)}, values)[0, 0])


def learn_cluster(table: DataFrame, clusters: int, n_experts: int, n_features: int, change: float = 1e-3, most: int = 500, steps: int | None = None) -> tuple:
    """(eps, pi, mu, sigma) by EM: even eps and pi, mu 2 on one axis each, sigma 5e6 at the start; clusters <= features."""
    if clusters > n_features:
        raise ValueError("more clusters than features")
    mu = [[2.0 if d == k else 0.0 for d in range(n_features)] for k in range(clusters)]
    start = ([[1.0 / n_experts] * n_experts for _ in range(clusters)], [1.0 / clusters] * clusters, mu, [5e6] * clusters)
    with _held(_one(table.select("b", "x"))) as (rows, together):
        return settle(rows, {(0, 0): start}, *_cluster(clusters, n_experts, n_features), change, most, steps, together)[0, 0]


def splits(pairs: DataFrame, size: int, samples: int) -> DataFrame:
    """(split_id, w1, w2, part) for each of `samples` draws: `size` pairs, or half of them if there are fewer, are `train`, the
    rest `test`. The draw is by md5 of split and pair, the same everywhere. Pairs are placed by ranges of that digest."""
    ids = pairs.sparkSession.range(samples).select(F.col("id").cast("int").alias("split_id"))
    drawn = F.md5(F.concat_ws(":", "split_id", "w1", "w2").cast("binary"))
    rows, _ = shared.written(pairs.crossJoin(F.broadcast(ids)).withColumn("drawn", drawn))
    placed = ranks.numbered(rows, ["split_id"], F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long"), ["drawn", "w1", "w2"])
    n = pairs.agg(F.count("*").alias("n"))
    take = F.when(F.lit(size) > F.col("n"), F.floor(F.col("n") / 2)).otherwise(F.lit(size))
    return placed.crossJoin(F.broadcast(n)).select("split_id", "w1", "w2", F.when(F.col("place") <= take, "train").otherwise("test").alias("part"))
