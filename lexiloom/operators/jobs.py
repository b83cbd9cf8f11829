"""Learning jobs: weights learned on training lists, applied to the words of test lists, truncated and written, all in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import experts as mixing
from . import learn, pmf


def applied(learner: str, train: DataFrame, words: DataFrame, experts: DataFrame, n_experts: int, target_vocab: DataFrame, mass: float, most: int | None = None) -> tuple[dict[int, list[float]], DataFrame]:
    """(weights of each job, pmf (job, w1, w2, p, rk)): weights learned from the pairs (job, w1, w2) of train, and the truncated mixtures
    for words (job, word). Jobs share every scan, join and step of learning; a job is a key, not a plan of its own."""
    jobs = sorted({r[0] for table in (train, words) for r in table.select("job").distinct().collect()})
    eps = learn.learned_weights(learner, train, experts, n_experts, target_vocab.select("word").distinct().count(), jobs)
    rows = [(job, j, float(e)) for job, w in eps.items() for j, e in enumerate(w)]
    weights = train.sparkSession.createDataFrame(rows, "job int, j int, e double")
    return eps, pmf.truncated(mixing.mixture(experts, weights, words, ["job"]), mass, most, by=["job", "w1"])


def run(spark: SparkSession, path: str, experts_of: Callable[[str, str], tuple[DataFrame, int, DataFrame]], learner: str = "EM", mass: float = 0.5, most: int | None = None) -> list[tuple[int, list[float]]]:
    """Runs every line `test col train l1 l2 out params` of a job list: (number, weights) of each.

    experts_of(l1, l2) gives (experts, their number, target vocabulary). The test words are column `col` of the file `test`, the
    pairs to learn from are the first two columns of `train`; the pmf goes to the file `out`, the weights to `params`. All jobs of a
    language pair are one plan; a job list is a short file, and so are its paths.
    """
    listed = files.jobs(spark, path).orderBy("split_id").collect()
    done = []
    for l1, l2 in sorted({(job["l1"], job["l2"]) for job in listed}):
        some = [job for job in listed if (job["l1"], job["l2"]) == (l1, l2)]
        experts, n, vocab = experts_of(l1, l2)
        pairs = files.columns(spark, [(j["split_id"], j["train"], [1, 2]) for j in some]).select("job", F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2")).distinct()
        words = files.columns(spark, [(j["split_id"], j["test"], [int(j["col"])]) for j in some]).select("job", F.col("words")[0].alias("word")).distinct()
        eps, found = applied(learner, pairs, words, experts, n, vocab, mass, most)
        out = spark.createDataFrame([(j["split_id"], j["out"]) for j in some], "job int, path string")
        files.write_pmfs(found.join(F.broadcast(out), "job"))
        files.write_lines(spark, {j["params"]: [files.numbers(eps[j["split_id"]])] for j in some})
        done += [(j["split_id"], eps[j["split_id"]]) for j in some]
    return sorted(done)


def splits_run(train: DataFrame, words: DataFrame, experts: DataFrame, n_experts: int, target_vocab: DataFrame, learner: str = "EM", mass: float = 0.5) -> DataFrame:
    """(split_id, w1, w2, p, rk) of cross-validation: train (split_id, w1, w2), words (split_id, word); all splits are one plan."""
    keyed = lambda df: df.withColumnRenamed("split_id", "job")
    return applied(learner, keyed(train), keyed(words), experts, n_experts, target_vocab, mass)[1].withColumnRenamed("job", "split_id")
