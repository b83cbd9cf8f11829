"""A training corpus from documents: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns all rows that stay, whole and with all their columns; the last one returns a
row for each copy that the mix takes, numbered by copy_no. Ids need not be unique: rows with a null or repeated doc_id are told
apart by a hash of id and text, and rows that are wholly alike are copies of each other. A table without rows stays so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import ids_hint, written
from lexiloom.llm.decontamination import matches
from lexiloom.llm.exact_dedup import exact_dedup
from lexiloom.llm.jaccard_join import jaccard_groups
from lexiloom.llm.language_id import identified, learned
from lexiloom.llm.mixing import mixed_sample


def _fresh(name: str, docs: DataFrame) -> str:
    """name, or name with _ behind it as often as docs has such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _with_row_id(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with an id for each row, its column, whether doc_id alone would not do). Ids that are unique are taken as they are;
    a row whose doc_id is null or repeated gets a negative hash of id and text."""
    name = _fresh("row_id", docs)
    doubled = written(docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").select(F.col("doc_id").alias("d")), "pipeline-ids")
    if doubled.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name, False
    own = F.col("doc_id").cast("long")
    hashed = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(2**63)))
    marked = docs.join(ids_hint(doubled.withColumn("twice", F.lit(True))), docs["doc_id"].eqNullSafe(F.col("d")), "left")
    return marked.withColumn(name, F.when(F.col("twice"), hashed).otherwise(own)).select(*[docs[c] for c in docs.columns], name), name, True


def _without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose id stands in gone (id)."""
    gone = ids_hint(written(gone.select(F.col("id").alias("gone_id")).distinct(), "pipeline-gone"))
    return docs.join(gone, docs[name] == gone["gone_id"], "left_anti").drop(name)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the learned filters can tell; null texts, texts without a letter and those whose n-grams are in no
    language's filter go."""
    return identified(docs, learned(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    docs, name, doubled = _with_row_id(docs)
    if doubled:
        hot = written(docs.groupBy(name).count().where("count > 1").select(F.col(name).alias("id")), "pipeline-alike")
        alike = docs.join(ids_hint(hot), docs[name] == F.col("id"), "left_semi").dropDuplicates([name])
        docs = docs.join(ids_hint(hot), docs[name] == F.col("id"), "left_anti").unionByName(alike)
    return _without(docs, name, exact_dedup(docs, id_col=name).where("NOT kept").select(F.col("doc_id").alias("id")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 5-word shingle similarity 0.75 or more hold together: the one of smallest id."""
    docs, name, _ = _with_row_id(docs)
    return _without(docs, name, jaccard_groups(docs, id_col=name).where("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    docs, name, _ = _with_row_id(docs)
    return _without(docs, name, matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name).select(F.col("doc_id").alias("id")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that mix sources to their target weights, one row each; a column of docs may have any name."""
    docs, name, _ = _with_row_id(docs)
    label, key, few, every = (_fresh(c, docs) for c in ("copy_no", "taken_id", "taken_n", "all_n"))
    taken = mixed_sample(docs, id_col=name).groupBy(F.col("doc_id").alias(key)).agg(F.min("n_copies").alias("low"), F.max("n_copies").alias(few), F.sum("n_copies").alias(every))
    taken = written(taken.where(F.col(few) > 0), "pipeline-taken")
    copies = lambda rows, n: rows.withColumn(label, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(name, key, n)
    even, odd = taken.where(F.col("low") == F.col(few)).select(key, few), taken.where(F.col("low") < F.col(few)).select(key, every)
    out = copies(docs.join(ids_hint(even), F.col(name) == F.col(key)), few)
    if odd.isEmpty():
        return out
    # rows wholly alike of which the mix takes some: one of them stands for all their copies
    return out.unionByName(copies(docs.join(ids_hint(odd), F.col(name) == F.col(key)).dropDuplicates([name]), every))


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", clean), ("mixing sources to target weights", mix)]

#: DuckDB has no like of the learned, hashed and tiled stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "pipeline-stage")
    return docs
