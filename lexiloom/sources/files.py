"""Readers and writers of the text formats: lines in, tables out. All take paths that Spark can read, gz included."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from ..operators.text import split_words
from . import shared
from .named import write_named

# ---- readers


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of each file, numbered from 0, whatever its size.

    Spark reads a file in blocks, the lines of a block in order; a line's number is its place in the block after the lines of the
    blocks before it, whose counts are a small table.
    """
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path, lineSep="\n").select(*block, F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    blocks = rows.groupBy("path", "start").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "start", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(blocks), ["path", "start"]).select("file", (F.col("before") + F.col("i") - F.col("first")).cast("int").alias("line"), "value")


def token_folder(spark: SparkSession, path: str, lang: str, name_pattern: str | None = None) -> DataFrame:
    """(lang, doc_id, pos, word) of a folder with one document a file, its name the id; only names that the pattern is found in."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
    if name_pattern:
        docs = docs.where(F.col("doc_id").rlike(name_pattern))
    return docs.select(F.lit(lang).alias("lang"), "doc_id", F.posexplode(split_words(F.col("text"))).alias("pos", "word")).where("word <> ''")


def state_lines(values: DataFrame, languages: dict[str, str], langs: list[str] | None = None) -> DataFrame:
    """(doc_id, lang, pos, word_id, word, topic) from lines `doc lang pos wordid word topic` (column value); # lines are skipped."""
    f = F.split(F.trim("value"), r"\s+")
    name = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    rows = values.where("NOT startswith(value, '#')").select(f.alias("f")).where("size(f) = 6")
    rows = rows.select(F.col("f")[0].alias("doc_id"), F.try_element_at(name, F.col("f")[1]).alias("lang"), F.col("f")[2].cast("int").alias("pos"), F.col("f")[3].cast("int").alias("word_id"), F.col("f")[4].alias("word"), F.col("f")[5].cast("int").alias("topic"))
    return rows.where(F.col("lang").isin(langs)) if langs else rows.where("lang IS NOT NULL")


def topic_state(spark: SparkSession, path: str, languages: dict[str, str], langs: list[str] | None = None) -> DataFrame:
    """state_lines() of a file, gz or plain, whose header starts with #."""
    return state_lines(spark.read.text(path), languages, langs)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2): lines of two tab-separated words, in lower case, without repeats."""
    f = F.split(F.lower(F.rtrim("value")), "\t")
    return spark.read.text(path).select(f.alias("f")).where("size(f) = 2").select(F.col("f")[0].alias("w1"), F.col("f")[1].alias("w2")).distinct()


def pmf_lines(values: DataFrame) -> DataFrame:
    """(w1, w2, p, rk) from (line, value) with lines `w1<TAB>w2 p<TAB>w2 p...`: a later line of a word replaces it, a later p of a
    candidate too; rk is the place in the line."""
    f = F.split(F.rtrim("value"), "\t")
    rows = values.select("line", F.get(f, F.lit(0)).alias("w1"), f.alias("f")).where("w1 <> ''")
    last = rows.groupBy("w1").agg(F.max_by("f", "line").alias("f"))
    cands = last.select("w1", F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("i", "c")).select("w1", "i", F.split("c", " ").alias("c"))
    cands = cands.select("w1", "i", F.col("c")[0].alias("w2"), F.col("c")[1].cast("double").alias("p"))
    return cands.groupBy("w1", "w2").agg(F.max_by("p", "i").alias("p"), (F.min("i") + 1).cast("int").alias("rk"))


def pmf(spark: SparkSession, path: str) -> DataFrame:
    return pmf_lines(lines(spark, path))


def word_list(spark: SparkSession, path: str, comments: bool = True, strip_pipe: bool = False) -> DataFrame:
    """(word, ord): one word a line. With comments, blank and # lines are skipped and repeats stay, in order; without, only the end
    is trimmed and repeats go. strip_pipe cuts `| comment` off first."""
    return word_list_lines(lines(spark, path), comments, strip_pipe)


def word_list_lines(values: DataFrame, comments: bool = True, strip_pipe: bool = False) -> DataFrame:
    value = F.regexp_replace("value", r"\s*\|.*$", "") if strip_pipe else F.col("value")
    rows = values.select((F.trim(value) if comments else F.rtrim(value)).alias("word"), F.col("line").alias("ord"))
    if comments:
        return rows.where("word <> '' AND NOT startswith(word, '#')")
    return rows.groupBy("word").agg(F.min("ord").alias("ord"))


def words_of(spark: SparkSession, path: str) -> DataFrame:
    """(word, ord): all words of a file between white space."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(split_words(F.col("value"))).alias("ord", "word")).where("word <> ''").select("word", "ord")


def name_values(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(name, value): lines of exactly two fields; # lines are skipped, the last line of a name counts."""
    f = F.split(F.rtrim("value"), separator)
    rows = lines(spark, path).where("NOT startswith(value, '#')").select("line", f.alias("f")).where("size(f) = 2")
    return rows.groupBy(F.col("f")[0].alias("name")).agg(F.max_by(F.col("f")[1], "line").alias("value"))


def table(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """A file of separated values without quotes, # lines skipped, by a given schema."""
    return spark.read.csv(path, schema=schema, sep=separator, comment="#", quote="")


def word_stats(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "word string, cf double, df double, adc double, idf double, cfidf double, tcfidf double")


def word_stats_documents(spark: SparkSession, path: str) -> DataFrame:
    """(n_docs) from the header NUM_DOCS=."""
    return spark.read.text(path).where("value LIKE '#%NUM_DOCS=%'").select(F.regexp_extract("value", r"NUM_DOCS=(\d+)", 1).cast("long").alias("n_docs"))


def doc_stats(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "doc_id string, nchars long, ntokens long, ntypes long")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(word, x) from lines `word<TAB>f1 f2 ...`."""
    f = F.split(F.rtrim("value"), "\t")
    return spark.read.text(path).select(f[0].alias("word"), F.transform(F.split(f[1], " "), lambda x: x.cast("double")).alias("x"))


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(j, e) from one line of numbers."""
    numbers = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(numbers).alias("j", "e")).select("j", F.col("e").cast("double").alias("e"))


def column(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(word, ord): one column, counted from 1, of lines of white space separated fields."""
    return lines(spark, path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(number - 1)).alias("word"), F.col("line").alias("ord")).where("word IS NOT NULL AND word <> ''")


def columns(spark: SparkSession, wanted: list[tuple[int, str, list[int]]]) -> DataFrame:
    """(job, words): of each (job, path, numbers) the columns of those numbers, counted from 1, of lines of white space separated
    fields that have them all. Files of any number of jobs, some of them the same, are one scan."""
    read = spark.read.text(sorted({path for _, path, _ in wanted}))
    plain = lambda uri: re.sub(r"^\w+:/+", "/", unquote(uri))
    found = [(uri, job, numbers) for uri in read.inputFiles() for job, path, numbers in wanted if plain(uri) == plain(path) or plain(uri).startswith(plain(path).rstrip("/") + "/")]
    files = spark.createDataFrame([(plain(uri), job, numbers) for uri, job, numbers in found], "file string, job int, numbers array<int>")
    at = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^\w+:/+", "/")
    rows = read.select(at.alias("file"), F.split(F.trim("value"), r"\s+").alias("f")).join(F.broadcast(files), "file")
    words = F.transform("numbers", lambda n: F.get("f", n - 1))
    return rows.select("job", words.alias("words")).where(F.forall("words", lambda w: w.isNotNull() & (w != "")))


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """(split_id, test, col, train, l1, l2, out, params): a line for each learning job."""
    f = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where("NOT startswith(value, '#')").select("line", f.alias("f")).where("size(f) = 7").select(F.col("line").alias("split_id"), *[F.col("f")[i].alias(c) for i, c in enumerate(("test", "col", "train", "l1", "l2", "out", "params"))])


def titles(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "id string, title string")


def links(spark: SparkSession, path: str, number: int = 1) -> DataFrame:
    """(id): one column, counted from 1, of a link file."""
    return spark.read.text(path).select(F.get(F.split(F.rtrim("value"), "\t"), F.lit(number - 1)).alias("id"))


def label_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, l1_labels, l2_labels): of every three lines that are not blank the second and third."""
    return label_block_lines(lines(spark, path))


def label_block_lines(values: DataFrame) -> DataFrame:
    # lines that are not blank are counted block by block
    rows = ranks.running(values, "line", F.when(F.trim("value") != "", 1), "count", "i").where("trim(value) <> ''")
    rows = rows.select((F.col("i") / 3).cast("int").alias("block"), (F.col("i") % 3).alias("k"), F.split(F.trim("value"), r"\s+").alias("w"))
    return rows.groupBy("block").agg(F.max(F.when(F.col("k") == 1, F.col("w"))).alias("l1_labels"), F.max(F.when(F.col("k") == 2, F.col("w"))).alias("l2_labels"))


def scores(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).where("size(f) = 3").select(F.col("f")[0].alias("w1"), F.col("f")[1].alias("w2"), F.col("f")[2].cast("double").alias("score"))


def number_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(item, x, y): two numbers a line."""
    f = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).select(F.col("line").alias("item"), f[0].cast("double").alias("x"), f[1].cast("double").alias("y"))


def annotation_rows(spark: SparkSession, path: str) -> DataFrame:
    """(coder, item, labels) from lines `coder item l1:l2`."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f.alias("f")).where("size(f) = 3").select(F.col("f")[0].alias("coder"), F.col("f")[1].alias("item"), F.split(F.col("f")[2], ":").alias("labels"))


# ---- writers


def pmf_text(pmf: DataFrame, digits: int | None = None) -> DataFrame:
    """(value): a line for each source word, its candidates in order of rank."""
    p = F.round("p", digits) if digits else F.col("p")
    cands = F.array_sort(F.collect_list(F.struct("rk", F.concat_ws(" ", "w2", p.cast("string")).alias("c"))))
    return pmf.groupBy("w1").agg(F.array_join(F.transform(cands, lambda x: x["c"]), "\t").alias("c")).select(F.concat_ws("\t", "w1", "c").alias("value"))


def write_pmf(pmf: DataFrame, path: str) -> None:
    pmf_text(pmf).write.text(path, compression="gzip")


def write_pmfs(pmfs: DataFrame) -> None:
    """(path, w1, w2, p, rk) as a file for each path, a line for each source word, in order; .gz paths are compressed."""
    cands = F.array_sort(F.collect_list(F.struct("rk", F.concat_ws(" ", "w2", F.col("p").cast("string")).alias("c"))))
    lines_ = pmfs.groupBy("path", "w1").agg(F.array_join(F.transform(cands, lambda x: x["c"]), "\t").alias("c"))
    write_named(lines_.select("path", "w1", F.concat_ws("\t", "w1", "c").alias("value")), "w1")


#: Lines that go to the writer of a file as one.
LINES_AT_ONCE = 256


def write_matrix(matrix: DataFrame, path: str) -> None:
    """(wid, did, n) as lines of three numbers in one file. Lines are sorted by ranges and put together side by side; the one writer of the
    file only strings up the pieces."""
    rows = shared.written(matrix.select("wid", "did", "n"))[0].repartitionByRange("wid", "did").sortWithinPartitions("wid", "did")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            some, parts = batch.column("value").to_pylist(), batch.column("part")
            joined = ["\n".join(some[at : at + LINES_AT_ONCE]) for at in range(0, len(some), LINES_AT_ONCE)]
            yield pa.RecordBatch.from_arrays([parts.slice(0, len(joined)), pa.array(range(done, done + len(joined)), pa.int64()), pa.array(joined, pa.string())], ["part", "piece", "value"])
            done += len(joined)

    lines_ = rows.select(F.spark_partition_id().alias("part"), F.concat_ws(" ", "wid", "did", F.col("n").cast("long")).alias("value"))
    found = lines_.mapInArrow(pieces, "part int, piece long, value string")
    write_named(found.select(F.lit(path).alias("path"), "part", "piece", "value"), "part", "piece")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(wid, did, n) of write_matrix()."""
    f = F.split(F.trim("value"), " ")
    return spark.read.text(path).select(f[0].cast("long").alias("wid"), f[1].alias("did"), f[2].cast("long").alias("n"))


def write_table(df: DataFrame, path: str, separator: str = "\t") -> None:
    """Flat columns as separated values without quotes; array columns are joined by blanks."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, sep=separator, quote="", escape="")


def _fixed(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c)


def word_stats_text(stats: DataFrame) -> DataFrame:
    """cf and df without decimals, the others with four."""
    return stats.select("word", _fixed("cf", 0), _fixed("df", 0), *[_fixed(c, 4) for c in ("adc", "idf", "cfidf", "tcfidf")])


def write_docs(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as a folder for each document."""
    docs.select("doc_id", F.col("text").alias("value")).write.partitionBy("doc_id").text(path)


def write_document_files(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as a file for each document, its name the id, its text and a line feed its content."""
    write_named(docs.select(F.concat(F.lit(path.rstrip("/") + "/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("value")))


def write_split_files(splits: DataFrame, path: str, prefix: str) -> None:
    """(split_id, part, w1, w2) as files <path>/<split_id>/<prefix>.tr.gold and .ts.gold, sorted."""
    end = F.when(F.col("part") == "train", f"/{prefix}.tr.gold").otherwise(f"/{prefix}.ts.gold")
    write_named(splits.select(F.concat(F.lit(path.rstrip("/") + "/"), F.col("split_id").cast("string"), end).alias("path"), F.concat_ws("\t", "w1", "w2").alias("value")), "value")


def split_files(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(split_id, part, w1, w2) of write_split_files()."""
    f, at = F.split("value", "\t"), F.regexp_extract("_metadata.file_path", r"/(\d+)/[^/]+\.(tr|ts)\.gold$", 1)
    rows = spark.read.text(f"{path.rstrip('/')}/*/{prefix}.t?.gold")
    return rows.select(at.cast("int").alias("split_id"), F.when(F.endswith("_metadata.file_path", F.lit(".tr.gold")), "train").otherwise("test").alias("part"), f[0].alias("w1"), f[1].alias("w2"))


def write_splits(splits: DataFrame, path: str) -> None:
    """(split_id, part, w1, w2) as folders split_id=/part=."""
    splits.select("split_id", "part", F.concat_ws("\t", "w1", "w2").alias("value")).write.partitionBy("split_id", "part").text(path)


def write_lines(spark: SparkSession, rows: dict[str, list[str]]) -> None:
    """A few lines for each path, as one text file, in order."""
    write_named(spark.createDataFrame([(path, k, x) for path, some in rows.items() for k, x in enumerate(some)], "path string, k int, value string"), "k")


def numbers(x: list[float]) -> str:
    return " ".join(map(str, x))


def write_weights(weights: DataFrame, path: str) -> None:
    """(j, e) as one line of numbers; weights() reads it."""
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "e"))), lambda x: x["e"].cast("string")), " ")
    write_named(weights.agg(one.alias("value")).withColumn("path", F.lit(path)))


def latent_text(eps: list[list[float]], theta: list[float], names: list[str] | None = None) -> list[str]:
    """Category weights as lines: numbers of experts and categories, a line of eps for each category, a line of name and theta for each;
    categories without names have numbers."""
    return [f"E={len(eps[0])}\tT={len(eps)}", *map(numbers, eps), *(f"{name}\t{t}" for name, t in zip(names or range(len(theta)), theta, strict=True))]


def write_latent(spark: SparkSession, eps: list[list[float]], theta: list[float], path: str, names: list[str] | None = None) -> None:
    write_lines(spark, {path: latent_text(eps, theta, names)})


def latent(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float]]:
    """(eps, theta) of write_latent()."""
    eps, theta, _ = named_latent(spark, path)
    return eps, theta


def named_latent(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float], list[str]]:
    """(eps, theta, category names) of write_latent()."""
    rows = [r["value"] for r in lines(spark, path).orderBy("line").collect()]  # a line or two for each category
    n = int(rows[0].rpartition("T=")[2])
    named = [x.split("\t") for x in rows[n + 1 : 2 * n + 1]]
    return [[float(v) for v in x.split()] for x in rows[1 : n + 1]], [float(t) for _, t in named], [name for name, _ in named]


def write_features(features: DataFrame, path: str) -> None:
    """(word, x) as lines `word<TAB>f1 f2 ...`; features() reads them."""
    features.select(F.concat_ws("\t", "word", F.array_join(F.transform("x", lambda v: v.cast("string")), " ")).alias("value")).write.text(path)


def gauss_text(eps: list[list[float]], pi: list[float], mu: list[list[float]], sigma: list[float], n: int) -> list[str]:
    """Cluster parameters as lines: a head, then EPS, PI, MU and SIGMA with a line for each cluster or one for all."""
    return [f"N={n}\tK={len(pi)}\tE={len(eps[0])}", "EPS", *map(numbers, eps), "PI", numbers(pi), "MU", *map(numbers, mu), "SIGMA", numbers(sigma)]


def write_gauss(spark: SparkSession, eps: list[list[float]], pi: list[float], mu: list[list[float]], sigma: list[float], n: int, path: str) -> None:
    write_lines(spark, {path: gauss_text(eps, pi, mu, sigma, n)})


def gauss(spark: SparkSession, path: str) -> tuple[list[list[float]], list[float], list[list[float]], list[float]]:
    """(eps, pi, mu, sigma) of write_gauss()."""
    rows = [r["value"] for r in lines(spark, path).orderBy("line").collect()]  # two lines for each cluster
    at = {name: rows.index(name) for name in ("EPS", "PI", "MU", "SIGMA")}
    part = lambda a, b: [[float(v) for v in x.split()] for x in rows[at[a] + 1 : at.get(b, len(rows))]]
    return part("EPS", "PI"), part("PI", "MU")[0], part("MU", "SIGMA"), part("SIGMA", "")[0]
