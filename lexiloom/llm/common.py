"""Shared pieces of the training-data operators: shared-folder tables, byte buffers, word and shingle hashes."""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to Python; by default 64 MB of texts would stand in the JVM and in the worker at once.
BATCH_BYTES = 4 << 20
#: Rows up to which a table of ids may be broadcast (about 48 MB as a hash relation).
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may leave it unset: its one machine then has
    a folder of its own below the working directory of Spark."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(spark.sparkContext._temp_dir, "lexiloom-tables")
    return found.rstrip("/")


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: a zip in the shared folder, which Spark hands to every Python worker."""
    context = spark.sparkContext
    if getattr(context, "_lexiloom_shipped", False):
        return
    context._lexiloom_shipped = True
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lexiloom-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    context.addPyFile(path.toString())


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, ready for Python operators: executors have this package, and Arrow batches hold at most BATCH_BYTES.

    The bound is a setting of the session, read when a plan runs, and so stays set; a smaller one is left as it is.
    """
    shipped(df.sparkSession)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmg]?)b?", df.sparkSession.conf.get(key).lower()).groups()
    if int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(*tables: DataFrame) -> None:
    """Takes away the files of tables from written() whose results have all been written themselves."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ids_hint(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """ids marked for broadcast if it has at most limit rows, else as it is (a shuffle join follows). ids must be cheap to read again."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


#: Counts up to which frequent keys are told apart one by one when their number is cut, and steps for each doubling above.
HISTOGRAM, OCTAVE = 10_000, 1_000


def most_frequent(counts: DataFrame, key: str, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts), sorted by key, of a table (key, c): those of the greatest counts above least, at most `most` of them.

    The cut is the least bin of counts above which no more than that stand, so that no task or driver sorts the keys.
    """
    bin_of = F.when(F.col("c") <= HISTOGRAM, F.col("c")).otherwise(HISTOGRAM + F.floor(F.log2(F.col("c") / HISTOGRAM) * OCTAVE)).cast("long")
    cut, left = least, most
    for row in sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("k")).collect(), reverse=True):
        left -= row["k"]
        if left < 0:
            cut = max(cut, row["bin"])
            break
    top = counts.where(bin_of > cut).toPandas()  # at most `most` rows
    keys = top[key].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["c"].to_numpy()[order]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of a text column whose bytes fit one step; null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_FACTOR = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0..n-1, modulo 2**64."""
    key = "i" if inverse else "b"
    if len(_powers.get(key, ())) < n:
        x = np.full(max(n, STEP_BYTES + 1), BASE_INVERSE if inverse else BASE, np.uint64)
        x[0] = 1
        _powers[key] = np.multiply.accumulate(x)
    return _powers[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of a polynomial modulo 2**64; (p[j]-p[i]) * BASE**-i is the hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document) of maximal runs of bytes that are not space; runs end with their document."""
    gap = is_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray) -> np.ndarray:
    """At every byte, and behind the last, the little-endian integer of the eight bytes from there on; 0 bytes follow the data."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


_KEPT_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; equal bytes have equal hashes, different ones differ but for about 1 in 2**64 pairs.

    Eight bytes at a time are mixed into the hash by a finaliser that is no polynomial, so that no pattern of bytes cancels.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight, sizes = lanes(data), ends - starts
    h = mixed(sizes.astype(np.uint64) + np.uint64(BASE))
    at, begin, rest, taken = None, starts, sizes, 0
    while True:
        v = eight[begin] & _KEPT_BYTES[np.minimum(rest, 8)]
        if at is None:
            h = mixed(h ^ v)
            at = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
        else:
            h[at] = mixed(h[at] ^ v)
            at = at[rest > 8]
        if not len(at):
            break
        taken += 8
        begin = starts[at] + taken
        rest = ends[at] - begin
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive words, also of those that cross documents."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out += words[k : k + count] * SHINGLE_FACTOR[k]
    return mixed(out)


def short_hash(words: np.ndarray) -> np.ndarray:
    """The hash of one sequence that is shorter than a shingle, as an array of one."""
    return shingle_hashes(words, len(words))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each document its set of n-word shingles as sorted hashes: A-Z lower-cased; a shorter text is one shingle; no words, empty."""
    for found, _ in named_sets(data, offsets, n):
        yield found


def named_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[tuple[np.ndarray, bytes]]:
    """shingle_sets() with a 128-bit name of each set: of its hashes, or of the words themselves where it has one shingle only, as
    sets of two and more differ in several 64-bit hashes at once."""
    data = FOLD[data]
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    shingles = shingle_hashes(words, n)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        found = np.unique(shingles[a : b - n + 1]) if b - a >= n else short_hash(words[a:b]) if b > a else np.zeros(0, np.uint64)
        own = found.tobytes() if len(found) != 1 else b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(a, min(b, a + n)))
        yield found, hashlib.blake2b(own, digest_size=16).digest()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its connected component.

    Alternates large-star and small-star contractions; each round is a few shuffles and ends in a written table, and the rounds
    grow with the logarithm of the longest path. Nothing but the count of changes reaches the driver. No links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        next_edges = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, written(next_edges, f"{name}-edges")
        deleted(last)
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
