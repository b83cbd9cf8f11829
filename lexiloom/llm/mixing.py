"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ids_hint, written

#: Weights of sources by code point, repeated; share of all words to take; most copies of a document.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2
#: Natural logarithms of ranks between -REACH and REACH are cut into CELLS cells, the one that matters into CELLS again.
REACH, CELLS = 16, 4096
#: Bits of a document's random number, from the first hexadecimal digits of an md5.
DIGITS, BITS = 13, 52


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: float = COPIES) -> DataFrame:
    """(sid, source, source_size, target) from one row per source (source, source_size); sid counts sources by code point, null last.

    share times all sizes is dealt by weight; a source stops at copies times its size and its excess is dealt again by weight
    until no source is above. Sources are numbered within ranges, and a round of dealing is one aggregation of which two sums
    reach the driver, so that sources may be many.
    """
    ordered = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("pid", F.spark_partition_id())
    ordered = written(ordered, "mix-sources")
    ranges = ordered.groupBy("pid").agg(F.count("*").alias("n"))  # a row for each partition
    ranges = ranges.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("pid").orderBy("last", "source"))
    rows = ordered.withColumn("i", number).join(F.broadcast(ranges), "pid").withColumn("sid", F.col("before") + F.col("i") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = written(rows.select("sid", "source", "source_size", weight.alias("w"), (F.lit(float(copies)) * F.col("source_size")).alias("cap")), "mix-weights")
    total, open_w = rows.agg(F.sum("source_size").cast("double") * F.lit(float(share)), F.sum("w")).first()
    level = (total or 0.0) / (open_w or 1.0)
    while True:
        full = F.col("w") * F.lit(level) > F.col("cap")
        row = rows.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        before, level = level, (total - row["caps"]) / row["w"]
        if level <= before:
            break
    return rows.select("sid", "source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def planned(sized: DataFrame, weights: tuple[float, ...], share: float, copies: int) -> DataFrame:
    """(sid, source, source_size, target, whole, sure, rate, rest) of every source.

    Every document has `whole` copies for certain. What the target lacks then is dealt in proportion to size: documents larger
    than `sure` get one more copy for certain, any other has the inclusion probability rate * size, below or at 1; rest are the
    words that those are to bring. The windows run over a source's different sizes, not over its documents.
    """
    by_size = written(sized.groupBy("source", "size").agg(F.count("*").alias("c")), "mix-by-size")
    plan = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size")), weights, share, copies)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    named = plan.select("sid", F.col("source").alias("name"), "due")
    rows = by_size.where("size > 0").join(ids_hint(named), F.col("source").eqNullSafe(F.col("name")))
    down = Window.partitionBy("sid").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("size") * F.col("c")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("c")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("rest", F.col("due") - larger).withColumn("rate", F.col("rest") / squares).where(F.col("rate") * F.col("size") <= 1)
    best = rows.groupBy("sid").agg(F.max(F.struct("size", "rate", "rest")).alias("b")).select("sid", F.col("b.size").alias("sure"), F.col("b.rate").alias("rate"), F.col("b.rest").alias("rest"))
    return written(plan.drop("due").join(best, "sid", "left"), "mix-plan")


def mixed_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """One row per row of docs: (doc_id, source, size, source_size, target, taken, n_copies); taken = n_copies * size.

    size counts the words of the whole text (null: 0). All documents of a source get the whole copies that its target allows. One
    more copy goes to a Pareto order sample: a document's inclusion probability p is proportional to its size, documents for
    which that reaches 1 are certain, and the others are ranked by u/(1-u) over p/(1-p), u from an md5 of seed, id and text. The
    sample has a fixed size in words: ranks are taken from the front until the words due are reached, the last one if that comes
    nearer to them than to leave it.

    Reruns agree: ranks come from hashes, not from row order. Rows that are wholly alike count as separate documents of one
    rank; where the sample ends among them, as many of them are taken as are due. Null sources form one source, the last; null
    texts and texts without words have size 0 and take 0 words; null ids are hashed as empty ones. A source without words has
    target 0. An empty table gives no rows; other columns are ignored.

    No task sorts a source: the place where the words due are reached is found in cells of the rank's logarithm, then in cells of
    that cell, and only the few rows of the last one are put in order. A cell has the same share of a source's documents
    whatever their probabilities.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).cast("binary"))
    h = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h")), "mix-sizes")
    plan = planned(sized, weights, share, copies)

    u = (F.col("h").cast("double") + 0.5) / F.lit(float(2**BITS))
    p = F.col("rate") * F.col("size")
    q = F.when(F.col("size") <= F.col("sure"), F.when(p >= 1, F.lit(0.0)).when(p > 0, u / (1 - u) / (p / (1 - p))))
    rows = sized.join(ids_hint(plan.withColumnRenamed("source", "name").select("sid", "name", "whole", "sure", "rate", "rest")), F.col("source").eqNullSafe(F.col("name")))
    place = (F.least(F.greatest(F.log("q"), F.lit(-REACH)), F.lit(REACH)) + REACH) * (CELLS / (2 * REACH))
    rows = rows.withColumn("q", q).withColumn("place", F.when(F.col("q") <= 0, F.lit(0.0)).otherwise(place))
    rows = rows.withColumn("c1", F.floor("place")).withColumn("c2", F.floor((F.col("place") - F.col("c1")) * CELLS))
    ranked = rows.where("q IS NOT NULL").withColumn("start", F.lit(0))

    first = _crossed(ranked, "c1", [])
    inside = ranked.drop("start").join(ids_hint(first.toDF("sid", "at1", "start")), "sid").where("c1 = at1")
    second = _crossed(inside, "c2", ["at1"])
    cell = inside.drop("start").join(ids_hint(second.toDF("sid", "a1", "at2", "start")), "sid").where("c2 = at2")
    alike = cell.groupBy("sid", "a1", "at2", "rest", "start", "q", "h", "doc_id", "size").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("sid").orderBy("q", "h", "doc_id", "size")
    before = F.col("start") + F.coalesce(F.sum(F.col("m") * F.col("size")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.greatest(F.lit(0), F.least(F.col("m"), F.floor((F.col("rest") - before) / F.col("size") + 0.5)))
    alike = alike.withColumn("k", k)
    cut = alike.groupBy("sid", "a1", "at2").agg(F.max(F.when(F.col("k") == F.col("m"), _key())).alias("upto"), F.max(F.when((F.col("k") > 0) & (F.col("k") < F.col("m")), F.struct(_key().alias("key"), "doc_id", "size", "m", "k"))).alias("part"))
    cut = written(cut, "mix-cut")  # a row for each source

    rows = rows.join(ids_hint(cut.withColumnRenamed("sid", "cut_sid")), F.col("sid") == F.col("cut_sid"), "left")
    here, mine = F.struct("c1", "c2"), F.struct(F.col("a1").alias("c1"), F.col("at2").alias("c2"))
    taken = F.col("a1").isNull() | (here < mine) | ((here == mine) & F.coalesce(_key() <= F.col("upto"), F.lit(False)))
    extra = F.when(F.col("size") > F.col("sure"), 1).when(F.col("q").isNull(), 0).when(taken, 1).otherwise(0)
    parted = F.col("q").isNotNull() & F.coalesce(_key() == F.col("part.key"), F.lit(False))
    out = rows.where(~parted).select("sid", "doc_id", "size", (F.col("whole") + F.coalesce(extra, F.lit(0))).alias("n_copies"))
    # the rows among which the sample ends, k of m alike, are written out anew
    more = cut.where("part IS NOT NULL").select("sid", "part.*").join(plan.select("sid", "whole"), "sid").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m"))))
    more = more.select("sid", "doc_id", "size", (F.col("whole") + (F.col("j") <= F.col("k")).cast("long")).alias("n_copies"))
    out = out.unionByName(more).join(ids_hint(plan.select("sid", "source", "source_size", "target")), "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def _key() -> Column:
    """What ranks are ordered by; a null id comes before others."""
    return F.struct("q", "h", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size")


def _crossed(rows: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """(sid, keys, cell, start), written: for each source the cell in which the words due are passed, and the words before it."""
    cells = rows.groupBy("sid", *keys, "rest", "start", cell).agg(F.sum("size").alias("words"))
    before = F.col("start") + F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).where(F.col("before") <= F.col("rest")).where(F.col("before") + F.col("words") > F.col("rest"))
    return written(cells.select("sid", *keys, cell, F.col("before").alias("start")), "mix-crossed")


#: DuckDB: targets, probabilities, ranks and the cut, by sorting each source.
MIXING_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, {DIGITS}))::bigint AS h FROM documents),
     s AS (SELECT source, sum(size)::bigint AS source_size, [{", ".join(f"{w}.0::double" for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::int] AS w FROM d GROUP BY source),
     o AS (SELECT *, {float(COPIES)}::double * source_size AS cap, sum(source_size) OVER ()::double * {SHARE}::double AS total,
                  coalesce(sum({float(COPIES)}::double * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_caps,
                  sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s),
     l AS (SELECT *, max(CASE WHEN (total - full_caps) / open_w * w <= cap THEN (total - full_caps) / open_w END) OVER () AS level FROM o),
     t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target,
                  coalesce(floor(coalesce(least(cap, level * w), cap) / nullif(source_size, 0)), 0)::bigint AS whole FROM l),
     b AS (SELECT source, size, count(*) AS c, any_value(target - whole * source_size) AS due FROM d JOIN t USING (source) WHERE size > 0 GROUP BY ALL),
     r AS (SELECT *, due - coalesce(sum(size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS rest,
                  sum(size::double * size * c) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares FROM b),
     m AS (SELECT source, max(size) AS sure, arg_max(rest / squares, size) AS rate, arg_max(rest, size) AS rest FROM r WHERE rest / squares * size <= 1 GROUP BY source),
     p AS (SELECT d.*, t.source_size, target, whole, sure, rest, rate * size AS p, (h::double + 0.5) / {2**BITS}::double AS u FROM d JOIN t USING (source) LEFT JOIN m USING (source)),
     q AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 AND size <= sure THEN u / (1 - u) / (p / (1 - p)) END AS q FROM p),
     c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM q WHERE size <= sure))
SELECT doc_id, size, source_size, target, taken, source FROM (
    SELECT doc_id, size, source_size, target, (whole + (CASE WHEN q IS NOT NULL AND before + size / 2.0::double <= rest THEN 1 ELSE 0 END)) * size AS taken, source FROM c
    UNION ALL SELECT doc_id, size, source_size, target, (whole + CASE WHEN size > sure THEN 1 ELSE 0 END) * size, source FROM q WHERE NOT coalesce(size <= sure, false))
"""
