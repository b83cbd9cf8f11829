"""Exact deduplication with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: Frequent digests that are split off; the sketch tracks at most TRACKED counters a task, whatever the input.
FREQUENT, TRACKED = 1_000, 10_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form feed and carriage return. Of equal
    texts the row with the most code points in the original text stays, then the smallest id.

    Null texts count as empty, and empty texts form one group. A null id loses ties against any other id; rows that are wholly
    alike (same id and text) get the same answers, kept included. An empty table gives no rows; other columns are ignored.

    A Misra-Gries sketch (Spark's approx_top_k) names at most `frequent` digests; their exact counts and winners, which are as
    many rows at most, are broadcast and answered map-side. All other digests are grouped by an ordinary shuffle, in which no
    key can be hot. The sketch chooses the route only; both routes are exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("size"), F.sha2(F.translate(text, SPACE, "").cast("binary"), 256).alias("text_sha256")), "exact-digests")
    return resolved(digests, frequent, tracked)


def resolved(digests: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """exact_dedup() from (doc_id, size, text_sha256) on."""
    best = F.max(F.struct("size", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("order")))
    grouped = lambda rows: rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("best")).select("text_sha256", "group_size", F.col("best.size").alias("best_size"), (-F.col("best.order")).alias("keep_id"))
    sketch = digests.agg(F.expr(f"approx_top_k(text_sha256, {frequent}, {tracked})").alias("top"))
    names = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    # at most `frequent` rows of fixed width, so the broadcasts below are bounded
    winners = F.broadcast(written(grouped(digests.join(F.broadcast(names), "text_sha256", "left_semi")), "exact-winners"))
    rest = digests.join(winners, "text_sha256", "left_anti")
    answers = digests.join(winners, "text_sha256").unionByName(rest.join(grouped(rest), "text_sha256"))
    kept = (F.col("size") == F.col("best_size")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return answers.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


#: DuckDB: the same answers.
EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
                  max(size) OVER (PARTITION BY text_sha256) AS top,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, size = top AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
