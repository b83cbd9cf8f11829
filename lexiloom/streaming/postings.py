"""Postings kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import tokens


def running_postings(docs: DataFrame) -> DataFrame:
    """(lang, word, doc_id, tf) over a streaming table of documents; write in update or complete mode."""
    return tokens(docs).groupBy("lang", "word", "doc_id").agg(F.count("*").alias("tf"))


def in_memory(docs: DataFrame, name: str) -> StreamingQuery:
    """running_postings() as an in-memory table, for all that the source has now."""
    return running_postings(docs).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
