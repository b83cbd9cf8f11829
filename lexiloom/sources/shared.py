"""Tables that cut lineage: written to the folder that the cluster names in spark.checkpoint.dir, and read again."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A local session may leave it unset and then has one
    below Spark's own working folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(spark.sparkContext._temp_dir, "lexiloom-shared")
    return found.rstrip("/")


#: Rows up to which a table of words or pairs of words is sent whole to a join, rather than have the other side shuffled.
FEW = 200_000


def hinted(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """table, or only its distinct columns, with a hint to broadcast it if it has no more than FEW rows. It is worked out for that, so it
    should be small work or cached."""
    table = table.select(*columns).distinct() if columns else table
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(table: DataFrame) -> tuple[DataFrame, str]:
    """(table, as read again from the files it has been written to; their path)."""
    spark = table.sparkSession
    path = f"{folder(spark)}/written-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path), path


@contextmanager
def held(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """The tables written and kept in memory as far as it reaches, for work that reads them again and again; gone afterwards.

    What is lost with an executor is read from the files, not worked out anew.
    """
    paths, out = [], []
    try:
        for table in tables:
            read, path = written(table)
            paths.append(path)
            out.append(read.cache())
        yield out
    finally:
        for table in out:
            table.unpersist()
        for path in paths:
            deleted(tables[0].sparkSession, path)
