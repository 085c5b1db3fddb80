"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes `df` to the folder in spark.checkpoint.dir and reads it back.

    With `by`, an integer column, rows are stored in a folder for each of its
    values, and a filter on it reads only that. Loops call it once a round: plans stay short, and a lost executor costs one
    round at most. Only a local session may go without the setting.
    """
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("cladeflow.settle.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cladeflow-settle-")
        spark.conf.set("cladeflow.settle.dir", folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/settle-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: str) -> DataFrame:
    """`df` settled with its rows dealt out by `by`, so that later tasks don't stay as few as the files that its sources have."""
    return settle(df.repartition(by))


def number(rows: DataFrame, key: str, start: int, out: str) -> DataFrame:
    """`rows` with consecutive numbers in the order of `key`, in column `out`.

    Keys are range-partitioned and numbered by partition, with the counts of
    earlier partitions added: no task sorts them all.
    """
    ordered = settle(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    offsets, total = [], start
    for p, n in sorted((r["p"], r["count"]) for r in ordered.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_p long, _first long")
    numbered = ordered.withColumn("_p", part).join(F.broadcast(table), "_p")  # a row a partition
    return numbered.select(*rows.columns, (F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(out))
