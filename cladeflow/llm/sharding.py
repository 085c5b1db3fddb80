"""Sharding by Hilbert-curve order over document metadata.

Language, source and size are each quantised to a grid, by ranks over the
corpus; a document's cell has a place on the Hilbert curve through the grid.
Documents are sorted by it, and the order is cut into runs of equal counts, so
each shard covers a compact box of the metadata and files can be skipped on any
of the dimensions. Documents of equal text share the metadata of the one with
the least id and lie next to each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, prepare, stage

DIMENSIONS = 3
BITS = 8


def hilbert_index(coordinates: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points in a grid of 2 ** bits cells a side.

    Skilling's transform: undo the excess turns from the highest bit down, Gray
    encode, and interleave the bits.
    """
    x = [np.asarray(c, np.int64).copy() for c in coordinates]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ turn) >> bit & 1)
    return out


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    """`df` sorted over partitions, staged, with `part` and the place in it, `place`."""
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stage(
        df.repartitionByRange(spread, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    )
    return ordered.withColumn("part", F.shiftright("_id", 33)).withColumn("place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def _before(ordered: DataFrame, amount: Column) -> tuple[DataFrame, int]:
    """part and the amount in the parts before it, a row for each part; and the whole amount."""
    rows, total = [], 0
    for part, n in sorted(ordered.groupBy("part").agg(F.sum(amount)).collect()):
        rows.append((part, total))
        total += n
    return F.broadcast(ordered.sparkSession.createDataFrame(rows, "part long, before long")), total


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with `name`, a string, put into cells by its rank, a common value counting by its rows.

    Whole strings are compared. A value lies where the middle of its rows does.
    """
    counts = _in_order(rows.groupBy(name).agg(F.count("*").alias("n")), F.col(name))
    before, total = _before(counts, F.col("n"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("place"))
    middle = F.col("before") + within - F.col("n") / 2
    cell = F.floor(middle * (1 << BITS) / max(total, 1)).cast("double")
    cells = stage(counts.join(before, "part").select(name, "n", cell.alias("cell")))
    return join_spread(rows, cells, name, "n", total).drop("n", name).withColumnRenamed("cell", name)


def _cells(cuts: list[list[float]]):
    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([np.searchsorted(k, v, "left") for k, v in zip(cuts, (a, b, c))]))

    return place


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert, by document.

    Law `rows`: shards' counts differ by one at most. The size is the text's
    UTF-8 bytes plus 1; a null text has none and counts as apart from an empty
    one only by nothing, as both have size 1. Null languages and sources count
    as empty strings. Rows that repeat an id each get a slot. An empty table
    gives no rows. Other columns don't matter.
    """
    prepare(docs.sparkSession)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.coalesce("lang", F.lit("")).alias("d_lang"),
            F.coalesce("source", F.lit("")).alias("d_source"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    for name in ("d_lang", "d_source"):
        rows = stage(_ranked(rows, name))
    share = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    dims = ("d_lang", "d_source", "d_size")
    sized = rows.withColumn("d_size", F.col("size").cast("double"))
    found = sized.agg(*(F.percentile_approx(d, share, 10_000).alias(d) for d in dims)).first()
    cuts = [sorted(set(found[d] or [])) for d in dims]
    group = ["text_hash", "text_crc32", "size"]
    lead = stage(rows.groupBy(*group).agg(F.min(F.struct("doc_id", "d_lang", "d_source")).alias("lead"), F.count("*").alias("n")))
    placed = join_spread(rows.select("doc_id", "row", *group), lead, group, "n", rows.count())
    placed = placed.withColumn(
        "hilbert", _cells(cuts)("lead.d_lang", "lead.d_source", F.col("size").cast("double"))
    )
    order = [F.col(c).asc_nulls_first() for c in ("hilbert", "text_hash", "doc_id", "row")]
    ordered = _in_order(placed.select("doc_id", "size", "text_crc32", "hilbert", "text_hash", "row"), *order)
    starts, total = _before(ordered, F.lit(1))
    bounds = [-(-total * s // shards) for s in range(shards)]  # first rank of each shard
    ranked = ordered.join(starts, "part").withColumn("rank", F.col("before") + F.col("place"))
    shard = sum((F.when(F.col("rank") >= b, 1).otherwise(0) for b in bounds[1:]), F.lit(0))
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.element_at(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
