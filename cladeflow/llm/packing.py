"""Packing documents into sequences of bounded length by first-fit decreasing.

A document's ids are cut into pieces of at most the sequence length. Groups of
documents, drawn by a hash of the id and the ids' checksum and length, so that
rows of one or no id spread, are packed each on its own: a group holds some
thousand documents whatever the corpus, and a random draw gives each group the
corpus's mix of lengths, so that little padding is left in any of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, texts
from .tokens import encoder

#: Documents of a group, on average.
GROUP_DOCS = 2048
#: Sequences of a group stay below this, so a group's number and a sequence's make one.
GROUP_SPAN = 1 << 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree over bins: each node knows the most room below it.

    Unopened bins count as empty ones, so the leftmost bin with enough room
    always exists.
    """

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Puts `length` into the first bin that takes it: (bin, room before)."""
        room, node = self.room, 1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        before = room[node]
        room[node] = before - length
        found = node - self.size
        while node > 1:
            node >>= 1
            left, right = room[2 * node], room[2 * node + 1]
            most = left if left >= right else right
            if room[node] == most:
                break
            room[node] = most
        return found, before


def first_fit_decreasing(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties in length go by position."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree = CapacityTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        bins[i], before = tree.place(lengths[i])
        offsets[i] = capacity - before
    return bins, offsets


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        to_ids, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = to_ids(text) + end
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    cut = raw[4 * at : 4 * (at + capacity)]
                    out.append((doc, at, len(cut) // 4, zlib.crc32(cut), n))
            columns = list(zip(*out)) or [()] * 5
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield batch(**{k: (v, pa.int64()) for k, v in zip(names, columns)})

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """A row for each piece, with its sequence and its offset there.

    Null texts are empty and still have their end id. Rows that repeat a doc_id
    are packed each on its own; null ids form pieces too. A document longer than
    a sequence is cut every `capacity` ids. Other columns of `docs` don't matter.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    groups = max(1, round(docs.count() / group_docs))
    pieces = texts(docs).mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES)

    def pack(pdf):
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = pdf["pack_group"] * GROUP_SPAN + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="pack_group")

    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "ids_crc32", "length"), F.lit(groups))
    return (
        pieces.withColumn("pack_group", drawn)
        .groupBy("pack_group")
        .applyInPandas(pack, PIECES + ", sequence_id long, offset long")
    )
