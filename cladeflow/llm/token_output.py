"""Token ids of all documents in files, with Elias-Fano document boundaries.

A file holds segments; a segment is one Parquet row and holds the ids of
consecutive documents end to end, the boundaries between them, and the
documents' ids, the latter two Elias-Fano encoded. Parquet carries the rows so
that any store Spark can reach will do. Boundaries are kept within a segment,
whose place in the whole id array is a number of its own, so that no structure
grows with the corpus.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, prepare, shared_folder, texts
from .eliasfano import EliasFano, encode
from .tokens import encoder

#: A segment ends with the document that brings it to this many ids.
SEGMENT_IDS = 1 << 19
SEGMENTS = (
    "part long, segment long, before long, n_docs long, n_ids long, "
    "width int, ids binary, bounds binary, doc_ids binary, null_docs long"
)


def _pack(part, number, before, docs, lengths, chunks, nulls, width) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    shift = docs[0] if docs else 0
    ids = np.frombuffer(b"".join(chunks), "<u4").astype(f"<u{width}").tobytes()
    known = np.array(docs, dtype=np.int64) - shift
    one = lambda v, t: ([v], t)
    return batch(
        part=one(part, pa.int64()),
        segment=one(number, pa.int64()),
        before=one(before, pa.int64()),
        n_docs=one(len(lengths), pa.int64()),
        n_ids=one(int(bounds[-1]), pa.int64()),
        width=one(width, pa.int32()),
        ids=one(ids, pa.binary()),
        bounds=one(encode(bounds), pa.binary()),
        doc_ids=one(np.int64(shift).tobytes() + encode(known), pa.binary()),
        null_docs=one(nulls, pa.int64()),
    )


def _segments(path: str, end_id: int, width: int):
    def run(batches):
        from pyspark import TaskContext

        to_ids, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        number = before = held = nulls = 0
        docs, lengths, chunks = [], [], []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = to_ids(text) + end
                if doc is None:
                    nulls += 1
                else:
                    docs.append(doc)
                chunks.append(raw)
                lengths.append(len(raw) // 4)
                held += lengths[-1]
                if held >= SEGMENT_IDS:
                    yield _pack(part, number, before, docs, lengths, chunks, nulls, width)
                    number, before = number + 1, before + held
                    held = nulls = 0
                    docs, lengths, chunks = [], [], []
        if lengths:
            yield _pack(part, number, before, docs, lengths, chunks, nulls, width)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes `docs` with the tokenizer at `tokenizer` and writes segment files.

    Documents lie in ascending doc_id order, those without an id first; rows
    that repeat a doc_id all stay, in any order. Null texts count as empty. Each
    document is followed by `end_id`. Ids take two bytes where the vocabulary
    allows. Other columns of `docs` don't matter.
    """
    prepare(docs.sparkSession)
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    spark = docs.sparkSession
    ordered = texts(docs)
    rows = ordered.repartitionByRange(
        max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("doc_id").asc_nulls_first()
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (
        rows.mapInArrow(_segments(tokenizer, end_id, width), SEGMENTS)
        .write.option("compression", "zstd")
        .parquet(folder)
    )


def _read(offsets: dict[int, int]):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                bounds, known = EliasFano(row["bounds"]), EliasFano(row["doc_ids"][8:])
                shift = int(np.frombuffer(row["doc_ids"], np.int64, 1)[0])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                base = offsets[row["part"]] + row["before"]
                marks = [bounds[i] for i in range(row["n_docs"] + 1)]  # by select
                spans = list(zip(marks, marks[1:]))
                yield batch(
                    doc_id=([None] * row["null_docs"] + [shift + known[i] for i in range(len(known))], pa.int64()),
                    start=([base + i for i, _ in spans], pa.int64()),
                    n_tokens=([j - i for i, j in spans], pa.int64()),
                    ids_crc32=([zlib.crc32(ids[i:j]) for i, j in spans], pa.int64()),
                )

    return run


def part_offsets(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each file part; as many numbers as there are parts."""
    rows = (
        spark.read.schema(SEGMENTS).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    )
    out, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in rows):
        out[part] = total
        total += n
    return out


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    prepare(spark)
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    return segments.mapInArrow(
        _read(part_offsets(spark, folder)), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files, to the shared folder unless told otherwise, and reads them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
