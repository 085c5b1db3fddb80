"""Benchmark decontamination by winnowed fingerprints.

Of each run of WINDOW consecutive k-gram hashes the least (of equal ones the
last) is kept, so two texts that share GUARANTEE = K + WINDOW - 1 words in a
row share a kept fingerprint. Fingerprints of documents and benchmark items
meet in a join; each hit is then extended along its alignment as far as words
agree, and stretches of GUARANTEE words or more count.

Items below GUARANTEE words are a window as they stand. Their fingerprint is
the hash of all their words, which documents are probed for at every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_spread, prepare, stage, texts, without
from .words import NOT_ALNUM, Words, cut, grams, slices

GUARANTEE = 13
K = 7
WINDOW = GUARANTEE - K + 1
#: Up to so many fingerprints of the benchmark go to each worker (8 MB); beyond
#: that, documents' fingerprints are joined with them by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word places and hashes of the kept k-grams of texts of GUARANTEE words or more."""
    h, _ = grams(words, K)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, WINDOW):
        later = h[i : i + n]
        take = later <= best
        best[take] = later[take]
        at[take] = np.flatnonzero(take) + i
    owner = words.owner()
    kept = np.unique(at[owner[:n] == owner[GUARANTEE - 1 :]])
    return kept, h[kept]


def whole(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all n-grams within a text, hashed apart from k-grams."""
    h, same = grams(words, n)
    return np.flatnonzero(same), h[same] ^ np.uint64(n)


def _fingerprint_items(batches):
    for b in batches:
        for at, part in slices(b.column("text")):
            words = cut(part, NOT_ALNUM, lower=True)
            counts, owner = np.diff(words.bounds), words.owner()
            keys = b.column("item_id").to_numpy(zero_copy_only=False)[at : at + len(part)]
            found = [(owner[p], h, 0) for p, h in [winnow(words)]]
            for n in np.unique(counts[(counts > 0) & (counts < GUARANTEE)]).tolist():
                p, h = whole(words, n)
                exact = counts[owner[p]] == n
                found.append((owner[p][exact], h[exact], n))
            for who, h, n in found:
                yield batch(
                    item_id=(keys[who], pa.int64()),
                    fingerprint=(h.view(np.int64), pa.int64()),
                    n_short=(np.full(len(h), n), pa.int32()),
                )


def _scan(lengths: list[int], known: np.ndarray | None):
    """known: the benchmark's fingerprints, sorted; None to give all of the documents'."""

    def run(batches):
        for b in batches:
            for at, part in slices(b.column("text")):
                words = cut(part, NOT_ALNUM, lower=True)
                owner = words.owner()
                who, what = [], []
                for p, h in [winnow(words), *(whole(words, n) for n in lengths)]:
                    if known is not None:
                        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else h < 0
                        p, h = p[hit], h[hit]
                    who.append(owner[p])
                    what.append(h)
                who, what = np.concatenate(who), np.concatenate(what)
                order = np.lexsort((what, who))
                who, what = who[order], what[order]
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
                who, what = who[new], what[new]
                rows = slice(at, at + len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[rows],
                        b.column("doc_key")[rows],
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(who, np.arange(len(part) + 1)), pa.int32()),
                            pa.array(what.view(np.int64), pa.int64()),
                        ),
                    ],
                    names=["doc_id", "doc_key", "n_words", "fingerprints"],
                )

    return run


def shared_spans(doc: Words, item: Words, short: int) -> list[tuple[int, int]]:
    """Word ranges of the document that lie in a shared window; both of one text.

    Each fingerprint that both have gives an alignment; along it, stretches of
    equal words that hold a whole window count.
    """
    need = short or GUARANTEE
    (p, h), (q, g) = (whole(doc, need), whole(item, need)) if short else (winnow(doc), winnow(item))
    order = np.argsort(g, kind="stable")
    left, right = np.searchsorted(g[order], h, "left"), np.searchsorted(g[order], h, "right")
    times = right - left
    aligned = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    shifts = np.unique(np.repeat(p, times) - q[order][aligned])
    m, n = len(doc.hashes), len(item.hashes)
    spans = []
    for shift in shifts.tolist():
        begin, end = max(0, -shift), min(n, m - shift)
        same = np.zeros(end - begin + 2, np.int8)
        same[1:-1] = doc.hashes[begin + shift : end + shift] == item.hashes[begin:end]
        turns = np.diff(same)
        for i, j in zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()):
            if j - i >= need:
                spans.append((begin + shift + i, begin + shift + j))
    return spans


def _verify(batches):
    for b in batches:
        out = ([], [], [])
        for key, item, short, text, item_text in zip(*(b.column(i).to_pylist() for i in range(5))):
            doc_words = cut(pa.array([text], pa.large_string()), NOT_ALNUM, lower=True)
            item_words = cut(pa.array([item_text], pa.large_string()), NOT_ALNUM, lower=True)
            if spans := shared_spans(doc_words, item_words, short):
                for column, value in zip(out, (key, item, [{"s": i, "e": j} for i, j in spans])):
                    column.append(value)
        span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield batch(doc_key=(out[0], pa.int64()), item_id=(out[1], pa.int64()), spans=(out[2], span))


def _key():
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and doc_key, by document.

    doc_key tells rows by id and text.

    Null texts have no words. A row of `docs` gives one row, also where ids
    repeat. Items with a null id count for n_hit and not for n_items; items that
    share an id count once. Items without words match nothing. Without items,
    or without documents, nothing is hit. Other columns don't matter.
    """
    prepare(docs.sparkSession)
    keyed = texts(docs).withColumn("doc_key", _key())
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("item_id", F.col("item_id").cast("long"))
    numbered = items.groupBy("item_id", "text").count().withColumn("item_key", F.xxhash64("item_id", "text"))
    prints = stage(
        numbered.select(F.col("item_key").alias("item_id"), "text")
        .mapInArrow(_fingerprint_items, "item_id long, fingerprint long, n_short int")
        .distinct()
    )
    lengths = sorted(r[0] for r in prints.filter("n_short > 0").select("n_short").distinct().collect())
    known = None
    if prints.count() <= broadcast_limit:
        rows = prints.select("fingerprint").distinct().toPandas()
        known = np.sort(rows["fingerprint"].to_numpy(np.int64).view(np.uint64))
    scanned = stage(
        keyed.mapInArrow(
            _scan(lengths, known), "doc_id long, doc_key long, n_words long, fingerprints array<long>"
        )
    )
    hits = scanned.select("doc_key", F.explode("fingerprints").alias("fingerprint"))
    pairs = stage(
        hits.join(prints, "fingerprint")
        .select("doc_key", F.col("item_id").alias("item_key"), "n_short")
        .distinct()
    )
    met = stage(
        pairs.groupBy("item_key").agg(F.count("*").alias("n"))
        .join(numbered.select("item_key", "item_id", F.col("text").alias("item_text")), "item_key")
    )
    hit_texts = keyed.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi")
    spans = (
        join_spread(pairs, met, "item_key", "n", pairs.count())  # an item that very many documents hold is broadcast
        .join(hit_texts.dropDuplicates(["doc_key"]).select("doc_key", "text"), "doc_key")
        .select("doc_key", "item_id", "n_short", "text", "item_text")
        .mapInArrow(_verify, "doc_key long, item_id long, spans array<struct<s: long, e: long>>")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["e"]).alias("to"),
        ),
        lambda a: a["n"],
    )
    by_doc = (
        spans.groupBy("doc_key")
        .agg(
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.collect_set(F.col("item_id").cast("string")).alias("items"),
        )
        .select("doc_key", covered.alias("n_hit"), F.array_sort("items").alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.join(by_doc, "doc_key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "doc_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated rows."""
    found = decontaminate(docs, benchmark).filter("contaminated").select("doc_key")
    return without(docs, _key(), found).select(docs.columns)
