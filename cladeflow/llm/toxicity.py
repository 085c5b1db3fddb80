"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first few bytes, so that inflected forms of a stem
meet. A vector holds all terms of a text; its norm counts those too that no
example has. A term weighs by its inverse document frequency over all documents
and by its relevance, log2(2 + how many times as often toxic examples have it).
Labelled examples stand in an inverted index whose postings are cut into blocks
of examples; a term's greatest weight in each block bounds a block's best cosine.
A search visits blocks by falling bound and ends when the bound can't reach the
K-th best cosine, so it finds K nearest examples exactly. They vote by distance,
and votes are calibrated on examples searched without themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import batch, columns_of, fold_held_out, prepare, stage
from .words import _TABLE, NOT_ALNUM, cut, mix, raw, slices

#: Labelled rows that the index is built from, at most, by label; drawn by a hash of the id.
EXAMPLES = {1: 512, 0: 640}
#: Power of a term's relevance in its weight.
RELEVANCE = 2.0
STEMS = (4, 5, 6)
K = 25
BLOCK = 64
#: Blocks that a search visits before it looks at bounds again.
FIRST_BLOCKS = 8
#: Added to a neighbour's distance before its vote is divided by it.
NEAREST = 0.05
BINS = 20
EVIDENCE = 5
#: Scores of texts that a worker remembers, so that copies are searched for once.
REMEMBERED = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each term, repeats included."""
    words = cut(part, NOT_ALNUM, lower=True)
    data, owner = _LOWER[raw(part)[0]], words.owner()
    who, what = [owner], [words.hashes]
    for n in STEMS:
        long = words.last - words.first > n
        at = words.first[long]
        total = np.full(len(at), n, np.uint64)
        for i in range(n):
            total += _TABLE[(i << 8) + data[at + i].astype(np.int64)]
        who.append(owner[long])
        what.append(mix(total ^ np.uint64(0x5DEECE66D)))
    return np.concatenate(who), np.concatenate(what)


def _distinct(who, what):
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    at = np.flatnonzero(new)
    return who[at], what[at], np.diff(np.append(at, len(who)))


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted hashes
    value: np.ndarray  # weight of each term, without the times it is in a text
    unknown: float  # the weight of any other term
    cells: np.ndarray = field(default=None, repr=False)

    def places(self, what: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where it has none."""
        if self.cells is None:
            self.cells = np.zeros(1 << 22, bool)
            self.cells[self.keys & np.uint64((1 << 22) - 1)] = True
        out = np.full(len(what), -1)
        maybe = np.flatnonzero(self.cells[what & np.uint64((1 << 22) - 1)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.keys, what[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[place] == what[maybe], place, -1)
        return out

    def vectors(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, term number and weight of known terms in unit-length vectors."""
        who, what, tf = _distinct(*terms(part))
        term = self.places(what)
        weight = (1 + np.log(tf)) * np.where(term < 0, self.unknown, self.value[term] if len(self.value) else 0.0)
        norm = np.sqrt(np.bincount(who, weight**2, len(part)))
        known = term >= 0
        who = who[known]
        return who, term[known], weight[known] / norm[who]


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the sizes of the ranges."""
    begin, size = begin.astype(np.int64), (end - begin).astype(np.int64)
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()), size


class BlockMaxIndex:
    """Inverted index over examples, with the greatest weight by term and block.

    example, term, weight: vectors of unit length, by example number; tie: a
    number of each example that orders examples of equal cosine, without labels.
    """

    def __init__(self, n_terms: int, ids: np.ndarray, labels: np.ndarray, example, term, weight, tie=None):
        tie = np.arange(len(ids)) if tie is None else tie
        heaviest = np.full(len(ids), -1)
        order = np.lexsort((weight, example))
        heaviest[example[order]] = term[order]
        ranked = np.lexsort((tie, heaviest))  # like examples share blocks
        self.rank = np.empty(len(ids), np.int64)
        self.rank[ranked] = np.arange(len(ids))
        self.ids, self.labels, self.tie = ids[ranked], labels[ranked], tie[ranked]
        self.blocks = -(-len(ids) // BLOCK)
        place = self.rank[example]
        order = np.lexsort((place, term))
        place, term = place[order], term[order]
        cell = term * self.blocks + place // BLOCK
        self.place, self.weight = place.astype(np.uint16 if len(ids) < 1 << 16 else np.int32), weight[order].astype(np.float32)
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        first = np.flatnonzero(new)
        self.posting = np.append(first, len(cell)).astype(np.int32)  # first posting of each cell
        self.block = (place[first] // BLOCK).astype(np.uint16 if self.blocks < 1 << 16 else np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.cell = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)  # first cell of each term
        self.visited = 0

    def search(self, term: np.ndarray, weight: np.ndarray, k: int = K, without: int = -1):
        """The k best places and cosines above 0; equal ones by `tie`.

        `without` leaves one place out.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not self.blocks or not len(term):
            return none
        cells, size = _ranges(self.cell[term], self.cell[term + 1])
        by_cell = np.repeat(weight, size)
        block = self.block[cells]
        bound = np.bincount(block, self.most[cells] * by_cell, self.blocks) + 1e-9
        order = np.argsort(-bound, kind="stable")
        scores = np.zeros(self.blocks * BLOCK)
        at, kth = 0, 0.0
        while at < self.blocks and bound[order[at]] >= max(kth, 2e-9):
            chosen = order[at:] if at else order[:FIRST_BLOCKS]
            chosen = chosen[bound[chosen] >= max(kth, 2e-9)]
            self.visited += len(chosen)
            at += len(chosen)
            open_ = np.zeros(self.blocks, bool)
            open_[chosen] = True
            used = open_[block]
            postings, n = _ranges(self.posting[cells[used]], self.posting[cells[used] + 1])
            scores += np.bincount(self.place[postings], self.weight[postings] * np.repeat(by_cell[used], n), len(scores))
            if without >= 0:
                scores[without] = 0
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        found = np.flatnonzero(scores >= max(kth, 1e-12))
        best = found[np.lexsort((self.tie[found], -scores[found]))[:k]]
        return best, np.minimum(scores[best], 1.0)


@dataclass
class Model:
    vocabulary: Vocabulary
    index: BlockMaxIndex
    weights: dict[int, float]  # labelled rows that an example of the label stands for
    silent: float  # score of a text without any known term
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    sent: object = None  # the vocabulary and the index, broadcast

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        if not len(places):
            return -1.0
        labels = self.index.labels[places]
        w = np.where(labels == 1, self.weights[1], self.weights[0]) / (1 - cosines + NEAREST)
        return float((w * labels).sum() / w.sum())

    def score(self, vote: float) -> float:
        return self.silent if vote < 0 else float(np.interp(vote, *self.curve))


def calibrated(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve from votes to shares of label 1, by pooling adjacent bins."""
    bins = np.minimum((votes * BINS).astype(int), BINS - 1)
    pools: list[list[float]] = []
    for i in range(BINS):
        own = bins == i
        if own.any():
            w = weights[own].sum()
            pools.append([(weights * votes)[own].sum(), (weights * labels)[own].sum(), w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([v / w for v, _, w in pools]), np.array([y / w for _, y, w in pools])


def _term_sets(batches):
    """Distinct terms of each example."""
    for b in batches:
        for at, part in slices(b.column("text")):
            who, what, tf = _distinct(*terms(part))
            ends = pa.array(np.searchsorted(who, np.arange(len(part) + 1)), pa.int32())
            rows = slice(at, at + len(part))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c)[rows] for c in ("doc_id", "toxic", "tie")),
                    pa.ListArray.from_arrays(ends, pa.array(what.view(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
                ],
                names=["doc_id", "toxic", "tie", "terms", "times"],
            )


def _document_counts(vocabulary):
    """In how many of the task's documents each known term is; row -1 counts the documents."""

    def run(batches):
        v = vocabulary.value
        total, n = np.zeros(len(v.keys), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, part in slices(b.column(0)):
                place = v.places(_distinct(*terms(part))[1])
                total += np.bincount(place[place >= 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield batch(term=(np.append(used, -1), pa.int32()), n=(np.append(total[used], n), pa.int64()))

    return run


def _examples(docs: DataFrame, labels: DataFrame, modulus: int, held: int, examples: dict):
    """Labelled texts to learn from, each once, and the number of labelled rows by label."""
    usable = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~fold_held_out(modulus, held))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    drawn = None
    for label, most in examples.items():
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    once = stage(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(drawn), "doc_id")  # at most sum(examples) rows
        .groupBy("text")  # a copied example would vote several times
        .agg(F.min(F.struct("doc_id", "toxic")).alias("first"))
        .select("first.doc_id", "first.toxic", "text", F.xxhash64("text").alias("tie"))
    )
    bounded = None  # an id may have many texts
    for label, most in examples.items():
        part = once.filter(F.col("toxic") == label).orderBy("tie", "doc_id").limit(most)
        bounded = part if bounded is None else bounded.unionByName(part)
    total = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return bounded, total


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, examples: dict = EXAMPLES) -> Model:
    """Fits on labelled documents whose crc32(doc_id as text) mod `modulus` isn't `held`.

    The examples, a bounded sample, are gathered; document frequencies are
    counted over all of `docs`.
    """
    spark = docs.sparkSession
    prepare(spark)
    sample, total = _examples(docs, labels, modulus, held, examples)
    schema = "doc_id long, toxic int, tie long, terms array<long>, times array<int>"
    rows = sample.select("doc_id", "toxic", "tie", "text").mapInArrow(_term_sets, schema).toArrow()
    rows = rows.sort_by([("tie", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    ids, toxic, tie = (rows.column(c).to_numpy() for c in ("doc_id", "toxic", "tie"))
    toxic = toxic.astype(np.int64)
    lists = rows.column("terms").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    what = lists.flatten().to_numpy().view(np.uint64)
    tf = rows.column("times").combine_chunks().flatten().to_numpy()
    n = {label: int((toxic == label).sum()) for label in (0, 1)}
    weights = {label: total.get(label, 0) / n[label] if n[label] else 0.0 for label in (0, 1)}

    keys, term = np.unique(what, return_inverse=True)
    example = np.repeat(np.arange(len(ids)), size)
    have_toxic = np.bincount(term, toxic[example], len(keys))
    have_other = np.bincount(term, minlength=len(keys)) - have_toxic
    odds = n[0] / n[1] if n[1] else 0.0
    relevance = np.log2(2 + have_toxic * odds / np.maximum(have_other + odds, 1e-9))
    vocabulary = Vocabulary(keys, np.zeros(0), 0.0)
    sent = spark.sparkContext.broadcast(vocabulary)
    counted = (
        docs.select(F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_document_counts(sent), "term int, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # one row a known term
    )
    df, every = np.zeros(len(keys), np.int64), 0
    at, count = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df[at[at >= 0]] = count[at >= 0]
    every = int(count[at < 0].sum())
    vocabulary.value = (np.log((1 + every) / (1 + df)) + 1) * relevance**RELEVANCE
    vocabulary.unknown = float(np.log(1 + every) + 1)

    weight = (1 + np.log(tf)) * vocabulary.value[term] if len(keys) else np.zeros(0)
    weight = weight / np.sqrt(np.bincount(example, weight**2, len(ids)))[example]
    spoken = size > 0
    number = np.cumsum(spoken) - 1
    index = BlockMaxIndex(len(keys), ids[spoken], toxic[spoken], number[example], term, weight, tie[spoken])
    mute = toxic[~spoken]
    silent = (mute * weights[1]).sum(), ((1 - mute) * weights[0]).sum()
    share = total.get(1, 0) / max(1, sum(total.values()))
    rate = float((silent[0] + share) / (sum(silent) + 1)) if len(ids) else 0.0
    model = Model(vocabulary, index, weights, rate)
    model.sent = spark.sparkContext.broadcast((vocabulary, index))
    model.curve = _calibrate(model, sample)
    return model


def _calibrate(model: Model, sample: DataFrame):
    """The curve from votes of the examples, each searched without itself, as a Spark job."""
    sent, weights = model.sent, model.weights

    def votes(batches):
        v, index = sent.value
        m, order = Model(v, index, weights, 0.0), np.argsort(index.tie)
        for b in batches:
            for at, part in slices(b.column("text")):
                who, term, weight = v.vectors(part)
                ends = np.searchsorted(who, np.arange(len(part) + 1)).tolist()
                ties = b.column("tie").to_numpy()[at : at + len(part)]
                own = order[np.minimum(np.searchsorted(index.tie[order], ties), max(0, len(order) - 1))] if len(order) else ties * 0
                out = [
                    m.vote(*index.search(term[i:j], weight[i:j], without=int(p))) for i, j, p in zip(ends, ends[1:], own.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column("toxic")[at : at + len(part)], pa.array(out, pa.float64())], names=["toxic", "vote"]
                )

    found = sample.select("toxic", "tie", "text").mapInArrow(votes, "toxic int, vote double").toArrow()
    votes_, toxic = found.column("vote").to_numpy(), found.column("toxic").to_numpy()
    known = votes_ >= 0
    w = np.where(toxic == 1, weights[1], weights[0])
    return calibrated(votes_[known], toxic[known], w[known])


EVIDENCE_FIELDS = [
    StructField("score", DoubleType()),
    StructField("predicted", IntegerType()),
    StructField("neighbours", ArrayType(LongType())),
    StructField("cosines", ArrayType(DoubleType())),
]


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`doc`, a struct of the columns `keep`, with the score and its evidence.

    score is 0 to 1; neighbours are doc_ids of the nearest examples with their
    cosines, the nearest first. A text without any term that an example has, an
    empty or null one too, gets the share of label 1 among examples without
    terms and one more row of the whole share, and no neighbours. Without labelled rows all scores are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent, weights, silent, curve = model.sent, model.weights, model.silent, model.curve
    rows = docs.select(F.struct(*columns_of(keep)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        m, found = Model(*sent.value, weights, silent, curve), {}
        for b in batches:
            for at, part in slices(b.column("text")):
                who, term, weight = m.vocabulary.vectors(part)
                ends = np.searchsorted(who, np.arange(len(part) + 1)).tolist()
                data, bounds = raw(part)
                data, bounds = memoryview(data), bounds.tolist()
                out = []
                for i in range(len(part)):
                    key = hashlib.blake2b(data[bounds[i] : bounds[i + 1]], digest_size=16).digest()
                    if key not in found:
                        if len(found) >= REMEMBERED:
                            found.clear()
                        own = slice(ends[i], ends[i + 1])
                        places, cosines = m.index.search(term[own], weight[own])
                        near = m.index.ids[places[:EVIDENCE]].tolist()
                        found[key] = (m.score(m.vote(places, cosines)), near, cosines[:EVIDENCE].tolist())
                    out.append(found[key])
                score = np.array([x[0] for x in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc")[at : at + len(part)],
                        pa.array(score, pa.float64()),
                        pa.array((score >= 0.5).astype(np.int32)),
                        pa.array([x[1] for x in out], pa.list_(pa.int64())),
                        pa.array([x[2] for x in out], pa.list_(pa.float64())),
                    ],
                    names=["doc", "score", "predicted", "neighbours", "cosines"],
                )

    return rows.mapInArrow(run, StructType([rows.schema["doc"], *EVIDENCE_FIELDS]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of each row.

    Labels with a null id or another value than 0 and 1 are left out; of several
    for one id the highest holds. Rows that repeat an id are scored by their own
    texts, and each different text of a labelled id may be an example. Other
    columns don't matter. An empty table gives no rows.
    """
    return toxicity_scores(docs, fit(docs, labels), ["doc_id"]).select(
        "doc.doc_id", "score", "predicted", "neighbours", "cosines"
    ).withColumn("held_out", fold_held_out(5, 0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted toxic; see toxicity() for odd rows, which stay unless predicted so.

    All columns pass through, whatever their names.
    """
    scored = toxicity_scores(docs, fit(docs, labels), docs.columns)
    return scored.filter("predicted = 0").select("doc.*")
