"""Language-model scores by a probabilistic suffix tree over bytes.

Symbols are the 62 most frequent bytes of the lower-cased training texts, one
symbol for all other bytes and one for a text's end. All contexts of up to DEPTH
symbols that the training texts hold are candidates, however rare. A candidate
stays where its next-symbol distribution diverges enough from its suffix's.
Distributions are smoothed by those of the suffix, and each symbol is scored in
the longest context of the tree that precedes it.

The tree isn't gathered. Contexts with the same last two symbols lie in one of
PARTS partitions, at most SYMBOLS ** 2 of full length for each such pair, and are
fitted there; the result is a table of the value of each context with each next
symbol that occurs. It meets the documents in a join. Only rows with at least
1 / (CONTEXTS * SYMBOLS) of all symbols, of which there are CONTEXTS * SYMBOLS at
most, are sent to the workers; this bears on speed and not on values.

A unigram score over words goes with it. Word counts are not bounded, so they
meet the documents in a join; only words with at least 1 / FREQUENT of all
tokens, of which there are FREQUENT at most, are sent to the workers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, fold_held_out, prepare, stage, texts
from .words import WHITE, cut, raw, slices

DEPTH = 4
BITS = 6
SYMBOLS = 1 << BITS
OTHER = SYMBOLS - 1
CONTEXTS = 16_000
#: Partitions in which the tree is fitted.
PARTS = 128
#: Nats that a context must save over its suffix, all its occurrences together.
LEAST_SAVED = 24.0
#: Occurrences that the suffix's distribution counts as.
PRIOR = 6.0
FREQUENT = 1 << 16
#: Distinct keys that a task gathers before it hands them on.
TALLY = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tally:
    """Counts of integer keys, merged now and then; hands on what grows too large."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray):
        keys = np.sort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        self._push(keys[at], np.diff(np.append(at, len(keys))))
        if self.size > 2 * TALLY:
            merged = self.take()
            if len(merged[0]) > TALLY:
                return merged
            self._push(*merged)
        return None

    def _push(self, keys, counts):
        self.held.append((keys, counts))
        self.size += len(keys)

    def take(self):
        keys = np.concatenate([k for k, _ in self.held] or [np.zeros(0, np.int64)])
        counts = np.concatenate([c for _, c in self.held] or [np.zeros(0, np.int64)])
        self.held, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        return keys[at], (np.add.reduceat(counts, at) if len(at) else counts)


def _rows(kind: int, found) -> pa.RecordBatch:
    keys, counts = found
    return batch(
        kind=(np.full(len(keys), kind), pa.int32()), key=(keys, pa.int64()), n=(counts, pa.int64())
    )


WORD, BYTE, TEXT = 0, 1, 2


def _count_words(batches):
    words, bytes_, n = Tally(), np.zeros(256, np.int64), 0
    for b in batches:
        n += b.num_rows
        for _, part in slices(b.column(0)):
            bytes_ += np.bincount(_LOWER[raw(part)[0]], minlength=256)
            if out := words.add(cut(part, WHITE, lower=True).hashes.view(np.int64)):
                yield _rows(WORD, out)
    yield _rows(WORD, words.take())
    yield _rows(BYTE, (np.arange(256), bytes_))
    yield _rows(TEXT, (np.zeros(1, np.int64), np.array([n])))


def _laid_out(part: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with DEPTH zeros before each text and one after.

    With it the places to predict, the first of them for each text, and the
    lower-cased bytes.
    """
    data, at = raw(part)
    data = _LOWER[data]
    gap = DEPTH + 1
    size = np.diff(at)
    text = np.repeat(np.arange(len(part)), size)
    out = np.zeros(len(data) + gap * len(part), np.int32)
    out[np.arange(len(data)) + text * gap + DEPTH] = codes[data]
    first = at[:-1] + np.arange(len(part))
    texts_ = np.repeat(np.arange(len(part)), size + 1)
    places = np.arange(len(data) + len(part)) + texts_ * DEPTH + DEPTH
    return out, places, first, data


def _contexts(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    context = symbols[places - DEPTH]
    for back in range(DEPTH - 1, 0, -1):
        context = context << BITS | symbols[places - back]
    return context


TRAIN, HELD = 0, 1


def _count_grams(codes: np.ndarray):
    """Contexts joined with the next symbol, of training and held-out texts."""

    def run(batches):
        tallies = {TRAIN: Tally(), HELD: Tally()}
        for b in batches:
            held = b.column("held_out")
            for kind, grams in tallies.items():
                own = b.column("text").filter(held if kind == HELD else pc.invert(held))
                for _, part in slices(own):
                    symbols, places, _, _ = _laid_out(part, codes)
                    if out := grams.add(_contexts(symbols, places) << BITS | symbols[places]):
                        yield _rows(kind, out)
        for kind, grams in tallies.items():
            yield _rows(kind, grams.take())

    return run


class SuffixTree:
    """log10 probabilities by context, and the context to use after any DEPTH symbols."""

    def __init__(self, codes, other, contexts, table):
        self.codes = codes  # byte to symbol
        self.other = other  # log10 share of each byte among those of symbol OTHER
        self.contexts = contexts  # by length: sorted contexts and their numbers
        self.table = table.astype(np.float32)

    def states(self, contexts: np.ndarray) -> np.ndarray:
        """The number of the longest context of the tree that ends each of DEPTH symbols."""
        states = np.zeros(len(contexts), np.int64)
        for length in range(1, DEPTH + 1):
            where, number = self.contexts[length]
            if len(where):
                suffix = contexts & ((1 << BITS * length) - 1)
                place = np.minimum(np.searchsorted(where, suffix), len(where) - 1)
                states = np.where(where[place] == suffix, number[place], states)
        return states

    def values(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each gram after the symbols before."""
        return self.table[self.states(grams >> BITS), grams & OTHER]

    def score(self, part: pa.Array) -> np.ndarray:
        """log10 probability of each text, its end included."""
        symbols, places, first, data = _laid_out(part, self.codes)
        value = self.values(_contexts(symbols, places) << BITS | symbols[places]).astype(np.float64)
        return np.add.reduceat(value, first) + _spread(self.other, part, data)


def _spread(other: np.ndarray, part: pa.Array, data: np.ndarray) -> np.ndarray:
    """Of each text, the sum of what its bytes of symbol OTHER add."""
    total = np.concatenate([[0.0], np.cumsum(other[data])])
    at = raw(part)[1]
    return total[at[1:]] - total[at[:-1]]


def fit_tree(
    levels: list[tuple[np.ndarray, np.ndarray]], byte_counts: np.ndarray, codes: np.ndarray, stay: tuple[int, ...] = ()
) -> SuffixTree:
    """levels[k]: contexts of k symbols joined with the next symbol, and counts.

    Contexts of one symbol in `stay` are kept in any case.
    """
    dense = []
    for keys, counts in levels:
        contexts, row = np.unique(keys >> BITS, return_inverse=True)
        table = np.zeros((len(contexts), SYMBOLS))
        np.add.at(table, (row, keys & OTHER), counts)
        dense.append((contexts, table))
    root = dense[0][1][0] if len(dense[0][1]) else np.zeros(SYMBOLS)
    smooth = [((root + 1) / (root.sum() + SYMBOLS))[None, :]]
    kept = [np.ones(1, bool)]
    for k in range(1, DEPTH + 1):
        contexts, table = dense[k]
        suffix = contexts & ((1 << BITS * (k - 1)) - 1)
        parents = dense[k - 1][0] if len(dense[k - 1][0]) else np.zeros(1, np.int64)
        parent = smooth[k - 1][np.searchsorted(parents, suffix)] if len(contexts) else np.zeros((0, SYMBOLS))
        total = table.sum(1, keepdims=True)
        share = table / np.maximum(total, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            saved = np.where(table > 0, table * np.log(share / parent), 0).sum(1)
        smooth.append((table + PRIOR * parent) / (total + PRIOR))
        kept.append(saved >= LEAST_SAVED)
    for k in range(DEPTH, 1, -1):  # a context's suffixes stay with it
        suffix = dense[k][0][kept[k]] & ((1 << BITS * (k - 1)) - 1)
        kept[k - 1][np.searchsorted(dense[k - 1][0], suffix)] = True
    if stay:
        kept[1] |= np.isin(dense[1][0], stay)
    rows, numbered, at = [smooth[0]], [None], 1
    for k in range(1, DEPTH + 1):
        n = int(kept[k].sum())
        numbered.append((dense[k][0][kept[k]], np.arange(at, at + n)))
        rows.append(smooth[k][kept[k]])
        at += n
    return SuffixTree(codes, _other_shares(byte_counts, codes), numbered, np.log10(np.concatenate(rows)))


def _other_shares(byte_counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    others = np.flatnonzero(codes == OTHER)
    other = np.zeros(256)
    other[others] = np.log10((byte_counts[others] + 1) / (byte_counts[others].sum() + len(others)))
    return other


def _summed(keys: np.ndarray, counts: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by the last `symbols` symbols of the keys."""
    found, at = np.unique(keys & ((1 << BITS * symbols) - 1), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, counts)
    return found, total


def _fit_part(pairs: tuple[np.ndarray, np.ndarray], byte_counts: np.ndarray, codes: np.ndarray):
    """key, n and value of all grams of a partition, which has whole pairs of last context symbols.

    pairs: counts of all contexts of one symbol joined with the next. The value is
    null where the tree has no context of two symbols or more; whether one of one
    symbol stays depends on other partitions.
    """

    def run(batches):
        held = list(batches)
        if not held:
            return
        key, trained, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        seen = trained > 0
        deep = [_summed(key[seen], trained[seen], k + 1) for k in range(2, DEPTH + 1)]
        tree = fit_tree([_summed(*pairs, 1), pairs, *deep], byte_counts, codes)
        states = tree.states(key >> BITS)
        value = tree.table[states, key & OTHER].astype(np.float64)
        open_ = states <= len(tree.contexts[1][0])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(value, mask=open_)], names=["key", "n", "value"])

    return run


class Values:
    """Values of some grams, by a table of slots; of grams that share a slot the last stays."""

    SLOT_BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self._slots = keys, values, None

    def _slot(self, keys):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its value, or 0."""
        if self._slots is None:
            own, value = np.full(1 << self.SLOT_BITS, -1, np.int32), np.zeros(1 << self.SLOT_BITS)
            slot = self._slot(self.keys)
            _, last = np.unique(slot[::-1], return_index=True)
            last = len(slot) - 1 - last
            own[slot[last]], value[slot[last]] = self.keys[last], self.values[last]
            self._slots = own, value
        slot = self._slot(keys)
        known = self._slots[0][slot] == keys
        return known, np.where(known, self._slots[1][slot], 0)


def symbol_codes(byte_counts: np.ndarray) -> np.ndarray:
    codes = np.full(256, OTHER, np.int32)
    top = np.argsort(-byte_counts, kind="stable")[: OTHER - 1]
    codes[top] = np.arange(1, OTHER)
    return codes


def _rare_grams(owner: np.ndarray, grams: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct grams of each of n texts, and how often each is there."""
    both, times = np.unique(owner.astype(np.int64) << BITS * (DEPTH + 1) | grams, return_counts=True)
    ends = pa.array(np.searchsorted(both >> BITS * (DEPTH + 1), np.arange(n + 1)), pa.int32())
    grams = both & ((1 << BITS * (DEPTH + 1)) - 1)
    return pa.ListArray.from_arrays(ends, pa.array(grams, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))


def _score(codes, other, common, frequent):
    def run(batches):
        (keys, counts), common_values = frequent.value, common.value
        for b in batches:
            for at, part in slices(b.column("text")):
                rows = slice(at, at + len(part))
                words = cut(part, WHITE, lower=True)
                owner, h = words.owner(), words.hashes.view(np.int64)
                order = np.lexsort((h, owner))
                owner, h = owner[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                owner, h = owner[first], h[first]
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                known = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                value = np.where(known, times * np.log10(counts[place] + 1.0), 0) if len(keys) else known * 1.0
                n = len(part)
                rare = np.flatnonzero(~known)
                ends = pa.array(np.searchsorted(owner[rare], np.arange(n + 1)), pa.int32())
                symbols, places, first, data = _laid_out(part, codes)
                grams = _contexts(symbols, places) << BITS | symbols[places]
                found, log_share = common_values.look_up(grams)
                text = np.repeat(np.arange(n), np.diff(np.append(first, len(grams))))
                score = np.add.reduceat(log_share, first) + _spread(other, part, data)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[rows],
                        b.column("held_out")[rows],
                        pa.array(np.diff(words.bounds) + 1, pa.int64()),
                        pa.array(np.bincount(owner, known * times, n).astype(np.int64)),
                        pa.array(np.bincount(owner, value, n)),
                        pa.array(score),
                        pa.ListArray.from_arrays(ends, pa.array(h[rare], pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(times[rare], pa.int32())),
                        *_rare_grams(text[~found], grams[~found], n),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_frequent", "frequent", "score", "rare", "times", "grams", "gram_times"],
                )

    return run


def _gram_values(grams: DataFrame, byte_counts: np.ndarray, codes: np.ndarray) -> tuple[DataFrame, int]:
    """key, n and value of each gram, and the sum of n; grams: key, trained, n."""
    spark = grams.sparkSession
    pair = F.col("key") % (1 << BITS * 2)
    counted = grams.groupBy(pair.alias("pair")).agg(F.sum("trained").alias("trained"), F.sum("n").alias("n")).toArrow()
    key, trained = counted.column("pair").to_numpy(), counted.column("trained").to_numpy()
    order = np.flatnonzero(trained)
    pairs = key[order].astype(np.int64), trained[order].astype(np.int64)

    short = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(short)
    spark.conf.set(short, "65536")  # numbers only
    fitted = stage(
        grams.repartition(PARTS, F.shiftright("key", BITS) % (1 << BITS * 2))
        .select("key", "trained", "n")
        .mapInArrow(_fit_part(pairs, byte_counts, codes), "key long, n long, value double")
    )
    spark.conf.set(short, before)

    last = F.shiftright("key", BITS) % SYMBOLS
    stay = fitted.filter("value is not null").select(last.alias("last")).distinct().collect()
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = fit_tree([_summed(*pairs, 1), pairs, *[empty] * (DEPTH - 1)], byte_counts, codes, tuple(r["last"] for r in stay))
    every = np.arange(1 << BITS * 2)
    short_values = [(int(k), float(v)) for k, v in zip(every, tree.values(every))]
    others = spark.createDataFrame(short_values, "pair long, short_value double")
    whole = fitted.filter("value is not null").unionByName(
        fitted.filter("value is null")
        .join(F.broadcast(others), pair == F.col("pair"))
        .select("key", "n", F.col("short_value").alias("value"))
    )
    return whole, int(counted.column("n").to_numpy().sum())


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent double, "
    "score double, rare array<long>, times array<int>, grams array<long>, gram_times array<int>"
)


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, by document.

    Documents with crc32(doc_id as text) mod `modulus` = `held` are held out of
    training; a null id counts as an empty text there. Null texts are empty and
    score as an end alone. Rows that repeat an id each count. With nothing to
    learn from, all symbols are equally likely. Other columns don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs).withColumn("held_out", fold_held_out(modulus, held))
    training = rows.filter(~F.col("held_out")).select("text")
    counted = stage(
        training.mapInArrow(_count_words, "kind int, key long, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    sums = {r["kind"]: (r["v"], r["n"] or 0) for r in counted.groupBy("kind").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    ends = sums.get(TEXT, (0, 0))[1]
    distinct, tokens = sums.get(WORD, (0, 0))
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    byte_counts = np.zeros(256, np.int64)
    for r in counted.filter(F.col("kind") == BYTE).collect():
        byte_counts[r["key"]] = r["n"]
    codes = symbol_codes(byte_counts)

    grams = stage(
        rows.select("text", "held_out")
        .mapInArrow(_count_grams(codes), "kind int, key long, n long")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("kind") == TRAIN, F.col("n")).otherwise(0)).alias("trained"), F.sum("n").alias("n"))
    )
    values, symbols = _gram_values(grams, byte_counts, codes)
    common = values.filter(F.col("n") >= symbols / (CONTEXTS * SYMBOLS)).toArrow().sort_by("n")
    common = Values(common.column("key").to_numpy(), common.column("value").to_numpy())

    words = counted.filter(F.col("kind") == WORD).select(F.col("key").alias("token"), F.col("n").alias("c"))
    often = words.filter(F.col("c") >= max(1, tokens / FREQUENT)).toArrow().sort_by("token")
    frequent = (often.column("token").to_numpy(), often.column("c").to_numpy())
    sent = spark.sparkContext.broadcast(common), spark.sparkContext.broadcast(frequent)
    scored = stage(
        rows.mapInArrow(_score(codes, _other_shares(byte_counts, codes), *sent), SCORED).withColumn("row", F.monotonically_increasing_id())
    )
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rest = (
        pairs.select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
        .join(words, "token")
        .groupBy("row")
        .agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("value"))
    )
    contexts = (
        scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x"))
        .select("row", F.col("x.grams").alias("key"), F.col("x.gram_times").alias("times"))
        .join(values.select("key", F.col("value").alias("log_share")), "key")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("log_share")).alias("rare_score"))
    )
    every = math.log10(tokens + distinct + 1)  # add-one smoothing over the known tokens and one unseen
    end = math.log10(ends + 1)
    return scored.join(rest, "row", "left").join(contexts, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.coalesce("value", F.lit(0.0)) + end - F.col("n_tokens") * every).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
