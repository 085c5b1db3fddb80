"""Periodic runs of words, found in suffix trees by the smaller-half traversal.

The texts of an Arrow slice make one forest of suffix trees: a word is a symbol
of its text, and each text ends with a separator of its own, so no tree holds
suffixes of two texts. The trees' inner nodes are the intervals of a suffix
array with longest common prefixes. At a node of depth D, all leaves but those
of its largest child are looked at: a leaf i makes a tandem repeat of 2 D words
if i + D or i - D is a leaf of the same node, and the repeat branches if the next
word doesn't go on with it. Each leaf is looked at in O(log n) nodes, as a text's
node at least doubles whenever one of its leaves lies outside the largest child.

A branching repeat is the last rotation of its run. It is rotated to the left
as long as words agree; repeats with one end whose lengths are multiples of a
run's period, and that lie in it, are merged with it. What is left are the
maximal runs, each with its smallest period.

A word that a text has fewer times than a run must repeat its period can't be in
a run, so it serves as a separator.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts
from .words import slices

#: A run has so many words and so many periods at least.
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Leaves of nodes that are looked at together.
LEAVES_AT_ONCE = 1 << 21

RUNS = "array<struct<start: long, length: long, period: long>>"
REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def symbols(word_lists: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words that may be in runs, and their places among all words; -1 is a separator.

    Equal words of one text have one number, others different ones. A separator
    stands where words are left out and between texts.
    """
    counts = np.array([len(w) for w in word_lists], np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = pa.array([w for words in word_lists for w in words], pa.binary()).dictionary_encode()
    kinds = len(flat.dictionary)
    owner = np.repeat(np.arange(len(counts)), counts)
    key = owner * kinds + flat.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    new = np.ones(total, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    dense = np.cumsum(new) - 1
    often = np.bincount(dense)[dense] >= least
    symbol = np.full(total, -1, np.int64)
    symbol[order[often]] = dense[often]
    at = np.flatnonzero(symbol >= 0)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.ones(len(at), np.int64)
    gap[1:] = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
    place = np.arange(len(at)) + np.cumsum(gap) - 1
    out, origin = np.full(place[-1] + 2, -1, np.int64), np.full(place[-1] + 2, -1, np.int64)
    out[place], origin[place] = symbol[at], at
    return out, origin


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words' suffixes in order, rank of each place, common words with the one before.

    Separators (-1) all differ from each other; they have ranks but no suffix in
    the order. Ranks by 1, 2, 4, ... symbols are refined only for suffixes that
    still share theirs. They are kept, and the common length of two suffixes that
    part in a round is read off the ranks of the rounds before.
    """
    words, breaks = np.flatnonzero(text >= 0), np.flatnonzero(text < 0)
    n = len(words)
    order = words[np.argsort(text[words], kind="stable")]
    rank = np.empty(len(text), np.int32)
    rank[breaks] = n + np.arange(len(breaks))
    start = np.ones(n, bool)
    start[1:] = text[order[1:]] != text[order[:-1]]
    common = np.zeros(n, np.int32)
    slots, heads, levels, h = np.arange(n), None, [], 1
    at = order
    while True:
        heads = slots[np.maximum.accumulate(np.where(start, np.arange(len(slots)), 0))] if len(slots) else slots
        rank[at] = heads
        alone = start & np.append(start[1:], True) if len(slots) else start
        slots = slots[~alone]
        if not len(slots):
            return order, rank, common
        levels.append(rank.copy())
        at = order[slots]
        group, after = rank[at].astype(np.int64), rank[at + h].astype(np.int64)
        sort = np.argsort(group * len(text) + after, kind="stable")
        at, after = at[sort], after[sort]  # groups stand in order already
        order[slots] = at
        apart = np.flatnonzero((group[1:] == group[:-1]) & (after[1:] != after[:-1])) + 1
        a, b = at[apart - 1] + h, at[apart] + h
        same = np.full(len(apart), h, np.int64)
        for k in range(len(levels) - 2, -1, -1):
            step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a, b, same = a + step, b + step, same + step
        common[slots[apart]] = same
        start = np.ones(len(slots), bool)
        start[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        h *= 2


def inner_nodes(common: np.ndarray) -> np.ndarray:
    """Rows of inner nodes below the root: first and last leaf, depth, first and last leaf of the largest child."""
    shared = common > 0
    open_ = np.append(shared, False)
    open_[1:] |= shared
    slots = np.flatnonzero(open_)
    lengths = np.append(common, 0)[slots]
    depths: list[int] = []
    firsts: list[int] = []
    child_first: list[int] = []
    child_last: list[int] = []
    found: list[int] = []
    for slot, length in zip(slots.tolist(), lengths.tolist()):
        first = big_first = big_last = slot - 1
        while depths and depths[-1] > length:
            depth, first, a, b = depths.pop(), firsts.pop(), child_first.pop(), child_last.pop()
            if big_last - big_first > b - a:
                a, b = big_first, big_last
            found += (first, slot - 1, depth, a, b)
            big_first, big_last = first, slot - 1
        if length:
            if depths and depths[-1] == length:
                if big_last - big_first > child_last[-1] - child_first[-1]:
                    child_first[-1], child_last[-1] = big_first, big_last
            else:
                depths.append(length)
                firsts.append(first)
                child_first.append(big_first)
                child_last.append(big_last)
    return np.array(found, np.int64).reshape(-1, 5)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, end to end."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def branching_repeats(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End and half length of each branching tandem repeat, by end, then length."""
    order, rank, common = suffix_array(text)
    nodes = inner_nodes(common)
    first, last, depth, a, b = nodes.T
    left, right = a - first, last - b
    work = np.cumsum(left + right)
    ends, halves = [], []
    begin = 0
    while begin < len(nodes):
        done = work[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(work, done + LEAVES_AT_ONCE, "right")))
        part = slice(begin, stop)
        begin = stop
        leaf = order[np.concatenate([ranges(first[part], left[part]), ranges(b[part] + 1, right[part])])]
        node = np.concatenate([np.repeat(np.arange(*part.indices(len(nodes))), x[part]) for x in (left, right)])
        d, low, high = depth[node], first[node], last[node]
        for i in (leaf, leaf - d):
            inside = i >= 0
            other = rank[np.where(inside, np.where(i == leaf, i + d, i), 0)]
            inside &= (other >= low) & (other <= high)
            at, half = i[inside], d[inside]
            x, y = text[at + half], text[at + 2 * half]
            branch = (x != y) | (x < 0)
            ends.append((at + 2 * half)[branch])
            halves.append(half[branch])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, half = np.concatenate(ends), np.concatenate(halves)
    sort = np.lexsort((half, end))
    end, half = end[sort], half[sort]
    new = np.ones(len(end), bool)
    new[1:] = (end[1:] != end[:-1]) | (half[1:] != half[:-1])
    return end[new], half[new]


def rotated(text: np.ndarray, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """How far each repeat can be moved to the left, a word at a time."""
    moved, block = np.zeros(len(start), np.int64), 8
    live = np.arange(len(start))
    while len(live):
        size = np.minimum(block, start[live] - moved[live])
        live, size = live[size > 0], size[size > 0]
        if not len(live):
            break
        back = ranges(np.zeros(len(live), np.int64), size)
        at = np.repeat(start[live] - moved[live], size) - 1 - back
        word = text[at]
        differs = (word != text[at + np.repeat(half[live], size)]) | (word < 0)
        agree = np.minimum.reduceat(np.where(differs, back, block), np.cumsum(size) - size)
        moved[live] += np.minimum(agree, size)
        live = live[agree >= block]
        block *= 2
    return moved


def maximal_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, end and smallest period of all maximal runs of two periods or more."""
    end, half = branching_repeats(text)
    found = []
    while len(end):
        least = np.ones(len(end), bool)
        least[1:] = end[1:] != end[:-1]
        e, p = end[least], half[least]
        s = e - 2 * p
        s = s - rotated(text, s, p)
        found.append((s, e, p))
        group = np.cumsum(least) - 1
        merged = (half % p[group] == 0) & (end - 2 * half >= s[group])
        end, half = end[~merged], half[~merged]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(word_lists: list[list[bytes]], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    found: list[list] = [[] for _ in word_lists]
    text, origin = symbols(word_lists, least_exponent)
    if not len(text):
        return found
    start, end, period = maximal_runs(text)
    length = end - start
    enough = (length >= least_length) & (length >= least_exponent * period)
    start, length, period = origin[start[enough]], length[enough], period[enough]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in word_lists])])
    owner = np.searchsorted(bounds, start, "right") - 1
    sort = np.lexsort((period, start))
    for who, s, n, p in zip(owner[sort].tolist(), (start - bounds[owner])[sort].tolist(), length[sort].tolist(), period[sort].tolist()):
        found[who].append((s, n, p))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        turns[start + period] += 1
        turns[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(turns[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the report's contract has them: ids whose crc32 ends in 0 repeat part of their tail."""
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = g % n
    period = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * -(-(n - a) // len(period)))[: n - a]


def _each_slice(b):
    """(ids, lists of words) of some texts at a time."""
    for at, part in slices(b.column(1)):
        yield b.column(0)[at : at + len(part)].to_pylist(), [t.encode().split() for t in part.to_pylist()]


def _report(batches):
    for b in batches:
        for ids, lists in _each_slice(b):
            lists = [with_repeated_tail(w, d) for w, d in zip(lists, ids)]
            out = []
            for doc_id, words, runs in zip(ids, lists, runs_of(lists, LEAST_LENGTH, LEAST_EXPONENT)):
                s, n, p = strongest(runs) or (None,) * 3
                told = "".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()
                out.append((
                    doc_id, len(runs), s, n, p, 1000 * n // p if runs else None,
                    hashlib.sha256(told).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest(),
                ))
            yield _batch(out, REPORT_TYPE)


def _runs(least_length: int, least_exponent: int):
    def run(batches):
        for b in batches:
            for ids, lists in _each_slice(b):
                runs = runs_of(lists, least_length, least_exponent)
                names = ("start", "length", "period")
                out = [(d, len(w), [dict(zip(names, r)) for r in x], collapsed(w, x).decode()) for d, w, x in zip(ids, lists, runs)]
                yield _batch(out, RUNS_TYPE)

    return run


_run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
RUNS_TYPE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _run), ("collapsed", pa.string())])
REPORT_TYPE = pa.schema([
    (c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in REPORT.split(", ")
])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by words) and the text collapsed to one period a run.

    A run is a longest stretch of consecutive words with one smallest period, of
    least_length words and least_exponent (2 or more) periods at least. Words lie
    between bytes 0x20 and 0x09 to 0x0D. Rows that repeat an id are looked at each
    on its own; null texts are empty and have no run; an empty table gives no
    rows; other columns don't matter. A task holds some megabytes of texts at a
    time, or one longer text; a text takes some 100 bytes a word.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    prepare(docs.sparkSession)
    out = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_runs(least_length, least_exponent), out)


def run_report(docs: DataFrame) -> DataFrame:
    """Number, strongest run and digests of the runs of each document.

    Before that, some texts' tails are made periodic (see with_repeated_tail); a
    null id has no decimal form and leaves its text alone. Otherwise as
    periodic_runs().
    """
    prepare(docs.sparkSession)
    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_report, REPORT)
