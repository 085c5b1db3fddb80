"""N-gram Jaccard join as a blocked sparse product of document by n-gram.

Documents are rows and word n-grams columns of an incidence matrix. Documents
with equal rows are one node. Columns are dealt out by hash, and each block of
columns tells which rows meet in it. Two bounds keep rows out of most columns.
By size: rows of similarity t share at least ceil(t * n) columns, so their
first n - ceil(t * n) + k columns, in any one order, have k in common. Columns
are counted among these first parts alone; a row then needs only all but k - 1
of its part, and takes the rarest. A chance column rarely is among them.

A column that thousands of near copies share isn't squared. Its rows first meet
one hub, and linked rows are joined to components. Where a hub's cluster then
still holds several, its rows meet its center, the one most like its middle, the
columns that most of them have. A row u that is not linked with a set h of
columns can only be linked with v if the columns in which u differs from h and
those in which v does have more than (t * extra + missing) / (1 + t) in common,
of v's extra and missing columns. So what is left to do is a second product, of
rows by their differences from the middle or center, of which v needs some
alone; near copies with edits of their own do not meet there. Any pair that
could be linked is decided exactly, by its rows or by their differences.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import batch, heavy_keys, join_spread, prepare, stage, unstage, without
from .components import components
from .words import WHITE, Words, cut, grams, mix, slices

#: The most columns whose counts order the others (1 MB); all else counts as rare.
HOT_COLUMNS = 1 << 16
#: A column is reported by a task when so many of its documents have it.
HOT_IN_TASK = 4
#: Cells of the filter that tells which columns more than one row may have (8 MB of bits).
FILTER_BITS = 26
#: Bits of a column's hash that tell columns apart where rows are told to meet; pairs are decided by all 64.
COLUMN_BITS = 40
#: Blocks of columns that are counted and laid out one after the other, so that their shuffles aren't on disk at once; a
#: block of fewer than BLOCK_ROWS rows only costs the driver.
ROUNDS = 4
BLOCK_ROWS = 1 << 22
#: Up to so many ids are sent to all workers (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Values of rows that are laid side by side at once.
PRODUCT_VALUES = 1 << 21
#: Nodes of a cluster that its middle is taken from, about; this bears on speed alone.
SAMPLED = 64


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct n-gram; a shorter text has one, of all its words."""
    h, same = grams(words, n)
    owner, size = words.owner(), np.diff(words.bounds)
    who, what = [owner[: len(h)][same]], [h[same]]
    for short in range(1, n):
        if (size == short).any():
            g, _ = grams(words, short)
            texts_ = np.flatnonzero(size == short)
            who.append(texts_)
            what.append(mix(g[words.bounds[texts_]] ^ np.uint64(short)))
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    return who[new], what[new]


def _nodes(who: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and a hash of each whole set, the same for equal sets."""
    bounds = np.searchsorted(who, np.arange(n + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(what ^ np.uint64(0x9E3779B97F4A7C15)))])
    size = np.diff(bounds)
    return size, mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)).view(np.int64)


def _sets(column: pa.Array, n: int):
    words = cut(column, WHITE, lower=True)
    who, what = shingle_sets(words, n)
    size, node = _nodes(who, what, len(column))
    return who, what, size, node


def _describe(n: int):
    """A row for each document; then the columns that many documents of the task have."""

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            for at, part in slices(b.column("text")):
                who, what, size, node = _sets(part, n)
                hashes, counts = np.unique(what, return_counts=True)
                for h, c in zip(hashes[counts >= 2].tolist(), counts[counts >= 2].tolist()):
                    seen[h] = seen.get(h, 0) + c
                if len(seen) > 4 * HOT_COLUMNS:
                    least = sorted(seen.values())[-HOT_COLUMNS]
                    seen = {h: c for h, c in seen.items() if c > least}
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[at : at + m],
                        b.column("row_key")[at : at + m],
                        pa.array(size, pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.nulls(m, pa.int64()),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "node", "hot"],
                )
        hot = [(h, c) for h, c in seen.items() if c >= HOT_IN_TASK]
        yield batch(
            doc_id=([None] * len(hot), pa.int64()),
            row_key=([None] * len(hot), pa.int64()),
            n_shingles=([c for _, c in hot], pa.int64()),
            node=(np.array([h for h, _ in hot], np.uint64).view(np.int64), pa.int64()),
            hot=([1] * len(hot), pa.int64()),
        )

    return run


def _least_shared(size, percent: int):
    """Columns that a row of this size shares with any row it is linked with."""
    return -(-percent * size // 100)


def _spare(size, percent: int):
    """How many common columns the first parts of linked rows of this size or more have."""
    return np.maximum(1, (100 - percent) * size // 100)


def _first_parts(n: int, percent: int, hot):
    """The first columns of each node, its size, and how many of them it needs at last."""

    def run(batches):
        keys, counts = hot.value
        done: set[int] = set()
        for b in batches:
            for _, part in slices(b.column(0)):
                who, what, size, node = _sets(part, n)
                new = np.zeros(len(part), bool)
                for i, key in enumerate(node.tolist()):
                    if size[i] and key not in done:
                        new[i] = True
                        done.add(key)
                if len(done) > 500_000:
                    done.clear()
                keep = new[who]
                who, what = who[keep], what[keep]
                often = np.zeros(len(what), np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, what), len(keys) - 1)
                    often = np.where(keys[place] == what, counts[place], 0)
                order = np.lexsort((what, often, who))
                who, what = who[order], what[order]
                begin = np.searchsorted(who, np.arange(len(part)))
                least = _least_shared(size, percent)
                first = size - least + _spare(size, percent)
                needed = first - _spare(least, percent) + 1
                used = np.arange(len(who)) - begin[who] < first[who]
                at, column = who[used], what[used] >> np.uint64(64 - COLUMN_BITS)
                # columns of a row that fall together count once; so it needs one more for each
                cell = np.sort(column | at.astype(np.uint64) << np.uint64(COLUMN_BITS))
                again = (cell[1:][cell[1:] == cell[:-1]] >> np.uint64(COLUMN_BITS)).astype(np.int64)
                needed = needed + np.bincount(again, minlength=len(part))
                yield batch(
                    gram=(column.view(np.int64), pa.int64()),
                    node=(node[at], pa.int64()),
                    size=(size[at], pa.int32()),
                    first=(first[at], pa.int32()),
                    needed=(needed[at], pa.int32()),
                )

    return run


def _sketches(who: np.ndarray, what: np.ndarray, size: np.ndarray) -> pa.Array:
    """The size of each row, in 8 bytes, and a bit for each cell that some column of it falls into.

    A row has as many cells as the next power of two, so a longer sketch is
    folded to a shorter one by halves.
    """
    cells = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(cells // 64 + 1)])
    bits = np.zeros(64 * begin[-1], bool)
    bits[64 * (begin[who] + 1) + (what & (cells[who] - 1).astype(np.uint64)).astype(np.int64)] = True
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    words[begin[:-1]] = size
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((8 * begin).astype(np.int32)), pa.py_buffer(words)])


def most_shared(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two sketched rows, and a bound on how many columns they share."""
    (m, p, u), (n, q, v) = ((int.from_bytes(s[:8], "little"), 8 * len(s) - 64, int.from_bytes(s[8:], "little")) for s in (x, y))
    while p > q:
        p //= 2
        u = u >> p | u & ((1 << p) - 1)
    while q > p:
        q //= 2
        v = v >> q | v & ((1 << q) - 1)
    both = u & v  # a cell of one row alone has a column of that row alone
    return m, n, min(m - (u ^ both).bit_count(), n - (v ^ both).bit_count())


def _likely(percent: int):
    """Pairs, and whether their sketches x and y leave it open that they are linked."""

    def run(batches):
        for b in batches:
            shared = [most_shared(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            likely = [100 * o >= percent * (m + n - o) for m, n, o in shared]
            out = b.drop_columns(["x", "y"])
            yield out.append_column("likely", pa.array(likely, pa.bool_()))

    return run


def _rows(n: int):
    def run(batches):
        for b in batches:
            for _, part in slices(b.column(0)):
                who, what, size, node = _sets(part, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(who, np.arange(len(part) + 1)), pa.int32()),
                            pa.array(what.view(np.int64), pa.int64()),
                        ),
                        _sketches(who, what, size),
                    ],
                    names=["node", "grams", "sketch"],
                )

    return run


def _side_by_side(batches):
    """Parts of batches with rows x and y, as (part, sizes of x and y, value, pair, side)."""
    for b in batches:
        ends = sum(b.column(name).offsets.to_numpy().astype(np.int64) for name in ("x", "y"))
        begin = 0
        while begin < b.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + PRODUCT_VALUES, "right")) - 1
            end = min(max(end, begin + 1), b.num_rows)
            part, begin = b.slice(begin, end - begin), end
            sides = []
            for name in ("x", "y"):
                column = part.column(name)
                bounds = column.offsets.to_numpy().astype(np.int64)
                sides.append((np.diff(bounds), column.values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]]))
            size = [s for s, _ in sides]
            pair = np.concatenate([np.repeat(np.arange(part.num_rows), s) for s in size])
            value = np.concatenate([v for _, v in sides])
            side = np.repeat(np.arange(2), [s.sum() for s in size])
            order = np.lexsort((side, value, pair))
            yield part, size, value[order], pair[order], side[order]


def _product(percent: int):
    """Pairs, and whether the overlap over all columns is large enough."""

    def run(batches):
        for b, size, value, pair, _ in _side_by_side(batches):
            twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            overlap = np.bincount(pair[1:][twice], minlength=b.num_rows)
            linked = 100 * overlap >= percent * (size[0] + size[1] - overlap)
            yield pa.RecordBatch.from_arrays([*b.select(["a", "b"]).columns, pa.array(linked)], names=["a", "b", "linked"])

    return run


COMPARED = "hub long, node long, size int, near boolean, similarity double"


def _compared(percent: int):
    """How similar each node, x, is to the middle of its cluster, y."""

    def run(batches):
        for b, size, value, pair, _ in _side_by_side(batches):
            twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            overlap = np.bincount(pair[1:][twice], minlength=b.num_rows)
            either = np.maximum(1, size[0] + size[1] - overlap)
            yield pa.RecordBatch.from_arrays(
                [*b.select(["hub", "node", "size"]).columns, pa.array(100 * overlap >= percent * either), pa.array(overlap / either)],
                names=["hub", "node", "size", "near", "similarity"],
            )

    return run


DIFFERENCES = "cluster long, node long, size int, component long, probes boolean, member long, listed int, columns array<long>"


def _differences(percent: int):
    """The columns in which a node, x, differs from y, of which the first `listed` are those it needs.

    member tells the rows apart, by cluster and node.
    """

    def run(batches):
        for b, _, value, pair, side in _side_by_side(batches):
            both = np.zeros(len(value) + 1, bool)
            both[1:-1] = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            once = ~(both[1:] | both[:-1])
            value, pair, side = value[once], pair[once], side[once]
            extra, missing = (np.bincount(pair[side == i], minlength=b.num_rows) for i in (0, 1))
            shared = (percent * extra + 100 * missing) // (100 + percent) + 1
            order = np.lexsort((mix(value), side, pair))
            ends = pa.array(np.concatenate([[0], np.cumsum(extra + missing)]), pa.int32())
            cluster, node = (b.column(c).to_numpy().view(np.uint64) for c in ("cluster", "node"))
            yield pa.RecordBatch.from_arrays(
                [
                    *b.select(["cluster", "node", "size", "component", "probes"]).columns,
                    pa.array(mix(node ^ mix(cluster + np.uint64(1))).view(np.int64)),
                    pa.array(np.maximum(0, extra + missing - shared + 1), pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(value[order].view(np.int64))),
                ],
                names=["cluster", "node", "size", "component", "probes", "member", "listed", "columns"],
            )

    return run


def _compared_differences(percent: int):
    """Pairs, and whether they are linked, by their sizes and differences x and y from one set.

    Two rows differ in the columns that just one of them has among its differences.
    """

    def run(batches):
        for b, size, value, pair, _ in _side_by_side(batches):
            twice = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
            differ = size[0] + size[1] - 2 * np.bincount(pair[1:][twice], minlength=b.num_rows)
            both = b.column("size").to_numpy().astype(np.int64) + b.column("size_o").to_numpy()
            overlap = (both - differ) // 2
            linked = 100 * overlap >= percent * (both - overlap)
            yield pa.RecordBatch.from_arrays([*b.select(["a", "b"]).columns, pa.array(linked)], names=["a", "b", "linked"])

    return run


def _fits(percent: int, a: str, b: str) -> Column:
    """Sizes of a pair are near enough to each other."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


class _Join:
    """nodes: node and row_key, that of one document of it. A hub's cluster is the nodes that share a column with it."""

    def __init__(self, keyed: DataFrame, nodes: DataFrame, n: int, percent: int):
        self.keyed, self.nodes, self.n, self.percent = keyed, nodes, n, percent
        self.grams: DataFrame | None = None

    def gather(self, nodes: DataFrame) -> None:
        """Lays out the whole row of each of `nodes`, from one document of it."""
        keys = stage(self.nodes.select("node", "row_key").join(nodes, "node", "left_semi"))
        few, wanted = keys.select("row_key").distinct(), keys.select("node")
        if keys.count() <= BROADCAST_IDS:
            few, wanted = F.broadcast(few), F.broadcast(wanted)
        made = stage(
            self.keyed.join(few, "row_key", "left_semi")
            .select("text")
            .mapInArrow(_rows(self.n), "node long, grams array<long>, sketch binary")
            .join(wanted, "node", "left_semi")
        )
        once = made.agg(F.count("*") == F.count_distinct("node")).first()[0]
        self.grams = made if once else stage(made.dropDuplicates(["node"]))
        unstage(keys, *([] if once else [made]))

    def row(self, end: str, name: str) -> DataFrame:
        """The whole rows of nodes, for a column `end` that names them."""
        return self.grams.select(F.col("node").alias(end), F.col("grams").alias(name))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs, `a` and `b`, of a staged table, which is unstaged then, and whether they may be linked by their sketches, `likely`."""
        sketches = [self.grams.select(F.col("node").alias(end), F.col("sketch").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
        out = stage(self.beside(pairs, *sketches).mapInArrow(_likely(self.percent), StructType([*pairs.schema.fields, StructField("likely", BooleanType())])))
        unstage(pairs)
        return out

    def beside(self, pairs: DataFrame, *rows: DataFrame) -> DataFrame:
        """`pairs`, staged, joined with each of `rows` on its first column, which tells its rows apart."""
        out = pairs
        for right in rows:
            end = right.columns[0]
            heavy = heavy_keys(pairs, end)
            if heavy is None:
                out = out.join(right, end)
                continue
            parts = F.coalesce("_parts", F.lit(1).cast("long"))  # rows of frequent keys are dealt out
            out = out.join(F.broadcast(heavy), end, "left")
            out = out.withColumn("_salt", F.pmod(F.xxhash64(*pairs.columns), parts)).drop("_parts")
            right = right.join(F.broadcast(heavy), end, "left")
            right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
            out = out.join(right, [end, "_salt"]).drop("_salt")
        return out.select(*pairs.columns, *(r.columns[1] for r in rows))

    def decide(self, pairs: DataFrame) -> DataFrame:
        """`a`, `b` and `linked` of the pairs of a staged table, which is unstaged then."""
        told = self.likely(pairs)
        open_ = stage(told.filter("likely").select("a", "b"))
        decided = self.beside(open_, self.row("a", "x"), self.row("b", "y")).mapInArrow(_product(self.percent), "a long, b long, linked boolean")
        out = stage(decided.unionByName(told.filter("not likely").select("a", "b", F.lit(False).alias("linked"))))
        unstage(told, open_)
        return out

    def stars(self, rows: DataFrame) -> DataFrame:
        """node, hub, their sizes, and whether the columns in which they meet have more rows, `several`.

        The hub of a column is the row with the fewest rarer columns: near
        copies differ from what they were copied from in rare ones.
        """
        least = F.struct("place", F.xxhash64("node"))
        hubs = stage(
            rows.groupBy("gram")
            .agg(F.min_by(F.struct("node", "size"), least).alias("hub"), F.count("*").alias("n"))
            .filter("n > 1")
        )
        met = join_spread(rows, hubs, "gram", "n", rows.count()).filter(F.col("node") != F.col("hub.node"))
        out = stage(
            met.groupBy("node", F.col("hub.node").alias("hub"))
            .agg(F.first("size").alias("size"), F.first("hub.size").alias("hub_size"), F.max(F.col("n") > 2).alias("several"))
        )
        unstage(hubs)
        return out

    def pairs_of(self, met: DataFrame, end: str) -> DataFrame:
        """Pairs of nodes and what column `end` names, with sizes near enough to each other."""
        return met.filter(_fits(self.percent, "size", f"{end}_size")).select(
            F.least("node", end).alias("a"), F.greatest("node", end).alias("b")
        ).distinct()

    def placed(self, rows: DataFrame, parts: DataFrame, name: str = "node") -> DataFrame:
        """`rows` with the `component` of column `name`."""
        own = parts.select(F.col("node").alias(name), "component")
        return rows.join(own, name, "left").withColumn("component", F.coalesce("component", name))

    def mixed(self, met: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of `met` whose hub has nodes of several components, with `component` and their number, `members`."""
        rows = stage(self.placed(met, parts))
        several = stage(
            rows.groupBy("hub")
            .agg(F.count("*").alias("members"), F.min("component").alias("_least"), F.max("component").alias("_most"))
            .filter("_least < _most")
            .select("hub", "members")
        )
        out = stage(join_spread(rows, several, "hub", "members", rows.count()))
        unstage(rows, several)
        return out

    def middles(self, open_: DataFrame) -> DataFrame:
        """hub, `y`, the columns that more than half of its nodes have, and members.

        Of many nodes some SAMPLED are counted, drawn by a hash: any set of
        columns serves for the argument that left() rests on. Near the middle of
        a cluster the differences of its nodes have least in common.
        """
        drawn = open_.filter(F.pmod(F.xxhash64("node", "hub"), F.ceil(F.col("members") / SAMPLED)) == 0).select("hub", "node")
        number = drawn.groupBy("hub").agg(F.count("*").alias("m"))
        columns = drawn.join(self.grams, "node").select("hub", F.explode("grams").alias("gram")).groupBy("hub", "gram").agg(F.count("*").alias("n"))
        middle = columns.join(number, "hub").filter("2 * n > m").groupBy("hub").agg(F.collect_list("gram").alias("y"))
        every = open_.groupBy("hub").agg(F.count("*").alias("members"))
        return stage(every.join(middle, "hub", "left").select("hub", F.coalesce("y", F.array().cast("array<long>")).alias("y"), "members"))

    def centred(self, open_: DataFrame, middles: DataFrame) -> DataFrame:
        """hub, node, size, whether it is linked with the middle, `near`, and the node most like the middle, `center`."""
        rows = stage(open_.select("hub", "node", "size"))
        compared = stage(self.beside(rows, self.row("node", "x"), middles.select("hub", "y")).mapInArrow(_compared(self.percent), COMPARED))
        most = F.max_by(F.struct("node", "size"), F.struct("similarity", F.xxhash64("node")))
        centers = compared.groupBy("hub").agg(most.alias("center"), F.count("*").alias("_n"))
        centers = stage(centers.select("hub", "_n", F.col("center.node").alias("center"), F.col("center.size").alias("center_size")))
        out = stage(join_spread(compared, centers, "hub", "_n", compared.count()).drop("_n", "similarity"))
        unstage(rows, compared, centers)
        return out

    def left(self, met: DataFrame, middles: DataFrame, states: DataFrame, parts: DataFrame) -> DataFrame:
        """Pairs of nodes of one cluster and different components that share a difference, with `linked`, but those that sketches rule out.

        Of two nodes of a cluster, both linked with its center, nothing is left to
        do. Let u not be linked with it. Where u isn't linked with the middle
        either, u probes with its differences from the middle, and else with those
        from the center; the other is met if it needs one of these columns.
        """
        linked = states.filter("linked").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "linked")
        pair = (F.least("node", "center") == F.col("_a")) & (F.greatest("node", "center") == F.col("_b"))
        known = F.coalesce("linked", F.col("node") == F.col("center"))
        members = stage(met.join(linked, pair, "left").withColumn("linked", known).drop("_a", "_b"))
        open_ = self.mixed(members, parts)
        unstage(members)
        differences, staged = None, []
        for far, rows in ((True, middles.select("hub", "y")), (False, self.row("center", "y"))):
            probes = ~F.col("linked") & (~F.col("near") if far else F.col("near"))
            used = stage(open_.filter(probes).groupBy("hub").agg(F.first("members").alias("_n")))
            own = join_spread(open_, used, "hub", "_n", open_.count()).withColumn("probes", probes)
            own = stage(own.select(F.xxhash64("hub", F.lit(far)).alias("cluster"), "hub", "center", "node", "size", "component", "probes"))
            part = stage(self.beside(own, self.row("node", "x"), rows).mapInArrow(_differences(self.percent), DIFFERENCES))
            unstage(used, own)
            staged.append(part)
            differences = part if differences is None else differences.unionByName(part)
        unstage(open_)
        used = F.when(F.col("probes"), F.col("columns")).otherwise(F.slice("columns", F.lit(1), F.col("listed")))
        cells = stage(
            differences.select("cluster", "member", "node", "size", "component", "probes", "listed", F.posexplode(used)).select(
                F.xxhash64("cluster", "col").alias("cell"), "member", "node", "size", "component", "probes", (F.col("pos") < F.col("listed")).alias("listed")
            )
        )
        several = stage(
            cells.groupBy("cell", "component")
            .agg(F.count("*").alias("n"), F.max("probes").alias("probes"), F.max("listed").alias("listed"))
            .groupBy("cell")
            .agg(
                F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("n"),
                F.max("probes").alias("probes"), F.max("listed").alias("listed"),
            )
            .filter("k > 1 and probes and listed")
            .select("cell", "n", F.col("main.component").alias("main"))
        )
        met_cells = stage(join_spread(cells, several, "cell", "n", cells.count()).drop("n"))
        unstage(cells, several)
        others = met_cells.filter("listed").select(*(F.col(c).alias(f"{c}_o") for c in ("cell", "member", "node", "size", "component", "main")))
        apart = (F.col("cell") == F.col("cell_o")) & (F.col("component") != F.col("component_o")) & _fits(self.percent, "size", "size_o")
        probing = met_cells.filter("probes")
        small = probing.filter("component != main").join(others, apart)
        large = probing.filter("component = main").join(others.filter("component_o != main_o"), apart)
        first = F.col("member") < F.col("member_o")
        one = lambda c: [F.when(first, F.col(c)).otherwise(F.col(f"{c}_o")), F.when(first, F.col(f"{c}_o")).otherwise(F.col(c))]
        ends = [x.alias(n) for c, names in (("member", ("m", "m_o")), ("node", ("a", "b")), ("size", ("size", "size_o"))) for x, n in zip(one(c), names)]
        told = self.likely(stage(small.unionByName(large).select(*ends).distinct()))
        found = stage(told.filter("likely").drop("likely"))
        unstage(met_cells, told)
        row = lambda end, name: differences.select(F.col("member").alias(end), F.col("columns").alias(name))
        rows = self.beside(found, row("m", "x"), row("m_o", "y"))
        out = stage(rows.mapInArrow(_compared_differences(self.percent), "a long, b long, linked boolean"))
        unstage(found, *staged)
        return out


def _known_bits(rows: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** FILTER_BITS cells that some gram of `rows` falls into; of fixed size."""
    cell = F.pmod(F.col("gram"), F.lit(1 << FILTER_BITS))
    words = (
        rows.groupBy(F.shiftright(cell, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(gram & 63))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _perhaps(bits):
    """Rows whose gram falls into a marked cell."""

    def run(batches):
        for b in batches:
            cell = b.column("gram").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            hit = bits.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    return run


def _once(keyed: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """`keyed` without further texts of nodes, up to BROADCAST_IDS of them.

    Any that stay lead to the same columns of the same node, which count once.
    """
    several = nodes.filter("n > 1").select("node", F.col("row_key").alias("kept"))
    others = sets.join(several, "node").filter("row_key != kept").select("row_key").distinct().limit(BROADCAST_IDS)
    return keyed.join(F.broadcast(others), "row_key", "left_anti")


def _several(parts: DataFrame) -> DataFrame:
    """The rows of a staged block of columns whose column has more than one, with the number of rows of it, `n`."""
    repeated = stage(parts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = parts.sparkSession.sparkContext.broadcast(_known_bits(repeated))
    out = stage(join_spread(parts.mapInArrow(_perhaps(bits), parts.schema), repeated, "gram", "n", total))
    bits.destroy()
    unstage(repeated)
    return out


def _joined(parts: DataFrame, states: DataFrame) -> DataFrame:
    """Components, of which the old ones are unstaged, with the links of `states` added."""
    more = states.filter("linked").select("a", "b")
    if more.isEmpty():
        return parts
    out = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    unstage(parts)
    return out


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key and head_key of each row.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A
    text of fewer than n words has one shingle, all its words; null texts and
    texts without words have none, are linked with nothing, and are their own
    component. component_id is the least doc_id that links lead to. Rows that
    repeat an id are each placed by their own text; a null id is no component's
    least unless the component has no other. row_key tells rows by id and text,
    head_key is that of the component's first row. Other columns don't matter.
    """
    spark = docs.sparkSession
    prepare(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _row_key().alias("row_key"))
    described = stage(
        keyed.mapInArrow(_describe(n), "doc_id long, row_key long, n_shingles long, node long, hot long")
    )
    sets = described.filter("hot is null and n_shingles > 0").select("doc_id", "row_key", "n_shingles", "node")
    top = (
        described.filter("hot = 1")
        .groupBy("node")
        .agg(F.sum("n_shingles").alias("n"))
        .orderBy(F.desc("n"), "node")
        .limit(HOT_COLUMNS)
        .toArrow()
    )
    keys = top.column("node").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order]))
    first_row = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    nodes = stage(
        sets.groupBy("node").agg(F.min("row_key").alias("row_key"), F.min(first_row).alias("head"), F.count("*").alias("n"))
    )
    parts_ = stage(
        _once(keyed, sets, nodes).select("text").mapInArrow(
            _first_parts(n, percent, hot), "gram long, node long, size int, first int, needed int"
        )
    )
    rounds = max(1, min(ROUNDS, parts_.count() // BLOCK_ROWS))
    blocks = [_several(parts_.filter(F.pmod(F.shiftright("gram", FILTER_BITS), F.lit(rounds)) == r)) for r in range(rounds)]
    unstage(parts_)
    several = reduce(DataFrame.unionByName, blocks)
    # the others of a node's first part have one row, and are the rarest
    placed = several.groupBy("node").agg(
        F.first("size").alias("size"), F.first("first").alias("first"), F.first("needed").alias("needed"),
        F.array_sort(F.collect_set(F.struct("n", "gram"))).alias("grams"),
    )
    alone = F.col("first") - F.size("grams")
    rows = stage(
        placed.filter(alone < F.col("needed"))
        .select("node", "size", alone.alias("alone"), F.posexplode(F.slice("grams", F.lit(1), F.col("needed") - alone)))
        .select(F.col("col.gram").alias("gram"), "node", "size", (F.col("alone") + F.col("pos")).alias("place"))
    )
    unstage(*blocks)
    join = _Join(keyed, nodes, n, percent)
    starred = met = join.stars(rows)
    unstage(rows)
    join.gather(met.select(F.explode(F.array("node", "hub")).alias("node")).distinct())
    states = join.decide(stage(join.pairs_of(met, "hub")))
    parts = components(states.filter("linked").select("a", "b"))
    open_ = join.mixed(met.filter("several"), parts)
    middles = join.middles(open_)
    met = join.centred(open_, middles)
    unstage(starred, open_)
    again = join.pairs_of(met.filter("node != center"), "center").join(states.select("a", "b"), ["a", "b"], "left_anti")
    again = join.decide(stage(again))
    parts = _joined(parts, again)
    rest = join.left(met, middles, states.unionByName(again), parts)
    unstage(met, middles, states, again, join.grams)
    parts = _joined(parts, rest)
    bare = nodes
    nodes = stage(join.placed(nodes, parts))
    unstage(bare, rest, parts)
    heads = stage(nodes.groupBy("component").agg(F.min("head").alias("first"), F.count("*").alias("nodes")))
    named = stage(
        join_spread(nodes, heads, "component", "nodes", nodes.count()).select(
            "node", "n", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("head_key")
        )
    )
    unstage(nodes, heads)
    return (
        join_spread(sets, named, "node", "n", sets.count())
        .select("doc_id", "n_shingles", "component_id", "row_key", "head_key")
        .unionByName(
            described.filter("hot is null and n_shingles = 0").select(
                "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key", F.col("row_key").alias("head_key")
            )
        )
    )


def _row_key() -> Column:
    """Tells rows by id and text."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each component, the one with the least id.

    A null id comes after all others. Texts without shingles are linked with
    nothing and all stay. Rows of one id and one text are one document, of which
    any row stays; of rows of one id and different texts each goes or stays by
    its own text. An empty table stays empty.
    """
    joined = stage(ngram_join(docs, n, percent))
    copies = joined.filter("row_key != head_key").select("row_key")
    again = stage(joined.filter("n_shingles > 0 and row_key = head_key").groupBy("row_key").count().filter("count > 1").select("row_key"))
    kept = without(docs, _row_key(), copies)
    if again.isEmpty():
        return kept.select(docs.columns)
    name = f"key_{uuid.uuid4().hex}"
    own = kept.withColumn(name, _row_key()).join(again.withColumnRenamed("row_key", name), name, "left_semi")
    single = own.dropDuplicates([name]).select(docs.columns)
    return without(kept, _row_key(), again).select(docs.columns).unionByName(single)
