"""What each of five filters takes away alone, after others, and in every order.

A fingerprint-routed RDD finds repeated texts. Map tasks keep, in chains by
xxhash64 fingerprint, each full text once with its least id; rows that are not
the least of their own task are emitted at once and dealt out by their ids, so
a text that a third of all rows share sends one row a task and chunk to the
partition of its fingerprint. There the chains of all tasks meet: texts are
compared in full, and ids above the least are emitted as repeated.

Every row then has a mask of the filters that it fails. combineByKey adds up
vectors of 32 counts by part; all 120 orders of the filters follow from these.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

FILTERS = "ABCDE"
#: Bit of a mask by filter; E is the filter of repeated texts.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MASKS = 1 << len(FILTERS)
#: Bytes of text that a map task holds before it sends its chains on.
CHUNK_BYTES = 64 << 20
#: Bytes of text for each partition that chains meet in, before repeated texts are merged.
PARTITION_BYTES = 64 << 20

LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = re.compile(rb"[#$%&*|]")

ROUTED = "doc_id long, part string, mask int, n long"
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_mask(text: str, raw: bytes) -> int:
    """Bits of the filters A to D, which a text fails by itself; raw: its UTF-8."""
    words = raw.split()  # bytes are split at 0x20 and 0x09 to 0x0D alone
    return (
        BIT["A"] * (len(words) < LEAST_WORDS)
        | BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words))
        | BIT["C"] * (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS_PERCENT * len(text))
        | BIT["D"] * bool(_MARKS.search(raw))
    )


class Chains:
    """Texts by fingerprint, each with its least id and the rows that have that id.

    Texts that share a fingerprint stand in one chain and are told apart in full.
    """

    def __init__(self):
        self.by_fingerprint: dict[int, list[list]] = {}
        self.held = 0

    def add(self, fingerprint: int, text: bytes, doc_id: int, rows: Counter):
        """Takes rows of one text and id; gives (id, rows) of those that are now known to repeat."""
        chain = self.by_fingerprint.setdefault(fingerprint, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, doc_id, rows])
            self.held += len(text)
            return None
        if doc_id == link[1]:
            link[2] = link[2] + rows
            return None
        if doc_id > link[1]:
            return doc_id, rows
        above, link[1:] = tuple(link[1:]), [doc_id, rows]
        return above

    def take(self):
        """(fingerprint, text, least id, rows) of all texts; nothing is held after."""
        for fingerprint, chain in self.by_fingerprint.items():
            for text, doc_id, rows in chain:
                yield fingerprint, text, doc_id, rows
        self.by_fingerprint, self.held = {}, 0


def _send(chunk_bytes: int):
    """Rows to (key, (text, id, rows)); without a text where it is settled whether they repeat."""

    def settled(doc_id, rows, bit):
        return hash(doc_id), (None, doc_id, [((part, mask | bit), n) for (part, mask), n in rows.items()])

    def sent(chains):
        for fingerprint, text, doc_id, rows in chains.take():
            yield fingerprint, (text, doc_id, list(rows.items()))

    def run(rows):
        chains = Chains()
        for doc_id, text, part, fingerprint in rows:
            raw = text.encode("utf-8", "surrogatepass")
            own = Counter({(part, own_mask(text, raw)): 1})
            if doc_id is None:
                yield settled(None, own, 0)
                continue
            if above := chains.add(fingerprint, raw, doc_id, own):
                yield settled(*above, BIT["E"])
            if chains.held >= chunk_bytes:
                yield from sent(chains)
        yield from sent(chains)

    return run


def _meet(messages):
    chains = Chains()
    for fingerprint, (text, doc_id, rows) in messages:
        if text is None:
            yield from ((doc_id, part, mask, n) for (part, mask), n in rows)
        elif above := chains.add(fingerprint, text, doc_id, Counter(dict(rows))):
            yield from ((above[0], part, mask | BIT["E"], n) for (part, mask), n in above[1].items())
    for _, _, doc_id, rows in chains.take():
        yield from ((doc_id, part, mask, n) for (part, mask), n in rows.items())


def failed_filters(docs: DataFrame, part: str = "source", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, part, mask of the failed filters and n, how many rows these are.

    A text repeats (E) if the same text has a smaller doc_id anywhere in the
    table; rows that repeat an id and its text fail it or not alike, and n counts
    them together. A null id is neither smaller than another nor larger. A null
    text is empty, a null part is the empty string. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), text, F.coalesce(F.col(part).cast("string"), F.lit("")), F.xxhash64(text)
    ).rdd
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    met = rows.mapPartitions(_send(chunk_bytes)).partitionBy(parts, lambda key: key).mapPartitions(_meet)
    return spark.createDataFrame(met, ROUTED, verifySchema=False)


def _orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each row, and for each kind of count which masks it adds up."""
    steps, taken = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    masks = np.arange(MASKS)
    for order in map("".join, permutations(FILTERS)):
        alive = np.ones(MASKS, bool)
        for step, name in enumerate(order, 1):
            fails = masks & BIT[name] != 0
            steps.append((order, step))
            taken["removed"].append(alive & fails)
            taken["redundant"].append(~alive & fails)
            taken["unique_fails"].append(masks == BIT[name])
            alive = alive & ~fails
            taken["kept"].append(alive)
    return steps, {k: np.array(v, np.int64) for k, v in taken.items()}


def _expand(groups):
    """Rows of all orders and steps from (part, counts by mask of rows, good and toxic ones)."""
    steps, taken = _orders()
    letter = np.array([FILTERS.index(order[step - 1]) for order, step in steps])
    for part, counts in groups:
        removed = taken["removed"] @ counts
        shapley = np.array([removed[letter == i, 0].sum() for i in range(len(FILTERS))])
        n = counts[:, 0]
        columns = (taken["kept"] @ n, removed[:, 0], taken["redundant"] @ n, taken["unique_fails"] @ n, removed[:, 1], removed[:, 2], shapley[letter])
        for (order, step), *values in zip(steps, *(c.tolist() for c in columns)):
            yield part, order, step, *values


def _first(row):
    return _added(np.zeros((MASKS, 3), np.int64), row)


def _added(counts, row):
    mask, n, good, toxic = row
    counts[mask] += (n, n * good, n * toxic)
    return counts


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Counts of each filter at each place of each order, by part.

    kept: rows left after the step; removed: rows it takes; redundant: rows that
    fail its filter and were taken before; unique_fails: rows that fail its filter
    alone; good_lost and toxic_lost: removed rows with label quality or toxic 1;
    shapley: what its filter removes, added up over all orders. An id with
    several labels has a label if one of its rows does; null ids have none. See
    failed_filters() for nulls, repeated rows and empty tables; further columns of
    either table don't matter.
    """
    spark = docs.sparkSession
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    zero = F.lit(0)
    rows = (
        failed_filters(docs, part)
        .join(marks, "doc_id", "left")
        .select("part", "mask", "n", F.coalesce("good", zero), F.coalesce("bad", zero))
        .rdd.map(lambda r: (r[0], tuple(r[1:])))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.combineByKey(_first, _added, lambda a, b: a + b, parts)
    return spark.createDataFrame(sums.mapPartitions(_expand), AUDIT, verifySchema=False)


#: The same counts in DuckDB, over documents and labels.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
failing AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
sums AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS l FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
placed AS (
  SELECT part, fails, n, good, bad, filter_order, step, l, strpos(fails, l) > 0 AS fails_it,
         CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))) END AS gone
  FROM sums, steps),
counted AS (
  SELECT part, filter_order, step, l,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails_it AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN bad ELSE 0 END) AS toxic_lost
  FROM placed GROUP BY part, filter_order, step, l)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""
