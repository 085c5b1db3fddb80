"""Personal data: patterns, and terms that disclose it by how they co-occur.

Values that patterns find (addresses, numbers) are the protected entities. An
entity c carries -log2 p(c) bits, where p(c) is the share of documents that hold
it. A term t near c gives away log2(p(c, t) / (p(c) p(t))) of them. Terms, words
and pairs of neighbouring words, that stand near an entity in several different
contexts and give away GENERALISE of its bits or more are found wherever they
occur; sanitise() puts their kind in their place, or removes them from REMOVE on.

All counts are over all documents. Only what lies within CONTEXT words of an
entity is gathered, and what several contexts share is then counted in every
text. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, columns_of, join_spread, prepare, stage, texts
from .words import NOT_ALNUM, Words, cut, grams, mix, raw, slices

#: Kinds in the order of the contract, then the kind that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KIND = "term"
#: Words on either side of an entity that are its context.
CONTEXT = 8
#: Different contexts in which a term must stand near an entity.
LEAST_CONTEXTS = 3
#: Shares of an entity's bits from which a term is replaced by its kind, or removed.
GENERALISE = 0.75
REMOVE = 0.9
#: Up to so many terms are sent to all workers (8 MB); beyond that they meet the texts in a shuffle.
BROADCAST_TERMS = 1_000_000

# The base patterns of the contract. A possessive repeat takes what
# the greedy one would, since no later part could use what it gives back.
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(c for c in range(256) if not 48 <= c < 58)


def passes_luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(rank of the kind, first byte, end) of the base matches, by kind, then place."""
    found = []
    before = 0
    for m in _DOMAIN.finditer(text):
        at = first = m.start()
        while first > before and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            found.append((0, first, m.end()))
            before = m.end()
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip(b"0")) < 3 or len(x) == 3 and x <= b"255" for p in m[0].split(b".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].translate(None, _NOT_DIGITS)) <= 19 and passes_luhn(d):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(None, _NOT_DIGITS)) <= 15:
            found.append((3, *m.span()))
    return found


def entity_of(kind: int, value: bytes) -> int:
    """A 64-bit key of an entity: addresses in lower case, numbers by their digits."""
    value = value.lower() if kind == 0 else value if kind == 1 else value.translate(None, _NOT_DIGITS)
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, salt=bytes([kind])).digest(), "little", signed=True)


def within(words: Words, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words overlap one of the spans."""
    inside = np.zeros(len(words.first), bool)
    for _, begin, end in spans:
        inside[np.searchsorted(words.last, begin, "right") : np.searchsorted(words.first, end, "left")] = True
    return inside


def pair_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with its next one, apart from those of words; whether both are of one text."""
    h, same = grams(words, 2)
    return mix(h ^ np.uint64(2)), same


def context_terms(text: bytes, words: Words, spans: list[tuple[int, int, int]], context: int):
    """(entity, term's hash, its words, the term, context) of a text, a row each, and one of no term for each entity."""
    hashes, free = words.hashes, ~within(words, spans)
    pairs, _ = pair_hashes(words)
    found: dict = {}
    for kind, begin, end in spans:
        entity = entity_of(kind, text[begin:end])
        left, right = np.searchsorted(words.last, begin, "right"), np.searchsorted(words.first, end, "left")
        near = [i for side in (range(max(0, left - context), left), range(right, min(len(hashes), right + context))) for i in side if free[i]]
        told = int(mix(np.array([hashes[near].sum()]))[0].view(np.int64)) if near else 0
        terms = [(hashes[i], 1, i, i) for i in near] + [(pairs[i], 2, i, j) for i, j in zip(near, near[1:]) if j == i + 1]
        found.setdefault((entity, 0), (0, "", 0))
        for h, n, i, j in terms:
            key = (entity, int(h.view(np.int64)))
            if key not in found or told < found[key][2]:
                name = b" ".join(text[words.first[k] : words.last[k]] for k in range(i, j + 1)).lower()
                found[key] = (n, name.decode("utf-8", "replace"), told)
    return [(entity, h, n, name, told) for (entity, h), (n, name, told) in found.items()]


CONTEXTS = "entity long, term_hash long, words int, term string, context long"


def _contexts(context: int):
    def run(batches):
        for b in batches:
            out = []
            for _, part in slices(b.column("text")):
                data, at = raw(part)
                whole = data.tobytes()
                for i in range(len(part)):
                    text = whole[at[i] : at[i + 1]]
                    if spans := base_spans(text):
                        out += context_terms(text, cut(part.slice(i, 1), NOT_ALNUM, lower=True), spans, context)
            columns = list(zip(*out)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield batch(**{c.split()[0]: (v, t) for c, v, t in zip(CONTEXTS.split(", "), columns, types)})

    return run


def terms_of(words: Words, which: tuple[bool, bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and number of words of each occurrence of a word (which[0]) or pair (which[1])."""
    places, hashes, sizes = [], [], []
    if which[0]:
        places.append(np.arange(len(words.hashes)))
        hashes.append(words.hashes)
    if which[1]:
        h, same = pair_hashes(words)
        places.append(np.flatnonzero(same))
        hashes.append(h[same])
    sizes = [np.full(len(p), n) for p, n in zip(places, [n for n in (1, 2) if which[n - 1]])]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (places, hashes, sizes))


def among(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _frequencies(which: tuple[bool, bool], known: np.ndarray | None):
    """term_hash and the documents of a slice that hold it; known: sorted hashes to count, or None for all."""

    def run(batches):
        for b in batches:
            for _, part in slices(b.column("text")):
                words = cut(part, NOT_ALNUM, lower=True)
                place, h, _ = terms_of(words, which)
                if known is not None:
                    hit = among(known, h)
                    place, h = place[hit], h[hit]
                who = words.owner()[place] if len(place) else place
                sort = np.lexsort((who, h))
                h, who = h[sort], who[sort]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
                terms, counts = np.unique(h[first], return_counts=True)
                yield batch(term_hash=(terms.astype(np.uint64).view(np.int64), pa.int64()), n=(counts, pa.int64()))

    return run


def _hashes(terms: DataFrame, column: str = "term_hash") -> np.ndarray:
    """The sorted hashes of a table of BROADCAST_TERMS rows at most."""
    found = np.array([r[0] for r in terms.select(column).distinct().collect()], np.int64)
    return np.sort(found.view(np.uint64))


def revealing_terms(
    docs: DataFrame,
    context: int = CONTEXT,
    least_contexts: int = LEAST_CONTEXTS,
    threshold: float = GENERALISE,
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """term_hash, words, term, disclosure (largest share of an entity's bits), and in how many documents it is.

    The frame is staged. Terms are compared by 64-bit hashes of their words in
    lower case (A-Z). Rows count as documents, repeated ones too; that the same
    words surround an entity again and again is one context.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs)
    near = stage(rows.mapInArrow(_contexts(context), CONTEXTS))
    pairs = (
        near.groupBy("entity", "term_hash", "words", "context")
        .agg(F.count("*").alias("n"), F.min("term").alias("term"))
        .groupBy("entity", "term_hash", "words")
        .agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts"), F.min("term").alias("term"))
    )
    pairs = stage(pairs.filter((F.col("words") == 0) | (F.col("contexts") >= least_contexts)))
    entities = pairs.filter("words = 0").select("entity", F.col("n_both").alias("n_entity"))
    candidates = stage(pairs.filter("words > 0").join(entities, "entity"))
    n_terms = candidates.select("term_hash").distinct().count()
    sizes = {r[0] for r in candidates.select("words").distinct().collect()}
    which = (1 in sizes, 2 in sizes)
    known = _hashes(candidates) if n_terms <= broadcast_terms else None
    if n_terms:
        counted = rows.mapInArrow(_frequencies(which, known), "term_hash long, n long").groupBy("term_hash").agg(F.sum("n").alias("n_term"))
    else:
        counted = spark.createDataFrame([], "term_hash long, n_term long")
    total = docs.count()
    bits = -F.log2(F.col("n_entity") / total)
    given = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return stage(
        candidates.join(counted, "term_hash")
        .withColumn("disclosure", F.when(bits > 0, given / bits))
        .filter(F.col("disclosure") >= threshold)
        .groupBy("term_hash", "words")
        .agg(F.min("term").alias("term"), F.max("disclosure").alias("disclosure"), F.max("n_term").alias("n_term"))
    )


def _row_terms(which: tuple[bool, bool]):
    """row and the hash of each of its terms, once."""

    def run(batches):
        for b in batches:
            rows = b.column("row").to_numpy()
            for at, part in slices(b.column("text")):
                words = cut(part, NOT_ALNUM, lower=True)
                place, h, _ = terms_of(words, which)
                who = words.owner()[place] if len(place) else place.astype(np.int64)
                sort = np.lexsort((h, who))
                h, who = h[sort], who[sort]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
                yield batch(row=(rows[at + who[first]], pa.int64()), term_hash=(h[first].astype(np.uint64).view(np.int64), pa.int64()))

    return run


def term_spans(words: Words, hits: np.ndarray, sizes: np.ndarray, covered: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, end) of stretches of hit words, but for covered ones; hits: first words of terms."""
    marked = np.zeros(len(words.first) + 1, bool)
    marked[hits] = True
    marked[hits[sizes == 2] + 1] = True
    marked = marked[:-1] & ~covered
    if not marked.any():
        return []
    owner = words.owner()
    begin, end = marked.copy(), marked.copy()
    begin[1:] &= ~marked[:-1] | (owner[1:] != owner[:-1])
    end[:-1] &= ~marked[1:] | (owner[1:] != owner[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    return list(zip(owner[first].tolist(), words.first[first].tolist(), words.last[last].tolist()))


def _spans_of(part: pa.Array, known: list[tuple[np.ndarray, bool]] | None, each: list | None):
    """For each text: its bytes, base spans and term spans (first byte, end, removed), by bytes.

    known: sorted hashes for all texts, of terms to replace and to remove; each:
    for each text, its own hashes of the two.
    """
    data, at = raw(part)
    whole = data.tobytes()
    base = [base_spans(whole[at[i] : at[i + 1]]) for i in range(len(part))]
    added: list[list] = [[] for _ in base]
    if known is not None and not any(len(k) for k in known) or each is not None and not any(len(k) for two in each for k in two):
        return whole, at, base, added
    words = cut(part, NOT_ALNUM, lower=True)
    place, h, size = terms_of(words, (True, True))
    covered = within(words, [(k, s + at[i], e + at[i]) for i, spans in enumerate(base) for k, s, e in sorted(spans, key=lambda x: x[1])])
    for removed in (0, 1):
        if known is not None:
            hit = among(known[removed], h)
        else:
            owner = words.owner()[place] if len(place) else place
            hit = np.zeros(len(h), bool)
            for i, two in enumerate(each):
                if len(two[removed]):
                    own = np.flatnonzero(owner == i)
                    hit[own] = among(two[removed], h[own])
        for i, s, e in term_spans(words, place[hit].astype(np.int64), size[hit], covered):
            added[i].append((s - at[i], e - at[i], removed))
    return whole, at, base, [_merged(x) for x in added]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by place; overlapping ones as one, removed if one of them is."""
    out: list[list[int]] = []
    for s, e, removed in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
            out[-1][2] |= removed
        else:
            out.append([s, e, removed])
    return [tuple(int(v) for v in x) for x in out]


def code_points(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, counted in bytes, by code points."""
    if text.isascii():
        return spans
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = lambda b: int(starts[b - 1]) if b else 0
    return [(before(s), before(e)) for s, e in spans]


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"


def _report(known):
    def run(batches):
        for b in batches:
            out = []
            for first, part in slices(b.column("text")):
                each = _own(b, first, len(part)) if known is None else None
                whole, at, base, added = _spans_of(part, known, each)
                ids = b.column("doc_id")[first : first + len(part)].to_pylist()
                for i, doc_id in enumerate(ids):
                    places = [x[1:] for x in base[i]] + [x[:2] for x in added[i]]
                    points = code_points(whole[at[i] : at[i + 1]], places) if places else []
                    kinds = [BASE_KINDS[k] for k, _, _ in base[i]] + [ADDED_KIND] * len(added[i])
                    told = [f"{k}:{s}:{e}" for k, (s, e) in zip(kinds, points)]
                    n = len(base[i])
                    digest = hashlib.sha256(",".join(told[:n]).encode()).hexdigest()
                    out.append((doc_id, *(kinds.count(k) for k in BASE_KINDS), digest, ",".join(told), len(added[i])))
            columns = list(zip(*out)) or [()] * 8
            kind = {"long": pa.int64(), "string": pa.string()}
            yield batch(**{c.split()[0]: (v, kind[c.split()[1]]) for c, v in zip(REPORT.split(", "), columns)})

    return run


def shape(term: bytes) -> bytes:
    """What stands in the place of a term: what kind of word it is."""
    return b"[NUMBER]" if term.isdigit() else b"[NAME]" if term[:1].isupper() else b"[TERM]"


def sanitised(text: bytes, base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> bytes:
    """The text with base spans and terms replaced by their kinds, or removed."""
    spans = [(s, e, b"[%s]" % BASE_KINDS[k].upper().encode()) for k, s, e in base]
    spans += [(s, e, b"" if removed else shape(text[s:e])) for s, e, removed in added]
    out, at = [], 0
    for s, e, instead in sorted(spans):
        if s >= at:
            out += (text[at:s], instead)
        at = max(at, e)
    return b"".join([*out, text[at:]])


def _sanitise(known):
    def run(batches):
        for b in batches:
            for first, part in slices(b.column("text")):
                each = _own(b, first, len(part)) if known is None else None
                whole, at, base, added = _spans_of(part, known, each)
                new = [sanitised(whole[at[i] : at[i + 1]], base[i], added[i]).decode() for i in range(len(part))]
                yield batch(row=(b.column("row")[first : first + len(part)], pa.int64()), text=(new, pa.string()))

    return run


def _own(b: pa.RecordBatch, first: int, n: int) -> list:
    lists = [b.column(c)[first : first + n].to_pylist() for c in ("replaced", "removed")]
    return [[np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in two] for two in zip(*lists)]


def _with_terms(rows: DataFrame, found: DataFrame, remove: float, broadcast_terms: int):
    """Rows to map over and the hashes to send along; None where each row brings its own.

    Beyond broadcast_terms, terms of rows meet the found ones in a shuffle.
    """
    gone = F.col("disclosure") >= remove
    if found.count() <= broadcast_terms:
        return rows, [_hashes(found.filter(~gone)), _hashes(found.filter(gone))]
    sizes = {r[0] for r in found.select("words").distinct().collect()}
    rows = stage(rows)
    table = stage(found.groupBy("term_hash").agg(F.max("disclosure").alias("disclosure"), F.max("n_term").alias("n_term")))
    each = rows.mapInArrow(_row_terms((1 in sizes, 2 in sizes)), "row long, term_hash long")
    met = join_spread(each, table, "term_hash", "n_term", rows.count())
    own = met.groupBy("row").agg(
        F.collect_list(F.when(~gone, F.col("term_hash"))).alias("replaced"), F.collect_list(F.when(gone, F.col("term_hash"))).alias("removed")
    )
    return rows.join(own, "row", "left"), None


def pii_report(docs: DataFrame, remove: float = REMOVE, broadcast_terms: int = BROADCAST_TERMS, **options) -> DataFrame:
    """Counts and digests of the spans of personal data, by document.

    spans lists the base kinds and then terms that disclose an entity, whatever
    text they stand in; words of base spans aren't terms. Rows that repeat an id
    are scanned each on its own; null texts are empty; an empty table gives no
    rows; other columns don't matter. Time is linear in a text's length.
    """
    prepare(docs.sparkSession)
    found = revealing_terms(docs, broadcast_terms=broadcast_terms, **options)
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    rows, known = _with_terms(rows, found, remove, broadcast_terms)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_report(known), REPORT)


def sanitise(docs: DataFrame, remove: float = REMOVE, broadcast_terms: int = BROADCAST_TERMS, **options) -> DataFrame:
    """`docs` with personal data out of the texts: base spans and terms give way to their kinds, or nothing.

    Null texts stay null; n_chars, where there is one, follows a changed text.
    Other columns stay, whatever their names.
    """
    prepare(docs.sparkSession)
    found = revealing_terms(docs, broadcast_terms=broadcast_terms, **options)
    row, new = f"row_{uuid.uuid4().hex}", f"text_{uuid.uuid4().hex}"
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = held.filter("text is not null").select(F.col(row).alias("row"), "text")
    rows, known = _with_terms(rows, found, remove, broadcast_terms)
    changed = rows.mapInArrow(_sanitise(known), "row long, text string").toDF(row, new)
    out = held.join(changed, row, "left")
    n_chars = {}
    if "n_chars" in docs.columns:
        n_chars["n_chars"] = F.when(F.col(new) != F.col("text"), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(n_chars).withColumn("text", F.col(new)).select(columns_of(docs.columns))
