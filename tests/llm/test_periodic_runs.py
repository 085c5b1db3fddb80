from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

from fixtures import empty, frame, sentence, texts
from hypothesis import given
from hypothesis import strategies as st

from cladeflow.llm.periodic_runs import periodic_runs, run_report, runs_of


def brute_runs(words, least_length, least_exponent):
    """All maximal runs, by trying each period at each place."""
    n, out = len(words), []
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            inside = words[i : i + length]
            smaller = any(all(inside[k] == inside[k + q] for k in range(length - q)) for q in range(1, p))
            if length >= max(least_length, least_exponent * p) and not smaller:
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, 6, 4)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=4), st.sampled_from([(2, 2), (6, 4), (1, 3)]))
def test_runs_equal_brute_force(lists, least):
    assert runs_of(lists, *least) == [brute_runs(w, *least) for w in lists]


def test_periodic_words_equal_brute_force():
    r = random.Random(3)
    for _ in range(60):
        words = []
        while len(words) < 150:
            unit = [r.choice([b"x", b"y", b"z", b"w"]) for _ in range(r.randrange(1, 8))]
            words += (unit * 9)[: r.randrange(1, 9 * len(unit))]
        assert runs_of([words, words[::-1]], 6, 4) == [brute_runs(words, 6, 4), brute_runs(words[::-1], 6, 4)]
        assert runs_of([words], 2, 2) == [brute_runs(words, 2, 2)]


def test_one_word_many_times_is_quick():
    assert runs_of([[b"a"] * 200_000 + [b"b"]], 6, 4) == [[(0, 200_000, 1)]]
    assert runs_of([[b"a", b"b", b"a"] * 60_000], 6, 4)[0][0] == (0, 180_000, 3)


def rows():
    r = random.Random(12)
    out = texts(12)
    for i in range(40):
        unit = sentence(r, r.randrange(1, 6))
        out.append((4000 + i, "\n".join([sentence(r, 9), *[unit] * r.randrange(2, 9), sentence(r, 4)])))
    return [(d, t if d != 609 else " ".join((t or "").split()[:400])) for d, t in out]


def test_report_equals_brute_force(spark):
    given_rows = rows()
    assert any(d is not None and t and zlib.crc32(str(d).encode()) % 10 == 0 for d, t in given_rows)
    got = sorted((tuple(r) for r in run_report(frame(spark, given_rows)).collect()), key=repr)
    assert got == sorted((brute_report(d, t) for d, t in given_rows), key=repr)


def test_collapsed_texts_have_no_run_left_of_one_period(spark):
    given_rows = rows()
    out = {(r["doc_id"], r["n_words"]): r for r in periodic_runs(frame(spark, given_rows)).collect()}
    for doc_id, text in given_rows:
        words = (text or "").encode().split()
        row = out[doc_id, len(words)]
        runs = brute_runs(words, 6, 4)
        assert [tuple(x) for x in row["runs"]] == runs
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert row["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_empty_table(spark):
    assert run_report(empty(spark)).collect() == [] and periodic_runs(empty(spark)).collect() == []
