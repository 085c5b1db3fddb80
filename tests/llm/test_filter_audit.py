from __future__ import annotations

import random
from itertools import permutations

import duckdb
from fixtures import empty, frame, sentence, texts

from cladeflow.llm.filter_audit import SQL, failed_filters, filter_audit

LABELS = "doc_id long, quality int, toxic int, part string"


def rows():
    r = random.Random(13)
    out = texts(13)
    shared = sentence(r, 80)
    out += [(3000 + i, shared) for i in range(40)] + [(2999, shared), (2999, shared), (None, shared)]
    out += [(3100 + i, "LOUD " * i + sentence(r, 55) + r.choice(["", " # $", " a|b"])) for i in range(40)]
    out += [(3200, None), (3201, ""), (3202, " ".join(f"w{i}" for i in range(50))), (3203, " ".join(f"w{i % 33}" for i in range(51)))]
    return out


def labels(spark, given):
    r = random.Random(14)
    found = [(d, r.choice([0, 1, None]), r.choice([0, 1]), "x") for d, _ in given if d is None or r.random() < 0.7]
    return spark.createDataFrame([*found, *found[:5], (10**9, 1, 1, "x")], LABELS)


def brute(docs, marks):
    good, bad = {m[0] for m in marks if m[1] == 1}, {m[0] for m in marks if m[2] == 1}
    least: dict = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    found = []
    for d, t, source in docs:
        t = t or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d,
        }
        found.append((source or "", fails, d is not None and d in good, d is not None and d in bad))
    out = {}
    for part in {f[0] for f in found}:
        own = [f[1:] for f in found if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[0][x]]
                failing = sum(f[0][x] for f in own)
                left = [f for f in left if not f[0][x]]
                alone = sum(f[0][x] and sum(f[0].values()) == 1 for f in own)
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(f[1] for f in gone), sum(f[2] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def collected(df):
    return {tuple(r)[:3]: list(tuple(r)[3:]) for r in df.collect()}


def test_counts_equal_brute_force_and_sql(spark):
    docs = frame(spark, rows())
    marks = labels(spark, rows())
    given = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = collected(filter_audit(docs, marks))
    assert got == brute(given, [tuple(r) for r in marks.collect()])
    con = duckdb.connect()
    for name, df in (("documents", docs.select("doc_id", "text", "source")), ("labels", marks)):
        con.register(name, df.toArrow())
    assert {r[:3]: list(r[3:]) for r in con.execute(SQL).fetchall()} == got


def test_small_chunks_change_nothing(spark):
    docs = frame(spark, rows())
    order = lambda df: sorted(map(tuple, df.selectExpr("doc_id", "part", "mask", "n").groupBy("doc_id", "part", "mask").sum("n").collect()), key=repr)
    assert order(failed_filters(docs)) == order(failed_filters(docs, chunk_bytes=300))


def test_texts_of_one_fingerprint_are_told_apart():
    from collections import Counter

    from cladeflow.llm.filter_audit import Chains

    chains, one = Chains(), Counter({("p", 0): 1})
    assert chains.add(7, b"first", 5, one) is None
    assert chains.add(7, b"second", 6, one) is None
    assert chains.add(7, b"first", 9, one) == (9, one)
    assert chains.add(7, b"second", 2, one) == (6, one)
    assert sorted(x[1:3] for x in chains.take()) == [(b"first", 5), (b"second", 2)]


def test_empty_table(spark):
    assert filter_audit(empty(spark), spark.createDataFrame([], LABELS)).collect() == []
