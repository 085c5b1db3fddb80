from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import edited, empty, frame, sentence, texts

from cladeflow.llm.common import heavy_keys, join_spread, stage
from cladeflow.llm.components import components
from cladeflow.llm import ngram_join as module
from cladeflow.llm.ngram_join import drop_near_copies, most_shared, ngram_join


def shingles(text, n=5) -> frozenset:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        ((d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)),
        key=repr,
    )


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_equals_brute_force(spark):
    rows = texts()
    assert found(ngram_join(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_large_groups_and_chance_columns(spark, seed):
    """Near copies at the threshold, among texts that share passages."""
    r = random.Random(seed)
    passages = [sentence(r, 25) for _ in range(3)]
    rows = []
    for i in range(150):
        kind = r.randrange(3)
        if kind == 0:
            rows.append((i, f"{r.choice(passages)} {sentence(r, r.randrange(0, 15))}"))
        elif kind == 1:
            rows.append((i, edited(r, " ".join(passages), r.randrange(0, 6))))
        else:
            rows.append((i, edited(r, passages[0] + " " + passages[1], r.randrange(0, 4))))
    assert found(ngram_join(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert ngram_join(empty(spark)).count() == 0
    assert drop_near_copies(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = texts()
    docs = frame(spark, rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    heads = {(d, c) for d, n, c in brute(rows) if d is not None}
    want = sorted([d for d, c in heads if d == c] + [None for d, _ in rows if d is None], key=repr)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == want


def test_components_of_a_star_and_a_path(spark):
    edges = [(i, 0) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (1, 0)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(50)} | {100 + i: 100 for i in range(41)}


def test_copies_are_laid_out_once_and_shuffles_deleted(spark, monkeypatch):
    """Exact copies in many tasks give the columns of one; what a step shuffled is gone when it ends."""
    r = random.Random(5)
    own = [sentence(r, 60) for _ in range(12)]
    rows = [(i, own[i % 12]) for i in range(96)]
    seen, real = [], module.stage

    def recording(df, *more):
        out = real(df, *more)
        if out.columns == ["gram", "node", "size", "first", "needed"]:
            seen.append(out.select("gram", "node").collect())
        return out

    monkeypatch.setattr(module, "stage", recording)
    assert found(ngram_join(frame(spark, rows).repartition(8))) == brute(rows)
    assert len(seen) == 1 and set(Counter(map(tuple, seen[0])).values()) == {1}


def test_sketches_never_rule_out_a_shared_column():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**64, 4000, np.uint64)
    sets = [np.unique(r.choice(pool[: 50 + 300 * (i % 9)], r.integers(1, 700))) for i in range(60)]
    sets += [np.append(s[: len(s) - len(s) // 15], r.integers(0, 2**64, 3, np.uint64)) for s in sets]
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    size = np.array([len(s) for s in sets])
    sketches = module._sketches(who, np.concatenate(sets), size).to_pylist()
    apart = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            m, n, most = most_shared(sketches[i], sketches[j])
            shared = len(np.intersect1d(x, y))
            assert (m, n) == (len(x), len(y)) and shared <= most
            apart += 100 * most < 80 * (m + n - most)
    assert apart > len(sets) ** 2 // 2


def test_columns_of_a_row_that_fall_together(monkeypatch):
    """With few bits, a row needs one more column for each that it lacks."""
    import pyarrow as pa

    class Sent:
        value = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    r = random.Random(7)
    texts_ = pa.RecordBatch.from_arrays([pa.array([sentence(r, 120) for _ in range(20)])], names=["text"])
    whole = [b.to_pydict() for b in module._first_parts(5, 80, Sent)([texts_])][0]
    monkeypatch.setattr(module, "COLUMN_BITS", 6)
    short = [b.to_pydict() for b in module._first_parts(5, 80, Sent)([texts_])][0]
    lost = 0
    for node in set(whole["node"]):
        at = [i for i, x in enumerate(whole["node"]) if x == node]
        twice = len(at) - len({short["gram"][i] for i in at})
        lost += twice
        assert {short["needed"][i] - whole["needed"][i] for i in at} == {twice}
    assert lost


def test_join_without_heavy_keys_is_one_join(spark):
    """Few rows of a key need no broadcast of their own, however large their share; a key with many gets one."""
    rows = stage(spark.range(200).selectExpr("if(id < 150, 0, id) as k", "id"))
    table = stage(rows.groupBy("k").count().withColumnRenamed("count", "n"))
    joined = join_spread(rows, table, "k", "n", 200)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(tuple(r) for r in joined.collect()) == sorted((0, i, 150) if i < 150 else (i, i, 1) for i in range(200))
    many = stage(spark.range(2000).selectExpr("if(id < 1500, 0, id) as k", "id"))
    table = stage(many.groupBy("k").count().withColumnRenamed("count", "n"))
    spread = join_spread(many, table, "k", "n", 2000)
    assert spread._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3
    assert spread.count() == 2000 and spread.filter("n = 1500").count() == 1500


def test_heavy_keys_need_no_python_worker(spark):
    rows = stage(spark.range(1000).selectExpr("if(id < 600, 7, id) as a", "id as b"))
    found = heavy_keys(rows, "a")
    assert [tuple(r) for r in found.collect()] == [(7, -(-256 * 600 // 1000))]
    assert "Python" not in found._jdf.queryExecution().toRdd().toDebugString()
