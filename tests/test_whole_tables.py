"""Queries over all rows of their tables against brute force, where no SQL tells."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from cladeflow import queries as lists

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def read(name, *columns):
    return pq.read_table(DATA / f"{name}.parquet", columns=list(columns)).to_pylist()


def test_closure_of_all_line_items(spark):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for r in read("lineitem", "l_orderkey", "l_partkey"):
        a, b = sorted((root(f"O{r['l_orderkey']}"), root(f"P{r['l_partkey']}")))
        up[b] = a
    got = {r["node"]: r["group"] for r in lists.queries()["relation_closure"](spark, str(DATA)).collect()}
    want = {x: root(x) for x in list(up)}
    assert got == want
    sizes = {r["group"]: r["n"] for r in lists.queries()["relation_closure_all"](spark, str(DATA)).collect()}
    assert sizes == Counter(want.values())


def test_ids_are_assigned_over_all_parts(spark, tmp_path):
    rows = [(k, f"n{k % 3}", f"b{k % 4}", f"t{k % 5}") for k in [*range(1, 40), *range(1000, 1050)]]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = defaultdict(list)
    for k, name, brand, kind in rows:
        for o, name2, brand2, kind2 in rows:
            if k >= 1000 > o and name == name2:
                found[name].append((-(13 + 5 * (brand == brand2) + 10 * (kind == kind2)), o, k))
    want = set()
    for pairs in found.values():
        old, new = set(), set()
        for _, o, k in sorted(pairs):
            if o not in old and k not in new:
                old.add(o), new.add(k), want.add((k, o))
    got = lists.queries()["stable_id_assignment"](spark, str(tmp_path)).collect()
    assert {(r["id"], r["old_id"]) for r in got} == want and len(got) == len(want)
