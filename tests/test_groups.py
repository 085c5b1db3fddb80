"""Grouping by authors and years, and pairs of near names, against brute force."""

from __future__ import annotations

import random

from cladeflow.functions.similarity import damerau, jaro_winkler
from cladeflow.operators import matching
from cladeflow.queries import names as queries


def test_homotypic_groups(spark):
    r = random.Random(5)
    rows = [(i, f"f{i % 3}", f"s{i % 4}", [["Mill"], ["L", "Kern"], []][r.randrange(3)], r.choice([None, *range(1750, 1800)])) for i in range(200)]
    names = spark.createDataFrame(rows, "id long, family string, stem string, team array<string>, year int")
    groups, want = {}, {}
    for i, family, stem, team, year in sorted(rows, key=lambda x: (x[4] is None, x[4] or 0, x[0])):
        own = groups.setdefault((family, stem), [])
        for head, other, first in own:
            if other == team and (year is None or first is None or abs(year - first) <= 5):
                want[i] = head
                break
        else:
            own.append((i, team, year))
            want[i] = i
    assert {r["id"]: r["group_id"] for r in matching.homotypic_groups(names).collect()} == want


def test_pairs_of_near_names(spark, tmp_path):
    rows = [(1, "red bolt", "a"), (2, "red bolts", "a"), (3, "der bolt", "a"), (4, "red bolt", "b"), (5, "red bolt", "a"), (6, "", "b")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = {(a[1], b[1]) for a in rows for b in rows if a[2] == b[2] and a[1] < b[1]}
    got = queries.REGISTRY["damerau_and_jaro"][0](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"], r["edits"], round(r["jaro"], 9)) for r in got} == {(a, b, damerau(a, b), round(jaro_winkler(a, b), 9)) for a, b in pairs}
    assert len(got) == len(pairs)


def test_swapped_letters_are_found(spark):
    rows = [(1, "Abies alba", "x"), (2, "Abeis alba", "x"), (3, "Abies albus", "x"), (4, "Abies alba", "y")]
    names = spark.createDataFrame(rows, "id long, name string, block string")
    assert [tuple(r) for r in matching.misspellings(names, ["block"]).collect()] == [(1, 2)]
