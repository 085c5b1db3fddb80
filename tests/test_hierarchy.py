"""Hierarchy sync on a small project, case by case."""

from __future__ import annotations

from cladeflow.plans.hierarchy import hierarchy_sync

P = "id string, parent_id string, name string, authorship string, rank string, status string, sector int, source_id string"
S = "id string, parent_id string, name string, authorship string, rank string, status string"
SOURCE = [
    ("k", None, "Regna", None, "kingdom", "ACCEPTED"), ("o", "k", "Orda", None, "order", "ACCEPTED"), ("f", "o", "Fama", "Li, 1900", "family", "ACCEPTED"),
    ("x", "f", "Unplaced", None, "unranked", "ACCEPTED"), ("g", "x", "Gena", "Ode, 1800", "genus", "ACCEPTED"), ("s1", "g", "Gena prima", "Ray, 1801", "species", "ACCEPTED"),
    ("s2", "g", "Gena altera", "Ray, 1802", "species", "ACCEPTED"), ("y1", "s1", "Gena primula", "Poe, 1850", "species", "SYNONYM"), ("y2", "s2", "Gena alterna", None, "species", "MISAPPLIED"),
    ("h", "f", "Hena", None, "genus", "ACCEPTED"), ("s3", "h", "Hena tertia", None, "species", "ACCEPTED"), ("fy", "f", "Famula", None, "family", "SYNONYM"),
]
PROJECT = [
    ("pf", None, "Fama", None, "family", "ACCEPTED", None, None), ("p1", "pf", "Gena prima", None, "species", "ACCEPTED", None, "s1"),
    ("p2", "p1", "Gena altera", "Old, 1700", "species", "SYNONYM", None, "s2"), ("p3", "pf", "Gena primula", None, "species", "ACCEPTED", None, "y1"),
    ("p4", "pf", "Hena tertia", None, "species", "ACCEPTED", None, None), ("p5", "pf", "Gena incognita", None, "species", "ACCEPTED", None, None),
    ("p6", "pf", "Alia res", None, "species", "ACCEPTED", None, None), ("old", "pf", "Gone", None, "genus", "ACCEPTED", 5, "zz"), ("p7", "pf", "Lost", None, "species", "ACCEPTED", None, "nowhere"),
]


def run(spark, project=PROJECT, source=SOURCE, **options):
    return hierarchy_sync(spark.createDataFrame(project, P), spark.createDataFrame(source, S), 5, **options)


def test_all_four_phases(spark):
    out = run(spark)
    got = {r["id"]: r for r in out.usages.collect()}
    assert "old" not in got
    assert {i for i in got if i.startswith("5:")} == {"5:k", "5:o", "5:g", "5:h", "5:y2", "5:fy"}
    assert [got[i]["parent_id"] for i in ("5:k", "5:o", "5:g", "5:h")] == [None, "5:k", "pf", "pf"]
    assert got["pf"]["parent_id"] == "5:o"  # matched by name, it stands for the family and moves below the order
    assert got["p1"]["parent_id"] == "5:g" and got["p1"]["authorship"] == "Ray, 1801"
    assert (got["p2"]["status"], got["p2"]["parent_id"], got["p2"]["authorship"]) == ("ACCEPTED", "5:g", "Old, 1700")
    assert (got["p3"]["status"], got["p3"]["parent_id"]) == ("SYNONYM", "p1")
    assert got["p4"]["parent_id"] == "5:h" and got["p5"]["parent_id"] == "5:g" and got["p6"]["parent_id"] == "pf" and got["p7"]["parent_id"] == "pf"
    assert {(r["id"], r["parent_id"]) for r in out.placed.collect()} >= {("p4", "5:h"), ("p5", "5:g")}
    assert got["5:fy"]["parent_id"] == "pf"


def test_authorships_always_and_never(spark):
    assert {r["id"]: r["authorship"] for r in run(spark, authorship="ALWAYS").usages.collect()}["p2"] == "Ray, 1802"
    assert {r["id"]: r["authorship"] for r in run(spark, authorship="NONE").usages.collect()}["p1"] is None


def test_moves_that_close_a_cycle_are_not_made(spark):
    project = [("a", None, "Aba", None, "genus", "ACCEPTED", None, "g1"), ("b", "a", "Bab", None, "family", "ACCEPTED", None, None)]
    source = [("r", None, "Bab", None, "family", "ACCEPTED"), ("g1", "r", "Aba", None, "genus", "ACCEPTED")]
    got = {r["id"]: r["parent_id"] for r in run(spark, project, source).usages.collect()}
    assert got == {"a": None, "b": "a"}


def test_running_again_changes_nothing_more(spark):
    first = run(spark).usages
    again = hierarchy_sync(first, spark.createDataFrame(SOURCE, S), 5).usages
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)


def test_empty_sides(spark):
    assert run(spark, [], SOURCE).usages.count() == 0
    assert run(spark, PROJECT, []).usages.count() == len(PROJECT) - 1
