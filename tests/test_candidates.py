"""The cascade of choices against one that goes through a query's candidates in turn."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cladeflow.operators import candidates as C

PAIRS = "query int, candidate string, qualified boolean, label boolean, equal string, authored boolean, status string, accepted string, common int, lowest int"
TAXA = ("ACCEPTED", "PROVISIONALLY_ACCEPTED")


def in_turn(cands):
    """cands: dicts of one query, by candidate."""
    qualified, left = cands[0]["qualified"], sorted(cands, key=lambda c: c["candidate"])
    alike = [c for c in left if not (c["authored"] and c["equal"] == "DIFFERENT")]
    exact = [c for c in alike if c["label"]]
    if qualified and len(exact) == 1:
        return exact[0]["candidate"], "MATCH"
    if qualified and not exact and len(alike) == 1:
        return alike[0]["candidate"], "MATCH"
    if len(left) == 1:
        return left[0]["candidate"], "MATCH"
    authored = [c for c in left if c["authored"]]
    if qualified and len(authored) == 1:
        return authored[0]["candidate"], "MATCH"
    if all(c["status"] not in TAXA for c in left) and len({c["accepted"] for c in left}) == 1 and left[0]["accepted"] is not None:
        return left[0]["candidate"], "SNAP"
    left = [c for c in left if c["status"] != "PROVISIONALLY_ACCEPTED"]
    if len(left) < 2:
        return (left[0]["candidate"], "SNAP") if left else (None, "NONE")
    for attribute in ("common", "lowest"):
        if attribute == "lowest":
            taxa = [c for c in left if c["status"] == "ACCEPTED"]
            left = taxa or left
            if len(taxa) == 1:
                return taxa[0]["candidate"], "SNAP"
        top = max((c[attribute] for c in left if c[attribute] is not None), default=None)
        best = [c for c in left if top is not None and c[attribute] == top]
        if len(best) == 1:
            return best[0]["candidate"], "AMBIGUOUS"
    return left[0]["candidate"], "AMBIGUOUS"


def test_choices_equal_those_made_in_turn(spark):
    r, rows = random.Random(4), []
    for q in range(3000):
        qualified, n = r.random() < 0.5, r.choice([1, 2, 2, 3, 5])
        syn = r.random() < 0.3
        for i in r.sample(range(20), n):
            status = r.choice(["SYNONYM", "MISAPPLIED"] if syn else ["ACCEPTED", "PROVISIONALLY_ACCEPTED", "SYNONYM"])
            authored = r.random() < 0.6
            rows.append((
                q, f"c{i:02}", qualified, r.random() < 0.2, r.choice(["EQUAL", "DIFFERENT", "UNKNOWN"]), authored, status,
                None if status in TAXA else r.choice(["x", "x", "y"]), r.choice([None, 3, 5]), r.choice([None, 2, 7]),
            ))
    got = {x["query"]: (x["match"], x["match_type"]) for x in C.choose(spark.createDataFrame(rows, PAIRS)).collect()}
    names = [c.split()[0] for c in PAIRS.split(", ")]
    by: dict = {}
    for row in rows:
        by.setdefault(row[0], []).append(dict(zip(names, row)))
    assert got == {q: in_turn(c) for q, c in by.items()}
    assert {t for _, t in got.values()} == {"MATCH", "SNAP", "AMBIGUOUS", "NONE"}


def test_ranks_authors_and_years(spark):
    rows = [(1, "a", "species", "species"), (1, "b", "species", "unranked"), (2, "c", "species", "unranked"), (2, "d", "species", "genus"), (3, "e", None, "genus"), (4, "f", "unranked", "genus")]
    df = spark.createDataFrame(rows, "query int, candidate string, q string, r string")
    assert sorted(x["candidate"] for x in C.strictest_rank(df, "q", "r").collect()) == ["a", "c", "e", "f"]
    rows = [("a", "species", "EQUAL", True, True), ("b", "species", "UNKNOWN", True, True), ("c", "species", "UNKNOWN", True, False), ("d", "genus", "DIFFERENT", True, True), ("e", "genus", "UNKNOWN", True, True), ("f", "family", "DIFFERENT", True, True), ("g", "species", "DIFFERENT", False, True)]
    df = spark.createDataFrame(rows, "candidate string, rank string, equal string, qualified boolean, authored boolean")
    assert sorted(x["candidate"] for x in C.drop_other_authors(df, "equal", "rank", "qualified").collect()) == ["a", "c", "e", "f", "g"]
    df = spark.createDataFrame([("a", True, 1816, 1817), ("b", True, 1816, None), ("c", True, 1816, 1850), ("d", False, 1816, None), ("e", True, None, 1900)], "candidate string, only boolean, y int, z int")
    assert sorted(x["candidate"] for x in C.drop_other_years(df, F.col("only"), F.col("y"), F.col("z")).collect()) == ["a", "d", "e"]


def test_lowest_common_classification(spark):
    path = "array<struct<rank_ord: int, name: string>>"
    df = spark.createDataFrame([([(1, "Life"), (5, "Aus")], [(1, "life"), (5, "aus"), (7, "x")]), ([(1, "a")], [(2, "a")]), ([], [(1, "a")])], f"a {path}, b {path}")
    assert [r[0] for r in df.select(C.lowest_common(F.col("a"), F.col("b"))).collect()] == [5, None, None]
