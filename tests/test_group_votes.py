"""Votes on groups and codes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cladeflow.operators import groups as G


def votes(*names):
    return G.resolve(sum(G.bit(n) for n in set(names)))


def test_resolution_of_votes():
    assert votes() is None and votes("Fungi") == "Fungi"
    assert votes("Eukaryotes", "Animals", "Insects") == "Insects"
    assert votes("Animals", "Insects", "Plants") == "Insects"  # two agree, one doesn't
    assert votes("Diptera", "Coleoptera") == "Eukaryotes" and votes("Insects", "Molluscs") == "Eukaryotes"
    assert votes("Algae", "Protists", "Plants") == "Algae"  # part of both
    assert votes("Viruses", "Bacteria") == "Viruses"
    assert votes("Animals", "Diptera", "Insects", "Angiosperms", "Plants", "Chordates") == "Animals"  # it alone agrees with four


def test_two_groups_resolve_alike_from_either_side():
    for a, b in combinations(G.GROUPS, 2):
        got = votes(a, b)
        if not G.disparate(a, b):
            assert got == (a if b in G.UP[a] else b)
        elif a not in G.UP[b] and b not in G.UP[a]:
            shared = G.UP[a] & G.UP[b]
            assert got in (shared or G.UP[a] | G.UP[b])


def test_disparity_of_columns(spark):
    pairs = [(a, b) for a in [*G.GROUPS, None] for b in [*G.GROUPS, None]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", G.are_disparate(F.col("a"), F.col("b")))
    assert all(r["d"] == (r["a"] is not None and r["b"] is not None and G.disparate(r["a"], r["b"])) for r in df.collect())


def test_codes_and_suffixes(spark):
    path = "array<struct<rank: string, authorship: string>>"
    rows = [
        (1, "species", "Smith, 1900", []), (2, "species", "(L.) Mill.", [("genus", "Smith, 1900"), ("family", "Brown, 1850")]), (3, "cultivar", "Smith, 1900", []),
        (4, "species", None, [("section", None)]), (5, "species", None, []), (6, "pathovar", None, None), (7, "species", "(L.) Mill.", [("genus", "Smith, 1900")]),
    ]
    df = spark.createDataFrame(rows, f"n int, rank string, authorship string, path {path}")
    got = {r["n"]: r["c"] for r in df.select("n", G.vote_code(F.col("rank"), F.col("authorship"), F.col("path")).alias("c")).collect()}
    assert got == {1: "zoological", 2: "botanical", 3: "cultivars", 4: "botanical", 5: None, 6: "bacterial", 7: "botanical"}
    rows = [("Muscidae", "family", "Animals"), ("Rosaceae", "family", "Prokaryotes"), ("Coronaviridae", "family", "Viruses"), ("Muscidae", "genus", None), ("Agaricomycetes", "class", "Fungi"), ("Perciformes", "order", "Animals"), (None, "order", None)]
    df = spark.createDataFrame(rows, "name string, rank string, want string")
    df = df.select("want", G.vote_suffix(F.array(G.suffix_mask(F.col("name"), F.col("rank")), F.lit(0).cast("long"))).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_groups_of_a_tree(spark):
    nodes = [
        ("k", None, "Animalia", "kingdom", "ACCEPTED", None), ("o", "k", "Diptera", "order", "ACCEPTED", None), ("g", "o", "Plantae", "genus", "ACCEPTED", None),
        ("y", "o", "Plantae", "order", "SYNONYM", None), ("x", None, "Unknown", "family", None, "botanical"), ("z", None, "Nothing", None, None, None),
    ]
    words = [("animalia", "Animals"), ("Diptera", "Diptera"), ("Diptera", "Plants"), ("PLANTAE", "Plants"), ("other", "No such group")]
    df = spark.createDataFrame(nodes, "id string, parent_id string, name string, rank string, status string, code string")
    got = {r["id"]: r["group"] for r in G.with_groups(df, spark.createDataFrame(words, "name string, group string")).collect()}
    assert got == {"k": "Animals", "o": "Diptera", "g": "Diptera", "y": "Diptera", "x": "Eukaryotes", "z": None}


def test_contradicting_candidates_go(spark):
    rows = [(1, "Animals", "Plants", "genus", "A", "A"), (2, "Animals", "Plants", "species", "A", "A"), (3, "Animals", "Insects", "genus", "A", None), (4, None, "Plants", "genus", None, None), (5, "Animals", "Plants", "species", "A", "B")]
    df = spark.createDataFrame(rows, "n int, group string, c_group string, rank string, authorship string, ca string")
    assert sorted(r["n"] for r in G.drop_disparate(df).collect()) == [2, 3, 4]
