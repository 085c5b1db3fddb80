"""Delimited files, folders of them and star archives, written and read back."""

from __future__ import annotations

import pytest

from cladeflow.sources import delimited as d
from cladeflow.sources import trees


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["a,b,c", "1,2,3"], (",", 3)), (["a\tb", "1,5\t2"], ("\t", 2)), (["a;b;c", '"x;y";2;3'], (";", 3)), (["alone", "x"], (",", 1)),
        (["a|b", "1|2"], ("|", 2)),
    ],
)
def test_dialect(lines, want):
    found = d.sniff(lines)
    assert (found.delimiter, found.columns) == want


@pytest.mark.parametrize(("text", "want"), [("<html>", False), ("{}", False), ("a,b", True), ("", False), ("PK\x03", False)])
def test_tables_look_like_tables(text, want):
    assert d.tabular([text]) is want


@pytest.mark.parametrize(
    ("data", "want"), [("é".encode(), "UTF-8"), ("é".encode("cp1252"), "windows-1252"), (b"\xff\xfea\x00", "UTF-16"), (b"\x81", "ISO-8859-1")]
)
def test_encoding(data, want):
    assert d.encoding_of(data) == want


def test_delimited_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text('dwc:taxonID,Name,note\n1," Abies  alba ","two\nlines"\n,,\n2,,x\n')
    rows = d.read_delimited(spark, str(tmp_path / "t.csv"), {"taxon_id": "id"}, {"note": "none", "kind": "k"}).collect()
    assert [(r["id"], r["Name"], r["kind"]) for r in rows] == [("1", "Abies alba", "k"), ("2", None, "k")]
    (tmp_path / "page.csv").write_text("<html></html>")
    with pytest.raises(ValueError):
        d.read_delimited(spark, str(tmp_path / "page.csv"))


def test_folder_round_trip(spark, tmp_path):
    usage = spark.createDataFrame([("1", "Abies"), ("2", "Larix")], "ID string, scientificName string")
    ref = spark.createDataFrame([("r1", "a title")], "ID string, title string")
    d.write_folder({"name_usage": usage, "Reference": ref, "Other": ref}, str(tmp_path / "f"))
    found = d.read_folder(spark, str(tmp_path / "f"), {"NameUsage": {"ID": "id"}, "reference": {}})
    assert set(found) == {"NameUsage", "reference"}
    assert sorted((r["id"], r["scientificName"]) for r in found["NameUsage"].collect()) == [("1", "Abies"), ("2", "Larix")]
    assert [tuple(r) for r in found["reference"].collect()] == [("r1", "a title")]


def test_star_archive_round_trip(spark, tmp_path):
    core = spark.createDataFrame([("1", "Abies", None), ("2", "id", "x y")], "id string, scientificName string, note string")
    names = spark.createDataFrame([("1", "fir"), ("9", "gone"), ("2", "larch")], "id string, vernacularName string")
    at = str(tmp_path / "a")
    d.write_star_archive(("Taxon", core), {"VernacularName": names}, at, "http://example.org/terms/")
    found = d.read_star_archive(spark, at)
    assert sorted(tuple(r) for r in found["Taxon"].select("id", "scientificName", "note").collect()) == [("1", "Abies", None), ("2", "id", "x y")]
    assert sorted(tuple(r) for r in found["VernacularName"].select("id", "vernacularName").collect()) == [("1", "fir"), ("2", "larch")]


def test_indented_tree(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Animalia\n  Abies\n    $Abies alba\n    =Pinus picea\n\n  †Larix\n    Larix decidua\nPlantae\n")
    rows = {r["name"]: r for r in trees.read_indented(spark, str(tmp_path / "t.txt")).collect()}
    up = {n: next((m for m, q in rows.items() if q["id"] == r["parent_id"]), None) for n, r in rows.items()}
    assert up == {"Animalia": None, "Abies": "Animalia", "Abies alba": "Abies", "Pinus picea": "Abies", "Larix": "Animalia", "Larix decidua": "Larix", "Plantae": None}
    assert (rows["Pinus picea"]["kind"], rows["Abies alba"]["kind"], rows["Larix"]["extinct"], rows["Abies"]["depth"]) == ("synonym", "basionym", True, 2)
