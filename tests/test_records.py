"""Torn records against a reader that goes line by line."""

from __future__ import annotations

import random

import pytest

from cladeflow.sources.records import read_torn

COLUMNS = ["a", "b", "c", "d", "e"]


def line_by_line(lines, width):
    out, row = [], None
    for line in lines:
        if not line.strip(" "):
            continue
        cells = line.split("\t")
        if row is not None and 1 < len(row) < width and len(row) + len(cells) - 1 <= width:
            row[-1] += "\n" + cells[0]
            row += cells[1:]
            continue
        if row is not None:
            out.append(row)
        row = cells
    if row is not None:
        out.append(row)
    padded = [tuple((c or None) for c in (r + [None] * width)[:width]) for r in out]
    return [r for r in padded if any(c is not None for c in r)]


@pytest.mark.parametrize("size", ["40b", "300b", "1m"])
def test_torn_records_equal_a_line_by_line_reader(spark, tmp_path, size):
    r = random.Random(size)
    want = []
    for f in range(3):
        lines = []
        for i in range(120):
            n = r.choice([1, 2, 2, 3, 3, 4, 5, 5, 5, 6])
            lines.append("\t".join(r.choice(["", "x", "zwölf", f"v{i}", "long text here"]) for _ in range(n)) if r.random() < 0.95 else "")
        (tmp_path / f"part{f}.tsv").write_text("\n".join(["\t".join(COLUMNS), *lines]) + "\n", encoding="utf-8")
        want += line_by_line(lines, 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [tuple(x) for x in read_torn(spark, str(tmp_path), COLUMNS).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_record_over_many_splits(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\nfirst\tp\n" + "q\n" * 200 + "second\ts\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50b")
    try:
        got = sorted(tuple(x) for x in read_torn(spark, str(tmp_path), ["a", "b"]).collect())
        three = sorted(tuple(x) for x in read_torn(spark, str(tmp_path), ["a", "b", "c"]).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("first", "p"), ("second", "s"), *[("q", None)] * 200], key=lambda t: (t[0], t[1] or ""))
    assert three == [("first", "p" + "\nq" * 200 + "\nsecond", "s")]


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n")
    assert read_torn(spark, str(tmp_path), ["a", "b"]).collect() == []
