"""Author comparison against cases with known answers, and against a loop over pairs."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeflow.functions.similarity import jaro_winkler
from cladeflow.operators import authorship as A

PAIR = f"n int, a {A.AUTHORSHIP}, b {A.AUTHORSHIP}"


def who(*authors, year=None, ex=None):
    return (list(authors), ex, year)


#: (a, b, years first)
CASES = [
    (who("Reich."), who("Reichen."), "EQUAL"),
    (who("Reich."), who("Reichenbrg."), "EQUAL"),
    (who("Reich."), who("Müller"), "DIFFERENT"),
    (who("Reich."), who(""), "UNKNOWN"),
    (who("Reich."), who("Jenkins", "Marx", "Kluse"), "DIFFERENT"),
    (who("Mill."), who("L."), "DIFFERENT"),
    (who("Mortensen", year="1933"), who("Meixner", year="1924"), "DIFFERENT"),
    (who("O.F. Müller", year="1776"), who("Müller O.F.", year="1785"), "EQUAL"),
    (who("Döring", ex=["Miller"]), who("Miller"), "EQUAL"),
    (who("Döring", ex=["Miller"]), who("Döring"), "EQUAL"),
    (who("Young", "Dye", "Wilkie", year="1978"), who("Young", "et al.", year="1978"), "EQUAL"),
    (who("Pallas", year="1771"), who("Pimbus", year="1771"), "DIFFERENT"),
    (who("Pallas", year="1771"), who(year="1771"), "EQUAL"),
    (who("Pallas", year="1771"), who("Pallas"), "EQUAL"),
    (who("Pallas", year="1771"), who(year="1778"), "DIFFERENT"),
    (who("Pallas"), who(year="1771"), "UNKNOWN"),
    (who("Conrad von Baldenstein", year="1827"), who("Conrad von Baldenstein", year="1828"), "EQUAL"),
    (who("Hook."), who("Hook.f."), "DIFFERENT"),
    (who("J. Smith", year="1840"), who("K. Smith", year="1840"), "DIFFERENT"),
    (who("J. Smith", year="184?"), who("J. K. Smith", year="1840"), "EQUAL"),
    (who("Smith", year="1800"), who("Smith", year="1812"), "DIFFERENT"),
    (who("Hübner"), who("Huebner"), "EQUAL"),
    (None, who("Smith"), "UNKNOWN"),
    (None, None, "UNKNOWN"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAIR)


def collect(df, name="equal"):
    return [r[name] for r in df.orderBy("n").collect()]


def test_known_cases(spark):
    assert collect(A.compare(frame(spark, [c[:2] for c in CASES]), "a", "b")) == [c[2] for c in CASES]


def test_years_alone(spark):
    cases = [("1999", "1999", 0, "EQUAL"), ("1999", "2000", 0, "DIFFERENT"), ("1999", "2000", 1, "UNKNOWN"), ("199?", "1994", 0, "EQUAL"), ("199?", "1984", 9, "DIFFERENT"), ("(1887)", "1887a", 0, "EQUAL"), (None, "1887", 0, "UNKNOWN"), ("18??", "1887", 0, "DIFFERENT"), ("in press", "In Press.", 0, "EQUAL")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "n int, a string, b string, t int")
    df = df.select("n", A.year_text(F.col("a")).alias("y"), A.year_text(F.col("b")).alias("z"))
    got = {r["n"]: {t: r[f"t{t}"] for t in (0, 1, 9)} for r in df.select("n", *(A.same_years(F.col("y"), F.col("z"), t).alias(f"t{t}") for t in (0, 1, 9))).collect()}
    assert [got[i][c[2]] for i, c in enumerate(cases)] == [c[3] for c in cases]


def test_authors_first(spark):
    rows = [(who("Smith", year="1900"), who("Jones", year="1900")), (who("Smith", year="1900"), who("Snyder", year="1900")), (who("Smith", year="1900"), who("Smith", year="1950")), (who(year="1900"), who("Smith", year="1900")), (who("Smith"), who("Jones"))]
    assert collect(A.compare_authors_first(frame(spark, rows), "a", "b")) == ["DIFFERENT", "EQUAL", "EQUAL", "EQUAL", "DIFFERENT"]


def test_strict_and_codes(spark):
    rows = [(who("Miller", ex=["Döring"]), who("Miller")), (who("Miller", ex=["Döring"]), who("Döring")), (who("Miller", year="1800"), who("Miller", year="1801")), (who("Miller"), who("Miller", year="1801")), (who("Millner"), who("Miller"))]
    assert collect(A.compare_strict(frame(spark, rows), "a", "b")) == [True, False, False, True, True]
    assert collect(A.compare_strict(frame(spark, rows), "a", "b", code="zoological")) == [False, True, False, True, True]


def test_abbreviations(spark):
    known = A.author_map(spark.createDataFrame([("L.", "Linnaeus", None), ("DC.", "Candolle", "botanical"), ("Xyz.", "Quist", "zoological")], "abbreviation string, author string, code string"))
    rows = [(who("L."), who("Linnaeus")), (who("DC."), who("Candolle")), (who("Xyz."), who("Quist")), (who("L."), who("Candolle"))]
    assert collect(A.compare(frame(spark, rows), "a", "b", known)) == ["EQUAL", "EQUAL", "DIFFERENT", "DIFFERENT"]
    assert collect(A.compare(frame(spark, rows), "a", "b")) == ["EQUAL", "DIFFERENT", "DIFFERENT", "DIFFERENT"]


def test_names_by_both_authorships(spark):
    none = who()
    rows = [
        (who("Smith"), who("Mill."), who("Smith"), who("Brown"), "EQUAL"), (none, who("Mill."), none, who("Brown"), "DIFFERENT"),
        (none, who("Mill."), who("Miller"), none, "EQUAL"), (none, who("Mill."), who("Brown"), none, "UNKNOWN"), (none, none, none, none, "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "n int, " + ", ".join(f"{c} {A.AUTHORSHIP}" for c in ("a_comb", "a_bas", "b_comb", "b_bas")))
    assert collect(A.compare_names(df)) == [r[4] for r in rows]


def loop(a, b):
    """Years first, one author after the other."""

    def fold(x):
        x = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
        x = " ".join(re.sub(r"[^\w\s,]|_", " ", re.sub("(?i)([auo])e", r"\1", x)).split())
        words = x.split(" ")
        behind = []
        while len(words) > 1 and len(words[-1]) == 1:
            behind.insert(0, words.pop())
        if behind and behind != ["f"] and re.search("[A-Za-z]{2}$", words[-1]):
            words = behind + words
        else:
            words += behind
        if len(words) > 1 and words[-1] in ("f", "fil") and words[-2][0].isupper():
            words[-1] = "filius"
        return " ".join(words).lower()

    def team(x):
        return [t for t in map(fold, [*x[0], *(x[1] or [])]) if t not in ("", "al")]

    def split(x):
        words = x.split(" ")
        initials = []
        while len(words) > 1 and len(words[0]) == 1:
            initials.append(words.pop(0))
        suffix = words.pop() if len(words) > 1 and words[-1] in ("filius", "bis", "ter") else ""
        return initials, words[-1], suffix

    def apart(x, y):
        (i, _, s), (j, _, t) = split(x), split(y)
        small, large = sorted((i, j), key=len)
        return bool(i and j and Counter(small) - Counter(large)) or s != t

    def same(x, y, start, least):
        s, t = split(x)[1], split(y)[1]
        sim = jaro_winkler(s, t) - max(0, 10 - len(s) - len(t)) * 5
        if s == t or min(len(s), len(t)) >= start and s[:start] == t[:start] or sim > least:
            return not apart(x, y)
        if (s.startswith(t) or t.startswith(s)) and not apart(x, y):
            return True
        return x == s and t.startswith(s) or y == t and s.startswith(t)

    y, z = a[2], b[2]
    years = "UNKNOWN" if None in (y, z) or 0 < abs(int(y) - int(z)) <= 11 else "EQUAL" if y == z else "DIFFERENT"
    if years == "DIFFERENT":
        return years
    near = years == "UNKNOWN" and None not in (y, z)
    p, q = team(a), team(b)
    if not p or not q:
        return "DIFFERENT" if near else years
    if p == q or any(same(x, y, *((12, 99) if near else (4, 90))) for x in p for y in q):
        return "EQUAL"
    return "DIFFERENT"


def test_random_pairs_equal_a_loop(spark):
    r = random.Random(8)
    surnames = ["Smith", "Smyth", "Smithson", "Müller", "Mueller", "Mull.", "Hook.", "Hooker", "Ng", "L.", "Linné", "Martinez", "Martines", "Marhtinez", "Li", "Lindley", "Schoch", "Schott"]

    def one():
        initials = "".join(r.choice("ABC") + ". " for _ in range(r.choice([0, 0, 1, 2])))
        name = r.choice(surnames)
        return r.choice([initials + name, name + " " + initials.replace(". ", "."), name + r.choice(["", " f.", " bis"])]).strip()

    def some():
        return ([one() for _ in range(r.choice([0, 1, 1, 2, 3]))], [one()] if r.random() < 0.2 else None, r.choice([None, "1800", "1805", "1812", "1900"]))

    rows = [(some(), some()) for _ in range(1500)]
    got = collect(A.compare(frame(spark, rows), "a", "b"))
    assert [(x, g) for x, g in zip(rows, got) if g != loop(*x)] == []
    assert len(set(got)) == 3


@pytest.mark.parametrize("way", [A.compare, A.compare_authors_first, A.compare_strict])
def test_empty_table(spark, way):
    assert way(frame(spark, []), "a", "b").collect() == []
