"""Comparing authorships: teams of authors and years, in three values.

An authorship is a struct of authors and ex-authors (arrays of strings) and a year
(string). Distinct pairs of authorships are decided once, however many names
share them. Rules on letters are column expressions over the two arrays; only
pairs of surnames that those leave open, and that are near enough in length, are
measured by Jaro-Winkler, each once, in Arrow batches. Abbreviations are looked
up by a join of the distinct authors, so the table of abbreviations may be of any size.

Results are EQUAL, DIFFERENT or UNKNOWN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unaccent
from ..functions.similarity import both, jaro_winkler_similarity
from ..lineage import settle

AUTHORSHIP = "struct<authors: array<string>, ex: array<string>, year: string>"

# Fixed values of the comparison: letters that surnames must share from the start, similarity of
# surnames above which they are one, length below which an author is looked up before the first
# comparison, years that may lie between, and what asks more where only the years are near.
COMMON_START, LEAST_JARO, SHORT_AUTHOR, NEAR_YEARS = 4, 90.0, 4, 11
STRICT_START, STRICT_JARO = 12, 99.0
#: Both surnames have so many letters, or lose this much similarity for each one less.
JARO_LETTERS, JARO_LOSS = 10, 5
#: A folded author's initials, surname and suffix; authors that stand for others.
AUTHOR_PARTS = r"^((?:[a-z] )*)(?:.*?[^a-z])??([a-z]+)(?: (filius|fil|fl|f|bis|ter))?$"
AND_OTHERS = "al"


def normal_author(x: Column) -> Column:
    """Folded, in lower case, with initials in front and `f.` spelled out; null if nothing is left."""
    folded = F.regexp_replace(F.regexp_replace(unaccent(x), r"(?i)([auo])e", "$1"), r"[\p{Punct}&&[^,]]+", " ")
    spaced = F.trim(F.regexp_replace(folded, r"\s+", " "))
    behind = F.regexp_extract(spaced, r"(?i)^(.*[a-z]{2,})((?: [a-z])+)$", 2)
    ahead = F.regexp_replace(spaced, r"(?i)^(.*[a-z]{2,})((?: [a-z])+)$", "$2 $1")
    turned = F.when((behind != "") & (F.trim(behind) != "f"), F.trim(ahead)).otherwise(spaced)
    spelled = F.regexp_replace(turned, r"([A-Z][a-z]*) +f(?:il)?\b", "$1 filius")
    return F.nullif(F.lower(F.trim(spelled)), F.lit(""))


def team(authorship: Column, code: Column) -> Column:
    """Normal authors of an authorship. With ex-authors, zoology takes those, other codes the authors, none both."""
    empty = F.array().cast("array<string>")
    own, ex = F.coalesce(authorship["authors"], empty), F.coalesce(authorship["ex"], empty)
    zoo = F.coalesce(code == "zoological", F.lit(False))
    chosen = (
        F.when(F.size(ex) == 0, own).when(code.isNull(), F.concat(own, ex)).when(zoo, ex).otherwise(own)
    )
    return F.filter(F.transform(chosen, normal_author), lambda a: a.isNotNull() & (a != AND_OTHERS))


def parts(author: Column) -> Column:
    """full, initials (letters), surname and suffix of a normal author; one of another shape is all surname."""
    part = lambda i: F.regexp_extract(author, AUTHOR_PARTS, i)
    fits = author.rlike(AUTHOR_PARTS)
    suffix = part(3)
    return F.struct(
        author.alias("full"),
        F.when(fits, F.split(F.regexp_replace(part(1), " ", ""), "")).otherwise(F.array().cast("array<string>")).alias("initials"),
        F.when(fits, part(2)).otherwise(author).alias("surname"),
        F.when(suffix.startswith("f"), "filius").otherwise(suffix).alias("suffix"),
    )


def _included(few: Column, many: Column) -> Column:
    """Whether an array's items are all in the other, as often at least."""
    count = lambda xs, c: F.size(F.filter(xs, lambda x: x == c))
    return F.forall(few, lambda c: count(few, c) <= count(many, c))


def relatives(a: Column, b: Column) -> Column:
    """Whether initials or suffixes tell two authors apart, as with fathers and sons."""
    x, y = (F.filter(p["initials"], lambda c: c != "") for p in (a, b))
    smaller_first = F.when(F.size(x) > F.size(y), _included(y, x)).otherwise(_included(x, y))
    return ((F.size(x) > 0) & (F.size(y) > 0) & ~smaller_first) | (a["suffix"] != b["suffix"])


def same_author(a: Column, b: Column, start: Column) -> Column:
    """Whether parts of two authors are one, by the letters of their surnames alone."""
    s, t = a["surname"], b["surname"]
    near = (s == t) | ((F.length(s) >= start) & (F.length(t) >= start) & (F.substring(s, F.lit(1), start) == F.substring(t, F.lit(1), start)))
    one_begins = s.startswith(t) | t.startswith(s)
    bare = ((a["full"] == s) & t.startswith(s)) | ((b["full"] == t) & s.startswith(t))
    return F.when(near, ~relatives(a, b)).otherwise((one_begins & ~relatives(a, b)) | bare)


def _looked_up(pairs: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
    """`pairs` with column `found`, a map of those of their authors that are abbreviations to what they stand for.

    pairs: id and arrays of authors; known: abbreviation, author.
    """
    authors = F.array_distinct(F.concat(*columns))
    each = pairs.select("id", F.explode(authors).alias("abbreviation"))
    names = each.join(known, "abbreviation").groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("abbreviation", "author"))).alias("found")
    )
    return pairs.join(names, "id", "left")


def author_map(rows: DataFrame, code: str | None = None) -> DataFrame:
    """abbreviation and author in normal form, one each, from rows of abbreviation, author and code (null: any)."""
    mine = F.col("code").isNull() | (F.col("code") == ("zoological" if code == "zoological" else "botanical"))
    normal = rows.filter(mine).select(normal_author(F.col("abbreviation")).alias("abbreviation"), normal_author(F.col("author")).alias("author"))
    return normal.filter("abbreviation is not null and author is not null").groupBy("abbreviation").agg(F.min("author").alias("author"))


def _same_teams(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """`pairs` with whether an author of the one array is one of the other; columns id, start, jaro."""
    people = settle(pairs.withColumn("_a", F.transform(a, parts)).withColumn("_b", F.transform(b, parts)))
    by_letters = (F.col(a) == F.col(b)) | F.exists("_a", lambda x: F.exists("_b", lambda y: same_author(x, y, F.col("start"))))
    people = settle(people.withColumn("_same", by_letters))
    open_ = (
        people.filter(~F.col("_same"))
        .select("id", "jaro", "_b", F.explode("_a").alias("x"))
        .select("id", "jaro", "x", F.explode("_b").alias("y"))
        .select("id", "jaro", F.col("x.surname").alias("s"), F.col("y.surname").alias("t"), relatives(F.col("x"), F.col("y")).alias("apart"))
        .filter(~F.col("apart") & (2 * F.least(F.length("s"), F.length("t")) > F.greatest(F.length("s"), F.length("t"))))
    )  # surnames of less than half the other's length stay below the least similarity
    letters = F.length("s") + F.length("t")
    measured = open_.select("s", "t").distinct().withColumn(
        "similar", jaro_winkler_similarity("s", "t") - F.greatest(F.lit(0), JARO_LETTERS - letters) * JARO_LOSS
    )
    near = open_.join(measured, ["s", "t"]).filter("similar > jaro").select("id").distinct().withColumn("_near", F.lit(True))
    joined = people.join(near, "id", "left")
    return joined.withColumn(out, F.col("_same") | F.coalesce("_near", F.lit(False))).drop("_a", "_b", "_same", "_near")


def compare_teams(pairs: DataFrame, known: DataFrame | None = None, short: int = SHORT_AUTHOR, code: Column | None = None) -> DataFrame:
    """id and `equal` (three values) of pairs of authorships.

    pairs: id, a, b, start (letters surnames must share), jaro (their least
    similarity). One author in common is enough. With a table of abbreviations
    (abbreviation, author), authors shorter than `short` are looked up first, and
    all of them where the teams differ.
    """
    code = F.lit(None).cast("string") if code is None else code
    teams = settle(pairs.select("id", "start", "jaro", team(F.col("a"), code).alias("ta"), team(F.col("b"), code).alias("tb")))
    if known is not None:
        teams = settle(_looked_up(teams, ["ta", "tb"], known))
        full = lambda x: F.coalesce(F.get(F.filter(F.map_entries("found"), lambda e: e["key"] == x), F.lit(0))["value"], x)
        teams = teams.withColumn("la", F.transform("ta", full)).withColumn("lb", F.transform("tb", full)).select(
            "id", "start", "jaro",
            *(F.transform(t, lambda x: F.when(F.length(x) < short, full(x)).otherwise(x)).alias(t) for t in ("ta", "tb")), "la", "lb",
        )
    out = _same_teams(teams, "ta", "tb", "same")
    if known is not None:
        changed = out.filter(~F.col("same") & ((F.col("ta") != F.col("la")) | (F.col("tb") != F.col("lb"))))
        again = _same_teams(changed, "la", "lb", "again").select("id", "again")
        out = out.join(again, "id", "left").withColumn("same", F.col("same") | F.coalesce("again", F.lit(False)))
    nobody = (F.size("ta") == 0) | (F.size("tb") == 0)
    return out.select("id", F.when(nobody, "UNKNOWN").when(F.col("same"), "EQUAL").otherwise("DIFFERENT").alias("equal"))


def year_text(x: Column) -> Column:
    """Four digits or question marks that stand alone, or else the text in normal form."""
    found = F.regexp_extract(F.regexp_replace(x, r"\s+", ""), r"(?:^|[^0-9])([0-9?]{4})(?:[^0-9]|$)", 1)
    return F.when(x.isNotNull(), F.coalesce(F.nullif(found, F.lit("")), normal_author(x)))


def same_years(y: Column, z: Column, tolerance: int = 0) -> Column:
    """EQUAL, also where question marks stand for digits; UNKNOWN within the tolerance or if one is missing; else DIFFERENT.

    y and z: results of year_text(), best as columns of their own.
    """
    n, m = y.try_cast("int"), z.try_cast("int")
    first = lambda x: F.instr(x, "?")
    masked = lambda x, i: F.when((i > 0) & (i <= F.length(x)), F.overlay(x, F.lit("_"), i, F.lit(1))).otherwise(x)
    hidden = lambda x: masked(masked(x, first(y)), first(z))
    marked = (first(y) > 0) | (first(z) > 0)
    return (
        F.when(y.isNull() | z.isNull(), "UNKNOWN")
        .when((y == z) | F.coalesce(n == m, F.lit(False)), "EQUAL")
        .when(F.coalesce(F.abs(n - m) <= tolerance, F.lit(False)), "UNKNOWN")
        .when((n.isNull() | m.isNull()) & marked & (hidden(y) == hidden(z)), "EQUAL")
        .otherwise("DIFFERENT")
    )


def _distinct_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    found = rows.select(F.col(a).cast(AUTHORSHIP).alias("a"), F.col(b).cast(AUTHORSHIP).alias("b")).distinct()
    years = {"ya": year_text(F.col("a.year")), "yb": year_text(F.col("b.year"))}
    return settle(found.withColumns(years).withColumn("id", F.monotonically_increasing_id()))


def _back(rows: DataFrame, a: str, b: str, decided: DataFrame, out: str) -> DataFrame:
    named = decided.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("equal").alias(out))
    on = F.col(a).cast(AUTHORSHIP).eqNullSafe(F.col("_a")) & F.col(b).cast(AUTHORSHIP).eqNullSafe(F.col("_b"))
    return rows.join(named, on, "left").drop("_a", "_b")


def compare(rows: DataFrame, a: str, b: str, known: DataFrame | None = None, out: str = "equal") -> DataFrame:
    """`rows` with the equality of two authorship columns, years first.

    Years more than NEAR_YEARS apart tell names apart; where they are near but not
    the same, surnames must agree more closely, and an empty team tells apart too.
    A null authorship has neither authors nor a year.
    """
    pairs = _distinct_pairs(rows, a, b)
    pairs = pairs.withColumn("years", same_years(F.col("ya"), F.col("yb"), NEAR_YEARS))
    near = (F.col("years") == "UNKNOWN") & F.col("ya").isNotNull() & F.col("yb").isNotNull()
    pairs = pairs.withColumn("near", near)
    pairs = pairs.withColumn("start", F.when(near, STRICT_START).otherwise(COMMON_START)).withColumn("jaro", F.when(near, STRICT_JARO).otherwise(LEAST_JARO))
    teams = compare_teams(pairs.filter("years != 'DIFFERENT'"), known)
    joined = pairs.join(teams, "id", "left").withColumn("team", F.coalesce("equal", F.lit("UNKNOWN")))
    decided = F.when((F.col("years") == "DIFFERENT") | (F.col("near") & (F.col("team") == "UNKNOWN")), "DIFFERENT").otherwise(
        both(F.col("years"), F.col("team"))
    )
    return _back(rows, a, b, joined.withColumn("equal", decided), out)


def compare_authors_first(rows: DataFrame, a: str, b: str, known: DataFrame | None = None, out: str = "equal") -> DataFrame:
    """`rows` with the equality of two authorship columns; years decide only where teams aren't equal.

    The same year makes teams equal whose authors share a capital letter.
    """
    pairs = _distinct_pairs(rows, a, b).withColumn("start", F.lit(COMMON_START)).withColumn("jaro", F.lit(LEAST_JARO))
    joined = pairs.join(compare_teams(pairs, known), "id")
    years = same_years(F.col("ya"), F.col("yb"))
    names = lambda x: F.coalesce(F.array_join(x["authors"], "; "), F.lit(""))
    capitals = lambda x: F.array_distinct(F.filter(F.split(names(x), ""), lambda c: c.rlike(r"\p{Lu}")))
    nobody = lambda x: F.coalesce(F.size(x["authors"]), F.lit(0)) <= 0
    told = (years == "DIFFERENT") | nobody(F.col("a")) | nobody(F.col("b")) | F.arrays_overlap(capitals(F.col("a")), capitals(F.col("b")))
    decided = F.when((F.col("equal") != "EQUAL") & (years != "UNKNOWN") & told, years).otherwise(F.col("equal"))
    return _back(rows, a, b, joined.withColumn("equal", decided), out)


def compare_strict(rows: DataFrame, a: str, b: str, known: DataFrame | None = None, code: str | None = None, years: int = 0, out: str = "equal") -> DataFrame:
    """`rows` with whether two authorships are surely one: equal teams under the code, years at most `years` apart."""
    pairs = _distinct_pairs(rows, a, b).withColumn("start", F.lit(COMMON_START)).withColumn("jaro", F.lit(100.0))
    teams = compare_teams(pairs, known, short=1 << 30, code=F.lit(code or "botanical"))
    apart = same_years(F.col("ya"), F.col("yb"), years) == "DIFFERENT"
    given = F.col("a.year").isNotNull() & F.col("b.year").isNotNull()
    joined = pairs.join(teams, "id").withColumn("equal", (F.col("equal") == "EQUAL") & ~(given & apart))
    return _back(rows, a, b, joined, out)


def compare_names(rows: DataFrame, known: DataFrame | None = None, way=compare, out: str = "equal") -> DataFrame:
    """`rows` with the equality of names by both of their authorships.

    Columns a_comb, a_bas, b_comb, b_bas. Those of the combination decide; where
    they are unknown, those of the original name do, or the one of each that is
    there, which can only prove names equal.
    """
    empty = lambda x: (F.coalesce(F.size(x["authors"]), F.lit(0)) <= 0) & (F.coalesce(F.size(x["ex"]), F.lit(0)) <= 0) & x["year"].isNull()
    none = lambda c: F.col(c).isNull() | empty(F.col(c))
    crossed = F.when(none("a_comb"), F.struct(F.col("a_bas").alias("x"), F.col("b_comb").alias("y"))).when(
        none("a_bas"), F.struct(F.col("a_comb").alias("x"), F.col("b_bas").alias("y"))
    )
    rows = rows.withColumn("_cross", crossed).withColumn("_x", F.col("_cross.x")).withColumn("_y", F.col("_cross.y"))
    for pair, name in ((("a_comb", "b_comb"), "_recombined"), (("a_bas", "b_bas"), "_original"), (("_x", "_y"), "_across")):
        rows = way(rows, *pair, known, out=name)
    across = F.when(F.col("_cross").isNotNull() & (F.col("_across") == "EQUAL"), "EQUAL").otherwise("UNKNOWN")
    decided = F.when(F.col("_recombined") != "UNKNOWN", F.col("_recombined")).when(F.col("_original") == "UNKNOWN", across).otherwise(F.col("_original"))
    return rows.withColumn(out, decided).drop("_cross", "_x", "_y", "_recombined", "_original", "_across")
