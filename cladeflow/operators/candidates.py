"""Choosing one of several candidates for a name, by a cascade of rules.

A query may have any number of candidates. All rules are answered by least and
greatest values, so one aggregation with partial results before its shuffle
decides every query; no task gathers a query's candidates. Where queries and
candidates share attributes, tally() needs no pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import VAGUE_RANKS, is_synonym, ordinal

#: Outcomes besides NONE: one candidate is left; one is as good as any other; one is the best guess.
MATCH, SNAP, AMBIGUOUS, NONE = "MATCH", "SNAP", "AMBIGUOUS", "NONE"
GENUS_RANKS = ("genus", "subgenus", "infragenus")


def fits_rank(query: Column, candidate: Column) -> Column:
    """Whether ranks may be the same: equal, or one of them missing or vague."""
    vague = lambda r: r.isNull() | r.isin(*VAGUE_RANKS)
    return vague(query) | vague(candidate) | (query == candidate)


def strictest_rank(pairs: DataFrame, query: str, candidate: str, key: str = "query") -> DataFrame:
    """Pairs whose ranks may be the same; where a query has candidates of just its rank, those alone."""
    fit = pairs.filter(fits_rank(F.col(query), F.col(candidate)))
    same = F.coalesce(F.col(query) == F.col(candidate), F.lit(False)) & ~F.col(query).isin(*VAGUE_RANKS)
    have = fit.filter(same).select(key).distinct().withColumn("_exact", F.lit(True))
    return fit.join(have, key, "left").filter(F.col("_exact").isNull() | same).drop("_exact")


def drop_other_authors(pairs: DataFrame, equal: str, rank: str, qualified: str, same_family: Column | None = None) -> DataFrame:
    """Pairs but those that authorship tells apart.

    Below the genus group, a query with authors and rank needs equal authors where
    the candidate has any. Genera with other authors stay in one family only.
    equal: EQUAL, DIFFERENT, UNKNOWN; candidates without authors: column authored.
    """
    suprageneric = F.col(rank).isin(*GENUS_RANKS) | (ordinal(F.col(rank), _ranks()) <= F.lit(_ranks().index("genus")))
    below = F.col(qualified) & ~suprageneric & F.col("authored") & (F.col(equal) != "EQUAL")
    family = F.coalesce(same_family, F.lit(False)) if same_family is not None else F.lit(False)
    genus = F.col(qualified) & (F.col(rank) == "genus") & F.col("authored") & (F.col(equal) == "DIFFERENT") & ~family
    return pairs.filter(~F.coalesce(below | genus, F.lit(False)))


def drop_other_years(pairs: DataFrame, year_only: Column, query_year: Column, year: Column, tolerance: int = 2) -> DataFrame:
    """Pairs but those of queries with a year and no author whose candidate has no year near it."""
    near = F.coalesce(F.abs(query_year - year) <= tolerance, F.lit(False))
    return pairs.filter(~F.coalesce(year_only, F.lit(False)) | query_year.isNull() | near)


def lowest_common(a: Column, b: Column) -> Column:
    """The lowest rank ordinal at which two classifications (arrays of rank_ord and name) have one name; null if none."""
    plain = lambda path: F.transform(path, lambda p: F.struct(p["rank_ord"].alias("r"), F.lower(p["name"]).alias("n")))
    return F.array_max(F.transform(F.array_intersect(plain(a), plain(b)), lambda p: p["r"]))


def choose(pairs: DataFrame) -> DataFrame:
    """query, match, match_type and n (candidates) for each query of `pairs`.

    Columns: query, candidate; qualified (the query has authors and a rank);
    label (same name and authors as written); equal (of the authorships); authored
    (the candidate has authors); status; accepted (of a synonym); common (rank
    ordinal of the lowest common classification, or null); lowest (that of the
    candidate's parent, or null).

    In turn: for qualified queries, the one candidate with the same label, or the
    one that authors don't tell apart; the only candidate; for qualified ones the
    only candidate with authors; any synonym, if all are synonyms of one name; the
    only one that isn't provisional; the one with the lowest common
    classification; the only accepted one; the one classified lowest; the first
    by id.
    """
    return decide(tally(pairs, ["query"], F.bool_or("qualified").alias("qualified")))


#: Parts of a tally: what holds of candidates whatever the query is, and what depends on the query.
OWN, ALIKE, LABEL, NEAR = PARTS = ("own", "alike", "label", "near")


def tally(pairs: DataFrame, keys: list[str], *more: Column, parts: tuple = PARTS) -> DataFrame:
    """What decide() needs of the candidates of each key; `more` aggregates stand beside it.

    A row may stand for several candidates that only their ids tell apart: columns
    `last`, the greatest of them, besides `candidate`, the least, and `times`. So
    the parts can be told by groups of candidates, each by the keys it depends on:
    OWN by none of the query's columns, ALIKE by `equal` and `authored`, LABEL by
    these and `label`, NEAR by `common`.
    """
    c, synonym = F.col("candidate"), is_synonym(F.col("status"))
    last = F.col("last") if "last" in pairs.columns else c
    times = F.col("times") if "times" in pairs.columns else F.lit(1)
    alike = F.coalesce(F.col("equal") != "DIFFERENT", F.lit(True)) | ~F.col("authored")
    firm = F.upper("status") != "PROVISIONALLY_ACCEPTED"
    taxon = firm & ~synonym
    first = lambda cond: F.min(F.when(cond, c))
    count = lambda cond: F.sum(F.when(cond, times).otherwise(0))

    def only_lowest(value: Column, cond: Column, name: str):
        """Least and greatest candidate among those of the greatest value."""
        given = cond & value.isNotNull()
        least = F.min(F.when(given, F.struct((-value).alias("v"), c.alias("c"))))["c"]
        return least.alias(f"{name}_min"), F.max(F.when(given, F.struct(value.alias("v"), last.alias("c"))))["c"].alias(f"{name}_max")

    told = {
        OWN: lambda: [
            F.sum(times).alias("n"), F.min(c).alias("least"), count(F.col("authored")).alias("n_authored"), first(F.col("authored")).alias("by_having"),
            count(~synonym).alias("n_taxa"), F.min("accepted").alias("to_min"), F.max("accepted").alias("to_max"), count(F.col("accepted").isNull()).alias("to_none"),
            count(firm).alias("n_firm"), first(firm).alias("by_firm"), count(taxon).alias("n_taxon"), first(taxon).alias("by_taxon"),
            *only_lowest(F.col("lowest"), taxon, "tax"), *only_lowest(F.col("lowest"), firm, "any"),
        ],
        ALIKE: lambda: [count(alike).alias("n_alike"), first(alike).alias("by_authors")],
        LABEL: lambda: [count(F.col("label") & alike).alias("n_label"), first(F.col("label") & alike).alias("by_label")],
        NEAR: lambda: only_lowest(F.col("common"), firm, "near"),
    }
    return pairs.groupBy(*keys).agg(*more, *(x for part in parts for x in told[part]()))


def decide(told: DataFrame) -> DataFrame:
    """query, match, match_type and n by the cascade of choose(), from all parts of a tally; columns query, qualified."""
    as_one = lambda m, kind: F.struct(m.alias("match"), F.lit(kind).alias("match_type"))
    col = F.col
    found = (
        F.when(col("qualified") & (col("n_label") == 1), as_one(col("by_label"), MATCH))
        .when(col("qualified") & (col("n_label") == 0) & (col("n_alike") == 1), as_one(col("by_authors"), MATCH))
        .when(col("n") == 1, as_one(col("least"), MATCH))
        .when(col("qualified") & (col("n_authored") == 1), as_one(col("by_having"), MATCH))
        .when((col("n_taxa") == 0) & (col("to_none") == 0) & (col("to_min") == col("to_max")), as_one(col("least"), SNAP))
        .when(col("n_firm") == 1, as_one(col("by_firm"), SNAP))
        .when(col("n_firm") == 0, as_one(F.lit(None).cast(told.schema["least"].dataType), NONE))
        .when(col("near_min") == col("near_max"), as_one(col("near_min"), AMBIGUOUS))
        .when(col("n_taxon") == 1, as_one(col("by_taxon"), SNAP))
        .when((col("n_taxon") > 0) & (col("tax_min") == col("tax_max")), as_one(col("tax_min"), AMBIGUOUS))
        .when((col("n_taxon") == 0) & (col("any_min") == col("any_max")), as_one(col("any_min"), AMBIGUOUS))
        .otherwise(as_one(F.when(col("n_taxon") > 0, col("by_taxon")).otherwise(col("by_firm")), AMBIGUOUS))
    )
    return told.select("query", found.alias("found"), "n").select("query", "found.match", "found.match_type", "n")


def _ranks():
    from ..vocab import RANKS

    return RANKS
