"""Faceted search: facets that leave their own filter out, orders, scores, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_epithet
from ..functions.scalars import unaccent
from .predicates import conjunction


def facets(
    rows: DataFrame, parameters: dict[str, list], names: list[str], limit: int = 10, min_count: int = 1,
    query: Column | None = None, arrays: frozenset = frozenset(), own_filter: bool = False,
) -> DataFrame:
    """facet, value, n and place: the most frequent values of each facet.

    A facet is counted under all filters but its own, unless `own_filter`; the
    text query counts always. Equal counts go by value. One scan serves all
    facets: rows that pass some facet's filters are tagged and exploded.
    """
    from pyspark.sql import Window

    base = rows if query is None else rows.filter(query)
    tagged = F.array(*(
        F.when(
            conjunction(parameters, arrays, None if own_filter else name),
            F.struct(
                F.lit(name).alias("facet"),
                (F.col(name) if name in arrays else F.array(F.col(name))).cast("array<string>").alias("values"),
            ),
        )
        for name in names
    ))
    counts = (
        base.select(F.explode(F.array_compact(tagged)).alias("f"))
        .select("f.facet", F.explode("f.values").alias("value"))
        .filter("value is not null")
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def taxonomic_order(status: str, rank: str, name: str, reverse: bool = False) -> list[Column]:
    """By status, then rank, then name; reversing turns ranks alone."""
    return [F.asc(status), F.desc(rank) if reverse else F.asc(rank), F.asc(name)]


def default_order(query: bool, filtered: bool) -> str | None:
    """Relevance for a text query, taxonomic for filters only, the table's own order without either."""
    return "relevance" if query else "taxonomic" if filtered else None


def name_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(unaccent(x)), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def _is_word(word: str, prefix: bool):
    return lambda t: t.startswith(word) if prefix else t == word


def _near_word(word: str):
    edits = 0 if len(word) < 3 else 1 if len(word) < 6 else 2
    return lambda t: t.startswith(word[:2]) & (F.levenshtein(t, F.lit(word)) <= edits)


def name_score(name: Column, query: str, accepted: Column) -> Column:
    """20 for the whole name, 10 for all words with the last as a prefix, 5 for words within an edit; more if accepted.

    Words of the third kind share their first two letters and differ by one edit
    from three letters on, by two from six.
    """
    words = [w for w in query.lower().split() if w]
    tokens = name_tokens(name)
    exact = F.lower(name) == query.lower()
    standard, fuzzy = F.lit(True), F.lit(True)
    for i, w in enumerate(words):
        standard = standard & F.exists(tokens, _is_word(w, prefix=i == len(words) - 1))
        fuzzy = fuzzy & F.exists(tokens, _near_word(w))
    if not words:
        return F.lit(0.0)
    base = F.when(exact, 20.0).when(standard, 10.0).when(fuzzy, 5.0).otherwise(0.0)
    return base * F.when(accepted, 1.1).otherwise(1.0)


def suggest(rows: DataFrame, name: str, query: str, accepted: Column, rank: Column, k: int = 10) -> DataFrame:
    """The k best names with a word that starts like the query: 1.1 if accepted, plus 100 over the rank's ordinal."""
    pattern = r"(?i)(^|[^\p{L}])\Q" + query + r"\E"
    score = F.when(accepted, 1.1).otherwise(0.0) + 100.0 / (rank + 1)
    found = rows.filter(F.col(name).rlike(pattern)).withColumn("score", score)
    return found.orderBy(F.desc("score"), F.asc(name)).limit(k)


def text_score(query: str, weights: dict[str, float]) -> Column:
    """Sum over weighted columns of how often words of the query occur."""
    words = [w for w in unaccent_words(query)]
    total = F.lit(0.0)
    for column, weight in weights.items():
        tokens = name_tokens(F.coalesce(F.col(column), F.lit("")))
        total = total + weight * F.size(F.filter(tokens, lambda t: t.isin(*words))).cast("double")
    return total


def unaccent_words(query: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", query.lower()) if not unicodedata.combining(c))
    return plain.split()


def epithet_matches(name: Column, epithet: str) -> Column:
    """Some word of the name has the epithet's stem."""
    wanted = normal_epithet(F.lit(epithet.lower()))
    return F.exists(name_tokens(name), lambda t: normal_epithet(t) == wanted)
