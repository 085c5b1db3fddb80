"""Substring search by an inverted table of trigrams, and words without their prefixes.

A text stands under each of its trigrams once. A pattern looks only under its
rarest one, so its work follows the shortest list and not the table; what it finds
there is verified by the built-in contains(). A trigram that very many texts have
is looked under only by patterns that have no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import unaccent
from ..lineage import settle

SIZE = 3


def folded(x: Column) -> Column:
    """Lower case without accents, which is how texts and patterns are compared."""
    return F.lower(unaccent(x))


def trigrams(x: Column) -> Column:
    """Distinct runs of three characters; none in shorter texts."""
    places = F.when(F.length(x) >= SIZE, F.sequence(F.lit(1), F.length(x) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(x, i, F.lit(SIZE))))


def index_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """trigram, key and the folded text, of rows with a text; to be stored by trigram."""
    texts = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), folded(F.col(text)).alias("text"))
    return texts.withColumn("trigram", F.explode(trigrams(F.col("text"))))


def search(index: DataFrame, patterns: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """pattern and key of each text that holds a pattern, whatever the case and accents.

    index: from index_of(), stored; patterns: pattern. Patterns of less than three
    characters have no trigram: they are looked for in `texts` (key, text), if given,
    and else are an error. An empty pattern is in every text; null in none.
    """
    wanted = settle(patterns.filter("pattern is not null").select("pattern").distinct().withColumn("p", folded(F.col("pattern"))))
    short = wanted.filter(F.length("p") < SIZE)
    counts = index.groupBy("trigram").agg(F.count("*").alias("n"))
    parts = wanted.select("pattern", "p", F.explode(trigrams(F.col("p"))).alias("trigram"))
    # a trigram that no text has is rarest of all, and the pattern is in no text
    rarest = parts.join(counts, "trigram", "left").groupBy("pattern", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "trigram")).alias("x"))
    probes = rarest.filter("x.n > 0").select("pattern", "p", F.col("x.trigram").alias("trigram"))
    found = index.join(probes, "trigram").filter(F.contains("text", "p")).select("pattern", "key")
    if short.isEmpty():
        return found
    if texts is None:
        raise ValueError("patterns of less than three characters need the texts themselves")
    named = [r[0] for r in short.select("p").distinct().collect()]  # of two characters at most
    plain = texts.filter("text is not null").select("key", folded(F.col("text")).alias("t"))
    held = plain.select("key", F.explode(F.filter(F.array(*map(F.lit, named)), lambda p: F.contains(F.col("t"), p))).alias("p"))
    return found.unionByName(held.join(short, "p").select("pattern", "key"))


def decompounded(word: Column, prefixes: list[str], least: int = 4) -> Column:
    """The word, and what is left of it without its longest prefix of a list, if that has enough letters."""
    pattern = "^(?:" + "|".join(sorted(prefixes, key=lambda p: (-len(p), p))) + f")([a-z]{{{least},}})$"
    rest = F.regexp_extract(F.lower(word), pattern, 1)
    return F.array_compact(F.array(word, F.nullif(rest, F.lit(""))))
