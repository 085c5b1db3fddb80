"""Typed values from text: each parser gives a value, or null with an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import digits_or_ascii_letters

# Words for yes and no in data files.
YES = ("T", "TRUE", "Y", "YES", "1", "X", "SI", "JA", "OUI")
NO = ("F", "FALSE", "N", "NO", "0", "NEIN", "NON", "-1")


def boolean(x: Column) -> Column:
    key = F.upper(F.trim(x))
    return F.when(key.isin(*YES), True).when(key.isin(*NO), False)


def integer(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"(?<=\d),(?=\d{3}\b)", "").try_cast("long")


def decimal(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def coordinate(lat: Column, lon: Column) -> Column:
    """Latitude and longitude in degrees; null unless both lie on the globe."""
    a, b = F.trim(lat).try_cast("double"), F.trim(lon).try_cast("double")
    return F.when(a.between(-90, 90) & b.between(-180, 180), F.struct(a.alias("lat"), b.alias("lon")))


def uri(x: Column) -> Column:
    """An http, https or ftp address; a bare host name gets http."""
    given = F.trim(x)
    full = F.when(given.rlike("(?i)^(https?|ftp)://"), given).when(given.rlike(r"^[\w-]+(\.[\w-]+)+(/\S*)?$"), F.concat(F.lit("http://"), given))
    return F.when(full.rlike(r"^(?i)(https?|ftp)://[^\s/]+\.[^\s]+$"), full)


def area(x: Column) -> Column:
    """scheme and code of `scheme:code`; text as it is counts as scheme text."""
    scheme = F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)\s*:", 1))
    return F.struct(
        F.when(scheme == "", "text").otherwise(scheme).alias("scheme"),
        F.trim(F.regexp_replace(x, r"^\s*[A-Za-z]+\s*:", "")).alias("code"),
    )


def parse_terms(rows: DataFrame, column: str, vocabulary: DataFrame, out: str, issue: str) -> DataFrame:
    """`rows` with `out`, the constant that `column` stands for, and `issue`.

    vocabulary: columns `text` and `constant`; keys are compared by their digits
    and letters alone. `issue` is true where a text is filled and unknown. The
    vocabulary's keys are made distinct first, so no row is multiplied.
    """
    known = (
        vocabulary.select(digits_or_ascii_letters(F.col("text")).alias("_term_key"), F.col("constant").alias(out))
        .filter("_term_key is not null")
        .groupBy("_term_key")
        .agg(F.min(out).alias(out))
    )
    keyed = rows.withColumn("_term_key", digits_or_ascii_letters(F.col(column)))
    return (
        keyed.join(known, "_term_key", "left")
        .withColumn(issue, F.col("_term_key").isNotNull() & F.col(out).isNull())
        .drop("_term_key")
    )
