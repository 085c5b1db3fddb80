"""Differences between two lists of labels: removed, added and changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import normal_name


def exact_diff(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """label and change, REMOVED or ADDED, by multiset difference: equal labels cancel one by one."""
    old, new = before.select(label), after.select(label)
    gone = old.groupBy(label).agg(F.count("*").alias("o"))
    come = new.groupBy(label).agg(F.count("*").alias("n"))
    both = gone.join(come, label, "full_outer").na.fill(0, ["o", "n"])
    change = F.when(F.col("o") > F.col("n"), "REMOVED").otherwise("ADDED")
    times = F.abs(F.col("o") - F.col("n")).cast("int")
    return both.filter("o != n").select(label, change.alias("change"), F.explode(F.array_repeat(F.lit(0), times)).alias("_x")).drop("_x")


def changed_labels(diff: DataFrame, label: str, distance: int = 1) -> DataFrame:
    """before and after of labels that changed little.

    Labels pair within a block, that of their first word, if their normalised
    forms differ by `distance` edits at most. A pair counts if it is the only one
    of both its labels; else the least label on each side takes the least free.
    """
    key = F.substring_index(F.col(label), " ", 1)
    form = normal_name(F.col(label))
    rows = diff.select(F.col(label).alias("l"), "change", key.alias("block"), form.alias("form")).distinct()
    old = rows.filter("change = 'REMOVED'").select("block", F.col("l").alias("before"), F.col("form").alias("f"))
    new = rows.filter("change = 'ADDED'").select("block", F.col("l").alias("after"), F.col("form").alias("g"))
    near = F.levenshtein("f", "g", distance) >= 0
    pairs = old.join(new, "block").filter(near).select("block", "before", "after")

    def choose(pdf):
        import pandas as pd

        used_before, used_after, out = set(), set(), []
        degree = pdf["before"].map(pdf["before"].value_counts()) + pdf["after"].map(pdf["after"].value_counts())
        for _, b, a in sorted(zip(degree, pdf["before"], pdf["after"])):
            if b not in used_before and a not in used_after:
                used_before.add(b)
                used_after.add(a)
                out.append((b, a))
        return pd.DataFrame(out, columns=["before", "after"])

    return pairs.groupBy("block").applyInPandas(choose, "before string, after string")


def row_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change of rows that came, went, or have other values in `columns`."""
    old = before.select(F.col(key).alias("_a"), F.xxhash64(*columns).alias("_x"), F.struct(*columns).alias("_v"))
    new = after.select(F.col(key).alias("_b"), F.xxhash64(*columns).alias("_y"), F.struct(*columns).alias("_w"))
    both = old.join(new, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED").when(~F.col("_v").eqNullSafe(F.col("_w")), "CHANGED")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def parse_attempts(text: str, latest: int) -> tuple[int, int]:
    """`a..b` with a below b; without a text, the two latest."""
    if not text:
        return latest - 1, latest
    a, _, b = text.partition("..")
    first, second = int(a), int(b)
    if first >= second:
        raise ValueError("attempts must rise")
    return first, second
