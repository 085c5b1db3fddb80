"""Grouped counts, count maps, breakdowns with a remainder, row ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import number


def group_counts(rows: DataFrame, columns: list[str], array: bool = False) -> DataFrame:
    """metric, key and n for each column, in one scan; nulls are left out.

    Rows are turned into (column, value) pairs and counted by a map-side partial
    aggregate, so one pass serves any number of breakdowns.
    """
    value = lambda c: F.col(c).cast("array<string>") if array else F.array(F.col(c).cast("string"))
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), value(c).alias("keys")) for c in columns))
    return (
        rows.select(F.explode(pairs).alias("p"))
        .select("p.metric", F.explode("p.keys").alias("key"))
        .filter("key is not null")
        .groupBy("metric", "key")
        .agg(F.count("*").alias("n"))
    )


def count_maps(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a map of counts for each column."""
    counts = group_counts(rows, columns)
    as_map = lambda c: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("metric") == c, F.struct("key", "n"))))
    )
    return counts.agg(*(as_map(c).alias(c) for c in columns))


def entity_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of counts, each under its condition, in one scan."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def sum_maps(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count maps added up by key: keys, entry, n."""
    return (
        rows.select(*keys, F.explode(column).alias("entry", "x")).groupBy(*keys, "entry").agg(F.sum("x").alias("n"))
    )


def breakdown(counts: DataFrame, parents: DataFrame) -> DataFrame:
    """group, parent and n: counts of groups rolled up, with an unknown child for what children don't cover.

    counts: group, n. parents: group, parent, level with 1 for the top; a bounded
    vocabulary, whose levels are walked from the bottom.
    """
    rows = parents.join(counts, "group", "left").withColumn("own", F.coalesce("n", F.lit(0))).drop("n")
    levels = [r[0] for r in parents.select("level").distinct().collect()]
    total = rows.withColumn("n", F.col("own"))
    for level in sorted(levels, reverse=True)[:-1]:
        below = total.filter(F.col("level") == level).groupBy("parent").agg(F.sum("n").alias("below"))
        below = below.select(F.col("parent").alias("group"), "below")
        total = total.join(below, "group", "left").withColumn("n", F.col("n") + F.coalesce("below", F.lit(0))).drop("below")
    inner = total.filter("own > 0").join(parents.select(F.col("parent").alias("group")).distinct(), "group", "left_semi")
    unknown = inner.select(F.concat(F.col("group"), F.lit(" unknown")).alias("group"), F.col("group").alias("parent"), F.col("own").alias("n"))
    return total.select("group", "parent", "n").unionByName(unknown)


def duplicates(
    rows: DataFrame, key: Column, id_column: str, min_size: int = 2, all_different: list[str] = (), any_of: Column | None = None
) -> DataFrame:
    """key, n and ids of groups of at least `min_size` rows.

    Columns in `all_different` must have as many values as rows; `any_of` must
    hold for some row. Ids are sorted; a group's list is as long as the group.
    """
    aggregates = [F.count("*").alias("n"), F.array_sort(F.collect_list(id_column)).alias("ids")]
    aggregates += [F.count_distinct(F.col(c)).alias(f"_{c}") for c in all_different]
    if any_of is not None:
        aggregates.append(F.bool_or(any_of).alias("_any"))
    found = rows.withColumn("key", key).filter("key is not null").groupBy("key").agg(*aggregates).filter(F.col("n") >= min_size)
    for c in all_different:
        found = found.filter(F.col(f"_{c}") == F.col("n"))
    if any_of is not None:
        found = found.filter("_any")
    return found.select("key", "n", "ids")


def flag_repeats(rows: DataFrame, keys: list[str], out: str = "repeated") -> DataFrame:
    """Whether a row's keys occur more than once; counted apart, so that a frequent key isn't one task's."""
    named = [F.col(k).alias(f"_{k}") for k in keys]
    counts = rows.groupBy(*named).agg(F.count("*").alias("_n")).filter("_n > 1")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(counts, on, "left")
    return joined.select(*rows.columns, F.col("_n").isNotNull().alias(out))


def best_by_priority(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`rows` with `best`: whether the row is first of its keys in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("best", F.row_number().over(w) == 1)


def worse_than_best(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """`rows` with `provisional`: whether another row of the keys has a better priority."""
    least = rows.groupBy(*keys).agg(F.min(priority).alias("_best"))
    return rows.join(least, keys).withColumn("provisional", F.col(priority) > F.col("_best")).drop("_best")


def shift_priorities(priority: Column, at: int) -> Column:
    """Room for a new priority: those from `at` on move by one."""
    return F.when(priority >= at, priority + 1).otherwise(priority)


def capped(rows: DataFrame, most: int) -> tuple[DataFrame, Column]:
    """At most `most` rows, and whether there were more: the feature of reports that are cut short."""
    return rows.limit(most), F.lit(rows.limit(most + 1).count() > most)


def dense_ids(rows: DataFrame, key: str, start: int = 1, out: str = "new_id") -> DataFrame:
    """Distinct keys with consecutive ids in key order; no task sorts them all."""
    return number(rows.select(key).distinct(), key, start, out)
