"""Lookups: rows without partners, as-of rows, star assembly, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settle

#: Rows of a block that meet the block in one go, and pairs that a task forms.
TILE, PAIRS_A_TASK = 512, 4_000_000


def orphans(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is filled and found nowhere among the targets."""
    wanted = targets.select(F.col(target_key).alias(key))
    return rows.filter(F.col(key).isNotNull()).join(wanted, key, "left_anti")


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Parent ids that no node has."""
    used = nodes.select(F.col("parent_id").alias("id")).filter("id is not null").distinct()
    return used.join(nodes.select("id"), "id", "left_anti")


def with_parent(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes with columns of the parent, each with parent_ before its name."""
    above = nodes.select(F.col("id").alias("parent_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return nodes.join(above, "parent_id", "left")


def chained_synonyms(nodes: DataFrame, synonyms: Column, accepted: bool = False) -> DataFrame:
    """Synonyms below synonyms, or with `accepted` the accepted nodes below synonyms."""
    flagged = nodes.withColumn("_syn", synonyms)
    found = with_parent(flagged, "_syn").filter(F.col("parent__syn") & (~F.col("_syn") if accepted else F.col("_syn")))
    return found.select(nodes.columns)


def foreign_children(nodes: DataFrame, sector: str, key) -> DataFrame:
    """Children of a sector's nodes that belong to another sector or none."""
    found = with_parent(nodes, sector).filter(
        (F.col(f"parent_{sector}") == key) & ~F.col(sector).eqNullSafe(F.lit(key))
    )
    return found.select(nodes.columns)


def sector_roots(nodes: DataFrame, sector: str, key) -> DataFrame:
    """A sector's nodes whose parent lies outside it."""
    found = with_parent(nodes, sector).filter((F.col(sector) == key) & ~F.col(f"parent_{sector}").eqNullSafe(F.lit(key)))
    return found.select(nodes.columns)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def neighbours(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows with `previous` and `next`, the value of the rows before and after within the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """`left` with the values of the last right row at or before its time, within the keys.

    Both sides go through one sort by key and time, so no pair of rows is formed.
    """
    mine = left.select(*left.columns, F.col(at).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values))
    theirs = right.select(
        *(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns),
        F.col(right_at).alias("_t"), F.lit(0).alias("_side"), *(F.col(v).alias(f"_{v}") for v in values),
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_{v}").alias(v) for v in values))), ignorenulls=True)
    rows = mine.unionByName(theirs).withColumn("_held", held.over(w)).filter("_side = 1")
    return rows.select(*left.columns, *(F.col(f"_held.{v}").alias(v) for v in values))


def star(core: DataFrame, key: str, extensions: dict[str, DataFrame]) -> DataFrame:
    """`core` with an array of structs for each extension; rows never multiply.

    Each extension is gathered by key before it meets the core, in sorted order.
    """
    out = core
    for name, rows in extensions.items():
        fields = [c for c in rows.columns if c != key]
        gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(gathered, key, "left").withColumn(name, F.coalesce(name, F.array().cast(gathered.schema[name].dataType)))
    return out


def overlay(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """`rows` with the filled values of `patch` over theirs."""
    fields = [c for c in patch.columns if c != key and c in rows.columns]
    renamed = patch.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    joined = rows.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def by_id_or_name(rows: DataFrame, targets: DataFrame, id_column: str, name_column: str, out: str) -> DataFrame:
    """`rows` with `out`, the target's id, found by id and else by a name that only one target has."""
    ids = targets.select(F.col("id").alias("_by_id")).distinct()
    names = (
        targets.groupBy("name").agg(F.min("id").alias("_by_name"), F.count("*").alias("_n"))
        .filter("_n = 1").select(F.col("name").alias("_name"), "_by_name")
    )
    found = rows.join(ids, F.col(id_column) == F.col("_by_id"), "left").join(names, F.col(name_column) == F.col("_name"), "left")
    return found.withColumn(out, F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name", "_name")


def pairs_within(rows: DataFrame, key: str, block: list[str]) -> DataFrame:
    """a and b, a before b: all pairs of keys within a block, which has no null.

    The result is quadratic in a block's size. Blocks are cut into tiles of some
    hundred rows that each meet the block, and tiles lie in as many partitions as
    the pairs need; so a task's work is bounded, however large a block is.
    """
    sizes = settle(rows.groupBy(*block).agg(F.count("*").alias("_n")).filter("_n > 1"))
    total = sizes.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)).first()[0] or 0
    parts = 1 + int(total // PAIRS_A_TASK)
    tiles = F.ceil(F.col("_n") / TILE)
    sized = rows.select(*block, key).join(sizes, block)
    left = sized.select(*block, F.col(key).alias("a"), F.pmod(F.xxhash64(key), tiles).alias("_tile"))
    right = sized.select(*block, F.col(key).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("_tile"))
    spread = lambda side: side.repartition(parts, *block, "_tile")
    return spread(left).join(spread(right), [*block, "_tile"]).filter("a < b").select("a", "b")
