"""Merging sources into a project and making releases of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.normalize import apply_decisions
from ..operators.tree import subtree


def attach(project: DataFrame, source_paths: DataFrame, root, target, sector, decisions: DataFrame | None = None) -> DataFrame:
    """The project with a source's subtree below `target`; earlier rows of the sector go first.

    A row whose parent a decision dropped moves to its nearest kept ancestor.
    """
    kept = project.filter(~F.col("sector").eqNullSafe(F.lit(sector)))
    rows = subtree(source_paths, root)
    if decisions is not None:
        rows = apply_decisions(rows, decisions).drop("reviewed")
    ids = rows.select(F.col("id").alias("above"))
    steps = rows.select("id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "step"))
    nearest = (
        steps.select("id", "at", F.col("step.id").alias("above"))
        .join(ids, "above")
        .groupBy("id")
        .agg(F.max_by("above", "at").alias("_parent"))
    )
    placed = rows.join(nearest, "id", "left").withColumn("parent_id", F.coalesce("_parent", F.lit(target)))
    return kept.unionByName(placed.withColumn("sector", F.lit(sector)).select(kept.columns))


def archive(known: DataFrame, release: DataFrame, key: int) -> DataFrame:
    """The archive with the release's rows it lacks, and the release's key on all that the release has.

    known: id, name, releases (array of keys).
    """
    here = release.select(F.col("id").alias("_id")).distinct()
    marked = known.join(here, F.col("id") == F.col("_id"), "left").withColumn(
        "releases", F.when(F.col("_id").isNotNull(), F.array_union("releases", F.array(F.lit(key)))).otherwise(F.col("releases"))
    )
    added = release.join(known.select("id"), "id", "left_anti").withColumn("releases", F.array(F.lit(key)))
    return marked.select(known.columns).unionByName(added.select(known.columns))


def due(datasets: DataFrame, now: str) -> DataFrame:
    """Datasets to import: those never imported, then those past their frequency, the longest due first."""
    at = F.to_timestamp(F.lit(now))
    next_at = F.col("last_attempt") + F.make_dt_interval(F.col("frequency_days"))
    return datasets.filter(F.col("last_attempt").isNull() | (next_at < at)).orderBy(
        F.col("last_attempt").isNotNull(), next_at, "key"
    )


def rebuild_needed(counts: DataFrame, threshold: float) -> DataFrame:
    """Datasets whose share of done rows is too far from 1: any gap for a threshold of 0 or less."""
    ratio = F.col("done") / F.col("total")
    far = (F.col("done") == 0) | (ratio < threshold) | (ratio > 2 - threshold)
    return counts.filter((F.col("done") != F.col("total")) if threshold <= 0 else far)


def copy_dataset(rows: DataFrame, key, new_key, ids: DataFrame | None = None) -> DataFrame:
    """A dataset's rows under a new key, with ids mapped where `ids` (id, new_id) has them."""
    out = rows.filter(F.col("dataset_key") == key).withColumn("dataset_key", F.lit(new_key))
    if ids is None:
        return out
    return out.join(ids, "id", "left").withColumn("id", F.coalesce("new_id", "id")).select(rows.columns)
