"""Cleaning an imported tree: chains, statuses, missing parents, implicit taxa, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import settle
from ..vocab import is_synonym

#: Rounds of pointer jumping; each doubles the chain that is resolved.
MOST_ROUNDS = 32


def resolve_chains(nodes: DataFrame) -> DataFrame:
    """`nodes` with synonyms linked to the accepted node at the end of their chain.

    Columns id, parent_id, status. Pointers of synonyms jump to their parent's
    pointer while that is a synonym. Synonyms whose chain never ends, or ends in
    nothing, lose their parent.
    """
    synonyms = nodes.filter(is_synonym(F.col("status")))
    pointers = settle(synonyms.select("id", F.col("parent_id").alias("to")))
    for _ in range(MOST_ROUNDS):
        onward = pointers.select(F.col("id").alias("to"), F.col("to").alias("then"), F.lit(True).alias("more"))
        moved = settle(
            pointers.join(onward, "to", "left").select(
                "id", F.when(F.col("more"), F.col("then")).otherwise(F.col("to")).alias("to"), F.coalesce("more", F.lit(False)).alias("moved")
            )
        )
        pointers = moved.select("id", "to")
        if moved.filter("moved").isEmpty():
            break
    ends = pointers.join(synonyms.select(F.col("id").alias("to"), F.lit(True).alias("loop")), "to", "left")
    ends = ends.select("id", F.when(F.col("loop").isNull(), F.col("to")).alias("_end"), F.lit(True).alias("_syn"))
    joined = nodes.join(ends, "id", "left")
    parent = F.when(F.col("_syn"), F.col("_end")).otherwise(F.col("parent_id"))
    return joined.withColumn("parent_id", parent).select(nodes.columns)


def lift_accepted(nodes: DataFrame) -> DataFrame:
    """Accepted nodes below a synonym move to that synonym's accepted node."""
    above = nodes.filter(is_synonym(F.col("status"))).select(
        F.col("id").alias("parent_id"), F.col("parent_id").alias("_up"), F.lit(True).alias("_below")
    )
    joined = nodes.join(above, "parent_id", "left")
    parent = F.when(F.col("_below") & ~is_synonym(F.col("status")), F.col("_up")).otherwise(F.col("parent_id"))
    return joined.withColumn("parent_id", parent).select(nodes.columns)


def drop_orphan_synonyms(nodes: DataFrame) -> DataFrame:
    """Without synonyms whose parent is null or missing."""
    ids = nodes.select(F.col("id").alias("parent_id"))
    bad = nodes.filter(is_synonym(F.col("status"))).join(ids, "parent_id", "left_anti").select("id")
    return nodes.join(bad, "id", "left_anti")


def rectify_status(nodes: DataFrame, name: str = "name", note: Column | None = None) -> DataFrame:
    """Synonyms of a name used more than once become ambiguous; those whose note says so, misapplied."""
    from ..functions.names import misapplied

    many = nodes.filter(is_synonym(F.col("status"))).groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1")
    joined = nodes.join(many, name, "left")
    plain = F.col("status") == "SYNONYM"
    status = F.when(plain & F.col("_n").isNotNull(), "AMBIGUOUS_SYNONYM").otherwise(F.col("status"))
    if note is not None:
        status = F.when(is_synonym(F.col("status")) & misapplied(note), "MISAPPLIED").otherwise(status)
    return joined.withColumn("status", status).select(nodes.columns)


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """`rows` with a project's decisions: BLOCK and IGNORE drop a row, UPDATE lays its filled values over, REVIEWED marks.

    decisions: subject_id, mode and, for updates, columns of `rows`.
    """
    fields = [c for c in decisions.columns if c in rows.columns]
    renamed = decisions.select("subject_id", "mode", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = rows.join(renamed, rows["id"] == renamed["subject_id"], "left")
    kept = joined.filter(F.col("mode").isNull() | ~F.col("mode").isin("BLOCK", "IGNORE"))
    values = [
        F.when(F.col("mode") == "UPDATE", F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in rows.columns
    ]
    return kept.select(*values, (F.coalesce("mode", F.lit("")) == "REVIEWED").alias("reviewed"))


def implicit_genera(names: DataFrame) -> DataFrame:
    """Genera that binomials name and that no row stands for."""
    first = F.substring_index(F.col("name"), " ", 1)
    wanted = names.filter(F.instr("name", " ") > 0).select(first.alias("name")).distinct()
    return wanted.join(names.select("name"), "name", "left_anti")


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order; null counts as no."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))


def name_issues() -> Column:
    """Consistency of a row with name, authorship, rank and year."""
    from ..functions import scalars

    name = F.col("name")
    return issues(
        {
            "unmatched_brackets": scalars.unmatched_brackets(name),
            "no_letter": scalars.no_letter(name),
            "missing_authorship": F.col("authorship").isNull(),
            "unlikely_year": ~F.col("year").between(1753, 2100),
            "binomial_rank": (F.col("rank") == "species") & ~scalars.multi_word(name),
            "contains_question": name.contains("?"),
        }
    )


def ensure_columns(rows: DataFrame, required: list[str], one_of: list[list[str]] = (), unwanted: list[str] = ()) -> DataFrame:
    """`rows`, if it has all required columns, one of each group, and none that is not wanted."""
    have = set(rows.columns)
    if missing := [c for c in required if c not in have]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for group in one_of:
        if not have & set(group):
            raise ValueError(f"one of these columns is needed: {', '.join(group)}")
    if found := have & set(unwanted):
        raise ValueError(f"columns not allowed: {', '.join(sorted(found))}")
    return rows
