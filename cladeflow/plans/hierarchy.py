"""Delegating a project's higher classification to a source.

Project usages that carry an id of the source, and accepted ones that the source
has by name, take over its higher ranks. Everything is joins on ids and on the
nodes of the source's paths; what happens to a usage is decided from the state
before the run, and moves that would close a cycle are taken back together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import index_key
from ..lineage import settle
from ..operators.tree import cycle_members
from ..vocab import is_synonym
from .merge import GENUS, _keyed

COLUMNS = ["id", "parent_id", "name", "authorship", "rank", "status", "sector", "source_id"]


class Synced(NamedTuple):
    """usages after the run; changes: id, what (CREATED, PARENT, STATUS, SYNONYM, AUTHORSHIP), value; placed: ids set by name alone."""

    usages: DataFrame
    changes: DataFrame
    placed: DataFrame


def _nearest(paths: DataFrame, homes: DataFrame, itself: bool = False) -> DataFrame:
    """sid and home: that of the lowest node on each source path that has one; the node itself counts only with `itself`."""
    steps = paths.select(F.col("id").alias("sid"), F.posexplode("path").alias("at", "p"), "depth").select("sid", "at", "depth", F.col("p.id").alias("node"))
    if not itself:
        steps = steps.filter(F.col("at") < F.col("depth") - 1)
    met = steps.join(homes.select(F.col("sid").alias("node"), "home"), "node")
    return met.groupBy("sid").agg(F.max_by("home", "at").alias("home"))


def _unique(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.min(value).alias(out), F.count("*").alias("_n"))
    return found.filter("_n = 1").drop("_n")


def hierarchy_sync(project: DataFrame, source: DataFrame, sector: int, authorship: str = "MISSING") -> Synced:
    """The project with the source's classification from genus upwards, its statuses, synonyms and authorships.

    project: the columns COLUMNS, source_id being the id in the source, or null;
    source: those but source_id. What an earlier run of the sector made goes first.

    1. Source ancestors of matched usages from genus upwards are reused, if a
       matched usage or one accepted usage of their name and rank stands for them,
       or else created as `sector:id`. Matched accepted usages move below the
       nearest of them; so do accepted usages without a source id that have one
       accepted name of their key and rank in the source, or one genus of their
       first word (`placed`).
    2. Matched usages get the source's status; a new synonym moves below what
       stands for its accepted name, and stays as it is if nothing does.
    3. Synonyms of source taxa that stand in the project are created, unless a
       usage has their id.
    4. Authorships are taken over where they are missing (MISSING), always (ALWAYS)
       or never (NONE).
    Of several usages with one source id, the greatest id stands for it, but a
    synonym that becomes accepted only where no other is. A move
    that would put a usage on a cycle isn't made.
    """
    kept = settle(project.filter(~F.col("sector").eqNullSafe(F.lit(sector))).select(COLUMNS))
    src = settle(_keyed(source))
    synonym = is_synonym(F.col("status"))
    s = src.select(F.col("id").alias("sid"), F.col("status").alias("s_status"), F.col("parent_id").alias("s_parent"), F.col("authorship").alias("s_authorship"))
    matched = settle(kept.filter("source_id is not null").join(s, F.col("source_id") == F.col("sid")).select(
        F.col("id").alias("pid"), F.col("parent_id").alias("p_parent"), F.col("status").alias("p_status"), F.col("authorship").alias("p_authorship"), "sid", "s_status", "s_parent", "s_authorship"
    ))
    stands = matched.groupBy("sid").agg(F.max_by(F.struct(F.when(is_synonym(F.col("p_status")), F.col("p_parent")).otherwise(F.col("pid")).alias("home")), "pid").alias("x"))
    by_id = stands.select("sid", F.col("x.home").alias("home")).filter("home is not null")

    # names: accepted usages without an id of the source
    higher = src.filter(~synonym & (F.col("rank_ord") <= GENUS))
    loose = kept.filter("source_id is null").filter(~synonym).select("id", index_key(F.col("name")).alias("key"), F.lower("rank").alias("rank"), F.lower(F.substring_index("name", " ", 1)).alias("first"), F.instr("name", " ").alias("space"))
    full = loose.join(_unique(src.filter(~synonym).select("key", "rank", "id"), ["key", "rank"], "id", "found"), ["key", "rank"]).select("id", "found")
    above = src.select(F.col("id").alias("found"), F.filter(F.slice("path", F.lit(1), F.col("depth") - 1), lambda p: p["rank_ord"] <= GENUS).alias("up"))
    anchors = full.join(above, "found").select("id", F.get("up", F.size("up") - 1)["id"].alias("anchor")).filter("anchor is not null")
    genera = _unique(higher.filter(F.col("rank_ord") == GENUS).select(F.lower("name").alias("first"), "id"), ["first"], "id", "anchor")
    by_genus = loose.filter("space > 0").join(full.select("id"), "id", "left_anti").join(genera, "first").select("id", "anchor")
    placed = settle(anchors.unionByName(by_genus))

    # 1: what stands for the source's higher taxa
    chains = src.join(matched.select(F.col("sid").alias("id")).distinct(), "id", "left_semi").select(F.explode(F.slice("path", F.lit(1), F.col("depth") - 1)).alias("p"))
    anchored = src.join(placed.select(F.col("anchor").alias("id")).distinct(), "id", "left_semi").select(F.explode("path").alias("p"))
    needed = chains.unionByName(anchored).select(F.col("p.id").alias("id")).distinct()
    needed = settle(src.join(needed, "id", "left_semi").filter((F.col("rank_ord") <= GENUS) & ~synonym))
    names = _unique(kept.filter(~synonym).select(index_key(F.col("name")).alias("key"), F.lower("rank").alias("rank"), "id"), ["key", "rank"], "id", "named")
    homes = (
        needed.join(by_id.withColumnRenamed("sid", "id"), "id", "left").join(names, ["key", "rank"], "left")
        .select(F.col("id").alias("sid"), F.coalesce("home", "named", F.concat(F.lit(f"{sector}:"), F.col("id"))).alias("home"), F.coalesce("home", "named").isNull().alias("made"))
    )
    homes = settle(homes)
    all_homes = settle(homes.select("sid", "home").unionByName(by_id.join(homes.select("sid"), "sid", "left_anti")))
    # a synonym that becomes accepted stands for its taxon itself, not by its former accepted name
    promoted = (
        matched.filter(is_synonym(F.col("p_status")) & ~is_synonym(F.col("s_status"))).join(_nearest(src, all_homes).select("sid"), "sid", "left_semi")
        .groupBy("sid").agg(F.max("pid").alias("itself"))
    )
    firm = matched.filter(~is_synonym(F.col("p_status"))).select("sid").distinct()
    promoted = promoted.join(firm, "sid", "left_anti")
    all_homes = settle(all_homes.join(promoted, "sid", "left").select("sid", F.coalesce("itself", "home").alias("home")))
    nearest = settle(_nearest(src, all_homes))
    above_of = nearest.select("sid", F.col("home").alias("new_parent"))
    created = settle(
        src.join(homes.filter("made").select(F.col("sid").alias("id"), "home"), "id").join(above_of.withColumnRenamed("sid", "id"), "id", "left")
        .select(F.col("home").alias("id"), F.col("new_parent").alias("parent_id"), "name", "authorship", "rank", "status", F.lit(sector).alias("sector"), F.col("id").alias("source_id"))
    )

    # 1 and 2: parents and statuses of matched usages
    accepted_home = all_homes.select(F.col("sid").alias("s_parent"), F.col("home").alias("accepted_home"))
    rows = matched.join(above_of, "sid", "left").join(accepted_home, "s_parent", "left")
    p_syn, s_syn = is_synonym(F.col("p_status")), is_synonym(F.col("s_status"))
    to_synonym = s_syn & F.col("accepted_home").isNotNull() & (F.col("accepted_home") != F.col("pid"))
    status = F.when(s_syn & (p_syn | to_synonym), F.col("s_status")).when(~s_syn & p_syn & F.col("new_parent").isNotNull(), F.col("s_status")).otherwise(F.col("p_status"))
    parent = F.when(to_synonym, F.col("accepted_home")).when(~s_syn & (F.col("new_parent") != F.col("pid")), F.col("new_parent"))
    moves = rows.select(F.col("pid").alias("id"), status.alias("new_status"), parent.alias("new_parent"))
    by_name = placed.join(all_homes.select(F.col("sid").alias("anchor"), "home"), "anchor").select("id", F.lit(None).cast("string").alias("new_status"), F.col("home").alias("new_parent"))
    moves = settle(moves.unionByName(by_name.filter("new_parent != id")))
    joined = kept.join(moves, "id", "left")
    moved = joined.withColumn("_parent", F.coalesce("new_parent", "parent_id")).withColumn("_status", F.coalesce("new_status", "status"))
    tried = settle(moved)
    tree = tried.select("id", F.col("_parent").alias("parent_id")).unionByName(created.select("id", "parent_id"))
    looped = settle(cycle_members(tree)).withColumn("_loop", F.lit(True))
    fixed = settle(tried.join(looped, "id", "left").select(
        "id", F.when(F.col("_loop"), F.col("parent_id")).otherwise(F.col("_parent")).alias("_parent"), F.when(F.col("_loop"), F.col("status")).otherwise(F.col("_status")).alias("_status"),
        *[c for c in COLUMNS if c != "id"],
    ))

    # 3: synonyms of taxa that stand in the project and are accepted there
    taxa = fixed.filter(~is_synonym(F.col("_status"))).select(F.col("id").alias("home")).unionByName(created.select(F.col("id").alias("home")))
    has_id = fixed.select(F.col("source_id").alias("id")).filter("id is not null").unionByName(created.select(F.col("source_id").alias("id"))).distinct()
    standing = all_homes.join(taxa, "home", "left_semi")
    synonyms = settle(
        source.filter(synonym).join(standing.select(F.col("sid").alias("parent_id"), "home"), "parent_id").join(has_id, "id", "left_anti")
        .select(F.concat(F.lit(f"{sector}:"), F.col("id")).alias("id"), F.col("home").alias("parent_id"), "name", "authorship", "rank", "status", F.lit(sector).alias("sector"), F.col("id").alias("source_id"))
    )

    # 4: authorships
    theirs = matched.groupBy(F.col("pid").alias("id")).agg(F.min("s_authorship").alias("s_authorship"))
    take = {"NONE": F.lit(False), "MISSING": F.col("authorship").isNull(), "ALWAYS": F.lit(True)}[authorship]
    final = fixed.join(theirs, "id", "left").withColumn("_authors", F.when(take, F.coalesce("s_authorship", "authorship")).otherwise(F.col("authorship")))
    final = settle(final)
    usages = final.select("id", F.col("_parent").alias("parent_id"), "name", F.col("_authors").alias("authorship"), "rank", F.col("_status").alias("status"), "sector", "source_id")
    changes = created.select("id", F.lit("CREATED").alias("what"), F.col("parent_id").alias("value")).unionByName(synonyms.select("id", F.lit("SYNONYM").alias("what"), F.col("parent_id").alias("value")))
    for what, old, new in (("PARENT", "parent_id", "_parent"), ("STATUS", "status", "_status"), ("AUTHORSHIP", "authorship", "_authors")):
        changes = changes.unionByName(final.filter(~F.col(old).eqNullSafe(F.col(new))).select("id", F.lit(what).alias("what"), F.col(new).alias("value")))
    out = settle(usages.unionByName(created.select(COLUMNS)).unionByName(synonyms.select(COLUMNS)))
    return Synced(out, changes, by_name.join(looped, "id", "left_anti").select("id", F.col("new_parent").alias("parent_id")))


