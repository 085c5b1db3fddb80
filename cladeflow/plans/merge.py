"""Merging source trees into a project's tree, level by level.

A source is walked from its roots down, one round of joins a level, since what a
row matches or makes decides where its children go. All candidates among the
project's usages are found by one join before the walk and stored by level; in a
round, only the rows of a level meet their own candidates and the usages that
earlier levels made. So a round's work follows the level, not the project.

Usages: id, parent_id, name, authorship, rank, status, sector. Nodes that no walk
from a root reaches (on cycles, or below missing parents) aren't merged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import index_key, parse_authorship
from ..lineage import number, settle, spread
from ..operators import authorship, candidates
from ..operators.normalize import drop_orphan_synonyms, issues, lift_accepted, resolve_chains
from ..operators.tree import cut_cycles, with_paths
from ..vocab import RANKS, VAGUE_RANKS, is_synonym, rank_ordinal

USAGE = ["id", "parent_id", "name", "authorship", "rank", "status", "sector"]
PATH = "array<struct<id: string, name: string, rank_ord: int>>"
FAMILY, GENUS = RANKS.index("family"), RANKS.index("genus")
GENUS_GROUP = ("genus", "subgenus", "infragenus")


class Merged(NamedTuple):
    """usages: the project after the merge; outcomes: source_id, outcome, usage_id; updates: id, info, value, source_id."""

    usages: DataFrame
    outcomes: DataFrame
    updates: DataFrame


def _keyed(usages: DataFrame) -> DataFrame:
    """Usages with their path, key and place in the ranks."""
    rows = usages.withColumn("rank", F.lower("rank")).withColumn("rank_ord", F.coalesce(rank_ordinal(F.col("rank")), F.lit(len(RANKS))))
    paths = with_paths(rows, ["name", "rank_ord", "status"])
    return paths.withColumn("key", index_key(F.col("name")))


def _plain(path: Column) -> Column:
    return F.transform(path, lambda p: F.struct(p["id"].cast("string").alias("id"), p["name"].alias("name"), p["rank_ord"].alias("rank_ord")))


def _above(path: Column) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def doubtful(path: Column) -> Column:
    """Whether an accepted node on a path, of a rank that compares, isn't below all such nodes above it."""
    vague = [RANKS.index(r) for r in VAGUE_RANKS] + [len(RANKS)]
    ranks = F.transform(F.filter(path, lambda p: ~is_synonym(p["status"]) & ~p["rank_ord"].isin(vague)), lambda p: p["rank_ord"])
    return ranks != F.array_sort(F.array_distinct(ranks))


def _family(path: Column) -> Column:
    return F.lower(F.get(F.filter(path, lambda p: p["rank_ord"] == FAMILY), F.lit(0))["name"])


def _authors_equal(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """key, sa, ca and `equal` of pairs of authorships as written that share a key."""
    parsed = pairs.withColumn("_sa", parse_authorship(F.col("sa"))).withColumn("_ca", parse_authorship(F.col("ca")))
    return authorship.compare(settle(parsed), "_sa", "_ca", known).drop("_sa", "_ca")


def _candidate_columns(rows: DataFrame) -> list[Column]:
    return [
        F.col("id").alias("candidate"), F.col("name").alias("c_name"), F.col("authorship").alias("ca"), F.col("rank").alias("c_rank"),
        F.col("rank_ord").alias("c_ord"), F.col("status").alias("c_status"), F.col("parent_id").alias("c_parent"),
        _plain(F.col("path")).alias("c_path"), F.col("key"), F.col("sector").alias("c_sector"),
    ]


def _chosen(pairs: DataFrame) -> DataFrame:
    """id, match_type and the columns of the chosen candidate; pairs: rows of a level with all their candidates."""
    qualified = F.col("authorship").isNotNull() & ~F.col("rank").isin("unranked")
    pairs = pairs.withColumn("query", F.col("id")).withColumn("qualified", qualified).withColumn("authored", F.col("ca").isNotNull())
    fit = candidates.strictest_rank(pairs, "rank", "c_rank")
    same_family = _family(F.col("path")) == _family(F.col("c_path"))
    fit = candidates.drop_other_authors(fit, "equal", "rank", "qualified", same_family)
    fit = fit.filter(~(F.col("rank").isin("unranked") & F.col("c_rank").isin(*GENUS_GROUP)))
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    told = fit.select(
        "query", "candidate", "qualified", ((lower("name") == lower("c_name")) & (lower("authorship") == lower("ca"))).alias("label"), "equal", "authored",
        F.col("c_status").alias("status"), F.when(is_synonym(F.col("c_status")), F.col("c_parent")).alias("accepted"),
        candidates.lowest_common(_plain(_above(F.col("path"))), _above(F.col("c_path"))).alias("common"),
        F.get(F.col("c_path"), F.size("c_path") - 2)["rank_ord"].alias("lowest"),
    )
    best = candidates.choose(told).filter("match is not null").select(F.col("query").alias("id"), F.col("match").alias("candidate"), "match_type")
    return fit.select("id", "candidate", *(c for c in fit.columns if c.startswith("c_")), "ca").join(best, ["id", "candidate"])


def merge_sector(
    project: DataFrame,
    source: DataFrame,
    sector: int,
    target: str | None = None,
    blocked: DataFrame | None = None,
    protected: list[str] = (),
    known: DataFrame | None = None,
) -> Merged:
    """The project with what a source adds to it.

    Each source row, from the roots down, is matched to a usage of the same key
    (see candidates.choose); it is CREATED where there is none, or else the usage is
    MATCHED and gets what it lacks: an authorship, or a closer parent. Children go
    below the lowest match above them, or below `target`. Not merged, though still
    matched so that their children find their place: BLOCKED ids; AMBIGUOUS
    matches; IGNORED rows: unranked ones, synonyms whose parent has no match,
    genera without authors and place, and rows that would stand below a lower rank.
    DOUBTFUL rows, whose ranks are out of order, and all below them are left alone,
    as is anything at or below a PROTECTED usage. REPEATED rows share key, rank and
    authorship as written with another of their level, which has the lesser id; so
    do synonyms of one parent. A synonym that this sector made is no match for one
    with another parent.

    A parent is closer if it lies between a usage and its parent, by rank and by
    the tree, and isn't the usage itself or below it. Of several rows that match
    one usage, the least id gives what it lacks.
    """
    project = spread(project.select(*USAGE), "id")
    src = _keyed(spread(source.withColumn("sector", F.lit(sector)), "id")).withColumn("doubtful", doubtful(F.col("path")))
    src = src.withColumn("blocked", F.lit(False)) if blocked is None else src.join(
        blocked.select("id").distinct().withColumn("blocked", F.lit(True)), "id", "left"
    ).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    src = settle(src, by="depth")
    prj = settle(_keyed(project))
    theirs = prj.filter("status != 'BARE_NAME'").select(*_candidate_columns(prj))
    own_keys = src.select("key", F.col("authorship").alias("sa")).distinct()
    made_keys = own_keys.select("key", F.col("sa").alias("ca"))
    equal = settle(_authors_equal(own_keys.join(theirs.select("key", "ca").unionByName(made_keys).distinct(), "key"), known))
    with_equal = lambda pairs: pairs.join(
        equal.select("key", F.col("sa").alias("_s"), F.col("ca").alias("_c"), "equal").alias("e"),
        (pairs["key"] == F.col("e.key")) & pairs["authorship"].eqNullSafe(F.col("_s")) & pairs["ca"].eqNullSafe(F.col("_c")),
    ).drop(F.col("e.key"), "_s", "_c")
    shown = ["id", "name", "authorship", "rank", "path", "depth", "key"]
    base = settle(with_equal(src.select(*shown).join(theirs, "key")), by="depth")
    levels = sorted(r[0] for r in src.select("depth").distinct().collect())  # as many as the source is deep

    none = F.lit(None).cast("string")
    start = prj.filter(F.col("id") == F.lit(target)).select("id", _plain(F.col("path")).alias("path")).limit(1).collect() if target else []
    root = F.lit(target) if start else none
    root_path = F.array(*(F.struct(F.lit(p["id"]).alias("id"), F.lit(p["name"]).alias("name"), F.lit(p["rank_ord"]).alias("rank_ord")) for p in start[0]["path"])).cast(PATH) if start else F.array().cast(PATH)
    state, made, done = None, [], []
    for depth in levels:
        rows = src.filter(F.col("depth") == depth)
        if state is None:
            rows = rows.withColumn("anchor", root).withColumn("anchor_path", root_path).withColumn("direct", none)
        else:
            rows = rows.join(state.select(F.col("id").alias("parent_id"), "anchor", "anchor_path", F.col("own").alias("direct")), "parent_id")
        pairs = base.filter(F.col("depth") == depth)
        if made:
            new = made[0]
            for frame in made[1:]:
                new = new.unionByName(frame)
            pairs = pairs.unionByName(with_equal(rows.select(*shown).join(new.select(*_candidate_columns(new)), "key")).select(pairs.columns))
        best = settle(_chosen(pairs))
        rows = settle(_decided(rows.join(best, "id", "left"), sector, protected))
        created = _created(rows.filter("outcome = 'CREATED'"), sector)
        made.append(settle(created))
        rows = _repeats(rows, made[-1])
        state = settle(_places(rows))
        done.append(rows)
    if not done:
        nothing = project.sparkSession.createDataFrame([], "source_id string, outcome string, usage_id string")
        return Merged(project.select(*USAGE), nothing, project.sparkSession.createDataFrame([], "id string, info string, value string, source_id string"))
    everything = done[0]
    for frame in done[1:]:
        everything = everything.unionByName(frame)
    everything = settle(everything)
    outcomes = everything.select(F.col("id").alias("source_id"), "outcome", "usage_id")
    updates = settle(_updates(everything))
    return Merged(settle(_applied(project, updates, made)), outcomes, updates)


def _ids(path: Column) -> Column:
    return F.transform(path, lambda p: p["id"])


def _decided(rows: DataFrame, sector: int, protected: list[str]) -> DataFrame:
    """Rows of a level with their outcome, the usage they match or would make, and its parent."""
    synonym = is_synonym(F.col("status"))
    vague = F.col("rank").isNull() | F.col("rank").isin(*VAGUE_RANKS)
    higher = F.filter("anchor_path", lambda p: vague | (p["rank_ord"] < F.col("rank_ord")))
    parent = F.when(synonym, F.col("direct")).otherwise(F.get(higher, F.size(higher) - 1)["id"])
    ours = (F.col("c_sector") == sector) & (synonym | is_synonym(F.col("c_status")))
    elsewhere = parent.isNull() | ((parent != F.col("c_parent")) & (parent != F.col("candidate")))
    part = F.coalesce(ours & elsewhere, F.lit(False))
    match = F.when(~part & (F.col("match_type") != candidates.AMBIGUOUS), F.col("candidate"))
    place_path = F.when(match.isNotNull(), F.col("c_path")).otherwise(F.col("anchor_path"))
    shielded = F.lit(False) if not protected else F.arrays_overlap(_ids(place_path), F.array(*(F.lit(p) for p in protected)))
    placeless = F.when(synonym, F.col("direct").isNull()).otherwise(F.col("anchor").isNotNull() & parent.isNull())
    bare_genus = (F.col("rank") == "genus") & F.col("authorship").isNull() & F.col("anchor").isNull() & ~synonym
    outcome = (
        F.when(F.col("doubtful"), "DOUBTFUL")
        .when(F.col("blocked"), "BLOCKED")
        .when(F.col("rank").isNull() | (F.col("rank") == "unranked"), "IGNORED")
        .when(shielded, "PROTECTED")
        .when(match.isNotNull(), "MATCHED")
        .when(~part & F.coalesce(F.col("match_type") == candidates.AMBIGUOUS, F.lit(False)), "AMBIGUOUS")
        .when(placeless | bare_genus, "IGNORED")
        .otherwise("CREATED")
    )
    return rows.withColumn("match", match).withColumn("new_parent", parent).withColumn("outcome", outcome)


def _group(rows: DataFrame) -> list[Column]:
    synonym = is_synonym(F.col("status"))
    return [
        F.col("key"), F.col("rank"), F.lower(F.coalesce("authorship", F.lit(""))).alias("g_authors"), synonym.alias("g_synonym"),
        F.when(synonym, F.col("new_parent")).otherwise("").alias("g_parent"),
    ]


def _created(rows: DataFrame, sector: int) -> DataFrame:
    """The usages that rows of a level make: one for each key, rank and authorship."""
    first = rows.groupBy(*_group(rows)).agg(
        F.min_by(F.struct("id", "name", "authorship", "status", "new_parent", "rank_ord", "anchor_path"), "id").alias("u")
    )
    new_id = F.concat(F.lit(f"{sector}:"), F.col("u.id").cast("string"))
    # ranks of the anchor's path that aren't above the new usage are left out of its own
    above = F.filter("u.anchor_path", lambda p: F.array_position(_ids(F.col("u.anchor_path")), p["id"]) <= F.array_position(_ids(F.col("u.anchor_path")), F.col("u.new_parent")))
    return first.select(
        new_id.alias("id"), F.col("u.new_parent").alias("parent_id"), F.col("u.name").alias("name"), F.col("u.authorship").alias("authorship"), "rank",
        F.col("u.status").alias("status"), F.lit(sector).alias("sector"), F.col("u.rank_ord").alias("rank_ord"), "key", "g_authors", "g_synonym", "g_parent",
        F.concat(above, F.array(F.struct(new_id.alias("id"), F.col("u.name").alias("name"), F.col("u.rank_ord").alias("rank_ord")))).cast(PATH).alias("path"),
        F.col("u.id").alias("source_id"),
    )


def _repeats(rows: DataFrame, created: DataFrame) -> DataFrame:
    """Rows with the usage that they made, or that another of their level made for them."""
    groups = _group(rows)
    names = ["key", "rank", "g_authors", "g_synonym", "g_parent"]
    made = created.select(*names, F.col("id").alias("made"), F.col("source_id").alias("maker"), F.col("path").alias("made_path"), F.col("name").alias("made_name"))
    making = F.when(F.col("outcome") == "CREATED", F.lit(True))
    rows = rows.withColumns({"g_authors": groups[2], "g_synonym": groups[3], "g_parent": groups[4], "making": making})
    joined = rows.join(made.withColumn("making", F.lit(True)), [*names, "making"], "left")
    outcome = F.when((F.col("outcome") == "CREATED") & (F.col("maker") != F.col("id")), "REPEATED").otherwise(F.col("outcome"))
    usage = F.when(F.col("outcome") == "MATCHED", F.col("match")).otherwise(F.col("made"))
    return joined.withColumn("outcome", outcome).withColumn("usage_id", usage)


def _places(rows: DataFrame) -> DataFrame:
    """id, own (the accepted usage of the row), anchor and anchor_path for the rows' children."""
    synonym = is_synonym(F.col("c_status"))
    matched = F.col("match").isNotNull() & ~F.col("doubtful")
    made = F.col("made").isNotNull() & ~is_synonym(F.col("status"))
    own = F.when(matched, F.when(synonym, F.col("c_parent")).otherwise(F.col("match"))).when(made, F.col("made"))
    path = F.when(matched, F.when(synonym, _above(F.col("c_path"))).otherwise(F.col("c_path"))).when(made, F.col("made_path")).otherwise(F.col("anchor_path"))
    return rows.select("id", own.alias("own"), F.coalesce(own, "anchor").alias("anchor"), path.alias("anchor_path"))


def _updates(rows: DataFrame) -> DataFrame:
    """id, info, value and source_id of what matched usages get; one of each kind."""
    taxa = ~is_synonym(F.col("status")) & ~is_synonym(F.col("c_status"))
    alike = is_synonym(F.col("status")) == is_synonym(F.col("c_status"))
    last = F.get(F.col("anchor_path"), F.size("anchor_path") - 1)
    old = F.get(F.col("c_path"), F.size("c_path") - 2)
    closer = (
        taxa & F.col("anchor").isNotNull() & (last["rank_ord"] < F.col("c_ord")) & (old["rank_ord"] < last["rank_ord"])
        & F.array_contains(_ids(F.col("anchor_path")), F.col("c_parent")) & ~F.array_contains(_ids(F.col("anchor_path")), F.col("match"))
        & (F.col("anchor") != F.col("c_parent"))
    )
    infos = F.array_compact(F.array(
        F.when(F.col("ca").isNull() & F.col("authorship").isNotNull() & alike, F.struct(F.lit("AUTHORSHIP").alias("info"), F.col("authorship").alias("value"))),
        F.when(F.coalesce(closer, F.lit(False)), F.struct(F.lit("PARENT").alias("info"), F.col("anchor").alias("value"))),
    ))
    each = rows.filter("outcome = 'MATCHED'").select(F.col("match").alias("usage"), F.col("id").alias("source_id"), F.explode(infos).alias("x"))
    return each.groupBy(F.col("usage").alias("id"), "x.info").agg(F.min_by("x.value", "source_id").alias("value"), F.min("source_id").alias("source_id"))


def _applied(project: DataFrame, updates: DataFrame, made: list[DataFrame]) -> DataFrame:
    wide = updates.groupBy("id").agg(
        F.max(F.when(F.col("info") == "AUTHORSHIP", F.col("value"))).alias("_authors"), F.max(F.when(F.col("info") == "PARENT", F.col("value"))).alias("_parent")
    )
    old = project.join(wide, "id", "left").withColumn("authorship", F.coalesce("authorship", "_authors")).withColumn("parent_id", F.coalesce("_parent", "parent_id"))
    out = old.select(*USAGE)
    for frame in made:
        out = out.unionByName(frame.select(*USAGE))
    return out


def place_strays(usages: DataFrame, incertae: str | None) -> DataFrame:
    """Usages with those below a missing parent, and one of each cycle, put below `incertae`, or made roots, and `issue`."""
    ids = usages.select(F.col("id").alias("parent_id"))
    missing = usages.filter("parent_id is not null").join(ids, "parent_id", "left_anti").select("id", F.lit("MISSING_PARENT").alias("issue"))
    ordered = usages.withColumn("_ord", F.coalesce(rank_ordinal(F.lower("rank")), F.lit(len(RANKS))))
    cut = cut_cycles(ordered, "_ord").filter("cut").select("id", F.lit("CYCLE").alias("issue"))
    strays = missing.unionByName(cut).groupBy("id").agg(F.min("issue").alias("issue"))
    joined = usages.join(strays, "id", "left")
    parent = F.when(F.col("issue").isNull(), F.col("parent_id")).otherwise(F.nullif(F.lit(incertae).cast("string"), F.col("id")))
    return joined.withColumn("parent_id", parent).select(*usages.columns, "issue")


def provisional_homonyms(usages: DataFrame, priorities: DataFrame) -> DataFrame:
    """Usages where accepted names of one key and rank, but for those of the best priority, become provisional.

    priorities: sector, priority, a row a sector; sectors without one, such as the base, come first.
    """
    known = usages.withColumn("_key", index_key(F.col("name"))).join(F.broadcast(priorities.select("sector", "priority")), "sector", "left")
    known = settle(known.withColumn("_priority", F.coalesce("priority", F.lit(-1))).drop("priority"))  # keys are dear, and used twice
    accepted = F.col("status") == "ACCEPTED"
    best = known.filter(accepted).groupBy("_key", "rank").agg(F.min("_priority").alias("_best"))
    joined = known.join(best.withColumnRenamed("rank", "_rank"), (known["_key"] == best["_key"]) & F.col("rank").eqNullSafe(F.col("_rank")), "left")
    status = F.when(accepted & (F.col("_priority") > F.col("_best")), "PROVISIONALLY_ACCEPTED").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*usages.columns)


def without_empty_genera(usages: DataFrame, sectors: list[int]) -> DataFrame:
    """Usages but genera of these sectors that nothing is below."""
    parents = usages.select(F.col("parent_id").alias("id")).distinct()
    empty = usages.filter((F.lower("rank") == "genus") & F.col("sector").isin(*sectors) & ~is_synonym(F.col("status"))).join(parents, "id", "left_anti")
    return usages.join(empty.select("id"), "id", "left_anti")


def with_stable_ids(usages: DataFrame, previous: DataFrame, made: Column) -> tuple[DataFrame, DataFrame]:
    """Usages with lasting ids where `made` holds, and id, temporary id of these.

    A made usage gets the id of the previous release's usage of the same key,
    rank, authorship and kind of status, if each side has one, and that id isn't in
    use. The others are numbered, x1, x2, ..., above all that were given before.
    """
    signature = [
        index_key(F.col("name")).alias("k"), F.coalesce(F.lower("rank"), F.lit("")).alias("r"),
        F.lower(F.coalesce("authorship", F.lit(""))).alias("a"), is_synonym(F.col("status")).alias("s"),
    ]
    one = lambda df, name: df.select(*signature, "id").groupBy("k", "r", "a", "s").agg(F.min("id").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    new = settle(usages.filter(made))
    used = usages.filter(~made).select("id")
    kept = one(new, "temporary").join(one(previous, "id"), ["k", "r", "a", "s"]).join(used, "id", "left_anti").select("temporary", "id")
    kept = settle(kept)
    rest = new.select(F.col("id").alias("temporary")).join(kept, "temporary", "left_anti")
    taken = previous.select("id").unionByName(used).select(F.regexp_extract("id", r"^x(\d+)$", 1).try_cast("long").alias("n"))
    start = (taken.agg(F.max("n")).first()[0] or 0) + 1
    numbered = number(rest, "temporary", start, "n").select("temporary", F.concat(F.lit("x"), "n").alias("id"))
    ids = settle(kept.unionByName(numbered))
    own, up = ids.select(F.col("temporary").alias("id"), F.col("id").alias("_id")), ids.select(F.col("temporary").alias("parent_id"), F.col("id").alias("_up"))
    out = usages.join(own, "id", "left").join(up, "parent_id", "left")
    out = out.withColumn("id", F.coalesce("_id", "id")).withColumn("parent_id", F.coalesce("_up", "parent_id"))
    return out.select(*usages.columns), ids


def tree_issues(usages: DataFrame) -> DataFrame:
    """id and issue of usages whose place contradicts their rank or status."""
    rows = usages.withColumn("rank", F.lower("rank")).withColumn("rank_ord", F.coalesce(rank_ordinal(F.col("rank")), F.lit(len(RANKS))))
    paths = with_paths(rows, ["name", "rank_ord", "status"])
    genus = F.get(F.filter(_above(F.col("path")), lambda p: p["rank_ord"] == GENUS), F.lit(0))["name"]
    species = F.col("rank") == "species"
    checks = {
        "RANK_ORDER": doubtful(F.col("path")),
        "SPECIES_WITHOUT_GENUS": species & genus.isNull() & ~is_synonym(F.col("status")),
        "GENUS_MISMATCH": species & (F.substring_index("name", " ", 1) != genus) & ~is_synonym(F.col("status")),
    }
    return paths.select("id", F.explode(issues(checks)).alias("issue"))


class Release(NamedTuple):
    """usages, with lasting ids; outcomes of the sectors; issues (id, issue); ids (temporary, id)."""

    usages: DataFrame
    outcomes: DataFrame
    issues: DataFrame
    ids: DataFrame


def extended_release(
    base: DataFrame,
    sectors: list[dict],
    previous: DataFrame,
    incertae: str | None = None,
    known: DataFrame | None = None,
    protected: list[str] = (),
    keep_empty_genera: bool = False,
) -> Release:
    """A release of `base` and what merge sectors add to it, with ids that last.

    Sectors are merged by priority. Then accepted homonyms of lesser sectors become
    provisional, chains of synonyms are resolved and accepted names lifted from
    below synonyms, cycles and missing parents end at `incertae` (or in roots),
    genera that sectors brought and nothing is below go, as do synonyms of
    nothing; ids of the previous release are given again, and issues are told.
    """
    spark = base.sparkSession
    usages, outcomes = merge_sectors(base, sectors, known, protected)
    order = spark.createDataFrame([(s["sector"], s["priority"]) for s in sectors], "sector int, priority int")
    usages = settle(provisional_homonyms(usages, order))
    usages = settle(lift_accepted(resolve_chains(usages)))
    usages = settle(place_strays(usages, incertae))
    moved = usages.filter("issue is not null").select("id", "issue")
    usages = usages.drop("issue")
    if not keep_empty_genera:
        usages = without_empty_genera(usages, [s["sector"] for s in sectors])
    usages = settle(drop_orphan_synonyms(usages))
    made = F.col("sector").isin(*(s["sector"] for s in sectors))
    final, ids = with_stable_ids(usages, previous, made)
    final = settle(final)
    renamed = moved.join(ids.select(F.col("temporary").alias("id"), F.col("id").alias("_id")), "id", "left").select(F.coalesce("_id", "id").alias("id"), "issue")
    told = renamed.join(final.select("id"), "id", "left_semi").unionByName(tree_issues(final))
    return Release(final, outcomes, told, ids)


def merge_sectors(project: DataFrame, sectors: list[dict], known: DataFrame | None = None, protected: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The project after all sectors, in order of priority, and their outcomes with the sector's key.

    sectors: dicts of priority, sector, source, and optionally target and blocked. A
    sector meets what those before it made, so the first to bring a name gives it.
    """
    outcomes = None
    for s in sorted(sectors, key=lambda s: (s["priority"], s["sector"])):
        merged = merge_sector(project, s["source"], s["sector"], s.get("target"), s.get("blocked"), protected, known)
        project = merged.usages
        told = merged.outcomes.withColumn("sector", F.lit(s["sector"]))
        outcomes = told if outcomes is None else outcomes.unionByName(told)
    return project, outcomes
