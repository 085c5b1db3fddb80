"""Trees of parent pointers: paths, subtrees, numbering, roll-ups, cycles.

Nodes are a table with id and parent_id. Walks are loops of joins, one round a
level, each settled so that plans stay short; pointer jumping takes as many
rounds as the logarithm of the longest chain. Paths are arrays of structs, so
that most later questions are expressions on one column.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import number, settle

#: Levels that are joined to one settled table.
LEVELS_TOGETHER = 32


def with_paths(nodes: DataFrame, carried: list[str] = ()) -> DataFrame:
    """`nodes` with `path`, structs of id and the carried columns from the root to the node, and `depth`, 1 for roots.

    A node whose parent is missing, or that a cycle keeps from any root, is left
    out; see unreached(). The walk ends with the deepest level, however deep.
    """
    step = F.struct("id", *carried)
    level = settle(nodes.filter("parent_id is null").withColumn("path", F.array(step)).withColumn("depth", F.lit(1)))
    found = level
    for depth in count(2):
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        level = settle(
            nodes.join(above, "parent_id")
            .withColumn("path", F.concat("_above", F.array(step)))
            .withColumn("depth", F.lit(depth))
            .select(*found.columns)
        )
        if level.isEmpty():
            return found
        found = found.unionByName(level)
        if depth % LEVELS_TOGETHER == 0:
            found = settle(found)


def unreached(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes without a way to a root: on a cycle, below one, or below a missing parent."""
    return nodes.join(paths.select("id"), "id", "left_anti")


def ancestors(path: Column, itself: bool = False) -> Column:
    """The path without the node, or with it."""
    return path if itself else F.slice(path, F.lit(1), F.size(path) - 1)


def parent_by_rank(path: Column, rank: int) -> Column:
    """Id of the node or ancestor of just this rank ordinal; carried column rank_ord.

    The walk upwards ends at the first node of a higher rank, so a node above an
    inverted rank isn't found.
    """
    upward = F.reverse(path)
    stop = F.array_position(F.transform(upward, lambda p: p["rank_ord"] < rank), True)
    reach = F.when(stop > 0, F.slice(upward, F.lit(1), stop.cast("int"))).otherwise(upward)
    return F.get(F.filter(reach, lambda p: p["rank_ord"] == rank), F.lit(0))["id"]


def explode_ancestors(paths: DataFrame, itself: bool = True) -> DataFrame:
    """A row for each node and ancestor: id, ancestor, distance."""
    rows = paths.select("id", "depth", F.posexplode(ancestors(F.col("path"), itself)).alias("at", "step"))
    return rows.select("id", F.col("step.id").alias("ancestor"), (F.col("depth") - F.col("at") - 1).alias("distance"))


def subtree(paths: DataFrame, root, without: list = (), lowest: int | None = None) -> DataFrame:
    """The nodes from `root` down, leaving out subtrees and ranks below an ordinal."""
    found = paths.filter(F.exists("path", lambda p: p["id"] == root))
    if without:
        found = found.filter(~F.exists("path", lambda p: p["id"].isin(*without)))
    return found if lowest is None else found.filter(F.col("rank_ord") <= lowest)


def roll_up(paths: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures summed over each node's subtree, itself included.

    Rows are summed by node before they are copied to ancestors, and the sums by
    ancestor are combined before the shuffle.
    """
    own = paths.groupBy("id").agg(
        F.first("path").alias("path"), *(F.sum(m).alias(k) for k, m in measures.items())
    )
    spread = own.select(F.explode("path").alias("step"), *measures)
    return spread.groupBy(F.col("step.id").alias("id")).agg(*(F.sum(k).alias(k) for k in measures))


def nested_set(paths: DataFrame, order: list[str]) -> DataFrame:
    """id, pre, lft and rgt: numbers of a depth-first walk with siblings in `order`.

    `order` names columns carried in the path. A range of lft then holds a
    subtree. The walk is a total order over the forest; it is sorted over range
    partitions, so that no task sorts a whole tree.
    """
    keys = F.transform("path", lambda p: F.struct(*(p[c] for c in order), p["id"]))
    rows = number(paths.select("id", "depth", keys.alias("walk")), "walk", 1, "pre")
    pre, size = F.col("pre"), roll_up(paths, {"size": F.lit(1)})
    return rows.join(size, "id").select(
        "id",
        "pre",
        (2 * pre - F.col("depth")).alias("lft"),
        (2 * pre - F.col("depth") + 2 * F.col("size") - 1).alias("rgt"),
    )


def cycle_members(nodes: DataFrame) -> DataFrame:
    """Ids of the nodes that lie on a cycle of parent pointers, by pointer jumping.

    Each round replaces a pointer by its pointer's pointer. Pointers that reach a
    root, or a missing parent, go; when no more go, those left all lead into
    cycles, and after as many rounds again as were needed to walk the longest
    chain, all point into them.
    """
    jumps = settle(nodes.filter("parent_id is not null").select("id", F.col("parent_id").alias("to")))
    known = jumps.count()
    steps = 1
    while known and steps <= 2 * known:
        following = jumps.select(F.col("id").alias("to"), F.col("to").alias("then"))
        jumps = settle(jumps.join(following, "to").select("id", F.col("then").alias("to")))
        known = jumps.count()
        steps *= 2
    return jumps.select(F.col("to").alias("id")).distinct()


def cut_cycles(nodes: DataFrame, rank: str) -> DataFrame:
    """`nodes` with one parent pointer of each cycle cleared, at the highest rank and least id, and `cut`."""
    members = settle(cycle_members(nodes))
    edges = nodes.join(members, "id", "left_semi").select("id", "parent_id", rank)
    label = settle(edges.withColumn("least", F.col("id")))
    while True:  # the least id of each cycle, passed along it
        passed = label.alias("a").join(
            label.select(F.col("id").alias("parent_id"), F.col("least").alias("other")), "parent_id"
        ).select("id", "parent_id", rank, F.least("least", "other").alias("least"))
        passed = settle(passed)
        if passed.join(label.select("id", F.col("least").alias("was")), "id").filter("least != was").isEmpty():
            break
        label = passed
    chosen = label.groupBy("least").agg(F.min(F.struct(rank, "id")).alias("top")).select(F.col("top.id").alias("id"))
    marked = nodes.join(chosen.withColumn("_cut", F.lit(True)), "id", "left")
    cut = F.coalesce("_cut", F.lit(False))
    return marked.withColumn("parent_id", F.when(~cut, F.col("parent_id"))).withColumn("cut", cut).drop("_cut")


def would_cycle(paths: DataFrame, node, parent) -> bool:
    """Whether the node is the new parent or one of its ancestors."""
    return not paths.filter((F.col("id") == parent) & F.exists("path", lambda p: p["id"] == node)).isEmpty()


def children_with_placeholder(nodes: DataFrame, parent, rank: str = "rank_ord") -> DataFrame:
    """Children of the highest rank among them, and one row for the others if there are any.

    The placeholder has no id, name `Not assigned`, and the count of what it hides.
    """
    own = nodes.filter(F.col("parent_id") == parent)
    top = own.agg(F.min(rank).alias("top"))
    tagged = own.crossJoin(F.broadcast(top))  # one row
    shown = tagged.filter(F.col(rank) == F.col("top")).select("id", "name", rank, F.lit(None).cast("long").alias("hidden"))
    hidden = (
        tagged.filter(F.col(rank) > F.col("top"))
        .groupBy("top")
        .agg(F.count("*").alias("hidden"))
        .select(F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), F.lit("Not assigned").alias("name"), F.col("top").alias(rank), "hidden")
    )
    return shown.unionByName(hidden)


def flat_to_tree(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """id, parent_id, rank and name of each distinct prefix of the rank columns; blanks are skipped."""
    steps = F.filter(
        F.array(*(F.struct(F.lit(r).alias("rank"), F.col(r).alias("name")) for r in ranks)),
        lambda s: F.coalesce(F.trim(s["name"]) != "", F.lit(False)),
    )
    prefix = lambda i: F.sha2(F.to_json(F.slice(F.col("steps"), F.lit(1), i)), 256)
    at = F.col("at") + 1
    return (
        rows.select(steps.alias("steps"))
        .distinct()
        .select("steps", F.posexplode("steps").alias("at", "step"))
        .select(prefix(at).alias("id"), F.when(at > 1, prefix(at - 1)).alias("parent_id"), "step.rank", "step.name")
        .distinct()
    )


def tree_to_flat(paths: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The name of the ancestor of each rank as columns; carried columns name and rank_ord."""
    at = lambda r: F.get(F.filter("path", lambda p: p["rank_ord"] == r), F.lit(0))["name"]
    return paths.select("id", *(at(r).alias(name) for name, r in ranks.items()))


def inverted_ranks(paths: DataFrame) -> DataFrame:
    """Nodes with an ancestor of the same or a lower rank."""
    above = ancestors(F.col("path"))
    return paths.filter(F.exists(above, lambda p: p["rank_ord"] >= F.col("rank_ord")))


def closure(edges: DataFrame) -> DataFrame:
    """node and group, the least node that edges lead to in either direction.

    Each round points nodes to the least node of their neighbourhood's least node
    and contracts the graph: edges join what their ends point to, and loops and
    repeats go. Nodes that are left at least halve; a node of a dense part is left
    only if it is the least around it. Afterwards the rounds' pointers are put
    together from the last on. In each join one side has a row a node, so that a
    node with many edges can be split over tasks.
    """
    ends = edges.filter("a is not null and b is not null")
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = settle(ends.select(least, most))  # most of these are distinct, and repeats do no harm
    left, rounds, nodes = pairs.filter("a != b"), [], pairs.filter("a = b").select(F.col("a").alias("node"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        if not rounds:
            nodes = nodes.unionByName(near.select(F.col("a").alias("node")))
        movers = near.filter("a != to")  # the least of their neighbourhood stay, and need no row
        onward = movers.select(F.col("a").alias("to"), F.col("to").alias("then"))
        rounds.append(settle(movers.join(onward, "to", "left").select(F.col("a").alias("node"), F.coalesce("then", "to").alias("to"))))
        to = lambda end: rounds[-1].select(F.col("node").alias(end), F.col("to").alias(f"_{end}"))
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left")
        a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        left = settle(moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct())
    if not rounds:
        return nodes.distinct().select("node", F.col("node").alias("group"))
    groups = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = groups.select(F.col("node").alias("to"), F.col("to").alias("_end"))
        # a node that others point to may move in several rounds, always to the same end
        groups = settle(earlier.join(later, "to", "left").select("node", F.coalesce("_end", "to").alias("to")).unionByName(groups).distinct())
    ends = nodes.select("node", F.col("node").alias("to")).unionByName(groups)
    return ends.groupBy("node").agg(F.min("to").alias("group"))  # an end is the least of its group


def last_known(paths: DataFrame, known: DataFrame) -> DataFrame:
    """id and match: the lowest node on the path, itself included, that `known` (id, match) has."""
    rows = explode_ancestors(paths).join(known.select(F.col("id").alias("ancestor"), "match"), "ancestor")
    return rows.groupBy("id").agg(F.min_by("match", "distance").alias("match"))
