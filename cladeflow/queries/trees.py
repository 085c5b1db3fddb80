"""Hierarchies: paths, subtrees, numbering, roll-ups, cycles, renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..sources import trees as text
from .registry import NODES_SQL, PATHS_SQL, nodes, registrar, tables

REGISTRY, query = registrar()


def _paths(spark, folder):
    return tree.with_paths(nodes(spark, folder), ["name", "rank_ord"])


@query(PATHS_SQL + " SELECT id, depth::INTEGER AS depth, array_to_string(names[:-2], ' > ') AS classification FROM paths")
def classification_names(spark, folder):
    """Ancestors' names from the root down."""
    names = F.transform(tree.ancestors(F.col("path")), lambda x: x["name"])
    return _paths(spark, folder).select("id", "depth", F.array_join(names, " > ").alias("classification"))


@query(PATHS_SQL + " SELECT id, array_to_string(ids, '/') AS ids FROM paths")
def classification_ids(spark, folder):
    return _paths(spark, folder).select("id", F.array_join(F.transform("path", lambda x: x["id"]), "/").alias("ids"))


@query(PATHS_SQL + " SELECT id, CASE WHEN depth >= 2 THEN ids[2] END AS nation FROM paths")
def parent_by_rank(spark, folder):
    """The node or ancestor of one rank."""
    return _paths(spark, folder).select("id", tree.parent_by_rank(F.col("path"), 1).alias("nation"))


@query(PATHS_SQL + " SELECT id, name FROM paths WHERE list_contains(ids, 'R1') AND NOT list_contains(ids, 'N1')")
def subtree_without(spark, folder):
    """All below a node, leaving out a subtree."""
    return tree.subtree(_paths(spark, folder), "R1", without=["N1"]).select("id", "name")


@query(PATHS_SQL + """ SELECT a AS id, count(*) FILTER (rank_ord = 2) AS leaves, count(*) AS size, max(depth)::INTEGER AS deepest
  FROM (SELECT rank_ord, depth, unnest(ids) AS a FROM paths) GROUP BY 1""")
def subtree_metrics(spark, folder):
    """Counts over subtrees for every node."""
    paths = _paths(spark, folder)
    sums = tree.roll_up(paths, {"leaves": F.when(F.col("rank_ord") == 2, 1).otherwise(0).cast("long"), "size": F.lit(1).cast("long")})
    deepest = paths.select(F.explode("path").alias("s"), "depth").groupBy(F.col("s.id").alias("id")).agg(F.max("depth").alias("deepest"))
    return sums.join(deepest, "id").select("id", "leaves", "size", "deepest")


@query(PATHS_SQL + """, walked AS (SELECT id, depth, ids, list_transform(range(1, depth + 1), lambda i: names[i] || chr(1) || ids[i]) AS walk FROM paths),
  sizes AS (SELECT a AS id, count(*) AS size FROM (SELECT unnest(ids) AS a FROM paths) GROUP BY 1)
  SELECT w.id, row_number() OVER (ORDER BY walk) AS pre, 2 * row_number() OVER (ORDER BY walk) - depth AS lft,
  2 * row_number() OVER (ORDER BY walk) - depth + 2 * size - 1 AS rgt FROM walked w JOIN sizes USING (id)""")
def nested_set_numbers(spark, folder):
    """Numbers by a depth-first walk, siblings by name."""
    found = tree.nested_set(_paths(spark, folder), ["name"])
    return found.select("id", F.col("pre").cast("long").alias("pre"), F.col("lft").cast("long").alias("lft"), F.col("rgt").cast("long").alias("rgt"))


@query(f"WITH {NODES_SQL} SELECT p.id, p.name, count(c.id) AS n FROM nodes p LEFT JOIN nodes c ON c.parent_id = p.id WHERE p.rank_ord < 2 GROUP BY 1, 2")
def tree_page_child_counts(spark, folder):
    """Nodes with their number of children."""
    rows = nodes(spark, folder)
    counts = rows.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    own = rows.filter("rank_ord < 2")
    return own.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {NODES_SQL}, mixed AS (SELECT id, name, CASE WHEN id LIKE 'S%' THEN 3 ELSE rank_ord END AS rank_ord FROM nodes WHERE parent_id = 'N3')
  SELECT id, name, rank_ord, NULL::BIGINT AS hidden FROM mixed WHERE rank_ord = 2
  UNION ALL SELECT NULL, 'Not assigned', 2, count(*) FROM mixed WHERE rank_ord > 2 HAVING count(*) > 0""")
def placeholder_children(spark, folder):
    """Children of the highest rank, and a placeholder for the others."""
    rows = nodes(spark, folder)
    rows = rows.withColumn("rank_ord", F.when(F.col("id").startswith("S"), 3).otherwise(F.col("rank_ord")))
    return tree.children_with_placeholder(rows, "N3")


@query(f"""WITH {NODES_SQL}, looped AS (SELECT id, CASE id WHEN 'N0' THEN 'N5' WHEN 'N5' THEN 'N10' WHEN 'N10' THEN 'N0' ELSE parent_id END AS parent_id FROM nodes)
  SELECT id FROM looped WHERE id IN ('N0', 'N5', 'N10')""")
def cycle_detection(spark, folder):
    """Members of a cycle that was put into the parent pointers."""
    return tree.cycle_members(_looped(spark, folder))


def _looped(spark, folder):
    to = F.create_map(*(F.lit(x) for x in ("N0", "N5", "N5", "N10", "N10", "N0")))
    return nodes(spark, folder).withColumn("parent_id", F.coalesce(F.element_at(to, F.col("id")), F.col("parent_id")))


@query(f"""WITH {NODES_SQL}, looped AS (SELECT id, CASE id WHEN 'N0' THEN 'N5' WHEN 'N5' THEN 'N10' WHEN 'N10' THEN 'N0' ELSE parent_id END AS parent_id FROM nodes)
  SELECT id, CASE WHEN id <> 'N0' THEN parent_id END AS parent_id, id = 'N0' AS cut FROM looped""")
def cycle_cut(spark, folder):
    """The same cycle cut at its highest rank and least id."""
    return tree.cut_cycles(_looped(spark, folder), "rank_ord").select("id", "parent_id", "cut")


@query(f"""WITH {NODES_SQL} SELECT DISTINCT r_name AS region, n_name AS nation, 'r' AS kind FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT NULL, r_name, 't' FROM region JOIN nation ON n_regionkey = r_regionkey""")
def flat_to_tree(spark, folder):
    """Rank columns turned into parents and children, named."""
    region, nation = tables(spark, folder, "region", "nation")
    flat = nation.join(region, nation.n_regionkey == region.r_regionkey).select("r_name", "n_name")
    rows = tree.flat_to_tree(flat, ["r_name", "n_name"])
    above = rows.select(F.col("id").alias("parent_id"), F.col("name").alias("region"))
    kind = F.when(F.col("parent_id").isNull(), "t").otherwise("r")
    return rows.join(above, "parent_id", "left").select("region", F.col("name").alias("nation"), kind.alias("kind"))


@query(PATHS_SQL + " SELECT id, names[1] AS region, names[2] AS nation FROM paths")
def tree_to_flat(spark, folder):
    return tree.tree_to_flat(_paths(spark, folder), {"region": 0, "nation": 1})


@query()
def relation_closure(spark, folder):
    """Groups of what all line items connect, orders and parts by their own keys; see the tests.

    A recursive query pairs all nodes of a group, so there is no SQL for it.
    """
    (items,) = tables(spark, folder, "lineitem")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return tree.closure(items.select(key("O", "l_orderkey").alias("a"), key("P", "l_partkey").alias("b")))


@query()
def relation_closure_all(spark, folder):
    """How many nodes each of these groups has."""
    return relation_closure(spark, folder).groupBy("group").agg(F.count("*").alias("n"))


@query(PATHS_SQL + """, lines AS (SELECT repeat(' ', (2 * (depth - 1))::INTEGER) || name AS line FROM paths) SELECT line, count(*) AS n FROM lines GROUP BY 1""")
def indented_text(spark, folder):
    """A text tree of all nodes; lines are counted, as results have no order."""
    paths = _paths(spark, folder)
    return text.render_indented(paths, F.col("name"), ["name"]).groupBy("line").agg(F.count("*").alias("n"))


@query("""SELECT '(' || string_agg(n_name, ',' ORDER BY n_name, 'N' || n_nationkey) || ')' || CASE WHEN r_name LIKE '% %' THEN '''' || r_name || '''' ELSE r_name END || ';' AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def newick_text(spark, folder):
    paths = _paths(spark, folder).filter("depth <= 2")
    return text.newick(paths, F.col("name"), ["name"])


@query(f"""WITH {NODES_SQL} SELECT '  n' || id || ' [label="' || name || '"]' AS line FROM nodes
  UNION ALL SELECT '  n' || parent_id || ' -> n' || id || ' [type=parent_of]' FROM nodes WHERE parent_id IS NOT NULL""")
def graph_text(spark, folder):
    return text.graph_lines(nodes(spark, folder), F.col("name"), F.lit(False))


@query(PATHS_SQL + """, m AS (SELECT id, 'M' || id AS match FROM nodes WHERE rank_ord = 0 OR id IN ('N2', 'C7'))
  SELECT id, arg_min(match, dist) AS match FROM (SELECT p.id, m.match, p.depth - list_position(p.ids, m.id) AS dist FROM paths p JOIN m ON list_contains(p.ids, m.id)) GROUP BY 1""")
def lowest_matched_parent(spark, folder):
    """The nearest matched node on the way to the root."""
    rows = nodes(spark, folder)
    known = rows.filter("rank_ord = 0 or id in ('N2', 'C7')").select("id", F.concat(F.lit("M"), F.col("id")).alias("match"))
    return tree.last_known(_paths(spark, folder), known)
