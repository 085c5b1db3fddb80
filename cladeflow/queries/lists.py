"""Differences of lists, set operations, releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff, joins, normalize
from ..plans import release
from .registry import registrar, tables

REGISTRY, query = registrar()


@query("""WITH o AS (SELECT p_name AS label, count(*) AS n FROM part WHERE p_partkey < 1200 GROUP BY 1), w AS (SELECT p_name AS label, count(*) AS n FROM part WHERE p_partkey >= 800 GROUP BY 1),
  d AS (SELECT label, coalesce(o.n, 0) AS a, coalesce(w.n, 0) AS b FROM o FULL JOIN w USING (label))
  SELECT label, CASE WHEN a > b THEN 'REMOVED' ELSE 'ADDED' END AS change FROM d, range(abs(a - b)) WHERE a <> b""")
def label_diff(spark, folder):
    """Multiset difference of two lists of labels."""
    (part,) = tables(spark, folder, "part")
    rows = part.select("p_partkey", F.col("p_name").alias("label"))
    return diff.exact_diff(rows.filter("p_partkey < 1200"), rows.filter("p_partkey >= 800"), "label")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'REMOVED' WHEN o_orderkey % 7 = 0 THEN 'ADDED' ELSE 'CHANGED' END AS change FROM orders
  WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0)""")
def row_diff(spark, folder):
    """Rows removed, added and changed between two versions."""
    (orders,) = tables(spark, folder, "orders")
    before = orders.filter("o_orderkey % 7 != 0")
    status = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    after = orders.filter("o_orderkey % 5 != 0").withColumn("o_orderstatus", status)
    return diff.row_diff(before, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""SELECT n_name || ' alba' AS before, n_name || ' albi' AS after FROM nation WHERE n_nationkey % 2 = 0""")
def changed_labels(spark, folder):
    """Labels that changed by an ending, paired; those that went without a partner are left."""
    (nation,) = tables(spark, folder, "nation")
    side = lambda end: nation.filter("n_nationkey % 2 = 0").select(F.concat("n_name", F.lit(end)).alias("label"))
    gone = nation.filter("n_nationkey % 2 = 1").select(F.concat("n_name", F.lit(" rubra")).alias("label"))
    return diff.changed_labels(diff.exact_diff(side(" alba").unionByName(gone), side(" albi"), "label"), "label")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0""")
def union_distinct(spark, folder):
    (part,) = tables(spark, folder, "part")
    rows = part.select("p_partkey", "p_name")
    return rows.filter("p_partkey % 2 = 0").unionByName(rows.filter("p_partkey % 3 = 0")).distinct()


@query("""SELECT id, name, sector, parent_id FROM (SELECT 'C' || c_custkey AS id, c_name AS name, 1 AS sector, 'N' || c_nationkey AS parent_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
  UNION ALL SELECT 'S' || s_suppkey, s_name, 1, 'N' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1
  UNION ALL SELECT 'N' || n_nationkey, n_name, 1, 'ROOT' FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'ROOT', 'Root', NULL, NULL)""")
def sector_attach(spark, folder):
    """A subtree copied into a project, with its top blocked by a decision."""
    from ..operators.tree import with_paths
    from .registry import nodes

    paths = with_paths(nodes(spark, folder), ["name", "rank_ord"])
    project = spark.createDataFrame([("ROOT", "Root", None, None)], "id string, name string, sector int, parent_id string")
    block = spark.createDataFrame([("R1", "BLOCK")], "subject_id string, mode string")
    return release.attach(project, paths, "R1", "ROOT", 1, block)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN '1,2' WHEN p_partkey % 2 = 0 THEN '1' ELSE '2' END AS releases FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def release_archive(spark, folder):
    (part,) = tables(spark, folder, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    known = rows.filter("id % 2 = 0").withColumn("releases", F.array(F.lit(1)))
    kept = release.archive(known, rows.filter("id % 3 = 0"), 2)
    return kept.select("id", F.array_join(F.transform("releases", lambda x: x.cast("string")), ",").alias("releases"))


@query("""SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part WHERE p_name LIKE '% %'""")
def implicit_parents(spark, folder):
    """First words that no row stands for."""
    (part,) = tables(spark, folder, "part")
    return normalize.implicit_genera(part.select(F.col("p_name").alias("name")))


@query("""SELECT issue, count(*) AS n FROM (SELECT 'no_date' AS issue FROM orders WHERE o_orderdate < '1996-01-01' UNION ALL SELECT 'cheap' FROM orders WHERE o_totalprice < 50000) GROUP BY 1""")
def issue_counts(spark, folder):
    """Issues of rows, exploded and counted."""
    (orders,) = tables(spark, folder, "orders")
    found = normalize.issues({"no_date": F.col("o_orderdate") < "1996-01-01", "cheap": F.col("o_totalprice") < 50000})
    return orders.select(F.explode(found).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS kept FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def restricted_export(spark, folder):
    """Only rows that an exported row refers to."""
    customer, orders = tables(spark, folder, "customer", "orders")
    kept = customer.join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    return kept.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kept"))


@query("""SELECT o_orderkey, o_orderpriority > lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rises FROM orders""")
def order_inversions(spark, folder):
    """A row against the one before."""
    (orders,) = tables(spark, folder, "orders")
    rows = joins.neighbours(orders, ["o_custkey"], [F.col("o_orderkey")], "o_orderpriority")
    return rows.select("o_orderkey", (F.col("o_orderpriority") > F.col("previous")).alias("rises"))
