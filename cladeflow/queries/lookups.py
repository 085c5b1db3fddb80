"""Joins: rows without partners, as-of rows, stars, overlays, related rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, normalize
from .registry import NODES_SQL, nodes, registrar, tables

REGISTRY, query = registrar()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def orphan_rows(spark, folder):
    customer, orders = tables(spark, folder, "customer", "orders")
    return joins.orphans(customer, "c_custkey", orders.filter("o_totalprice > 200000"), "o_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def rows_without_match(spark, folder):
    part, items = tables(spark, folder, "part", "lineitem")
    return joins.orphans(part, "p_partkey", items.filter("l_quantity > 45"), "l_partkey").select("p_partkey")


@query(f"WITH {NODES_SQL}, cut AS (SELECT * FROM nodes WHERE id <> 'N4') SELECT DISTINCT parent_id AS id FROM cut WHERE parent_id NOT IN (SELECT id FROM cut)")
def missing_parent_ids(spark, folder):
    return joins.missing_parents(nodes(spark, folder).filter("id != 'N4'"))


def _statuses(spark, folder):
    """Suppliers are synonyms: of a customer, or for keys divisible by seven of the next supplier."""
    suppliers, customers = tables(spark, folder, "supplier", "customer")
    key = F.col("s_suppkey")
    chained = (key % 7 == 0) & (key < 99)
    parent = F.when(chained, F.concat(F.lit("S"), key + 1)).otherwise(F.concat(F.lit("C"), key))
    own = suppliers.select(
        F.concat(F.lit("S"), key).alias("id"), parent.alias("parent_id"), F.col("s_name").alias("name"), F.lit("SYNONYM").alias("status")
    )
    accepted = customers.select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"),
        F.col("c_name").alias("name"), F.lit("ACCEPTED").alias("status"),
    )
    return own.unionByName(accepted)


@query("SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey < 99 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)")
def chained_synonyms(spark, folder):
    return joins.chained_synonyms(_statuses(spark, folder), F.col("status") == "SYNONYM").select("id")


@query("SELECT 'S' || s_suppkey AS id, 'C' || CASE WHEN s_suppkey % 7 = 0 AND s_suppkey < 99 THEN s_suppkey + 1 ELSE s_suppkey END AS parent_id FROM supplier")
def resolved_synonym_chains(spark, folder):
    """Synonyms of synonyms linked to the accepted name."""
    return normalize.resolve_chains(_statuses(spark, folder)).filter("status = 'SYNONYM'").select("id", "parent_id")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def previous_and_next(spark, folder):
    (orders,) = tables(spark, folder, "orders")
    rows = joins.neighbours(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return rows.select("o_orderkey", "previous", "next")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_per_key(spark, folder):
    (orders,) = tables(spark, folder, "orders")
    return joins.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT e.event_id, (SELECT p.event_id FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'error' AND p.ts <= e.ts ORDER BY p.ts DESC LIMIT 1) AS error_id
  FROM events e WHERE e.event_type = 'click'""")
def as_of_join(spark, folder):
    """Each click with the user's last error before it."""
    (events,) = tables(spark, folder, "events")
    errors = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("error_id"))
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.as_of(clicks, errors, ["user_id"], "ts", "at", ["error_id"]).select("event_id", "error_id")


@query("""SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(first_key, -1) AS first_key, coalesce(n_seg, 0) AS n_seg FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_orderkey) AS first_key FROM orders GROUP BY 1) ON o_custkey = c_custkey
  LEFT JOIN (SELECT s_nationkey, count(*) AS n_seg FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def star_assembly(spark, folder):
    """Children of two tables gathered by key, so that rows don't multiply."""
    customer, orders, supplier = tables(spark, folder, "customer", "orders", "supplier")
    own = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    by_customer = joins.star(customer, "c_custkey", {"orders": own})
    full = joins.star(by_customer, "c_nationkey", {"suppliers": supplier.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")})
    first = F.coalesce(F.get("orders", F.lit(0))["o_orderkey"], F.lit(-1))
    return full.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), first.alias("first_key"), F.size("suppliers").cast("long").alias("n_seg"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'PATCHED' ELSE n_name END AS n_name, n_regionkey FROM nation")
def metadata_overlay(spark, folder):
    """Filled values of a patch over the rows."""
    (nation,) = tables(spark, folder, "nation")
    patch = nation.filter("n_nationkey % 5 = 0").select("n_nationkey", F.lit("PATCHED").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    return joins.overlay(nation, patch, "n_nationkey").select("n_nationkey", "n_name", "n_regionkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS s_acctbal, s_suppkey % 4 = 3 AS reviewed FROM supplier WHERE s_suppkey % 4 <> 1""".replace(
    "CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END", "CASE WHEN s_suppkey % 4 = 2 THEN 0.0 ELSE s_acctbal END"))
def decision_overlay(spark, folder):
    """Rows blocked, updated or reviewed by decisions."""
    (supplier,) = tables(spark, folder, "supplier")
    rows = supplier.withColumnRenamed("s_suppkey", "id")
    mode = F.when(F.col("id") % 4 == 1, "BLOCK").when(F.col("id") % 4 == 2, "UPDATE").otherwise("REVIEWED")
    decisions = rows.filter("id % 4 > 0").select(F.col("id").alias("subject_id"), mode.alias("mode"), F.lit(0.0).alias("s_acctbal"))
    return normalize.apply_decisions(rows, decisions).select(F.col("id").alias("s_suppkey"), "s_acctbal", "reviewed")


@query(f"""WITH {NODES_SQL} SELECT c.id FROM nodes c JOIN nodes p ON c.parent_id = p.id WHERE length(p.id) = 2 AND length(c.id) <> 2 AND p.rank_ord = 1""")
def foreign_children(spark, folder):
    """Children of a sector's rows that belong to another sector."""
    rows = nodes(spark, folder).withColumn("sector", F.when(F.col("rank_ord") > 0, F.length("id")))
    return joins.foreign_children(rows, "sector", 2).select("id")


@query("SELECT o.o_orderkey, coalesce(c.c_custkey, d.c_custkey) AS found FROM orders o LEFT JOIN customer c ON c.c_custkey = CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_custkey END LEFT JOIN customer d ON d.c_name = 'Customer#' || lpad(o.o_custkey::VARCHAR, 9, '0')")
def key_by_id_or_name(spark, folder):
    """Targets by id, and else by name."""
    orders, customer = tables(spark, folder, "orders", "customer")
    rows = orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("cid"),
        F.format_string("Customer#%09d", "o_custkey").alias("cname"),
    )
    targets = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return joins.by_id_or_name(rows, targets, "cid", "cname", "found").select("o_orderkey", "found")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def blocked_pairs(spark, folder):
    """Pairs within a block, each once."""
    (part,) = tables(spark, folder, "part")
    return joins.pairs_within(part, "p_partkey", ["p_brand", "p_type", "p_size"])
