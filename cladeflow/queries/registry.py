"""Registration of queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def registrar():
    """A registry, and a decorator that adds a query, named by its function, with its SQL."""
    registry: dict = {}

    def query(sql: str | None = None):
        def add(f):
            registry[f.__name__] = (f, sql)
            return f

        return add

    return registry, query


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


#: The hierarchy of the test tables: regions, nations, customers and suppliers.
NODES_SQL = """nodes AS (
  SELECT 'R' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS name, 0 AS rank_ord FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 1 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, 2 FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, 2 FROM supplier)"""
PATHS_SQL = f"""WITH RECURSIVE {NODES_SQL}, paths AS (
  SELECT id, parent_id, name, rank_ord, [id] AS ids, [name] AS names, 1 AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, n.parent_id, n.name, n.rank_ord, list_append(p.ids, n.id), list_append(p.names, n.name), p.depth + 1
  FROM nodes n JOIN paths p ON n.parent_id = p.id)"""


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchy as id, parent_id, name, rank_ord."""
    region, nation, customer, supplier = tables(spark, folder, "region", "nation", "customer", "supplier")
    row = lambda t, mark, key, up, parent, name, rank: t.select(
        F.concat(F.lit(mark), F.col(key)).alias("id"),
        (F.concat(F.lit(up), F.col(parent)) if parent else F.lit(None).cast("string")).alias("parent_id"),
        F.col(name).alias("name"),
        F.lit(rank).alias("rank_ord"),
    )
    return (
        row(region, "R", "r_regionkey", "", None, "r_name", 0)
        .unionByName(row(nation, "N", "n_nationkey", "R", "n_regionkey", "n_name", 1))
        .unionByName(row(customer, "C", "c_custkey", "N", "c_nationkey", "c_name", 2))
        .unionByName(row(supplier, "S", "s_suppkey", "N", "s_nationkey", "s_name", 2))
    )
