"""Assembly of a project: sector merge, extended release, hierarchy sync, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import hierarchy, merge
from .registry import registrar, tables

REGISTRY, query = registrar()

# The project: regions as orders, nations as families, customers as species with their segment as author. The source
# has the same regions, nations with every fifth under another name, and for each supplier a customer's name, with
# the customer's authorship, another one or none.
_SQL = """p_species AS (SELECT 'C' || c_custkey AS id, 'N' || c_nationkey AS parent_id, c_name AS name, c_mktsegment || ', ' || (1800 + c_custkey % 90) AS authorship FROM customer),
  p_all AS (
    SELECT 'R' || r_regionkey AS id, NULL AS parent_id, r_name AS name, NULL AS authorship, 'order' AS rank FROM region
    UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, NULL, 'family' FROM nation
    UNION ALL SELECT id, parent_id, name, authorship, 'species' FROM p_species),
  s_all AS (
    SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS up, 'Customer#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0') AS name, s_nationkey AS nation,
           CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN authorship ELSE 'Zzyzx, 1700' END AS authorship, p_species.id AS customer
    FROM supplier LEFT JOIN p_species ON p_species.id = 'C' || (s_suppkey * 3)),
  told AS (
    SELECT 'r' || r_regionkey AS source_id, 'MATCHED' AS outcome, 'R' || r_regionkey AS usage_id, NULL AS up FROM region
    UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'CREATED' ELSE 'MATCHED' END,
                     CASE WHEN n_nationkey % 5 = 0 THEN '7:n' || n_nationkey ELSE 'N' || n_nationkey END, 'R' || n_regionkey FROM nation
    UNION ALL SELECT id, CASE WHEN customer IS NOT NULL AND coalesce(authorship, '') <> 'Zzyzx, 1700' THEN 'MATCHED' ELSE 'CREATED' END,
                     CASE WHEN customer IS NOT NULL AND coalesce(authorship, '') <> 'Zzyzx, 1700' THEN customer ELSE '7:' || id END,
                     CASE WHEN nation % 5 = 0 THEN '7:n' || nation ELSE 'N' || nation END FROM s_all)"""


def _sides(spark, folder):
    region, nation, customer, supplier = tables(spark, folder, "region", "nation", "customer", "supplier")
    null = F.lit(None).cast("string")
    row = lambda t, mark, key, up, parent, name, authors, rank, sector: t.select(
        F.concat(F.lit(mark), F.col(key)).alias("id"), (F.concat(F.lit(up), F.col(parent)) if parent else null).alias("parent_id"),
        name.alias("name"), authors.alias("authorship"), F.lit(rank).alias("rank"), F.lit("ACCEPTED").alias("status"), F.lit(sector).alias("sector"),
    )
    authors = F.concat_ws(", ", "c_mktsegment", (1800 + F.col("c_custkey") % 90).cast("string"))
    species = row(customer, "C", "c_custkey", "N", "c_nationkey", F.col("c_name"), authors, "species", 0)
    project = (
        row(region, "R", "r_regionkey", "", None, F.col("r_name"), null, "order", 0)
        .unionByName(row(nation, "N", "n_nationkey", "R", "n_regionkey", F.col("n_name"), null, "family", 0))
        .unionByName(species)
    )
    key = F.col("s_suppkey")
    own = supplier.join(species.select(F.col("id").alias("c"), F.col("authorship").alias("ca")), F.concat(F.lit("C"), key * 3) == F.col("c"), "left")
    given = F.when(key % 5 == 0, null).when(key % 2 == 0, F.col("ca")).otherwise("Zzyzx, 1700")
    nations = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.col("n_name"), F.lit("x"))).otherwise(F.col("n_name"))
    source = (
        row(region, "r", "r_regionkey", "", None, F.col("r_name"), null, "order", 0)
        .unionByName(row(nation, "n", "n_nationkey", "r", "n_regionkey", nations, null, "family", 0))
        .unionByName(row(own, "s", "s_suppkey", "n", "s_nationkey", F.concat(F.lit("Customer#"), F.lpad((key * 3).cast("string"), 9, "0")), given, "species", 0))
    )
    return project, source


@query(f"WITH {_SQL} SELECT source_id, outcome, usage_id FROM told")
def sector_merge(spark, folder):
    """What becomes of each row of a source that is merged into a project."""
    return merge.merge_sector(*_sides(spark, folder), 7).outcomes


@query(f"""WITH {_SQL},
  fresh AS (SELECT t.usage_id AS temporary, t.up AS parent_id, s.name, s.authorship, 'species' AS rank FROM told t JOIN s_all s ON s.id = t.source_id WHERE outcome = 'CREATED'
    UNION ALL SELECT t.usage_id, t.up, n_name || 'x', NULL, 'family' FROM told t JOIN nation ON t.source_id = 'n' || n_nationkey WHERE outcome = 'CREATED'),
  numbered AS (SELECT *, 'x' || (100 + row_number() OVER (ORDER BY temporary)) AS id FROM fresh)
  SELECT id, parent_id, name, authorship, 'ACCEPTED' AS status FROM p_all
  UNION ALL SELECT n.id, coalesce(m.id, n.parent_id), n.name, n.authorship,
    CASE WHEN n.rank = 'species' AND n.name IN (SELECT name FROM p_species) THEN 'PROVISIONALLY_ACCEPTED' ELSE 'ACCEPTED' END
  FROM numbered n LEFT JOIN numbered m ON m.temporary = n.parent_id""")
def extended_release(spark, folder):
    """Usages of a release with a merged source, new ids following those of the release before."""
    project, source = _sides(spark, folder)
    before = project.limit(0).unionByName(spark.createDataFrame([("x100", None, "Elsewhere", None, "genus", "ACCEPTED", 0)], project.schema))
    made = merge.extended_release(project, [{"priority": 1, "sector": 7, "source": source}], before)
    return made.usages.select("id", "parent_id", "name", "authorship", "status")


@query("""WITH linked AS (SELECT c_custkey, c_nationkey, c_name, c_custkey % 4 AS kind FROM customer),
  used AS (SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation JOIN linked ON c_nationkey = n_nationkey WHERE kind <> 0),
  regions AS (SELECT DISTINCT n_regionkey FROM used)
  SELECT 'C' || c_custkey AS id, CASE WHEN kind = 0 THEN NULL ELSE '5:n' || c_nationkey END AS parent_id, CASE WHEN kind = 2 THEN 'Auth, 1900' END AS authorship,
         'ACCEPTED' AS status, c_name AS name FROM linked
  UNION ALL SELECT '5:n' || n_nationkey, '5:r' || n_regionkey, NULL, 'ACCEPTED', n_name FROM used
  UNION ALL SELECT '5:r' || n_regionkey, NULL, NULL, 'ACCEPTED', r_name FROM regions JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT '5:y' || s_suppkey, 'C' || s_suppkey, NULL, 'SYNONYM', s_name FROM supplier JOIN linked ON c_custkey = s_suppkey WHERE kind IN (1, 2)""")
def hierarchy_synced(spark, folder):
    """Customers without a tree take over nations and regions of a source: by its ids, or for every fourth (3) by name; suppliers are its synonyms."""
    region, nation, customer, supplier = tables(spark, folder, "region", "nation", "customer", "supplier")
    null, kind = F.lit(None).cast("string"), F.col("c_custkey") % 4
    accepted = lambda status="ACCEPTED": F.lit(status).alias("status")
    own = F.concat(F.lit("c"), "c_custkey")
    project = customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("id"), null.alias("parent_id"), F.col("c_name").alias("name"), null.alias("authorship"), F.lit("species").alias("rank"),
        accepted(), F.lit(None).cast("int").alias("sector"), F.when(kind.isin(1, 2), own).when(kind == 0, "gone").alias("source_id"),
    )
    source = (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), null.alias("parent_id"), F.col("r_name").alias("name"), null.alias("authorship"), F.lit("order").alias("rank"), accepted())
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), null.alias("authorship"), F.lit("family").alias("rank"), accepted()))
        .unionByName(customer.select(own.alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.when(kind >= 2, "Auth, 1900").alias("authorship"), F.lit("species").alias("rank"), accepted()))
        .unionByName(supplier.select(F.concat(F.lit("y"), "s_suppkey").alias("id"), F.concat(F.lit("c"), "s_suppkey").alias("parent_id"), F.col("s_name").alias("name"), null.alias("authorship"), F.lit("species").alias("rank"), accepted("SYNONYM")))
    )
    return hierarchy.hierarchy_sync(project, source, 5).usages.select("id", "parent_id", "authorship", "status", "name")
