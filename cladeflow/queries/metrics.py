"""Counts, count maps, duplicates, breakdowns, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as f
from ..operators import metrics as m
from ..streaming import events as ev
from .registry import registrar, tables

REGISTRY, query = registrar()


@query("""SELECT 'l_linestatus' AS metric, l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2""")
def grouped_counts(spark, folder):
    """Several breakdowns in one scan."""
    (items,) = tables(spark, folder, "lineitem")
    return m.group_counts(items, ["l_linestatus", "l_returnflag", "l_linenumber"])


@query("""SELECT count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem""")
def entity_counts(spark, folder):
    (items,) = tables(spark, folder, "lineitem")
    conditions = {"items": F.lit(True), "returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.05}
    return m.entity_counts(items, conditions)


@query("""SELECT o_orderstatus, o_orderpriority AS entry, sum(n)::BIGINT AS n FROM (SELECT o_custkey % 10 AS g, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1, 2""")
def count_map_roll_up(spark, folder):
    """Count maps of sectors added up by source."""
    (orders,) = tables(spark, folder, "orders")
    counts = orders.groupBy((F.col("o_custkey") % 10).alias("g"), "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = counts.groupBy("g", "o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("counts"))
    return m.sum_maps(maps, ["o_orderstatus"], "counts")


@query("""WITH a AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
  b AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority < '4' GROUP BY 1)
  SELECT key, (coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS n FROM a FULL JOIN b USING (key)""")
def count_map_sum(spark, folder):
    """Key-wise sum of two count maps."""
    (orders,) = tables(spark, folder, "orders")
    side = lambda c: m.group_counts(orders.filter(c), ["o_orderpriority"]).agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
    a, b = side("o_orderstatus = 'F'"), side("o_orderstatus = 'P' and o_orderpriority < '4'").withColumnRenamed("counts", "more")
    both = a.crossJoin(b)  # a row each
    return both.select(F.explode(f.add_counts(F.col("counts"), F.col("more"))).alias("key", "n"))


@query("""SELECT o_orderstatus, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS top, max(n) AS n FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def top_value(spark, folder):
    """The most frequent key of each count map."""
    (orders,) = tables(spark, folder, "orders")
    counts = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("c"))
    best = F.get(f.counts_sorted(F.col("c")), F.lit(0))
    return maps.select("o_orderstatus", best["key"].alias("top"), best["value"].alias("n"))


@query("""SELECT p_name || '|' || p_type AS key, count(*) AS n, array_to_string(list_sort(list(p_partkey)), ',') AS ids FROM part GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p_brand) = count(*)""")
def strict_duplicates(spark, folder):
    """Equal names and types whose brands all differ."""
    (part,) = tables(spark, folder, "part")
    rows = m.duplicates(part, F.concat_ws("|", "p_name", "p_type"), "p_partkey", 3, all_different=["p_brand"])
    return rows.select("key", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT upper(regexp_replace(s_name, '[^A-Za-z]+', '', 'g')) AS key, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 2""")
def fuzzy_duplicates(spark, folder):
    (supplier,) = tables(spark, folder, "supplier")
    key = F.upper(F.regexp_replace("s_name", "[^A-Za-z]+", ""))
    return m.duplicates(supplier, key, "s_suppkey").select("key", "n")


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand) > 1 AS repeated FROM part""")
def repeated_rows_flag(spark, folder):
    (part,) = tables(spark, folder, "part")
    return m.flag_repeats(part, ["p_name", "p_brand"]).select("p_partkey", "repeated")


@query("""SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def homonyms(spark, folder):
    (part,) = tables(spark, folder, "part")
    return part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH c AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)
  SELECT 'N' || n_nationkey AS "group", 'R' || n_regionkey AS parent, n FROM c
  UNION ALL SELECT 'R' || n_regionkey, NULL, sum(n)::BIGINT + 5 FROM c GROUP BY n_regionkey
  UNION ALL SELECT 'R' || r_regionkey || ' unknown', 'R' || r_regionkey, 5 FROM region""")
def breakdown_with_remainder(spark, folder):
    """Groups rolled up, with an unknown child for what children don't cover."""
    region, nation, customer = tables(spark, folder, "region", "nation", "customer")
    n = F.concat(F.lit("N"), "n_nationkey")
    r = lambda c: F.concat(F.lit("R"), c)
    parents = nation.select(n.alias("group"), r("n_regionkey").alias("parent"), F.lit(2).alias("level")).unionByName(
        region.select(r("r_regionkey").alias("group"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"))
    )
    counts = customer.groupBy(F.concat(F.lit("N"), "c_nationkey").alias("group")).agg(F.count("*").alias("n"))
    own = region.select(r("r_regionkey").alias("group"), F.lit(5).cast("long").alias("n"))
    return m.breakdown(counts.unionByName(own), parents)


@query("""SELECT p_partkey, p_size > min(p_size) OVER (PARTITION BY p_name) AS provisional FROM part""")
def provisional_by_priority(spark, folder):
    """Rows that another of the same name outranks."""
    (part,) = tables(spark, folder, "part")
    return m.worse_than_best(part, ["p_name"], "p_size").select("p_partkey", "provisional")


@query("""SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def best_per_group(spark, folder):
    (part,) = tables(spark, folder, "part")
    return m.best_by_priority(part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")]).filter("best").select("p_partkey")


@query("""SELECT name, row_number() OVER (ORDER BY name) AS new_id FROM (SELECT DISTINCT p_name AS name FROM part)""")
def dense_ids(spark, folder):
    """Consecutive ids of distinct keys, numbered by range."""
    (part,) = tables(spark, folder, "part")
    return m.dense_ids(part.select(F.col("p_name").alias("name")), "name")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def priced_summary(spark, folder):
    (items,) = tables(spark, folder, "lineitem")
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count("*").alias("n"),
    )


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY 1""")
def aggregated_lists(spark, folder):
    """Distinct values gathered by key, and nulls left out."""
    (orders,) = tables(spark, folder, "orders")
    return orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@query("""SELECT c.c_custkey, sum(l_quantity)::BIGINT AS qty FROM customer c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'MACHINERY' GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 20""")
def joined_top_k(spark, folder):
    customer, orders, items = tables(spark, folder, "customer", "orders", "lineitem")
    rows = customer.filter("c_mktsegment = 'MACHINERY'").join(orders, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(items, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("c_custkey")
    return rows.agg(F.sum("l_quantity").cast("long").alias("qty")).orderBy(F.desc("qty"), "c_custkey").limit(20)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_events(spark, folder):
    """Counts by hour and type, as a stream would give them."""
    (events,) = tables(spark, folder, "events")
    return ev.windowed_counts(events, "ts", ["event_type"], "1 hour").select("start", "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS first, max(ts) + INTERVAL '2 hours' AS due, count(*) AS n FROM s GROUP BY user_id, k""")
def debounced_events(spark, folder):
    """Bursts of each user's events."""
    (events,) = tables(spark, folder, "events")
    return ev.debounced(events, "ts", "user_id", "2 hours")


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1""")
def latest_change(spark, folder):
    (events,) = tables(spark, folder, "events")
    return ev.latest_changes(events, "user_id", "ts", ["event_type"])


@query("""SELECT event_id, event_type FROM events WHERE event_id > 9000""")
def incremental_catch_up(spark, folder):
    (events,) = tables(spark, folder, "events")
    return ev.catch_up(events, "event_id", 9000)[0].select("event_id", "event_type")
