"""Filters, facets, orders, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import settle
from ..operators import predicates as p
from ..operators import search as s
from ..operators import trigrams
from .registry import nodes, registrar, tables

REGISTRY, query = registrar()

_FACETS = """
  SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus IN ('F') GROUP BY 2"""


@query(f"""SELECT facet, value, n, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS place FROM ({_FACETS})) WHERE place <= 10""")
def facet_search(spark, folder):
    """Two facets, each under the other's filter."""
    (orders,) = tables(spark, folder, "orders")
    chosen = {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}
    return s.facets(orders, chosen, ["o_orderstatus", "o_orderpriority"])


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
  WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IS NOT NULL AND o_totalprice BETWEEN 1000 AND 200000
  ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderpriority, o_orderkey LIMIT 50 OFFSET 10""")
def filter_sort_page(spark, folder):
    """Filters on values, presence and a range; taxonomic order; a page."""
    (orders,) = tables(spark, folder, "orders")
    keep = p.conjunction({"o_orderstatus": ["F", "P"], "o_orderpriority": [p.NOT_NULL]})
    status = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("status")
    found = orders.filter(keep & F.col("o_totalprice").between(1000, 200000)).withColumn("status", status)
    ordered = found.orderBy(*s.taxonomic_order("status", "o_orderpriority", "o_orderkey"))
    return p.page(ordered, 50, 10).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("""SELECT id, name, rank_ord FROM (WITH """ + """{nodes} SELECT * FROM nodes WHERE rank_ord BETWEEN 1 AND 2 AND upper(name[1]) = 'S')""")
def rank_range_alpha_index(spark, folder):
    """Ranks between two, by the first letter of the name."""
    found = nodes(spark, folder).filter(p.rank_between(F.col("rank_ord"), lowest=2, highest=1) & p.alpha_index(F.col("name"), "s"))
    return found.select("id", "name", "rank_ord")


@query("""SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type IN ('error')""")
def null_or_value_filter(spark, folder):
    (events,) = tables(spark, folder, "events")
    return events.filter(p.matches("event_type", [p.NULL, "error"])).select("event_id", "event_type")


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0""")
def nested_decision_filter(spark, folder):
    """Customers with an urgent entry among nested structs of one status."""
    (orders,) = tables(spark, folder, "orders")
    decision = F.struct(F.col("o_orderstatus").alias("project"), F.col("o_orderpriority").alias("mode"))
    nested = orders.groupBy("o_custkey").agg(F.collect_list(decision).alias("decisions"))
    own = F.filter("decisions", lambda d: d["project"] == "O")
    return nested.filter(p.decided(F.col("decisions"), "O", ["1-URGENT"])).select("o_custkey", F.size(own).cast("long").alias("n"))


@query("""SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|small) .*(ring|widget)$')""")
def regex_search(spark, folder):
    (part,) = tables(spark, folder, "part")
    return part.filter(F.col("p_name").rlike("^(red|small) .*(ring|widget)$")).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red widget' THEN 20.0 WHEN p_name LIKE '%red%' AND regexp_matches(p_name, '(^| )red( |$)') AND regexp_matches(p_name, '(^| )widget') THEN 10.0
  ELSE 5.0 END * 1.1 AS score FROM part WHERE lower(p_name) = 'red widget' OR (regexp_matches(p_name, '(^| )red( |$)') AND regexp_matches(p_name, '(^| )widget'))""")
def name_query_scores(spark, folder):
    """Whole names before word matches; accepted names score more."""
    (part,) = tables(spark, folder, "part")
    score = s.name_score(F.col("p_name"), "red widget", F.lit(True))
    return part.select("p_partkey", "p_name", score.alias("score")).filter("score >= 11")


@query("""WITH words AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS t FROM part)
  SELECT DISTINCT p_partkey, p_name FROM words WHERE t[1:2] = 'wi' AND levenshtein(t, 'widgte') <= 2""")
def fuzzy_name_query(spark, folder):
    """Words that share two letters with the query and differ by two edits at most."""
    (part,) = tables(spark, folder, "part")
    return part.filter(s.name_score(F.col("p_name"), "widgte", F.lit(False)) > 0).select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name, round(1.1 + 100.0 / (p_size + 1), 6) AS score FROM part WHERE regexp_matches(p_name, '(^| )giz')
  ORDER BY 1.1 + 100.0 / (p_size + 1) DESC, p_name, p_partkey LIMIT 5""")
def suggest_top_k(spark, folder):
    (part,) = tables(spark, folder, "part")
    found = part.filter(F.col("p_name").rlike("(^| )giz"))
    best = s.suggest(found, "p_name", "giz", F.lit(True), F.col("p_size"), k=1000)
    rows = best.orderBy(F.desc("score"), "p_name", "p_partkey").limit(5)
    return rows.select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@query("""SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, key LIMIT 3 OFFSET 1""")
def facet_page(spark, folder):
    """Facet values from a minimum count on, paged."""
    (orders,) = tables(spark, folder, "orders")
    rows = orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n")).filter("n >= 100")
    return p.page(rows.orderBy(F.desc("n"), "key"), 3, 1)


@query("""SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0""")
def json_property_counts(spark, folder):
    """A property of JSON documents, counted."""
    (events,) = tables(spark, folder, "events")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def _fill():
    from .registry import NODES_SQL

    for name, (run, sql) in REGISTRY.items():
        if sql and "{nodes}" in sql:
            REGISTRY[name] = (run, sql.replace("{nodes}", NODES_SQL))


_fill()


@query("""WITH texts AS (SELECT p_partkey, lower(p_name || ' of ' || p_type) AS t FROM part),
  patterns AS (SELECT DISTINCT lower(substr(p_name, 3, 6)) AS p FROM part UNION SELECT DISTINCT lower(right(p_name, 3) || ' of ' || left(p_type, 4)) FROM part)
  SELECT p AS pattern, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM patterns JOIN texts ON contains(t, p) GROUP BY p""")
def substring_search(spark, folder):
    """Texts that hold a pattern, by its rarest trigram; patterns are pieces of the names themselves.

    Rows of one text are found as one, and then counted.
    """
    (part,) = tables(spark, folder, "part")
    own = part.select("p_partkey", F.concat_ws(" of ", "p_name", "p_type").alias("key"), "p_name", "p_type")
    texts = settle(own.groupBy("key", "p_name", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last")))
    piece = F.concat(F.substring("p_name", -3, 3), F.lit(" of "), F.substring("p_type", 1, 4))
    patterns = texts.select(F.lower(F.substring("p_name", 3, 6)).alias("pattern")).union(texts.select(F.lower(piece))).distinct()
    whole = texts.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    found = trigrams.search(settle(trigrams.index_of(whole, "key", "key")), patterns)
    return found.join(whole, "key").groupBy("pattern").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
