"""Names: keys, similarity, matching, stable ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import similarity as sim
from ..functions.differences import longest_common_text
from ..operators import matching
from .registry import registrar, tables

REGISTRY, query = registrar()


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS edits,
  round(100.0 * (1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name))), 6) AS similar
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def edit_similarity(spark, folder):
    (nation,) = tables(spark, folder, "nation")
    other = nation.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), F.col("n_regionkey").alias("rb"))
    pairs = nation.withColumnRenamed("n_name", "a").join(other, (F.col("n_regionkey") == F.col("rb")) & (F.col("n_nationkey") < F.col("kb")))
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("edits"), F.round(sim.normal_levenshtein(F.col("a"), F.col("b")), 6).alias("similar"))


@query()
def damerau_and_jaro(spark, folder):
    """Measures that run as Arrow batches, on pairs of part names within a block; see the tests."""
    (part,) = tables(spark, folder, "part")
    names = part.select("p_name", "p_type").distinct()
    other = names.select(F.col("p_name").alias("b"), F.col("p_type").alias("t"))
    pairs = names.join(other, (F.col("p_type") == F.col("t")) & (F.col("p_name") < F.col("b")))
    return pairs.select(F.col("p_name").alias("a"), "b", sim.damerau_distance("p_name", "b").alias("edits"), sim.jaro_winkler_similarity("p_name", "b").alias("jaro"))


@query("""WITH k AS (SELECT DISTINCT p_name AS name, lower(p_name) AS k FROM part)
  SELECT name, dense_rank() OVER (ORDER BY k) AS index_id FROM k""")
def names_index(spark, folder):
    """Names with the ids of an index of their keys; the words of these names keep their order when stemmed."""
    (part,) = tables(spark, folder, "part")
    rows = part.select(F.col("p_name").alias("name")).distinct()
    return matching.match_index(rows, "name", matching.build_index(rows, "name")).select("name", F.col("index_id").cast("long").alias("index_id"))


@query("""WITH c AS (SELECT p_name, p_brand, min(p_partkey) AS id, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
  SELECT q.p_partkey AS query_id, c.id AS match_id, CASE WHEN c.id IS NULL THEN 'NONE' WHEN c.n > 1 THEN 'AMBIGUOUS' ELSE 'EXACT' END AS match_type
  FROM part q LEFT JOIN c ON c.p_name = q.p_name AND c.p_brand = q.p_brand WHERE q.p_partkey % 2 = 1""")
def usage_matching(spark, folder):
    """Parts of odd key matched to those of even key; the brand stands for the authorship."""
    (part,) = tables(spark, folder, "part")
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("authorship"),
        F.lit("species").alias("rank"), F.lit(0).alias("status_ord"), n.index_key(F.col("p_name")).alias("index_key"),
    )
    odd = rows.filter("id % 2 = 1").withColumnRenamed("id", "query_id")
    return matching.match_usages(odd, rows.filter("id % 2 = 0"))


@query("""WITH t AS (SELECT p_name, min(p_partkey) AS id, count(*) AS n FROM part WHERE p_partkey < 500 GROUP BY 1)
  SELECT p_partkey AS subject_id, CASE WHEN n = 1 THEN id END AS target_id, CASE WHEN n = 1 THEN 'UPDATED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'BROKEN' END AS outcome
  FROM part LEFT JOIN t USING (p_name) WHERE p_partkey >= 500""")
def unique_rematch(spark, folder):
    (part,) = tables(spark, folder, "part")
    targets = part.filter("p_partkey < 500").select(F.col("p_partkey").alias("id"), "p_name")
    subjects = part.filter("p_partkey >= 500").select(F.col("p_partkey").alias("subject_id"), "p_name")
    return matching.unique_rematch(subjects, targets, ["p_name"])


@query("""SELECT bucket, max(score)::INTEGER AS best, count(*) AS pairs FROM (
    SELECT a.p_name AS bucket, 13 + CASE WHEN a.p_brand = b.p_brand THEN 5 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 10 ELSE 0 END AS score
    FROM part a JOIN part b USING (p_name) WHERE a.p_partkey >= 1000 AND b.p_partkey < 1000) GROUP BY 1""")
def stable_id_scores(spark, folder):
    """Scores of new names against old ids within a bucket of one key."""
    return _best(_scored(spark, folder))


@query("""SELECT score, count(*) AS pairs FROM (
    SELECT 13 + CASE WHEN a.p_brand = b.p_brand THEN 5 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 10 ELSE 0 END AS score
    FROM part a JOIN part b USING (p_name) WHERE a.p_partkey >= 1000 AND b.p_partkey < 1000) GROUP BY 1""")
def stable_id_scores_all(spark, folder):
    """How many pairs have each score."""
    return _scored(spark, folder).groupBy("score").agg(F.count("*").alias("pairs"))


def _best(pairs):
    return pairs.groupBy("bucket").agg(F.max("score").alias("best"), F.count("*").alias("pairs"))


def _scored(spark, folder):
    (part,) = tables(spark, folder, "part")
    new = part.filter("p_partkey >= 1000").select(F.col("p_name").alias("bucket"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("s1"), F.col("p_type").alias("r1"))
    old = part.filter("p_partkey < 1000").select(F.col("p_name").alias("bucket"), F.col("p_partkey").alias("old_id"), F.col("p_brand").alias("s2"), F.col("p_type").alias("r2"))
    same = F.lit("x")
    score = matching.stable_id_score(
        {"status": F.col("s1"), "rank": F.col("r1"), "accepted": same, "authorship": same},
        {"status": F.col("s2"), "rank": F.col("r2"), "accepted": same, "authorship": same},
    )
    return new.join(old, "bucket").withColumn("score", score)


@query()
def stable_id_assignment(spark, folder):
    """Old ids given to new names, the best scores first; see the tests."""
    return matching.assign_ids(_scored(spark, folder))


@query("""WITH o AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0), w AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0), e AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0)
  SELECT coalesce(o.id, w.id) AS id, CASE WHEN w.id IS NULL THEN 'DELETED' WHEN o.id IS NOT NULL THEN 'KEPT' WHEN e.id IS NOT NULL THEN 'RESURRECTED' ELSE 'CREATED' END AS outcome
  FROM o FULL JOIN w ON o.id = w.id LEFT JOIN e ON e.id = coalesce(o.id, w.id)""")
def stable_id_report(spark, folder):
    (part,) = tables(spark, folder, "part")
    rows = part.select(F.col("p_partkey").alias("id"))
    return matching.id_report(rows.filter("id % 3 != 0"), rows.filter("id % 4 != 0"), rows.filter("id % 2 = 0"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND levenshtein(a.s_name, b.s_name) <= 1""")
def misspelled_pairs(spark, folder):
    """Names within a block that differ by an edit; these have no swapped letters."""
    (supplier,) = tables(spark, folder, "supplier")
    rows = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    return matching.misspellings(rows, ["s_nationkey"], swaps=False)


@query()
def homotypic_groups(spark, folder):
    """Names that fall together by authors and near years; see the tests."""
    (part,) = tables(spark, folder, "part")
    rows = part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), n.stem_epithet(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("stem"),
        n.author_team(F.col("p_brand")).alias("team"), (1750 + F.col("p_size")).alias("year"),
    )
    return matching.homotypic_groups(rows)


@query("""SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' '))::INTEGER AS words FROM part""")
def canonical_forms(spark, folder):
    (part,) = tables(spark, folder, "part")
    words = F.split(n.normal_name(F.col("p_name")), " ")
    return part.select("p_partkey", F.get(words, F.lit(0)).alias("first_word"), F.size(words).alias("words"))




@query("""WITH pairs AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part),
  pieces AS (SELECT a, b, s, l, substr(b, s, l) AS piece FROM pairs, (SELECT unnest(range(1, 40)) AS s), (SELECT unnest(range(1, 40)) AS l) WHERE s + l - 1 <= length(b)),
  best AS (SELECT a, b, arg_max(piece, l * 100 - s) AS common FROM pieces WHERE contains(a, piece) GROUP BY a, b)
  SELECT p_partkey, coalesce(common, '') AS common FROM part LEFT JOIN best ON a = p_name AND b = lower(p_type)""")
def common_parts(spark, folder):
    """The longest text that a part's name and type share; worked out once for each pair of them."""
    (part,) = tables(spark, folder, "part")
    pairs = part.select("p_name", "p_type").distinct().withColumn("common", longest_common_text("p_name", F.lower("p_type")))
    return part.select("p_partkey", "p_name", "p_type").join(pairs, ["p_name", "p_type"]).select("p_partkey", "common")
