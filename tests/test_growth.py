"""Steps whose work must follow the input: results on many copies, and the rows that plans pass on."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cladeflow import queries as lists
from cladeflow.operators import joins, matching, tree


def most_rows(df) -> int:
    """The most rows that any operator of the plan put out, as the run before counted them."""

    def walk(plan):
        metric = plan.metrics().get("numOutputRows")
        yield metric.get().value() if metric.isDefined() else 0
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(plan.plan())
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))


def brute_matches(queries, candidates):
    """What match_usages() tells, pair by pair; rows: id, key, name, authorship, rank, and status for candidates."""
    out = {}
    for i, key, name, by, rank in queries:
        found = []
        for j, k, n, b, r, status in candidates:
            same, none = (by or "").lower() == (b or "").lower(), not by or not b
            if key is not None and key == k and (rank is None or r is None or rank == r) and (same or none):
                label = same and name is not None and name == n
                found.append((0 if label else 1 if same else 2, status, j))
        found.sort()
        tie = len(found) > 1 and found[0][:2] == found[1][:2]
        out[i] = (found[0][2], "AMBIGUOUS" if tie else ("EXACT", "VARIANT", "CANONICAL")[found[0][0]]) if found else (None, "NONE")
    return out


def test_match_usages_of_many_copies(spark):
    names, authors, ranks = ["a b", "A b", None], ["L.", "l.", "Mill.", "", None], ["species", "genus", None]
    rows = [(i, "kx"[i % 29 == 0], names[i % 3], authors[i // 3 % 5], ranks[i // 15 % 3]) for i in range(1, 90)] + [(90, None, "a b", "L.", None)]
    candidates = [(i + 1000, *r, i % 3 % 2) for i, *r in rows[::4]] + [(5000, "x", "a b", "", "genus", 0)]
    q = spark.createDataFrame(rows, "query_id long, index_key string, name string, authorship string, rank string")
    c = spark.createDataFrame(candidates, "id long, index_key string, name string, authorship string, rank string, status_ord int")
    got = {r["query_id"]: (r["match_id"], r["match_type"]) for r in matching.match_usages(q, c).collect()}
    assert got == brute_matches(rows, candidates)
    copies = lambda df, key: df.crossJoin(spark.range(40).withColumnRenamed("id", "i")).withColumn(key, df[key] + 10000 * F.col("i")).drop("i")
    many = matching.match_usages(copies(q, "query_id"), copies(c, "id"))
    assert len(many.collect()) == 40 * len(rows)
    assert most_rows(many) <= 3 * 40 * len(rows)


def test_chosen_candidates_form_no_pairs(spark, tmp_path):
    rows = [(i, "ab"[i % 2000 // 1000], "B", "UVW"[i // 2 % 7 % 3], i // 3 % 50) for i in range(4000)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    made = lists.queries()["chosen_candidates"](spark, str(tmp_path))
    got = {tuple(r) for r in made.select("query", "match", "match_type", "n").collect()}
    found = duckdb.connect()
    found.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = set(found.execute(f"SELECT query, match, match_type, n FROM ({lists.oracle_sql()['chosen_candidates']})").fetchall())
    assert got == want and len(got) == 2000
    assert most_rows(made) <= 20000


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1] and a[i - 1] != b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_misspellings_by_shared_forms(spark):
    names = ["", "a", "ab", "ba", "abc", "acb", "abcd", "abd", "xbcd", "ab", "badc", None, "abcd"]
    rows = [(i, n, k) for k, base in ((1, 0), (2, 50), (None, 100)) for i, n in enumerate(names, base)]
    df = spark.createDataFrame(rows, "id long, name string, block int")
    for distance in (1, 2):
        want = {(i, j) for i, a, k in rows for j, b, m in rows if i < j and k == m and None not in (a, b) and edits(a, b) <= distance}
        got = [tuple(r) for r in matching.misspellings(df, ["block"], distance).collect()]
        assert set(got) == want and len(got) == len(want)


def test_misspelled_pairs_of_one_block(spark):
    """Names far apart must not meet, though all stand in one block."""
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("name"), F.lit(1).alias("block"))
    made = matching.misspellings(rows, ["block"], swaps=False)
    assert made.collect() == []
    assert most_rows(made) < 200000


def told_by_sql(name, folder, *tables):
    found = duckdb.connect()
    for t in tables:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return Counter(found.execute(lists.oracle_sql()[name]).fetchall())


def test_dataset_counts_copy_no_rows(spark, tmp_path):
    items = spark.range(20000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id * 7 % 500 AS l_partkey", "id % 37 AS l_suppkey", "'R' AS l_returnflag")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(400).selectExpr("id AS p_partkey", "concat('n', id % 9) AS p_name", "'b' AS p_brand", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    made = lists.queries()["dataset_name_counts"](spark, str(tmp_path))
    got = Counter(tuple(r) for r in made.select("dataset_key", "usages", "names", "canonical").collect())
    assert got == told_by_sql("dataset_name_counts", tmp_path, "lineitem", "part")
    assert most_rows(made) <= 20000


def test_substring_search_meets_each_text_once(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS p_partkey", "concat('lárge Ring', id % 2) AS p_name", "concat('SMALL', id % 3) AS p_type")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    made = lists.queries()["substring_search"](spark, str(tmp_path))
    got = {r["pattern"]: (r["n"], r["first"], r["last"]) for r in made.collect()}
    assert got["rge ri"] == (3000, 0, 2999) and got["ng1 of smal"] == (1500, 1, 2999)
    assert most_rows(made) <= 300


def test_blocked_pairs_spread_a_large_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 100)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 50000)
    sizes = {("b", "t", 1): 1500, ("b", "u", 2): 3, ("c", "t", 1): 1, ("d", None, 1): 3}
    rows = [(i, *k) for i, k in enumerate(k for k, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    made = lists.queries()["blocked_pairs"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in made.collect()) == told_by_sql("blocked_pairs", tmp_path, "part")
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1500 * 1499 / 2 / 2


def test_no_pairs(spark):
    assert joins.pairs_within(spark.range(5), "id", ["id"]).collect() == []


def test_closure_rounds_hold_moved_nodes_alone(spark, monkeypatch):
    """Nodes that stay what they are need no row in a round; results as by union-find."""
    held, plain = [], tree.settle
    monkeypatch.setattr(tree, "settle", lambda df, *a: held.append(plain(df, *a)) or held[-1])
    edges = [(f"O{i}", f"P{i * j % 97}") for i in range(600) for j in (1, 5)] + [("x", "x"), ("x", "x"), ("y", "x"), (None, "z")]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(30)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = [tuple(r) for r in tree.closure(spark.createDataFrame(edges, "a string, b string")).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in list(up))
    pointers = [df for df in held if df.columns == ["node", "to"]]
    assert pointers and all(df.filter("node = to").isEmpty() for df in pointers)
