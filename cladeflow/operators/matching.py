"""Matching names to an index and usages to usages, and stable ids over versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import index_key, normal_name
from ..functions.similarity import HEAD, ONE_IS_OTHER, damerau_distance, normal_name_similarity
from ..lineage import settle
from .metrics import dense_ids
from .tree import closure


def eligible(name: Column) -> Column:
    """Whether a name can be indexed: it holds a letter or digit."""
    return F.coalesce(name.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def build_index(names: DataFrame, column: str) -> DataFrame:
    """index_key and index_id, consecutive in key order, of all eligible names."""
    keys = names.filter(eligible(F.col(column))).select(index_key(F.col(column)).alias("index_key"))
    return dense_ids(keys, "index_key", out="index_id")


def match_index(names: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """`names` with index_id, null where the index lacks the name."""
    return names.withColumn("index_key", index_key(F.col(column))).join(index, "index_key", "left")


def extend_index(index: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The index with the names it lacks; new ids follow the highest."""
    keys = names.filter(eligible(F.col(column))).select(index_key(F.col(column)).alias("index_key"))
    missing = keys.join(index, "index_key", "left_anti")
    highest = index.agg(F.coalesce(F.max("index_id"), F.lit(0))).first()[0]
    return index.unionByName(dense_ids(missing, "index_key", start=highest + 1, out="index_id"))


def match_usages(queries: DataFrame, candidates: DataFrame, on: str = "index_key") -> DataFrame:
    """query_id, match_id and match_type for each query.

    Both sides: `on`, name, authorship, rank, status_ord; queries have query_id,
    candidates id. Candidates of another rank or with other authors are dropped.
    Of the rest, the same label comes first, then the same authors, accepted ones
    and the least id. EXACT: same label; VARIANT: same authors; CANONICAL: one
    side lacks authors; AMBIGUOUS: the order had to fall back on the id; NONE.

    Neither side's copies meet: candidates are first put together by what a query
    can ask for (a label, authors, or whether there are any), rank and status, and
    a query looks under each of these once.
    """
    lower = F.lower(F.coalesce("authorship", F.lit("")))
    nothing = F.lit(None).cast("string")

    def asked(kind: int, authors: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), authors.alias("authors"), name.alias("name"))

    bare = F.when(lower == "", "without").otherwise("with")
    other = F.when(lower == "", "with").otherwise("without")
    kinds = lambda side: F.explode(F.array(asked(0, lower, F.col("name")), asked(1, lower, nothing), asked(2, side, nothing))).alias("ask")
    c = candidates.select(F.col(on).alias("key"), "rank", "status_ord", "id", kinds(bare))
    c = c.groupBy("key", "ask", "rank", "status_ord").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    form = F.struct(F.col(on).alias("key"), lower.alias("authors"), "name", "rank")
    forms = queries.select(form.alias("form")).distinct().select("form", "form.key", "form.name", F.col("form.rank").alias("q_rank"), F.col("form.authors").alias("authorship"))
    q = forms.select("form", "key", "q_rank", kinds(other)).filter("ask.kind > 0 or ask.name is not null")
    ranks = F.col("q_rank").isNull() | F.col("rank").isNull() | (F.col("q_rank") == F.col("rank"))
    kept = q.join(c, ["key", "ask"]).filter(ranks).groupBy("form", F.col("ask.kind").alias("kind"), "status_ord")
    best = kept.agg(F.min("id").alias("id"), F.sum("n").alias("n")).groupBy("form").agg(F.min(F.struct("kind", "status_ord", "id", "n")).alias("best"))
    named = F.when(F.col("best.n") > 1, "AMBIGUOUS").otherwise(
        F.element_at(F.array(F.lit("EXACT"), F.lit("VARIANT"), F.lit("CANONICAL")), F.col("best.kind") + 1)
    )
    found = best.select("form", F.col("best.id").alias("match_id"), named.alias("match_type"))
    told = queries.select("query_id", form.alias("form")).join(found, "form", "left")
    return told.select("query_id", "match_id", F.coalesce("match_type", F.lit("NONE")).alias("match_type"))


def unique_rematch(subjects: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """subject_id and outcome: UPDATED with the one target of the same keys, AMBIGUOUS, or BROKEN."""
    found = targets.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias("target_id"))
    joined = subjects.join(found, keys, "left")
    outcome = F.when(F.col("_n") == 1, "UPDATED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("BROKEN")
    return joined.select("subject_id", F.when(F.col("_n") == 1, F.col("target_id")).alias("target_id"), outcome.alias("outcome"))


def stable_id_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1, and 5 for the status, 10 for the rank, 6 for the accepted name and 6 for the authorship; 0 if only one is misapplied."""
    same = lambda k, n: F.when(a[k].eqNullSafe(b[k]), n).otherwise(0)
    mixed = (a["status"] == "MISAPPLIED") != (b["status"] == "MISAPPLIED")
    total = 1 + same("status", 5) + same("rank", 10) + same("accepted", 6) + same("authorship", 6)
    return F.when(F.coalesce(mixed, F.lit(False)), 0).otherwise(total)


def assign_ids(scores: DataFrame) -> DataFrame:
    """id and old_id: within each bucket the best score is taken first, and each side once.

    scores: bucket, id, old_id, score. Equal scores go by old_id, then id. A
    bucket holds the names of one key.
    """

    def greedy(pdf):
        import pandas as pd

        taken, given, out = set(), set(), []
        for _, old, new in sorted(zip(-pdf["score"], pdf["old_id"], pdf["id"])):
            if old not in taken and new not in given:
                taken.add(old)
                given.add(new)
                out.append((new, old))
        return pd.DataFrame(out, columns=["id", "old_id"])

    schema = f"id {scores.schema['id'].dataType.simpleString()}, old_id {scores.schema['old_id'].dataType.simpleString()}"
    return scores.filter("score > 0").groupBy("bucket").applyInPandas(greedy, schema)


def id_report(before: DataFrame, after: DataFrame, archive: DataFrame) -> DataFrame:
    """id and outcome: CREATED, DELETED, RESURRECTED or KEPT, from tables of ids."""
    old, new, ever = (t.select("id").distinct() for t in (before, after, archive))
    both = old.withColumn("_o", F.lit(1)).join(new.withColumn("_n", F.lit(1)), "id", "full_outer")
    both = both.join(ever.withColumn("_e", F.lit(1)), "id", "left")
    outcome = (
        F.when(F.col("_n").isNull(), "DELETED")
        .when(F.col("_o").isNotNull(), "KEPT")
        .when(F.col("_e").isNotNull(), "RESURRECTED")
        .otherwise("CREATED")
    )
    return both.select("id", outcome.alias("outcome"))


def misspellings(names: DataFrame, block: list[str], distance: int = 1, swaps: bool = True) -> DataFrame:
    """a and b: pairs of ids within a block whose names differ by at most `distance` edits, swaps included or not.

    names: id, name and the block's columns. Names that so few edits part share a
    form that each becomes by leaving out at most as many letters; so only names
    with such a form meet, once however many ids have them, and are then compared.
    """
    on = [F.col(c).alias(f"b{i}") for i, c in enumerate(block)]
    blocks = [f"b{i}" for i in range(len(block))]
    rows = settle(names.filter("name is not null").select("id", "name", *on))
    forms = F.array("name")
    for _ in range(distance):
        shorter = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, shorter))))
    formed = rows.select(*blocks, "name").distinct().select(F.struct(*blocks).alias("block"), "name", F.explode(forms).alias("form"))
    other = formed.withColumnRenamed("name", "other")
    near = formed.join(other, ["block", "form"]).filter("name <= other").select("block", "name", "other").distinct()
    close = near.filter(F.levenshtein("name", "other", 2 * distance if swaps else distance) >= 0)
    found = close.filter(damerau_distance("name", "other") <= distance) if swaps else close
    found = settle(found)
    sided = lambda key, out: rows.select(F.struct(*blocks).alias("block"), F.col("name").alias(key), F.col("id").alias(out))
    one, two = sided("name", "x"), sided("other", "y")
    pairs = found.join(one, ["block", "name"]).join(two, ["block", "other"])
    told = pairs.filter((F.col("x") != F.col("y")) & ((F.col("name") != F.col("other")) | (F.col("x") < F.col("y"))))
    return told.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """id, other and similarity of names whose words are alike, at least `least`, which is above 5.

    left and right: id, name. Names are alike only if each word begins with the
    same letter, and words of less than four letters are the same; so only names
    with the same such beginnings meet, and names of unlike numbers of words don't.
    Equal names meet once, however many ids
    they have.
    """
    if least <= ONE_IS_OTHER:
        raise ValueError(f"the least similarity must be above {ONE_IS_OTHER}")
    words = F.split("normal", " ")
    block = F.array_join(F.transform(words, lambda w: F.when(F.length(w) < HEAD, w).otherwise(F.concat(F.substring(w, 1, 1), F.lit("*")))), " ")
    keyed = lambda df: settle(df.select("id", normal_name(F.col("name")).alias("normal")).filter("normal != ''"))
    own, others = keyed(left), keyed(right)
    names = lambda df, name: df.select("normal").distinct().withColumn("block", block).withColumnRenamed("normal", name)
    near = F.abs(F.length("a") - F.length("b")) <= 2 * F.size(F.split("a", " "))
    pairs = names(own, "a").join(names(others, "b"), "block").filter(near)
    scored = settle(pairs.select("a", "b", normal_name_similarity("a", "b").alias("similarity")).filter(F.col("similarity") >= least))
    return scored.join(own.withColumnRenamed("normal", "a"), "a").join(others.select(F.col("id").alias("other"), F.col("normal").alias("b")), "b").select("id", "other", "similarity")


def variant_groups(names: DataFrame, block: list[str]) -> DataFrame:
    """node and group of names that misspellings connect."""
    return closure(misspellings(names, block))


def homotypic_groups(names: DataFrame) -> DataFrame:
    """id and group_id: within family and stem, names fall into the first group with the same authors and near years.

    names: id, family, stem, team, year. Sorted by year and id; the years of a
    group lie within five of its first. A family's names of one stem are few.
    """

    def fit(pdf):
        pdf = pdf.sort_values(["year", "id"], na_position="last", kind="stable")
        groups, out = [], []
        for row in pdf.itertuples(index=False):
            team = tuple(row.team) if row.team is not None else ()
            for g in groups:
                near = row.year != row.year or g[2] != g[2] or abs(row.year - g[2]) <= 5
                if g[1] == team and near:
                    out.append(g[0])
                    break
            else:
                groups.append((row.id, team, row.year))
                out.append(row.id)
        pdf = pdf[["id"]].copy()
        pdf["group_id"] = out
        return pdf

    kind = names.schema["id"].dataType.simpleString()
    return names.groupBy("family", "stem").applyInPandas(fit, f"id {kind}, group_id {kind}")


def higher_match(paths: DataFrame, direct: DataFrame) -> DataFrame:
    """id and match of the nearest ancestor, itself included, that `direct` (id, match) has; see last_known()."""
    from .tree import last_known

    return last_known(paths, direct)


def ranked(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score))
    return rows.withColumn("rank", F.rank().over(w))
