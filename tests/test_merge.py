"""Merging of trees against a walk that takes one row after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_authorship import loop
from test_candidates import in_turn

from cladeflow.plans.merge import USAGE, merge_sector, merge_sectors, provisional_homonyms
from cladeflow.vocab import RANKS, VAGUE_RANKS

SCHEMA = "id string, parent_id string, name string, authorship string, rank string, status string, sector int"
SYN = ("SYNONYM", "AMBIGUOUS_SYNONYM", "MISAPPLIED")


def authors(x):
    if x is None:
        return ([], None, None)
    *people, last = x.split(", ")
    return (people, None, last) if last.isdigit() else ([*people, last], None, None)


class Tree:
    def __init__(self, rows):
        self.by_id = {r[0]: dict(zip(USAGE, r)) for r in rows}

    def path(self, i):
        out = []
        while i is not None:
            if i in [u["id"] for u in out] or i not in self.by_id:
                return None
            out.insert(0, self.by_id[i])
            i = out[0]["parent_id"]
        return out


def place(u):
    return RANKS.index(u["rank"]) if u["rank"] in RANKS else len(RANKS)


def one_by_one(project, source, sector, target=None, blocked=(), protected=()):
    """(usages, outcomes): levels from above; within a level all rows see what was there before it."""
    src, prj = Tree(source), Tree(project)
    paths = {i: prj.path(i) for i in prj.by_id}
    index = [{**prj.by_id[i], "path": p} for i, p in paths.items() if p is not None and prj.by_id[i]["status"] != "BARE_NAME"]
    state, outcomes, changes, made = {}, {}, {}, []
    by_level: dict = {}
    for i in src.by_id:
        if (p := src.path(i)) is not None:
            by_level.setdefault(len(p), []).append(i)
    root_path = paths.get(target) or []
    for level in sorted(by_level):
        created: dict = {}
        later = []
        for i in sorted(by_level[level]):
            u, path = src.by_id[i], src.path(i)
            up = state[u["parent_id"]] if u["parent_id"] is not None else {"own": None, "path": root_path}
            ranks = [place(x) for x in path if x["status"] not in SYN and x["rank"] not in VAGUE_RANKS and x["rank"] is not None]
            bad = ranks != sorted(set(ranks))
            syn, vague = u["status"] in SYN, u["rank"] is None or u["rank"] in VAGUE_RANKS
            qualified = u["authorship"] is not None and u["rank"] != "unranked" and u["rank"] is not None
            cands = []
            for c in index:
                if c["name"].lower() != u["name"].lower():
                    continue
                if not (vague or c["rank"] is None or c["rank"] in VAGUE_RANKS or c["rank"] == u["rank"]):
                    continue
                equal = loop(authors(u["authorship"]), authors(c["authorship"]))
                names = lambda q: {(place(x), x["name"].lower()) for x in q}
                common = max((r for r, n in names(path[:-1]) & names(c["path"][:-1])), default=None)
                family = lambda q: next((x["name"].lower() for x in q if x["rank"] == "family"), None)
                cands.append(dict(
                    candidate=c["id"], c=c, qualified=qualified, authored=c["authorship"] is not None, equal=equal, status=c["status"],
                    label=c["name"].lower() == u["name"].lower() and (c["authorship"] or "").lower() == (u["authorship"] or "").lower(),
                    accepted=c["parent_id"] if c["status"] in SYN else None, common=common, lowest=place(c["path"][-2]) if len(c["path"]) > 1 else None,
                    family=family(path) is not None and family(path) == family(c["path"]),
                ))
            if not vague and any(c["c"]["rank"] == u["rank"] for c in cands):
                cands = [c for c in cands if c["c"]["rank"] == u["rank"]]
            if qualified and u["rank"] in ("species", "subspecies"):
                cands = [c for c in cands if not c["authored"] or c["equal"] == "EQUAL"]
            if qualified and u["rank"] == "genus":
                cands = [c for c in cands if not c["authored"] or c["equal"] != "DIFFERENT" or c["family"]]
            if u["rank"] == "unranked":
                cands = [c for c in cands if c["c"]["rank"] != "genus"]
            best, kind = in_turn(cands) if cands else (None, "NONE")
            match = next((c["c"] for c in cands if c["candidate"] == best), None)
            higher = [x for x in up["path"] if vague or place(x) < place(u)]
            parent = up["own"] if syn else (higher[-1]["id"] if higher else None)
            part = match is not None and match["sector"] == sector and (syn or match["status"] in SYN) and (parent is None or parent not in (match["parent_id"], match["id"]))
            ambiguous = match is not None and kind == "AMBIGUOUS" and not part
            if part or kind == "AMBIGUOUS":
                match = None
            where = match["path"] if match else up["path"]
            anchor = up["path"][-1]["id"] if up["path"] else None
            if bad:
                out = "DOUBTFUL"
            elif i in blocked:
                out = "BLOCKED"
            elif u["rank"] in (None, "unranked"):
                out = "IGNORED"
            elif {x["id"] for x in where} & set(protected):
                out = "PROTECTED"
            elif match:
                out = "MATCHED"
            elif ambiguous:
                out = "AMBIGUOUS"
            elif (parent is None and (syn or anchor is not None)) or (u["rank"] == "genus" and u["authorship"] is None and anchor is None and not syn):
                out = "IGNORED"
            else:
                out = "CREATED"
            usage = match["id"] if out == "MATCHED" else None
            new = None
            if out == "CREATED":
                group = (u["name"].lower(), u["rank"], (u["authorship"] or "").lower(), syn, parent if syn else "")
                if group in created:
                    out = "REPEATED"
                else:
                    keep = up["path"]
                    if parent in [x["id"] for x in keep]:
                        keep = keep[: [x["id"] for x in keep].index(parent) + 1]
                    else:
                        keep = []
                    n = dict(zip(USAGE, (f"{sector}:{i}", parent, u["name"], u["authorship"], u["rank"], u["status"], sector)))
                    created[group] = {**n, "path": [*keep, n]}
                new = created[group]
                usage = new["id"]
            outcomes[i] = (out, usage)
            if match and not bad:
                own, p = (match["parent_id"], match["path"][:-1]) if match["status"] in SYN else (match["id"], match["path"])
            elif new and not syn:
                own, p = new["id"], new["path"]
            else:
                own, p = None, up["path"]
            state[i] = {"own": own, "path": p}
            if out == "MATCHED":
                later.append((i, u, match, up["path"], anchor))
        for i, u, m, p, anchor in later:
            if m["authorship"] is None and u["authorship"] is not None and (u["status"] in SYN) == (m["status"] in SYN):
                changes.setdefault((m["id"], "authorship"), (i, u["authorship"]))
            if u["status"] not in SYN and m["status"] not in SYN and anchor is not None and len(m["path"]) > 1:
                ids = [x["id"] for x in p]
                if place(m["path"][-2]) < place(p[-1]) < place(m) and m["parent_id"] in ids and m["id"] not in ids and anchor != m["parent_id"]:
                    changes.setdefault((m["id"], "parent_id"), (i, anchor))
        index += created.values()
        made += created.values()
    usages = [dict(u) for u in prj.by_id.values()]
    for u in usages:
        for field in ("authorship", "parent_id"):
            if (u["id"], field) in changes:
                u[field] = min(x for k, x in changes.items() if k == (u["id"], field))[1]
    return sorted((tuple(u[c] for c in USAGE) for u in [*usages, *made]), key=repr), outcomes


def random_tree(r, prefix, n, sector=None):
    ranks = ["order", "suborder", "family", "genus", "species", "unranked"]
    rows: list = []
    for k in range(n):
        parent = r.choice([*rows[-25:], None]) if rows else None
        while parent is not None and parent[5] in SYN:
            parent = r.choice([*rows, None])
        at = ranks.index(parent[4]) if parent else -1
        rank = r.choice(ranks[min(at + 1, 4) :] if r.random() < 0.93 else ranks)
        syn = parent is not None and r.random() < 0.2
        name = r.choice(["Abax", "Brut", "Crix", "Dolm", "Evan", "Fint", "Gorb", "Hilt"]) + r.choice(["", "", "or", "ul"])
        rows.append((f"{prefix}{k:03}", parent[0] if parent else None, name, r.choice([None, "Smith", "Smith, 1900", "Brown, 1850", "Miller"]), rank, "SYNONYM" if syn else r.choice(["ACCEPTED", "ACCEPTED", "PROVISIONALLY_ACCEPTED"]), sector))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_a_walk(spark, seed):
    r = random.Random(seed)
    project, source = random_tree(r, "p", 70, 0), random_tree(r, "s", 120)
    target, blocked, protected = project[0][0], [source[5][0], source[60][0]], [project[7][0]]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = merge_sector(df(project), df(source), 9, target, spark.createDataFrame([(b,) for b in blocked], "id string"), protected)
    usages, outcomes = one_by_one(project, source, 9, target, blocked, protected)
    assert {x["source_id"]: (x["outcome"], x["usage_id"]) for x in got.outcomes.collect()} == outcomes
    assert sorted((tuple(x) for x in got.usages.collect()), key=repr) == usages
    assert {"CREATED", "MATCHED", "DOUBTFUL"} <= {o for o, _ in outcomes.values()}


def test_sectors_by_priority_and_closer_parents(spark):
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    project = df([("o", None, "Orda", None, "order", "ACCEPTED", 0), ("f", "o", "Fama", None, "family", "ACCEPTED", 0), ("g", "f", "Gena", None, "genus", "ACCEPTED", 0)])
    one = df([("1", None, "Orda", None, "order", "ACCEPTED", 0), ("2", "1", "Subra", "Li, 1900", "suborder", "ACCEPTED", 0), ("3", "2", "Fama", "Ode, 1800", "family", "ACCEPTED", 0), ("4", "3", "Gena", "Ray, 1820", "genus", "ACCEPTED", 0), ("5", "4", "Gena prima", "Ray, 1820", "species", "ACCEPTED", 0)])
    two = df([("a", None, "Fama", None, "family", "ACCEPTED", 0), ("b", "a", "Gena", None, "genus", "ACCEPTED", 0), ("c", "b", "Gena prima", "Ray, 1820", "species", "ACCEPTED", 0), ("d", "b", "Gena altera", "Ray, 1821", "species", "ACCEPTED", 0), ("e", "d", "Gena alteri", "Ray, 1821", "species", "SYNONYM", 0)])
    usages, outcomes = merge_sectors(project, [{"priority": 2, "sector": 22, "source": two}, {"priority": 1, "sector": 11, "source": one}])
    got = {x["name"]: x for x in usages.collect()}
    assert got["Fama"]["parent_id"] == "11:2" and got["Fama"]["authorship"] == "Ode, 1800" and got["Subra"]["parent_id"] == "o"
    assert got["Gena prima"]["sector"] == 11 and got["Gena altera"]["sector"] == 22 and got["Gena altera"]["parent_id"] == "g"
    told = {(x["sector"], x["source_id"]): x["outcome"] for x in outcomes.collect()}
    assert told[22, "c"] == "MATCHED" and told[11, "5"] == "CREATED" and len(got) == 6


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("1", None, "Orda", "Li, 1900", "order", "ACCEPTED", 0)], SCHEMA)
    assert merge_sector(one, empty, 1).usages.count() == 1
    assert [x["id"] for x in merge_sector(empty, one, 1).usages.collect()] == ["1:1"]


def test_rows_of_one_file_are_dealt_out(spark):
    """Neither the project nor the release stays in as few tasks as its source's files, or its sectors."""
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    id_ = F.col("id").cast("string")
    rows = spark.range(20000).coalesce(1).select(
        id_.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("Abax a"), F.translate(id_, "0123456789", "abcdefghij")).alias("name"),
        F.lit(None).cast("string").alias("authorship"), F.lit("species").alias("rank"), F.lit("ACCEPTED").alias("status"), F.lit(0).alias("sector"),
    )
    source = spark.createDataFrame([("s", None, "Brut", "Li, 1900", "order", "ACCEPTED", 0)], SCHEMA)
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        usages = merge_sector(rows, source, 9).usages
        told = provisional_homonyms(usages, spark.createDataFrame([(9, 1)], "sector int, priority int"))
        for df in (usages, told):
            parts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(parts) == 20001 and max(parts) < 10000
    finally:
        spark.conf.set(size, before)
