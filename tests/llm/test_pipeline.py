"""The pipeline's stages against the operators and brute force on a small folder."""

from __future__ import annotations

import random

from fixtures import frame, sentence, texts
from test_decontamination import brute as contaminated
from test_ngram_join import brute as joined
from test_toxicity import planted

import corpus_pipeline
from cladeflow.llm.common import load
from cladeflow.llm.tokens import vocabulary


def folder(spark, at):
    rows, marks = planted(300)
    r = random.Random(4)
    items = [(i, sentence(r, 40)) for i in range(5)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(texts())]
    rows += [(2000 + i, f"{sentence(r, 30)} {items[i % 5][1]}") for i in range(10)]
    rows += [(3000, "a password = hunter2hunter2 here"), (3001, None)]
    rows += [(4000 + i, rows[7][1]) for i in range(3)]
    frame(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return rows, items


def test_each_stage_on_its_own_input(spark, tmp_path):
    sf = str(tmp_path / "sf")
    _, items = folder(spark, sf)
    docs = load(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()]
        docs = spark.read.parquet(path)
    ids = lambda rows: sorted(d for d, _ in rows)
    before, after = seen["toxicity"]
    assert {d for d, _ in before} - {d for d, _ in after} <= set(range(0, 300, 5))
    assert len(before) - len(after) >= 55
    before, after = seen["ngram_jaccard_join"]
    assert ids(after) == sorted(d for d, _, c in joined(before) if d == c)
    before, after = seen["benchmark_decontamination"]
    assert ids(after) == sorted(r[0] for r in contaminated(before, items) if not r[5])
    assert ids(before) != ids(after)
    before, after = seen["secret_scans"]
    assert ids(before) == ids(after)
    assert dict(after)[3000] == "a [SECRET] here"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    from tokenizers import Tokenizer

    count = Tokenizer.from_file(vocabulary()).encode
    want = {d: len(count(t or "", add_special_tokens=False).ids) + 1 for d, t in after}
    got = packed.groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == want


def test_stages_pass_columns_of_clashing_names_on(spark, tmp_path):
    sf = str(tmp_path / "sf")
    folder(spark, sf)
    docs = load(spark, sf, "documents")
    mark = {c: "concat('own ', doc_id)" for c in ("secret_scan", "held_out")} | {c: "doc_id * 7" for c in ("node", "size", "row", "component")}
    docs = docs.selectExpr(*(f"cast({mark[c]} as {t}) as {c}" if c in mark else c for c, t in docs.dtypes))
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf)
        for r in docs.filter("doc_id is not null").collect():
            assert r["secret_scan"] == r["held_out"] == f"own {r['doc_id']}"
            assert r["node"] == r["size"] == r["row"] == r["component"] == 7 * r["doc_id"]


def test_run_gives_the_packed_rows(spark, tmp_path):
    sf = str(tmp_path / "sf")
    folder(spark, sf)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 200
