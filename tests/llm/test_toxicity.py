from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import empty, frame, sentence, texts

from cladeflow.llm.toxicity import BlockMaxIndex, calibrated, drop_toxic, toxicity

_BAD = ["grumlik", "vexort", "snarbol", "hargul", "trobnik"]


def planted(n=600):
    r = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = sentence(r, r.randrange(20, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(_BAD) + r.choice(["", "s", "ed"]))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_search_equals_all_cosines():
    rng = np.random.default_rng(4)
    n, terms = 2000, 60
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < 0.1)
    dense[:, :10] = 20 * (rng.random((n, 10)) < 0.01)  # rare and heavy, as telling terms are
    dense = dense[dense.any(1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    ids = np.arange(len(dense))
    example, term = np.nonzero(dense)
    index = BlockMaxIndex(terms, ids, ids % 2, example, term, dense[example, term])
    for i in range(30):
        query = rng.random(terms) * (rng.random(terms) < 0.15)
        query[i % 10] = 5
        used = np.flatnonzero(query)
        if not len(used):
            continue
        query /= np.linalg.norm(query)
        places, cosines = index.search(used, query[used], k=10)
        want = np.sort(dense @ query)[::-1][:10]
        assert np.allclose(cosines, want[want > 0][: len(cosines)]) and len(cosines) == (want > 0).sum()
        assert np.allclose((dense @ query)[index.ids[places]], cosines)
    assert index.visited < 30 * index.blocks


def test_ties_do_not_depend_on_labels():
    example, term, weight = np.arange(6), np.zeros(6, int), np.ones(6)
    tie = np.array([5, 3, 1, 0, 2, 4])
    found = []
    for labels_ in ([0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0]):
        index = BlockMaxIndex(1, np.arange(6), np.array(labels_), example, term, weight, tie)
        places, _ = index.search(np.array([0]), np.array([1.0]), k=3)
        found.append(index.ids[places].tolist())
    assert found == [[3, 2, 4]] * 2


def brute_votes(rows, marks, examples):
    """The vote of each text, by all cosines between whole vectors in plain Python."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    def count(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        return Counter(x for w in words for x in [w, *((n, w.encode()[:n]) for n in (4, 5, 6) if len(w.encode()) > n)])

    counts = [count(t) for _, t in rows]
    df = Counter(x for c in counts for x in c)
    known = {x for i, _ in examples for x in counts[i]}
    toxic = [marks[rows[i][0]] for i, _ in examples]
    n1 = sum(toxic)
    odds = (len(toxic) - n1) / n1

    def value(x):
        if x not in known:
            return math.log(1 + len(rows)) + 1
        a = sum(y for (i, _), y in zip(examples, toxic) if x in counts[i])
        c = sum(1 - y for (i, _), y in zip(examples, toxic) if x in counts[i])
        return (math.log((1 + len(rows)) / (1 + df[x])) + 1) * math.log2(2 + a * odds / (c + odds)) ** 2

    values = {x: value(x) for x in df}

    def vector(c):
        w = {x: (1 + math.log(n)) * values[x] for x, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    vectors = [vector(c) if c else {} for c in counts]
    return vectors, toxic


def test_neighbours_are_those_of_all_whole_vectors(spark):
    rows, marks = planted(150)
    rows = rows + [(7000, "one word unseen"), (7001, "")]
    label = {d: t for d, _, t in marks}
    examples = [(i, None) for i, (d, _) in enumerate(rows) if d in label and zlib.crc32(str(d).encode()) % 5]
    vectors, _ = brute_votes(rows, label, examples)
    ids = [d for d, _ in rows]
    got = {r["doc_id"]: r for r in toxicity(frame(spark, rows), labels(spark, marks)).collect()}
    for i, own in enumerate(vectors):
        cosines = {ids[j]: sum(v * vectors[j].get(x, 0) for x, v in own.items()) for j, _ in examples}
        best = sorted((c for c in cosines.values() if c > 1e-12), reverse=True)[:5]
        found = got[ids[i]]
        assert np.allclose(found["cosines"], best) and len(best) == len(found["cosines"])
        assert np.allclose([cosines[d] for d in found["neighbours"]], found["cosines"])


def test_repeated_ids_with_different_texts_and_odd_column_names(spark):
    rows, marks = planted(200)
    again = [(d, t + " more words here") for d, t in rows[:60]]
    docs = frame(spark, rows + again).withColumnRenamed("node", "my col").withColumnRenamed("size", "a.b")
    kept = drop_toxic(docs, labels(spark, marks))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} <= set(range(200))
    assert toxicity(docs, labels(spark, marks)).count() == 260


def test_one_example_is_left_out():
    index = BlockMaxIndex(1, np.arange(3), np.array([0, 1, 1]), np.arange(3), np.zeros(3, int), np.ones(3))
    places, _ = index.search(np.array([0]), np.array([1.0]), k=5, without=1)
    assert sorted(places.tolist()) == [0, 2]


def test_calibration_rises():
    rng = np.random.default_rng(1)
    votes = rng.random(4000)
    x, y = calibrated(votes, (rng.random(4000) < votes**2).astype(int), np.ones(4000))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and abs(np.interp(0.8, x, y) - 0.64) < 0.08


def test_held_out_accuracy_on_planted_terms(spark):
    rows, marks = planted()
    got = toxicity(frame(spark, rows), labels(spark, marks)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert list(r["cosines"]) == sorted(r["cosines"], reverse=True)
    own = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in own) >= 0.98 * len(own)


def test_toxic_rows_go_and_others_stay(spark):
    rows, marks = planted()
    docs = frame(spark, rows + [(None, "plain words"), (9000, None), (9001, "")])
    kept = drop_toxic(docs, labels(spark, marks + [(None, 1, 1), (5000, 1, None), (0, 1, 1)]))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {None, 9000, 9001} <= set(ids)
    assert sum(i is not None and i < 600 and i % 5 == 0 for i in ids) <= 2
    assert sum(i is not None and i < 600 and i % 5 > 0 for i in ids) == 480


def test_no_labels_and_no_documents(spark):
    none = labels(spark, [])
    assert toxicity(empty(spark), none).count() == 0
    assert all(r["score"] == 0 for r in toxicity(frame(spark, texts()), none).collect())
