from __future__ import annotations

import re

import numpy as np
from fixtures import empty, frame, sentence, texts

from cladeflow.llm.quality_rules import learn, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
        len(words) < 20 or 100 * len(hit) > 30 * len(words),
    )


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_equal_brute_force(spark):
    rows = texts(9) + [(3000, "# a * b\n" * 9), (3001, "$$$ <b>|&%\n\n x"), (3002, "w " * 7), (3003, "w " * 8), (3004, "w " * 9)]
    none = labels(spark, [])
    got = sorted((tuple(r) for r in quality_rules(frame(spark, rows), none).select("doc_id", *NAMES).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_rules_find_what_labels_mark(spark):
    import random

    r = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(r, r.randrange(40, 90))
        rows.append((i, re.sub(" ", " #$ ", text) if bad else text))
        marks.append((i, None if i % 50 == 3 else 0 if bad else 1, 0))
    got = quality_rules(frame(spark, rows), labels(spark, marks + [(None, 0, 0)])).collect()
    dropped = {r["doc_id"] for r in got if not r["kept"]}
    assert dropped <= set(range(0, 400, 4)) and len(dropped) >= 95
    assert all((r["rule"] > 0) == (not r["kept"]) for r in got)


def test_learned_list_is_ordered_and_pruned():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    rules = learn(x, bad)
    assert 1 <= len(rules) <= 4
    assert rules[0][0].feature == "a" and rules[0][0].above
    covered = np.zeros(3000, bool)
    for rule in rules:
        hit = np.ones(3000, bool)
        for c in rule:
            hit &= c.covers(x)
        covered |= hit
    assert (covered == bad).mean() > 0.97


def test_no_labels_and_no_documents(spark):
    assert quality_rules(empty(spark), labels(spark, [])).count() == 0
    got = quality_rules(frame(spark, texts()), labels(spark, [(1, 1, 0)])).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
