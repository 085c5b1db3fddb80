from __future__ import annotations

import hashlib
import random
import re

import pytest
from fixtures import empty, frame, sentence, texts

from cladeflow.llm.decontamination import decontaminate, drop_contaminated


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for d, t in rows:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            n = min(13, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item)
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def case():
    r = random.Random(5)
    items = [(i, sentence(r, r.randrange(1, 60))) for i in range(20)]
    items += [(30, None), (31, ""), (32, "..."), (33, items[3][1]), (None, items[4][1]), (34, "Solo"), (5, items[5][1])]
    rows = texts(3)
    for i in range(40):
        n, text = r.randrange(20), items[r.randrange(20)][1].split()
        part = text[n // 3 : n // 3 + r.randrange(8, 40)]
        rows.append((1000 + i, f"{sentence(r, r.randrange(0, 200))}. {' '.join(part).upper()}! {sentence(r, 20)}"))
    rows += [(2000, "solo words"), (2001, items[6][1]), (2002, (items[7][1] + " ") * 4)]
    return rows, items


def found(df):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_equals_brute_force(spark, limit):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate(frame(spark, rows), bench, limit)) == brute(rows, items)


def test_clean_documents_stay(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    want = [r[0] for r in brute(rows, items) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = texts()
    assert decontaminate(empty(spark), none).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(frame(spark, rows), none).collect())
