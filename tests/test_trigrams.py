from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cladeflow.operators.trigrams import decompounded, index_of, search


def test_search_equals_a_scan(spark):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("aábc d") for _ in range(r.randrange(0, 14)))) for i in range(300)] + [(900, None), (901, "Ábaca"), (902, "aaaaaaa")]
    patterns = ["ab", "", "abc", "ÁBC", "bbb", "caba", "zzz", "a b", "aaaa", "d a", "xyzabc", None]
    rows = spark.createDataFrame(texts, "key int, text string")
    got = search(index_of(rows, "key", "text"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), rows)
    fold = lambda x: x.lower().replace("á", "a")
    want = {(p, k) for p in patterns if p is not None for k, t in texts if t is not None and fold(p) in fold(t)}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_short_patterns_need_texts(spark):
    rows = spark.createDataFrame([(1, "abc")], "key int, text string")
    with pytest.raises(ValueError):
        search(index_of(rows, "key", "text"), spark.createDataFrame([("a",)], "pattern string"))


def test_words_without_prefixes(spark):
    df = spark.createDataFrame([("submucidus",), ("mucidus",), ("subalba",), ("pseudosub",), (None,)], "w string")
    got = [r[0] for r in df.select(decompounded(F.col("w"), ["sub", "pseudo", "pseudosub"])).collect()]
    assert got == [["submucidus", "mucidus"], ["mucidus"], ["subalba", "alba"], ["pseudosub"], []]
