from __future__ import annotations

import zlib
from itertools import product

import numpy as np
from fixtures import empty, frame, texts

from cladeflow.llm.sharding import hilbert_index, hilbert_shards


def test_curve_visits_neighbours():
    """All cells of a small grid have different places, and the next place is one step away."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=dims)))
        index = hilbert_index(list(cells.T), bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        walked = cells[np.argsort(index)]
        assert (np.abs(np.diff(walked, axis=0)).sum(1) == 1).all()


def test_shards_are_whole_and_even(spark):
    rows = texts(6)
    got = hilbert_shards(frame(spark, rows), 8).toPandas()
    raw = lambda t: (t or "").encode()
    want = sorted(((d, len(raw(t)) + 1, zlib.crc32(raw(t))) for d, t in rows), key=repr)
    plain = lambda d: None if d is None or d != d else int(d)
    assert sorted(((plain(r.doc_id), r.size, r.text_crc32) for r in got.itertuples()), key=repr) == want
    counts = got.groupby("shard").size()
    assert set(counts.index) == set(range(8)) and counts.max() - counts.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()


def test_order_follows_the_curve_and_keeps_copies_together(spark):
    got = hilbert_shards(frame(spark, texts(6)), 8).toPandas().sort_values(["shard", "slot"])
    assert got["hilbert"].is_monotonic_increasing
    base = np.flatnonzero((got["doc_id"] >= 200) & (got["doc_id"] < 208))
    assert base.max() - base.min() + 1 == len(base)


def test_fewer_documents_than_shards_and_none(spark):
    got = hilbert_shards(frame(spark, [(1, "a"), (2, None), (3, "a")]), 8).toPandas()
    assert len(got) == 3 and got.groupby("shard").size().max() == 1
    assert hilbert_shards(empty(spark), 8).count() == 0
