from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import empty, frame, texts

from cladeflow.llm import suffix_tree as st
from cladeflow.llm.suffix_tree import BITS, DEPTH, Tally, fit_tree, lm_scores, symbol_codes


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def brute(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\n"]
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {
        (d, t): (held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                 sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for d, t in rows
    }


@pytest.mark.parametrize("frequent", [1 << 16, 20])
def test_base_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(st, "FREQUENT", frequent)
    rows = [r for i, r in enumerate(texts(8)) if r not in texts(8)[:i]]
    by_id = {d: v for (d, _), v in brute(rows).items()}
    got = lm_scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = by_id[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert math.isclose(r["base_score"], want[4], rel_tol=1e-9)
        assert r["score"] < 0


def test_shares_of_known_tokens_and_an_unseen_one_sum_to_1(spark):
    words = "a b b c c c".split()
    apart = next(i for i in range(2000, 3000) if held(i))
    rows = [(i, " ".join(words)) for i in range(40)] + [(1000, "a"), (1001, "b"), (1002, "c"), (1004, ""), (apart, "unseen")]
    train = sum(not held(d) for d, _ in rows)
    got = {r["doc_id"]: r["base_score"] for r in lm_scores(frame(spark, rows)).collect()}
    end = got[1004]
    shares = [10 ** (got[i] - end) for i in (1000, 1001, 1002, apart)]
    assert train and math.isclose(sum(shares) + 10**end, 1, rel_tol=1e-9)


def tree_of(train):
    part = pa.array(train)
    counts = np.bincount(np.frombuffer("".join(map(low, train)).encode(), np.uint8), minlength=256)
    codes = symbol_codes(counts)
    symbols, places, _, _ = st._laid_out(part, codes)
    tally = Tally()
    tally.add(st._contexts(symbols, places) << BITS | symbols[places])
    keys, n = tally.take()
    least = len(places) / st.CONTEXTS
    levels = []
    for k in range(DEPTH + 1):
        own = keys % (1 << BITS * (k + 1))
        total = Counter()
        for context, c in zip((own >> BITS).tolist(), n.tolist()):
            total[context] += c
        keep = np.array([total[c] >= least for c in (own >> BITS).tolist()])
        unique, at = np.unique(own[keep], return_inverse=True)
        levels.append((unique, np.bincount(at, n[keep]).astype(np.int64)))
    return fit_tree(levels, counts, codes)


def test_next_symbols_sum_to_one():
    tree = tree_of(["the cat sat on the mat " * 30, "a dog ran to the cat " * 30])
    assert np.allclose((10.0**tree.table).sum(1), 1, atol=1e-4)
    others = tree.codes == st.OTHER
    assert np.isclose((10.0 ** tree.other[others]).sum(), 1)


def test_contexts_help_and_are_the_longest():
    tree = tree_of(["the cat sat on the mat " * 50, "a dog ran to the cat " * 50])
    seen, mixed, foreign = tree.score(pa.array(["the cat ran on the mat", "tam eht no nar tac eht", "qqq zzz xxx jjj vvv kk"]))
    assert seen > mixed > foreign
    assert len(tree.table) > 20


def test_empty_and_unlearned(spark):
    assert lm_scores(empty(spark)).count() == 0
    only = next(i for i in range(100) if held(i))
    row = lm_scores(frame(spark, [(only, "some text")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] < 0


def whole_tree(train):
    """The tree of all contexts that the texts hold, without any cut."""
    part = pa.array([t or "" for t in train])
    counts = np.bincount(np.frombuffer("".join(map(low, train)).encode(), np.uint8), minlength=256)
    codes = symbol_codes(counts)
    symbols, places, _, _ = st._laid_out(part, codes)
    grams = (st._contexts(symbols, places) << BITS | symbols[places]).tolist()
    levels = []
    for k in range(DEPTH + 1):
        found = sorted(Counter(g % (1 << BITS * (k + 1)) for g in grams).items())
        levels.append((np.array([g for g, _ in found]), np.array([n for _, n in found])))
    return fit_tree(levels, counts, codes)


@pytest.mark.parametrize("contexts", [16_000, 2])
def test_rare_contexts_stay_whatever_the_size(spark, monkeypatch, contexts):
    filler = "the cat sat on the mat and a dog ran to it "
    train = [i for i in range(200) if not held(i)]
    rows = [(i, filler * 60) for i in train[:150]] + [(i, "zqxj wvk") for i in train[150:165]]
    rows += [(d, t) for d, t in texts(9) if d is not None and d >= 300]
    rows += [(1000 + i, t) for i, t in enumerate(["zqxj", "the zqxw", "\x01\x02", "東京 zqxj"])]
    tree = whole_tree([t for d, t in rows if not held(d)])
    # 15 occurrences are less than 1/16000 of the symbols
    assert sum(len(t or "") for _, t in rows) / 16_000 > 15
    assert tree.codes[ord("z")] in tree.contexts[1][0]
    monkeypatch.setattr(st, "CONTEXTS", contexts)
    got = lm_scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((d, round(float(v), 2)) for (d, _), v in zip(rows, tree.score(pa.array([t or "" for _, t in rows]))))
    by_id = {}
    for d, v in want:
        by_id.setdefault(d, []).append(v)
    for r in got:
        assert any(math.isclose(r["score"], v, rel_tol=1e-5, abs_tol=0.02) for v in by_id[r["doc_id"]])
