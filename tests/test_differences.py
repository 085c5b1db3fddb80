"""Edit scripts and common parts against tables of all prefixes."""

from __future__ import annotations

from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.functions.differences import DELETE, EQUAL, INSERT, change_chunks, chunks, edit_script, longest_common, longest_common_text

words = st.text(alphabet="abc", max_size=12)


def in_common(a, b):
    @cache
    def go(i, j):
        if not i or not j:
            return 0
        return max(go(i - 1, j), go(i, j - 1), go(i - 1, j - 1) + (a[i - 1] == b[j - 1]))

    return go(len(a), len(b))


@settings(deadline=None, max_examples=500)
@given(words, words)
def test_scripts_are_right_and_shortest(a, b):
    script = edit_script(a, b)
    assert "".join(a[i:j] for op, i, j in script if op != INSERT) == a
    assert "".join((b if op == INSERT else a)[i:j] for op, i, j in script if op != DELETE) == b
    assert sum(j - i for op, i, j in script if op == EQUAL) == in_common(a, b)
    assert all(x[0] != y[0] for x, y in zip(script, script[1:]))


def test_lists_and_long_texts():
    assert edit_script(["x", "y"], ["y", "z"]) == [(DELETE, 0, 1), (EQUAL, 1, 2), (INSERT, 1, 2)]
    a = [str(i) for i in range(20_000)]
    b = a[:5000] + ["new"] + a[5001:15_000] + a[15_001:]
    assert [s[0] for s in edit_script(a, b)] == [EQUAL, DELETE, INSERT, EQUAL, DELETE, EQUAL]


@settings(deadline=None, max_examples=500)
@given(words, words)
def test_longest_common_part(a, b):
    got = longest_common(a, b)
    assert got in a and got in b
    longest = max((j - i for i in range(len(a)) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    assert len(got) == longest


def test_columns(spark):
    df = spark.createDataFrame([("Abies alba", "Abies albus"), (None, "x"), ("same", "same"), ("", "")], "a string, b string")
    got = df.select("a", "b", change_chunks("a", "b").alias("c"), longest_common_text("a", "b").alias("l")).collect()
    assert [[tuple(c) for c in r["c"]] for r in got] == [chunks(r["a"] or "", r["b"] or "") for r in got]
    assert [tuple(c) for c in got[0]["c"]] == [(EQUAL, "Abies alb"), (DELETE, "a"), (INSERT, "us")]
    assert [r["l"] for r in got] == ["Abies alb", None, "same", ""]
