"""What changes between two texts, and what they have in common, as Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EQUAL, DELETE, INSERT = "EQUAL", "DELETE", "INSERT"


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """The shortest script from `a` to `b`: EQUAL and DELETE with a range of `a`, INSERT with one of `b`.

    Scripts of 0, 1, 2, ... edits are tried, each reaching as far as it can on
    each diagonal. Work is the length times the edits, and memory the square of
    the edits, whatever the length. Deletions stand before insertions.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), min(len(a), len(b)) - head)
    n, m = len(a) - head - tail, len(b) - head - tail
    steps, furthest = [], {1: 0}
    for edits in range(n + m + 1):
        steps.append(furthest)
        reached: dict[int, int] = {}
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or k != edits and furthest.get(k - 1, -1) < furthest.get(k + 1, -1)
            x = furthest[k + 1] if down else furthest[k - 1] + 1
            y = x - k
            while x < n and y < m and a[head + x] == b[head + y]:
                x, y = x + 1, y + 1
            reached[k] = x
        furthest = reached
        if furthest.get(n - m, -1) >= n:
            break
    moves, x, y = [], n, m
    for edits in range(len(steps) - 1, 0, -1):
        before, k = steps[edits], x - y
        down = k == -edits or k != edits and before.get(k - 1, -1) < before.get(k + 1, -1)
        px = before[k + 1] if down else before[k - 1]
        moves.append((INSERT, px - k - 1) if down else (DELETE, px))
        x, y = (px, px - k - 1) if down else (px, px - k + 1)
    gone, new = {i for op, i in moves if op == DELETE}, {i for op, i in moves if op == INSERT}
    out: list[list] = []

    def add(op: str, i: int):
        if out and out[-1][0] == op and out[-1][2] == i:
            out[-1][2] = i + 1
        else:
            out.append([op, i, i + 1])

    if head:
        out.append([EQUAL, 0, head])
    x = y = 0
    while x < n or y < m:
        if x in gone:
            add(DELETE, head + x)
            x += 1
        elif y in new:
            add(INSERT, head + y)
            y += 1
        else:
            add(EQUAL, head + x)
            x, y = x + 1, y + 1
    if tail:
        if out and out[-1][0] == EQUAL:
            out[-1][2] = len(a)
        else:
            out.append([EQUAL, len(a) - tail, len(a)])
    return [tuple(s) for s in out]


def chunks(a: str, b: str) -> list[tuple[str, str]]:
    """Stretches of letters that stay, go or come between two labels."""
    return [(op, (b if op == INSERT else a)[i:j]) for op, i, j in edit_script(a, b)]


_CHUNK = T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_CHUNK))
def change_chunks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Chunks of each pair of labels; a missing label counts as an empty one."""
    return pd.Series([[{"op": o, "text": t} for o, t in chunks(x or "", y or "")] for x, y in zip(a, b)])


def longest_common(a: str, b: str) -> str:
    """The longest text that is part of both, the first in `b` of equal ones.

    By the automaton of all parts of `a`, in time linear in both.
    """
    following, link, size = [{}], [-1], [0]
    last = 0
    for c in a:
        new = len(size)
        following.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and c not in following[at]:
            following[at][c] = new
            at = link[at]
        if at >= 0:
            other = following[at][c]
            if size[other] == size[at] + 1:
                link[new] = other
            else:
                copy = len(size)
                following.append(dict(following[other]))
                link.append(link[other])
                size.append(size[at] + 1)
                while at >= 0 and following[at].get(c) == other:
                    following[at][c] = copy
                    at = link[at]
                link[other] = link[new] = copy
        last = new
    best = end = state = length = 0
    for i, c in enumerate(b, 1):
        while state and c not in following[state]:
            state = link[state]
            length = size[state]
        if c in following[state]:
            state, length = following[state][c], length + 1
        if length > best:
            best, end = length, i
    return b[end - best : end]


@F.pandas_udf(T.StringType())
def longest_common_text(a: pd.Series, b: pd.Series) -> pd.Series:
    """longest_common() of columns; null where either is null."""
    return pd.Series([None if x is None or y is None else longest_common(x, y) for x, y in zip(a, b)], dtype=object)
