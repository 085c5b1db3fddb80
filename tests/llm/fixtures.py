"""Small tables that hold the awkward cases, for all operators' tests."""

from __future__ import annotations

import random

#: Extra columns with names that operators use themselves.
CLASHING = "node long, size int, row long, component long, text_hash long, secret_scan string, held_out string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"

_WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "se", "ro") for b in ("n", "ra", "sti", "vo", "lem", "p")]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(_WORDS) for _ in range(n))


def edited(r: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = r.choice(_WORDS) + "x"
    return " ".join(words)


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): prose, groups of copies and near copies, and odd texts."""
    r = random.Random(seed)
    found: list[tuple[int | None, str | None]] = []
    passage = sentence(r, 60)
    for i in range(30):
        found.append((100 + i, sentence(r, r.randrange(1, 120))))
    base = sentence(r, 150)
    found += [(200 + i, base) for i in range(8)]
    found += [(300 + i, edited(r, base, 1 + i % 6)) for i in range(24)]
    found += [(400 + i, f"{sentence(r, 12)} {passage} {sentence(r, 12)}") for i in range(8)]
    for group in range(6):
        own = sentence(r, r.randrange(8, 60))
        found += [(500 + 10 * group + i, edited(r, own, i)) for i in range(5)]
    found += [
        (600, None), (601, ""), (602, "   \t\n "), (603, "one"), (604, "one"), (605, "One Two three"),
        (606, "Zürich größe 東京 😀 emoji 😀"), (607, "line a\nline a\n\nline b\r\nline a"), (608, "a" * 5000),
        (609, sentence(r, 6000)), (610, "x y z w v u t s r q " * 30), (None, "text of no id here and there"),
        (200, base), (611, "\x0b\x0c lone\x1fcontrol chars"),
    ]
    return found


def frame(spark, rows, langs=("en", "de", None)):
    """A documents table of (doc_id, text) rows, with clashing columns."""
    full = [
        (d, t, langs[i % len(langs)], (None if i % 11 == 0 else f"owner{i % 4}/repo{i % 6}"), len(t or ""), *[None] * 5, "x", None)
        for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame([r[:12] for r in full], DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)
