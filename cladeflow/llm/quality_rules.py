"""Quality rules: a decision list learned from labelled documents.

Counts are taken over every whole text. Ratios of them are the features. Rules
that mark low quality are found by sequential covering: a rule grows, condition
by condition, by information gain on one part of the labelled rows, is pruned
on the other part, and the rows it covers are set aside before the next. The
list becomes an ordered chain of Spark conditional expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, stage, texts
from .words import WHITE, cut, grams, mix, raw, slices

#: Labelled rows that the rules are learned from, at most; drawn by a hash of the id.
TRAINING_ROWS = 20_000
#: Words of a window for n_repeat_words.
REPEAT_WINDOW = 8

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_digits", "n_upper", "n_distinct", "longest_word",
)
BASE = COUNTS[:5]
#: Features: numerator over denominator.
FEATURES = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "digit_share": ("n_digits", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "longest_word": ("longest_word", None),
}


def _flags(*ranges: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for r in ranges:
        out[list(r)] = 1
    return out


_SYMBOLS, _DIGITS, _UPPER = _flags(b"#*$%&|<>"), _flags(b"0123456789"), _flags(bytes(range(65, 91)))
_CODE_POINTS = np.array([0 if 0x80 <= b < 0xC0 or b in WHITE else 1 for b in range(256)])
_IN_WORD = np.array([b not in WHITE for b in range(256)]).astype(np.int64)


def _sum_within(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    keys = np.unique(mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    return np.bincount(owner[keys], minlength=n)


def count(part: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text of an Arrow column without nulls."""
    n = len(part)
    data, at = raw(part)
    words, lines = cut(part, WHITE), cut(part, b"\n")
    owner = words.owner()
    per_word = np.concatenate([[0], np.cumsum(_IN_WORD[data])])
    worded = per_word[lines.last] > per_word[lines.first]
    line_owner, line_hash = lines.owner()[worded], lines.hashes[worded]
    n_lines = np.bincount(line_owner, minlength=n)
    h, same = grams(words, REPEAT_WINDOW)
    begins = np.flatnonzero(same)
    keys = mix(h[begins] ^ mix(owner[begins].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    twin = np.zeros(len(keys) + 1, bool)
    twin[1:-1] = keys[order][1:] == keys[order][:-1]
    again = begins[order[twin[1:] | twin[:-1]]]
    turns = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(turns, again, 1)
    np.add.at(turns, again + REPEAT_WINDOW, -1)
    covered = (np.cumsum(turns)[:-1] > 0).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, words.last - words.first)
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": _sum_within(_CODE_POINTS[data], at),
        "n_symbols": _sum_within(_SYMBOLS[data], at),
        "n_dup_lines": n_lines - _distinct(line_owner, line_hash, n),
        "n_repeat_words": _sum_within(covered, words.bounds),
        "n_lines": n_lines,
        "n_digits": _sum_within(_DIGITS[data], at),
        "n_upper": _sum_within(_UPPER[data], at),
        "n_distinct": _distinct(owner, words.hashes, n),
        "longest_word": longest,
    }


def _count(batches):
    for b in batches:
        for at, part in slices(b.column("text")):
            found = count(part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[at : at + len(part)], *(pa.array(found[c], pa.int64()) for c in COUNTS)],
                names=["doc_id", *COUNTS],
            )


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row; a null text has no words."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    """The feature as a Spark expression over COUNTS; 0 where there is nothing to divide by."""
    top, below = FEATURES[name]
    if below is None:
        return F.col(top).cast("double")
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def expression(self) -> Column:
        value = feature(self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _best_condition(x, bad, cuts) -> tuple[float, Condition | None]:
    """The condition with the most information gain, FOIL's: p * (log2 share after - before)."""
    before = np.log2(bad.mean())
    best, found = 0.0, None
    for name, thresholds in cuts.items():
        place = np.searchsorted(thresholds, x[name], "right")
        n_bad = np.bincount(place[bad], minlength=len(thresholds) + 1).cumsum()
        n_all = np.bincount(place, minlength=len(thresholds) + 1).cumsum()
        for above in (False, True):
            p = (n_bad[-1] - n_bad if above else n_bad)[:-1]
            t = (n_all[-1] - n_all if above else n_all)[:-1]
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(t, 1)) - before), 0)
            if len(gain) and gain.max() > best + 1e-9:
                best, found = float(gain.max()), Condition(name, above, float(thresholds[gain.argmax()]))
    return best, found


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_covered: int = 5, most_rules: int = 16
) -> list[Rule]:
    """An ordered list of conjunctions that mark low quality.

    A third of the rows prune what the others grow. A rule stays if, on the
    pruning rows it covers, at least `min_precision` are low quality, by
    Laplace's estimate over all covered rows.
    """
    part = np.arange(len(bad)) % 3 == 0
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:])) for k, v in x.items()} if len(bad) else {}
    open_rows, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (bad & open_rows & ~part).sum() >= min_covered:
        now = open_rows & ~part
        rule: Rule = ()
        while (bad & now).any() and not bad[now].all() and len(rule) < 4:
            rows = {k: v[now] for k, v in x.items()}
            _, condition = _best_condition(rows, bad[now], cuts)
            if condition is None:
                break
            rule += (condition,)
            now &= condition.covers(x)
        checked = {k: v[open_rows & part] for k, v in x.items()}
        bad_checked = bad[open_rows & part]

        def worth(r: Rule) -> float:
            hit = _covers(r, checked)
            p, n = (hit & bad_checked).sum(), (hit & ~bad_checked).sum()
            return (p - n) / max(1, p + n) + 1e-6 * p

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule:
            break
        hit = _covers(rule, x) & open_rows
        if (bad & hit).sum() < min_covered or ((bad & hit).sum() + 1) / (hit.sum() + 2) < min_precision:
            break
        rules.append(rule)
        open_rows &= ~hit
    return rules


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, from 1; 0 where none does."""
    out = F
    for number, rule in enumerate(rules, 1):
        all_ = rule[0].expression()
        for c in rule[1:]:
            all_ = all_ & c.expression()
        out = out.when(all_, F.lit(number))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def quality_rules(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule (0: none) and kept, by document.

    base_failed: fewer than 20 words, or more than 30 of 100 words in repeated
    windows. Null and empty texts fail so. Labels with a null id or quality are
    left out; of several for one id the lowest holds. Without labels of both
    kinds there are no rules, and base_failed alone decides. Rows that repeat an
    id are each judged on their own text. Other columns don't matter.
    """
    counts = stage(text_counts(docs)).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    drawn = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(training_rows)
    )
    rows = (
        counts.filter(~F.col("base_failed"))
        .join(drawn, "doc_id")
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("quality", *(feature(f).alias(f) for f in FEATURES))
        .limit(training_rows)
        .toPandas()
    )
    rules = learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["quality"].to_numpy() == 0)
    return counts.withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )
