"""Quality rules: learned decision lists over text statistics.

Sequential covering learns ordered conjunctions of thresholds from labelled
statistics: each rule is grown by information gain on two thirds of the
labelled rows and pruned on the rest, the rows it covers are set aside, and
the next rule is learned, until a rule no longer pays. The list is emitted as
one ordered Spark conditional expression, so applying it is plain codegen.

Edge cases: a null or empty text has zero in every statistic and fails the
base rule; repeated rows are judged alike; labels that are null are ignored,
and where a document has several the smallest quality counts; with no labels,
or labels of one kind only, the list is empty and keeps what the base keeps;
other columns of the input are passed through, and lose their place only to
the statistics' own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MUL, mix, prepare, released, text_bytes

#: Bound of the labelled sample that the list is learned from.
MAX_LABELLED = 20_000

#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_digits", "n_distinct_words", "n_toptwo")

#: The statistics that rules may test, each a ratio of counts.
FEATURES: dict[str, tuple[str, str | None]] = {
    "words": ("n_words", None),
    "symbol_share": ("n_symbols", "word_chars"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bang_share": ("n_bang", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "top_word_share": ("n_toptwo", "n_words"),
    "word_length": ("word_chars", "n_words"),
}

_WS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def text_counts(raw: bytes) -> tuple[int, ...]:
    """The counts of one text, as listed in COUNTS."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    size = len(raw)
    spaces = size - len(raw.translate(None, _WS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    seen, times = np.unique(h, return_counts=True)
    repeated = 0
    if n >= 4:
        w = mix(mix(h[:-2] * _MUL + h[1:-1]) * _A + h[2:] * _B)
        order = np.argsort(w)
        same = np.diff(w[order]) == 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeated = int(covered.sum())
    top = int(np.sort(times)[-2:].sum())
    return (
        n,
        len(raw.decode("utf-8", "replace")) - spaces,
        size - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(raw.translate(None, _UPPER)),
        raw.count(b"!"),
        size - len(raw.translate(None, _DIGIT)),
        len(seen),
        top,
    )


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of COUNTS added; one pass, no shuffle."""
    prepare(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([text_counts(x) for x in batch.column(batch.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(table[:, i]) for i in range(len(COUNTS)))], [*kept, *COUNTS])

    return docs.select(*[F.col(f"`{c}`") for c in kept], text_bytes().alias("__raw")).mapInArrow(released(run), schema)


def feature(name: str) -> F.Column:
    """A statistic as a Spark expression; a ratio over nothing is 0."""
    top, bottom = FEATURES[name]
    if bottom is None:
        return F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds; texts that meet all of them are rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & (feature(name) <= F.lit(at) if op == "<=" else feature(name) > F.lit(at))
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        got = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.tests:
            got &= x[name] <= at if op == "<=" else x[name] > at
        return got

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {at:.6g}" for n, op, at in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the test of largest information gain until no clean row is covered."""
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < most:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, hits = v[order], np.cumsum(b[order])
            cut = np.flatnonzero(np.diff(v) > 0)
            if not len(cut):
                continue
            below, count = hits[cut].astype(float), cut + 1.0
            for op, pos, all_ in (("<=", below, count), (">", p - below, p + n - count)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / all_) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = Rule(tuple(tests)).covers(x)
    return Rule(tuple(tests))


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    got = rule.covers(x)
    p, n = int(bad[got].sum()), int((~bad[got]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that mark bad rows, by sequential covering.

    A rule joins the list while at least ``precision`` of the rows that it
    covers, in the growing and in the pruning part, are bad.
    """
    rules: list[Rule] = []
    bad = bad.astype(bool)
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & left & part).any():
        grow = {k: v[left & part] for k, v in x.items()}
        prune = {k: v[left & ~part] for k, v in x.items()}
        rule = _grow(grow, bad[left & part], most_tests)
        if not rule.tests:
            break
        options = [Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)]
        rule = max(options, key=lambda r: _worth(r, prune, bad[left & ~part]))
        got = rule.covers(x) & left
        fit, held = got & part, got & ~part
        if not fit.any() or bad[fit].mean() < precision or (held.any() and bad[held].mean() < precision) or bad[got].sum() < 3:
            break
        rules.append(rule)
        left &= ~got
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """A list learned from at most ``max_labelled`` labelled documents, chosen by hash."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # at most max_labelled rows are broadcast
    got = with_statistics(rows, ["doc_id", "__quality"]).select("doc_id", "__quality", *[feature(k).alias(k) for k in FEATURES]).toPandas()
    got = got.sort_values(["doc_id", *FEATURES])
    bad = (got["__quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn({k: got[k].to_numpy(float) for k in FEATURES}, bad, **how)


def verdict(rules: list[Rule]) -> F.Column:
    """The decision list as one conditional expression: false at the first rule that holds."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Each document with its statistics, ``base_failed`` and ``kept``."""
    out = with_statistics(docs, keep)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
