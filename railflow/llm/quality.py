"""Quality rules (5): learned decision lists over text statistics.

One scan turns each text into statistics (``STATS``). From labelled documents, sequential covering
grows a conjunction of thresholds on two thirds of them (best information gain, one condition at a
time), prunes it on the rest, and repeats on what is not yet covered. The ordered rules become one
Spark ``CASE`` expression, so the verdict is plain codegen and can be read.

Training takes at most ``MAX_TRAIN`` labelled documents (those with the smallest hash of their id);
statistics and verdicts cover every document.

Defined cases: a null or empty text has no words and zero statistics and fails the base rule; null labels
are not used; a document labelled several times counts as bad if any label says so; without both good
and bad labels there are no rules and the base rule alone decides; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from railflow.llm import textscan as ts
from railflow.staging import stage

MAX_TRAIN = 20_000
SLICE_BYTES = 1 << 18  # some dozens of arrays of a slice's length are alive at once
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may ask for: ratios that do not grow with the text, and the length.
FEATURES = [
    "words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio",
    "distinct_ratio", "line_words", "stop_ratio",
]
STATS = ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in FEATURES)])

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:()[]{}\"'@/\\=_~^+")] = True


def _repeats(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans have an equal span in the same text at all, and which have an earlier one."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    k, o = key[order], owner[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    again = np.zeros(len(key), bool)
    earlier = np.zeros(len(key), bool)
    again[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return again, earlier


def _stats(s: ts.Slice) -> list[np.ndarray]:
    buf = s.buf
    starts, ends = s.runs(ts.INK_BYTES[buf])
    off = s.per_text(starts)
    own = ts.owner(off)
    h = ts.span_hash(buf, starts, ends)
    n_words = np.diff(off)
    ink_chars = ts.sums(ts.INK_BYTES[buf] & ((buf & 0xC0) != 0x80), s.at)
    symbols = ts.sums(_SYMBOLS[buf], s.at)
    # lines with a word that equal an earlier line of the text
    lines = buf != 10
    edge = np.zeros(len(buf) + 1, bool)
    edge[s.at] = True
    edge[1:][~lines] = True
    cut = np.flatnonzero(edge)  # a line begins at the start of a text and after each \n
    last = np.append(cut[1:], len(buf))
    last = last - ((last > cut) & (buf[np.maximum(last - 1, 0)] == 10))
    inked = np.searchsorted(starts, last) > np.searchsorted(starts, cut)
    line_at, line_end = cut[inked], last[inked]
    line_off = s.per_text(line_at)
    line_hash = ts.span_hash(buf, line_at, line_end)
    _, earlier = _repeats(line_hash, ts.owner(line_off))
    n_dup = ts.sums(earlier, line_off)
    # words in 3-word windows that come twice or more
    w, at = ts.windows(h, off, 3)
    again, _ = _repeats(w, own[at] if len(at) else at)
    step = np.zeros(len(h) + 1, np.int64)
    hit = at[again]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + 3, -1)
    n_repeat = ts.sums(np.cumsum(step[:-1]) > 0, off)
    # ratios
    words = np.maximum(n_words, 1)
    letters = np.maximum(ts.sums(_LETTER[buf], s.at), 1)
    bytes_ = np.maximum(np.diff(s.at), 1)
    _, repeated = _repeats(h, own)
    n_lines = np.maximum(np.diff(line_off), 1)
    short = (ends - starts) <= 3
    return [
        n_words, ink_chars, symbols, n_dup, n_repeat,
        n_words.astype(float), ink_chars / words, symbols / words, n_dup / n_lines, n_repeat / words,
        ts.sums(_UPPER[buf], s.at) / letters, ts.sums(_DIGIT[buf], s.at) / bytes_, ts.sums(_MARK[buf], s.at) / words,
        1 - ts.sums(repeated, off) / words, n_words / n_lines, ts.sums(short, off) / words,
    ]


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) in the struct ``doc``, with the statistics of its whole text."""
    names = ["doc", *COUNTS, *FEATURES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), *map(pa.array, _stats(s))], names)

    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col("text").alias("_text"))
    return doc.mapInArrow(scan, StructType([doc.schema["doc"], *StructType.fromDDL(STATS).fields]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Condition = tuple[str, str, float]  # feature, ">=" or "<=", threshold
Rule = list[Condition]


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, t in rule:
        v = x[:, FEATURES.index(name)]
        out &= v >= t if sign == ">=" else v <= t
    return out


def _grow(x: np.ndarray, bad: np.ndarray, steps: int) -> Rule:
    """Add the condition of most gain until no good document is covered or no condition helps."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < steps and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        now = np.log2(p / (p + n))
        best = (0.0, None)
        for i, name in enumerate(FEATURES):
            v = x[inside, i]
            y = bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[1:] != v[:-1])
            if not len(ends):
                continue
            bad_low = np.cumsum(y)[ends].astype(float)
            all_low = ends + 1.0
            for sign, pos, tot in (("<=", bad_low, all_low), (">=", p - bad_low, p + n - all_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / tot) - now), 0)
                j = int(np.argmax(gain))
                if gain[j] > best[0] + 1e-9:
                    best = (float(gain[j]), (name, sign, float((v[ends[j]] + v[ends[j] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers(x, rule[-1:])
    return rule


def _prune(x: np.ndarray, bad: np.ndarray, rule: Rule) -> Rule:
    """Shortest prefix with the best (bad - good) / covered on the held-out part."""

    def worth(r: Rule) -> float:
        inside = _covers(x, r)
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, rules: int = 16, steps: int = 5, seed: int = 7) -> list[Rule]:
    """Ordered rules, each a conjunction; what any of them covers is bad. A rule stays if it is right for
    ``precision`` of what it covers on the held-out third, with all documents as its background."""
    rng = np.random.default_rng(seed)
    held = rng.random(len(x)) < 1 / 3
    left = np.ones(len(x), bool)
    found: list[Rule] = []
    while len(found) < rules and (bad & left & ~held).any():
        rule = _grow(x[left & ~held], bad[left & ~held], steps)
        rule = _prune(x[left & held], bad[left & held], rule) if rule and (left & held).any() else rule
        if not rule:
            break
        inside = _covers(x, rule) & left
        right = (bad & inside).sum()
        check = inside & held
        if right < max(3, precision * inside.sum()) or (check.any() and (bad & check).sum() < precision * check.sum()):
            break
        found.append(rule)
        left &= ~inside
    return found


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1 in order; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, sign, t in rule:
            test = test & (F.col(name) >= F.lit(t) if sign == ">=" else F.col(name) <= F.lit(t))
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def training_rows(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and verdicts (1: bad) of at most ``max_train`` labelled documents."""
    own = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("_bad"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    found = stats.select(F.col("doc.doc_id").alias("doc_id"), *FEATURES).join(own, "doc_id")
    one = found.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in [*FEATURES, "_bad"]])
    rows = one.orderBy("doc_id").toArrow()
    x = np.column_stack([np.asarray(rows[c]) for c in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return x, np.asarray(rows["_bad"]).astype(bool)


def judge(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the columns ``keep``, by default all), statistics, ``base_failed``, ``rule`` (0: none) and ``kept`` per document."""
    stats = stage(statistics(docs, keep), "text-statistics")
    x, bad = training_rows(stats, labels, max_train)
    rule = expression(learn(x, bad)).alias("rule")
    return stats.withColumn("base_failed", base_failed()).select("*", rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document, with the number of the rule that rejected it."""
    return judge(docs, labels, keep=["doc_id"]).select("doc.doc_id", *COUNTS, "base_failed", "kept", "rule")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the base rule or a learned rule rejects."""
    return judge(docs, labels).filter("kept").select("doc.*")
