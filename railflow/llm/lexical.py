"""Ranked lexical search (13): hashed max-sketches give bounds, exact rescoring in descending order of the bounds.

``index`` reads every whole text once and writes one row per document: its number of terms, its distinct terms
(sorted 64-bit hashes) with their frequencies, and a max-sketch. Each term folds its frequency into two cells of the
sketch, which keep the coordinatewise maximum. Inside a document the impact of a term grows with its frequency alone,
so a cell's maximum bounds the impacts of its terms whatever the corpus counts turn out to be; an index can be written
before they are known, and added to.

``search`` takes the items in blocks of bounded size. For a block one job counts the documents of its terms, and one
job ranks: a task looks the terms of all items of the block up in the sketches of many documents at once, the smaller of a term's two
cells bounds its impact, and the weighted sum bounds the score. The documents of each item are rescored exactly in
descending order of their bounds, more and more at a time, until no bound reaches the item's threshold, its ``k``-th best score so
far, which is carried on through the task. A task gives at most ``k`` rows an item; these are merged by one more ranking.
The result is exact: a bound is never below the score, and ties with the threshold are rescored.

Defined cases: a null text, or one without terms, is no document and, as an item, finds nothing; a document without a
term of the item is not listed; equal scores go by ascending id, null ids last; repeated documents and repeated items are each ranked on
their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from railflow.llm import textscan as ts
from railflow.staging import stage

K = 10
CELLS = 4  # of a sketch per distinct term, at least
LEAST, MOST = 16, 1 << 14  # cells of a sketch
FULL = 255  # a cell of that value bounds nothing below the greatest impact
BLOCK_TERMS = 100_000  # distinct terms, summed over the items of a block
HELD = 1 << 21  # bounds of single terms that a task holds at a time
#: Fixed values of the scoring formula: greatest impact of a term, and the two shares (in hundredths) of the length normalisation.
TOP_IMPACT = 1_000_000
LENGTH_SHARE = 75
POSTED = "n bigint, terms binary, freqs binary, sketch binary"


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    """The length normalisation ``m`` of a document of ``n`` terms, in hundredths."""
    return 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms


def impact(freq: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(freq > 0, (1000 * TOP_IMPACT * freq) // np.maximum(1000 * freq + 8 * m, 1), 0)


def _cells(h: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of a term in a sketch of ``width`` (a power of two)."""
    return (h >> ts.U(44)).astype(np.int64) & (width - 1), (h >> ts.U(24)).astype(np.int64) & (width - 1)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each pair of consecutive offsets in ``data``."""
    at = np.ascontiguousarray(offsets * data.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Contents of a binary column end to end, and the offsets of its rows, in units of ``kind``."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind) if len(raw) else np.zeros(0, kind), (at - at[0]) // size


def _posted(s: ts.Slice) -> list[pa.Array]:
    starts, ends = s.runs(ts.WORD_BYTES[s.buf])
    off = s.per_text(starts)
    different, number = np.unique(ts.span_hash(ts.LOWER[s.buf], starts, ends), return_inverse=True)
    many = max(1, len(different))
    pair, freq = np.unique(ts.owner(off) * many + number, return_counts=True)
    doc, terms = pair // many, different[pair % many] if len(different) else different
    held = np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int64)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(CELLS * np.diff(held), 1))).astype(np.int64), LEAST, MOST)
    at = np.zeros(s.n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    sketch = np.zeros(int(at[-1]), np.uint8)
    capped = np.minimum(freq, FULL).astype(np.uint8)
    for cell in _cells(terms, width[doc]):
        np.maximum.at(sketch, at[doc] + cell, capped)
    return [pa.array(np.diff(off)), _binary(terms, held), _binary(freq.astype(np.int32), held), _binary(sketch, at)]


def index(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (first column: its id, second: its text): ``id``, ``n``, ``terms``, ``freqs``, ``sketch``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                posted = [x if i == 0 else x.cast(pa.binary()) for i, x in enumerate(_posted(s))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), *posted], ["id", "n", "terms", "freqs", "sketch"])

    return docs.mapInArrow(scan, StructType([StructField("id", docs.schema[0].dataType), *StructType.fromDDL(POSTED).fields]))


class _Block:
    """Items of a block: the distinct ``terms`` of all, and per item (from ``first[q]`` on) its terms and their repeats."""

    def __init__(self, rows: pa.Table):
        self.names = np.asarray(rows["_q"]).astype(np.int64)
        terms, off = _flat(rows["terms"].combine_chunks(), np.uint64)
        repeats, _ = _flat(rows["freqs"].combine_chunks(), np.int32)
        self.first, self.size = off[:-1], np.diff(off)
        self.terms, self.term = np.unique(terms, return_inverse=True)
        self.repeats = repeats.astype(np.int64)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.terms >> ts.U(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of the block, and their numbers."""
        at = np.flatnonzero(self.near[h >> ts.U(44)])
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[place] == h[at]
        return at[same], place[same]


def _frequencies(posted: DataFrame, block: _Block) -> np.ndarray:
    """Number of documents of each term of the block."""
    shared = posted.sparkSession.sparkContext.broadcast(block)  # about BLOCK_TERMS terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(len(b.terms), np.int64)
        for batch in batches:
            total += np.bincount(b.find(_flat(batch.column(0), np.uint64)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

    got = posted.select("terms").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.terms), np.int64)
    out[np.asarray(got["t"])] = np.asarray(got["n"])
    return out


class _Ranking:
    """The best ``k`` documents so far of each item of a block, and the scores that others have to reach."""

    def __init__(self, block: _Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.block, self.k, self.n_docs, self.n_terms = block, k, n_docs, n_terms
        self.worth = block.repeats * weights[block.term]  # of each term of each item
        self.items = np.flatnonzero(block.size > 0)
        self.least = np.ones(len(block.size), np.int64)
        self.best: list[list[tuple[int, bool, object]]] = [[] for _ in block.size]

    def take(self, batch: pa.RecordBatch) -> None:
        n = np.asarray(batch.column(1))
        m = np.array([length_factor(x, self.n_docs, self.n_terms) for x in n.tolist()], np.int64)
        terms, held = _flat(batch.column(2), np.uint64)
        freqs, _ = _flat(batch.column(3), np.int32)
        sketch, at = _flat(batch.column(4), np.uint8)
        width = np.diff(at)
        for w in np.unique(width[n > 0]).tolist():
            cells = _cells(self.block.terms, w)
            rows = np.flatnonzero((width == w) & (n > 0))
            step = max(1, HELD // max(len(self.block.term), w))
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                folded = sketch[at[own][:, None] + np.arange(w)]
                bound = self._bounds(np.minimum(folded[:, cells[0]], folded[:, cells[1]]), m[own])
                self._rescore(bound, m[own], batch.column(0), own, terms, freqs, held)

    def _bounds(self, freq: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of documents (rows) for items (columns), from bounds of the terms' frequencies."""
        table = impact(np.arange(FULL + 1)[None, :], m[:, None]).astype(np.float64)
        table[:, FULL] = TOP_IMPACT
        single = np.take_along_axis(table, freq.astype(np.intp), axis=1)[:, self.block.term]
        single *= self.worth
        out = np.zeros((len(m), len(self.block.size)))
        if len(self.items):
            out[:, self.items] = np.add.reduceat(single, self.block.first[self.items], axis=1)
        return out

    def _rescore(
        self, bound: np.ndarray, m: np.ndarray, ids: pa.Array, own: np.ndarray, terms: np.ndarray, freqs: np.ndarray, held: np.ndarray
    ) -> None:
        open_ = np.flatnonzero((bound >= self.least).any(axis=0))
        if not len(open_):
            return
        order = np.argsort(-bound[:, open_], axis=0, kind="stable")
        exact: np.ndarray | None = None
        lo, size = 0, self.k
        while lo < len(bound):
            ranked = order[lo : lo + size]
            item = np.broadcast_to(open_, ranked.shape)
            still = bound[ranked, item] >= self.least[item]
            if not still.any():
                return
            if exact is None:
                exact = self._exact_freqs(own, terms, freqs, held)
            self._score(exact, ranked[still], item[still], m, ids, own)
            lo, size = lo + size, size * 4

    def _exact_freqs(self, own: np.ndarray, terms: np.ndarray, freqs: np.ndarray, held: np.ndarray) -> np.ndarray:
        size = held[own + 1] - held[own]
        row = np.repeat(np.arange(len(own)), size)
        at = np.repeat(held[own] - np.cumsum(size) + size, size) + np.arange(len(row))
        hit, term = self.block.find(terms[at])
        out = np.zeros((len(own), len(self.block.terms)), np.int32)
        out[row[hit], term] = freqs[at[hit]]
        return out

    def _score(self, exact: np.ndarray, row: np.ndarray, item: np.ndarray, m: np.ndarray, ids: pa.Array, own: np.ndarray) -> None:
        size = self.block.size[item]
        pair = np.repeat(np.arange(len(row)), size)
        first = np.cumsum(size) - size
        at = np.repeat(self.block.first[item] - first, size) + np.arange(len(pair))
        freq = exact[row[pair], self.block.term[at]].astype(np.int64)
        some = np.flatnonzero(freq)
        score = np.zeros(len(row), np.int64)
        np.add.at(score, pair[some], self.worth[at[some]] * impact(freq[some], m[row[pair[some]]]))
        good = np.flatnonzero(score >= self.least[item])
        for i in good[np.argsort(-score[good], kind="stable")].tolist():
            q, value = int(item[i]), int(score[i])
            if value < self.least[q]:
                continue
            name = ids[int(own[row[i]])].as_py()
            best = self.best[q]
            best.append((-value, name is None, name))
            if len(best) >= self.k:
                best.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
                del best[self.k :]
                self.least[q] = -best[-1][0]


def search(posted: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Of an ``index`` that has been written, the ``k`` best documents for each row of ``items`` (first column: its
    id, second: its text): ``item``, ``rank``, ``id``, ``score``."""
    asked = stage(index(items).withColumn("_q", F.monotonically_increasing_id()), "items")
    counted = posted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    total = asked.agg(F.sum(F.length("terms") / 8).alias("t")).first()["t"] or 0
    blocks = max(1, math.ceil(total / block_terms))
    kind = StructType([StructField("id", posted.schema["id"].dataType), *StructType.fromDDL("_q bigint, score bigint").fields])
    found = None
    for b in range(blocks if counted["docs"] else 0):
        block = _Block(asked.filter((F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b) & (F.col("n") > 0)).select("_q", "terms", "freqs").toArrow())
        if not len(block.terms):
            continue
        weights = np.array([weight(counted["docs"], df) for df in _frequencies(posted, block).tolist()], np.int64)
        ranked = stage(_ranked(posted, _Ranking(block, weights, counted["docs"], counted["terms"], k), kind), "ranked")
        found = ranked if found is None else found.union(ranked)
    if found is None:
        found = posted.sparkSession.createDataFrame([], kind)
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())  # k rows a task
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(asked.select("_q", F.col("id").alias("item")), "_q").select("item", "rank", "id", "score")


def _ranked(posted: DataFrame, ranking: _Ranking, kind: StructType) -> DataFrame:
    shared = posted.sparkSession.sparkContext.broadcast(ranking)  # about BLOCK_TERMS terms

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = copy.deepcopy(shared.value)  # a worker keeps the broadcast value for its next task
        as_id = None
        for batch in batches:
            as_id = batch.schema.field(0).type
            r.take(batch)
        rows = [(-score, name, int(r.block.names[q])) for q, best in enumerate(r.best) for score, _, name in best]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[1] for x in rows], as_id), pa.array([x[2] for x in rows], pa.int64()), pa.array([x[0] for x in rows], pa.int64())],
                ["id", "_q", "score"],
            )

    return posted.select("id", "n", "terms", "freqs", "sketch").mapInArrow(rank, kind)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows: the best documents of each item."""
    posted = stage(index(docs.select("doc_id", "text")), "postings")
    found = search(posted, benchmark.select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").cast("bigint").alias("doc_id"), "score")
