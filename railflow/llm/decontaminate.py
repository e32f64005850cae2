"""Benchmark decontamination (4): training windows against a broadcast set of test n-grams.

Benchmark items become normalised windows of ``n`` words (an item of fewer words is one window).
Their hashes are broadcast while there are at most ``MAX_BROADCAST_WINDOWS``; a larger benchmark
is joined by hash instead. Every hash hit is verified on the words themselves. One scan of the
documents, no shuffle of text on the broadcast path.

Defined cases: a null or empty text has no words and no hits; a null ``item_id`` counts as the
empty name; items with one name are one item; repeated documents give repeated rows; without
items nothing is hit; other columns of either table are ignored or passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railflow.llm import textscan as ts
from railflow.staging import stage

N = 10
MAX_BROADCAST_WINDOWS = 1_000_000  # about 150 MB of hashes and words
WINDOW = "item string, k int, h bigint, words binary"
SCANNED = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"


class _Words:
    """The words of a slice: lower-cased bytes, spans, hashes, offsets per text."""

    def __init__(self, s: ts.Slice):
        self.low = ts.LOWER[s.buf]
        self.starts, self.ends = s.runs(ts.WORD_BYTES[s.buf])
        self.hash = ts.span_hash(self.low, self.starts, self.ends)
        self.offsets = s.per_text(self.starts)

    def text(self, i: int, k: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[i : i + k], self.ends[i : i + k], strict=True))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows of the items: ``item``, length ``k``, hash ``h``, ``words`` joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for s in ts.slices(batch.column(1)):
                w, rows = _Words(s), []
                for t in range(s.n):
                    lo, hi = w.offsets[t], w.offsets[t + 1]
                    k = int(min(n, hi - lo))
                    rows += [(names[s.first + t], k, w.text(i, k)) for i in range(lo, hi - k + 1) if k]
                if rows:
                    yield _hashed(rows)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    return items.mapInArrow(cut, WINDOW).distinct()


def _hashed(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    """Window hashes of joined words, computed as ``ts.windows`` does for documents."""
    words = ts.slices(pa.array([r[2] for r in rows], pa.large_binary()).cast(pa.large_string()), 1 << 62)
    w = _Words(next(words))
    h = np.zeros(len(rows), ts.U)
    for k in {r[1] for r in rows}:
        of, at = ts.windows(w.hash, w.offsets, k)
        first = np.full(len(w.hash), -1)
        first[at] = np.arange(len(at))
        own = [i for i, r in enumerate(rows) if r[1] == k]
        h[own] = of[first[w.offsets[own]]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array(h.view(np.int64)),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        ["item", "k", "h", "words"],
    )


class Table:
    """Windows of all items, ready for lookups; bounded by ``MAX_BROADCAST_WINDOWS``."""

    def __init__(self, rows: pa.Table):
        self.lengths = sorted(set(rows["k"].to_pylist()))
        self.names = sorted(set(rows["item"].to_pylist()))
        number = {x: i for i, x in enumerate(self.names)}
        self.found: dict[int, dict[bytes, list[int]]] = {}
        hashes = np.asarray(rows["h"]).astype(np.int64).view(ts.U)
        for h, item, words in zip(hashes.tolist(), rows["item"].to_pylist(), rows["words"].to_pylist(), strict=True):
            self.found.setdefault(h, {}).setdefault(words, []).append(number[item])
        self.hash = np.unique(hashes)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hash >> ts.U(42)] = True

    def hits(self, w: _Words) -> Iterator[tuple[int, int, list[int]]]:
        """Verified hits: index of the first word, number of words, items."""
        for k in self.lengths:
            h, at = ts.windows(w.hash, w.offsets, k)
            near = np.flatnonzero(self.filter[h >> ts.U(42)])
            if len(near):
                place = np.minimum(np.searchsorted(self.hash, h[near]), len(self.hash) - 1)
                near = near[self.hash[place] == h[near]]
            for i, x in zip(at[near].tolist(), h[near].tolist(), strict=True):
                items = self.found[x].get(w.text(i, k))
                if items:
                    yield i, k, items


def _result(s: ts.Slice, w: _Words, hits: Iterator[tuple[int, int, list[int]]], names: list[str]) -> list[pa.Array]:
    step = np.zeros(len(w.starts) + 1, np.int64)
    pairs: set[tuple[int, int]] = set()
    for i, k, items in hits:
        step[i] += 1
        step[i + k] -= 1
        t = int(np.searchsorted(w.offsets, i, "right")) - 1
        pairs.update((t, x) for x in items)
    hit = np.cumsum(step[:-1]) > 0
    found: list[list[str]] = [[] for _ in range(s.n)]
    for t, x in sorted(pairs):
        found[t].append(names[x])
    spans: list[list[dict[str, int]]] = [[] for _ in range(s.n)]
    if hit.any():
        chars = ts.code_points(s.buf)
        joined = np.zeros(len(hit) + 1, bool)
        joined[1:-1] = hit[1:] & hit[:-1]
        joined[w.offsets] = False
        for a, b in zip(np.flatnonzero(hit & ~joined[:-1]), np.flatnonzero(hit & ~joined[1:]), strict=True):
            t = int(np.searchsorted(w.offsets, a, "right")) - 1
            zero = chars[s.at[t]]
            spans[t].append({"start": int(chars[w.starts[a]] - zero), "end": int(chars[w.ends[b]] - zero)})
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [
        pa.array(np.diff(w.offsets)), pa.array(ts.sums(hit, w.offsets)), pa.array(found, pa.list_(pa.string())), pa.array(spans, span),
    ]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """All columns of ``docs`` in the struct ``doc``, with ``n_words``, ``n_hit`` (words inside an occurring
    window), ``items`` (names of items with occurring windows) and the hit ``spans`` in code points."""
    table = stage(benchmark_windows(benchmark, n), "benchmark-windows")
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("_text"))
    schema = f"doc {doc.schema['doc'].dataType.simpleString()}, {SCANNED}"
    if table.count() > max_broadcast:
        return _scan_joined(doc, table, schema)
    windows = docs.sparkSession.sparkContext.broadcast(Table(table.toArrow()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = windows.value
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                w = _Words(s)
                out = _result(s, w, t.hits(w), t.names)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), *out], ["doc", "n_words", "n_hit", "items", "spans"])

    return doc.mapInArrow(look, _schema(doc, SCANNED))


def _schema(doc: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([doc.schema["doc"], *StructType.fromDDL(more).fields])


def _scan_joined(doc: DataFrame, table: DataFrame, schema: str) -> DataFrame:
    """The same by a hash join, for a benchmark too large to broadcast."""
    rows = stage(doc.withColumn("_row", F.monotonically_increasing_id()), "documents-rows")
    lengths = [r["k"] for r in table.select("k").distinct().collect()]  # n values at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.asarray(batch.column(0))
            for s in ts.slices(batch.column(1)):
                w = _Words(s)
                for k in lengths:
                    h, at = ts.windows(w.hash, w.offsets, k)
                    t = np.searchsorted(w.offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[s.first + t]), pa.array(at - w.offsets[t]), pa.array(np.full(len(at), k, np.int32)), pa.array(h.view(np.int64))],
                        ["_row", "i", "k", "h"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            claims = batch.column(2).to_pylist()
            for s in ts.slices(batch.column(1)):
                w = _Words(s)
                own = [(t, c) for t in range(s.n) for c in claims[s.first + t] or []]
                names = sorted({c["item"] for _, c in own})
                hits = (
                    (int(w.offsets[t]) + c["i"], c["k"], [names.index(c["item"])])
                    for t, c in own
                    if w.text(int(w.offsets[t]) + c["i"], c["k"]) == c["words"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), *_result(s, w, hits, names)], ["doc", "n_words", "n_hit", "items", "spans"]
                )

    found = rows.select("_row", "_text").mapInArrow(emit, "_row bigint, i bigint, k int, h bigint").join(table, ["k", "h"])
    claims = found.groupBy("_row").agg(F.collect_list(F.struct("i", "k", "item", "words")).alias("claims"))
    return rows.join(claims, "_row", "left").select("doc", "_text", "claims").mapInArrow(verify, _schema(doc, SCANNED))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row per document."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc.doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without the hit documents, or (``mode="spans"``) with the hit spans cut from their texts."""
    found = scan(docs, benchmark, n)
    if mode == "documents":
        return found.filter("n_hit = 0").select("doc.*")
    text = F.aggregate(
        F.reverse("spans"),
        F.col("doc.text"),
        lambda t, x: F.concat(F.substring(t, F.lit(1), x["start"].cast("int")), F.substring(t, x["end"].cast("int") + 1, F.length(t))),
    )
    return found.select(*[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
