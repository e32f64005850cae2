"""N-gram Jaccard join (2): a chosen-path join of the documents' sets of word n-grams.

A document is the set of its windows of ``n`` normalised words. Equal sets are one set by a 128-bit
hash. MinHash embeds a set in ``SKETCH`` tokens. A run splits all sets on one or two sampled tokens;
a bucket of more than ``LEAF`` sets is split again on tokens its own hash samples, down to
``DEPTH``; the sets of a leaf are compared by brute force on their sketches, in block pairs. Runs
repeat until a pair of the wanted similarity is met with probability ``RECALL``. The candidate links
of all leaves form components; inside a component every pair is verified on the exact sets, which
gives each set's number of links and the final classes. Only sets in a component send their n-grams.

Defined cases: a text of fewer words than ``n`` is one window of all its words; a null text, or one
without words, is in no link and a class of its own row; repeated documents are copies, of one class;
other columns pass through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from railflow.llm import linking
from railflow.llm import textscan as ts
from railflow.staging import stage

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
SKETCH = 64
LEAF = 500
DEPTH = 3
BLOCK = 512
CELLS = 4_000_000  # of a membership matrix held at a time

_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, SKETCH, dtype=np.uint64) * ts.U(2) + ts.U(1)


def meeting(similarity: float, depth: int) -> float:
    """Probability that a pair of that similarity shares a leaf of one run that is ``depth`` splits deep.

    A split takes one token in three of four nodes and two in the fourth: 1.25 on average, the inverse of 0.8."""
    q = 1.0
    for _ in range(depth):
        x = similarity * q
        q = 0.75 * x + 0.25 * (1 - (1 - x) ** 2)
    return q


def runs(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting(similarity, depth)))


def _sets(s: ts.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it, and their offsets per text."""
    starts, ends = s.runs(ts.WORD_BYTES[s.buf])
    off = s.per_text(starts)
    h = ts.span_hash(ts.LOWER[s.buf], starts, ends)
    w, at = ts.windows(h, off, n)
    text = np.searchsorted(off, at, "right") - 1
    size = np.diff(off)
    for k in range(1, n):  # short texts are one window
        few = np.flatnonzero(size == k)
        if len(few):
            w, text = np.append(w, ts.window_hash(h, off[few], k)), np.append(text, few)
    order = np.lexsort((w, text))
    w, text = w[order], text[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (text[1:] != text[:-1])
    w, text = w[new], text[new]
    return w, np.searchsorted(text, np.arange(s.n + 1)).astype(np.int64)


def _sums(w: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(w) + 1, ts.U)
    np.cumsum(w, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _keys(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each set, as two longs."""
    one, two = _sums(ts.mix(w + ts.U(11)), off), _sums(ts.mix(w ^ ts.U(0xA5A5A5A5A5A5)), off)
    return ts.mix(one + np.diff(off).astype(ts.U)).view(np.int64), ts.mix(two).view(np.int64)


def sketches(docs: DataFrame, n: int = N) -> DataFrame:
    """Per row of ``docs`` (first column: its name, second: text): set hashes ``h``, ``h2``, ``size`` and ``sketch``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                w, off = _sets(s, n)
                h, h2 = _keys(w, off)
                size = np.diff(off)
                full = np.flatnonzero(size)
                sketch = np.zeros((s.n, SKETCH), np.uint32)
                for k in range(SKETCH):
                    if len(full):
                        sketch[full, k] = np.minimum.reduceat(w * _FACTORS[k], off[full]) >> ts.U(32)
                flat = pa.array(sketch.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.n), pa.array(h), pa.array(h2), pa.array(size),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, s.n * SKETCH + 1, SKETCH, dtype=np.int32)), flat),
                    ],
                    ["row", "h", "h2", "size", "sketch"],
                )

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(scan, StructType.fromDDL(f"row {kind}, h bigint, h2 bigint, size bigint, sketch array<int>"))


def _children(bucket: Column) -> Column:
    """Buckets below ``bucket`` of a set with ``sketch``: one or two sampled tokens, by the bucket's own hash."""

    def child(k: int) -> Column:
        at = F.pmod(F.xxhash64(bucket, F.lit(k)), F.lit(SKETCH)).cast("int")
        return F.xxhash64(bucket, at, F.get("sketch", at))

    two = F.pmod(F.xxhash64(bucket, F.lit(-1)), F.lit(4)) == 0
    return F.when(two, F.array_distinct(F.array(child(0), child(1)))).otherwise(F.array(child(0)))


def leaves(sets: DataFrame, n_runs: int, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """(``bucket``, ``h``): the leaves, of two sets or more, in which each set ends up."""
    roots = F.flatten(F.array(*[_children(F.lit(r)) for r in range(n_runs)]))
    paths = sets.select("h", F.explode(roots).alias("bucket"))
    out = None
    for level in range(1, depth + 1):
        paths = stage(paths, f"paths-{level}")
        sizes = paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        placed = stage(paths.join(sizes, "bucket"), f"buckets-{level}")
        done = (placed if level == depth else placed.filter(F.col("_n") <= leaf)).select("bucket", "h")
        out = done if out is None else out.union(done)
        if level < depth:
            wide = placed.filter(F.col("_n") > leaf).select("bucket", "h")
            paths = wide.join(sets.select("h", "sketch"), "h").select("h", F.explode(_children(F.col("bucket"))).alias("bucket"))
    return out


def _alike(similarity: float) -> linking.Linked:
    """Sketches that agree in so many tokens that the wanted similarity is within four standard deviations."""
    least = SKETCH * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / SKETCH))

    def linked(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, bool)
        x = table["sketch"].combine_chunks().flatten()
        x = np.asarray(x).reshape(len(table), SKETCH)
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 20_000):
            part = slice(lo, lo + 20_000)
            out[part] = (x[a[part]] == x[b[part]]).sum(axis=1) >= least
        return out

    return linked


class _Exact:
    """Jaccard similarity of at least ``similarity`` on exact sets, from products of membership matrices."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.table: pa.Table | None = None

    def __call__(self, table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if table is not self.table:
            self.table, self.g, self.common = table, np.asarray(table["_g"]), {}
            self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["grams"].combine_chunks()]
            self.size = np.array([len(x) for x in self.sets])
        out = np.zeros(len(a), bool)
        order = np.argsort(self.g[a], kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(self.g[a][order])) + 1):
            if not len(own):
                continue
            first = int(np.searchsorted(self.g, self.g[a[own[0]]]))
            if first not in self.common:
                self.common = {first: self._common(first, int(np.searchsorted(self.g, self.g[first], "right")))}
            both = self.common[first][a[own] - first, b[own] - first]
            out[own] = both >= self.similarity * (self.size[a[own]] + self.size[b[own]] - both) - 1e-9
        return out

    def _common(self, lo: int, hi: int) -> np.ndarray:
        """Sizes of the intersections of the sets of a group."""
        flat = np.concatenate(self.sets[lo:hi])
        owner = np.repeat(np.arange(hi - lo), self.size[lo:hi])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        token = np.cumsum(new) - 1
        held = np.bincount(token)
        shared = held[token] > 1  # others add to no intersection
        token, owner = np.cumsum(held > 1)[token[shared]] - 1, owner[shared]
        out = np.zeros((hi - lo, hi - lo), np.float64)
        width = max(1, CELLS // (hi - lo))
        for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            i, j = np.searchsorted(token, (at, at + width))
            part = np.zeros((hi - lo, width), np.float32)
            part[owner[i:j], token[i:j] - at] = 1
            out += part @ part.T
        np.fill_diagonal(out, self.size[lo:hi])
        return out


def _grams(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(``h``, ``grams``) of the sets in ``wanted`` (and of a few more that the filter lets pass)."""
    some = docs.sparkSession.sparkContext.broadcast(linking.membership_filter(wanted, "h"))  # 8 MB

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                w, off = _sets(s, n)
                h, _ = _keys(w, off)
                own = np.flatnonzero(some.value.has(h) & (np.diff(off) > 0))
                own = own[np.unique(h[own], return_index=True)[1]]
                grams = [w[off[t] : off[t + 1]].tobytes() for t in own]
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(grams, pa.binary())], ["h", "grams"])

    return docs.mapInArrow(emit, "h bigint, grams binary").groupBy("h").agg(F.first("grams").alias("grams"))


def classes(
    docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH
) -> DataFrame:
    """One row per row of ``docs`` (its first column names the row, its second is the text): ``row``, ``class_id``
    (the smallest name in its class) and ``n_links`` (other rows of at least that similarity)."""
    known = stage(sketches(docs, n), "sketches")
    sets = stage(
        known.filter("size > 0").groupBy("h", "h2").agg(
            F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")
        ),
        "sets",
    )
    met = leaves(sets, runs(similarity, recall, depth), leaf, depth)
    dealt = linking.blocks(met.join(sets.select("h", "sketch"), "h"), "bucket", "h", BLOCK)
    likely = linking.components(linking.edges_within(dealt, "h", _alike(similarity)), "likely")
    grams = stage(_grams(docs, likely.withColumnRenamed("id", "h"), n), "grams")
    members = likely.withColumnRenamed("id", "h").join(grams, "h").join(sets.select("h", "copies"), "h")
    found = stage(
        linking.links_within(linking.blocks(members, "root", "h", BLOCK), "h", _Exact(similarity), "copies", roots=True), "links"
    )
    near = found.groupBy(F.col("id").alias("h")).agg(F.sum("n").alias("_near"))
    roots = linking.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "classes").withColumnRenamed("id", "h")
    own = stage(sets.drop("sketch").join(roots, "h", "left").join(near, "h", "left"), "set-classes")
    first = own.filter("root is not null").groupBy("root").agg(F.min("first").alias("_first"))
    by_set = own.join(first, "root", "left").select(
        "h", "h2", F.coalesce("_first", "first").alias("class_id"), (F.coalesce("_near", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = known.filter("size = 0").select("row", F.col("row").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return known.filter("size > 0").select("row", "h", "h2").join(by_set, ["h", "h2"]).select("row", "class_id", "n_links").union(alone)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its class (the smallest doc_id in it) and its number of links."""
    return classes(docs.select("doc_id", "text")).withColumnRenamed("row", "doc_id")


def without_near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "documents-rows")
    stay = classes(rows.select("_row", "text"), n, similarity).filter("row = class_id").select(F.col("row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
