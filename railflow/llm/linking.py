"""Links between items that share a bucket: bounded filters, blocks, forests and components.

Nothing here emits the pairs of a bucket or holds a whole bucket in one task. A bucket larger than a
block is dealt out as pairs of blocks; a task checks the pairs inside its block pair and emits at
most one row per item: an edge of a spanning forest, or a number of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railflow.staging import stage

BITS = 26  # of a membership filter: 2**26 bits are 8 MB, whatever the number of members
PAIRS = 100_000  # pairs checked at a time


class Filter:
    """A bitmap of 64-bit ids: never misses a member, may let others pass."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, ids: np.ndarray) -> np.ndarray:
        h = ids.view(np.uint64)
        word = self.words[(h >> np.uint64(70 - BITS)).astype(np.int64)]
        return (word >> ((h >> np.uint64(64 - BITS)) & np.uint64(63))) & np.uint64(1) == 1


def membership_filter(ids: DataFrame, column: str) -> Filter:
    """Built by a bitwise aggregate of at most ``2**(BITS - 6)`` rows."""
    top = F.shiftrightunsigned(F.col(column), 64 - BITS)
    rows = ids.select(top.alias("_b")).select(
        F.shiftrightunsigned("_b", 6).alias("w"), F.expr("shiftleft(1L, cast(_b & 63 as int))").alias("m")
    )
    got = rows.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << (BITS - 6), np.uint64)
    words[np.asarray(got["w"]).astype(np.int64)] = np.asarray(got["m"]).astype(np.int64).view(np.uint64)
    return Filter(words)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows equal in the first column, which arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        cut = int(np.searchsorted(key, key[-1]))
        if held and held[-1].column(0)[-1].as_py() != key[0].item():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def blocks(members: DataFrame, key: str, item: str, block: int) -> DataFrame:
    """Deal the members of each ``key`` into block pairs of at most about ``2 * block`` members.

    Adds ``_g`` (first column), the group to check, and ``_part``; in a group of two parts only pairs
    of different parts are to be checked, so each pair of a key meets once. Sorted by ``_g``."""
    sizes = stage(members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "group-sizes")  # so that Spark knows how small it is
    parts = F.ceil(F.col("_n") / block).cast("int")
    rows = (
        members.join(sizes, key)
        .withColumn("_part", F.pmod(F.xxhash64(item, F.lit(17)), parts).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("_g", F.xxhash64(key, F.least("_part", "_other"), F.greatest("_part", "_other")))
        .drop("_n")
    )
    others = [c for c in rows.columns if c not in ("_g", "_part", "_other")]
    return rows.repartition("_g").sortWithinPartitions("_g", item).select("_g", "_part", "_other", *others)


def pairs(table: pa.Table, across: bool | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to check in a table of whole groups, some at a time; with ``across`` those of different
    parts only, or (false) those of one part."""
    g, part, other = (np.asarray(table[c]) for c in ("_g", "_part", "_other"))
    single = part == other  # the group of one part with itself
    left, a, b, held = np.arange(len(g)), [], [], 0
    lag = 0
    while True:
        lag += 1
        left = left[left + lag < len(g)]
        left = left[g[left] == g[left + lag]]
        if not len(left):
            break
        i, j = left, left + lag
        ok = part[i] != part[j]
        if across is not True:
            ok = ~ok if across is False else ok | single[i]
        a.append(i[ok])
        b.append(j[ok])
        held += len(a[-1])
        if held >= PAIRS:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def forest(n: int, a: np.ndarray, b: np.ndarray, top: np.ndarray | None = None) -> np.ndarray:
    """Root (smallest number) of each of ``n`` nodes, joined by the edges; ``top`` goes on from earlier roots."""
    top = np.arange(n) if top is None else top
    while len(a):
        ra, rb = top[a], top[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(top, hi[open_], lo[open_])
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up
    return top


Linked = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def _grown(table: pa.Table, linked: Linked, top: np.ndarray, across: bool) -> np.ndarray:
    """``top`` with the linked pairs of one part, or of different parts; pairs that are joined already are not checked."""
    for a, b in pairs(table, across):
        open_ = top[a] != top[b]
        a, b = a[open_], b[open_]
        ok = linked(table, a, b)
        top = forest(len(top), a[ok], b[ok], top)
    return top


def _news(table: pa.Table, within: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Items whose root is news: in a group of two parts only the roots within a part, as the part's own group tells the
    rest. So a group of n linked items has about n edges and not n for each of its parts."""
    one = np.arange(len(top))
    single = np.asarray(table["_part"]) == np.asarray(table["_other"])
    return (top != one) & (single | (within == one))


def edges_within(dealt: DataFrame, item: str, linked: Linked) -> DataFrame:
    """Edges (``a`` < root ``b``) that join what is linked within each group of ``blocks``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            ids = np.asarray(table[item])
            within = _grown(table, linked, np.arange(len(ids)), across=False)
            top = _grown(table, linked, within.copy(), across=True)
            own = np.flatnonzero(_news(table, within, top))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[top[own]])], ["a", "b"])

    return dealt.mapInArrow(check, "a bigint, b bigint")


def links_within(dealt: DataFrame, item: str, linked: Linked, weight: str, roots: bool = False) -> DataFrame:
    """Per item and group: its verified links, counted with the partners' ``weight``, as ``n``, and (with ``roots``) an
    edge to its root in the group as ``root``, where that is news, else itself."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            ids, w = np.asarray(table[item]), np.asarray(table[weight])
            count = np.zeros(len(ids), np.int64)
            within = _grown(table, linked, np.arange(len(ids)), across=False) if roots else np.arange(len(ids))
            top = within.copy()
            for a, b in pairs(table):
                ok = linked(table, a, b)
                a, b = a[ok], b[ok]
                np.add.at(count, a, w[b])
                np.add.at(count, b, w[a])
                if roots:
                    top = forest(len(ids), a, b, top)
            root = np.where(_news(table, within, top), top, np.arange(len(ids)))
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]]), pa.array(count[own])], ["id", "root", "n"])

    return dealt.mapInArrow(check, "id bigint, root bigint, n bigint")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(``id``, ``root``): the smallest id of each item's component, for items with an edge.

    Smallest-label rounds with pointer jumping, each written out; hot centres are summed before the
    shuffle, and a join on them is one that Spark can split."""
    plain = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stage(plain.union(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{label}-edges")
    now = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")), f"{label}-roots")
    while True:
        near = now.select(F.col("id").alias("b"), F.col("root").alias("_r"))
        heard = both.join(near, "b").groupBy(F.col("a").alias("id")).agg(F.min("_r").alias("_m"))
        told = now.join(heard, "id").select("id", F.col("root").alias("_old"), F.least("root", "_m").alias("_t"))
        up = now.select(F.col("id").alias("_t"), F.col("root").alias("_u"))
        new = stage(told.join(up, "_t").select("id", F.least("_t", "_u").alias("root"), "_old"), f"{label}-roots")
        moved = new.filter("root <> _old").limit(1).count()
        now = new.select("id", "root")
        if not moved:
            return now
