"""Line dedup (1): a segment-partition edit join of the lines of all documents.

Every line with ink takes part. Equal lines are one line by a 128-bit hash. Different lines are linked when at
most ``edits`` insertions, deletions or substitutions apart, and not more than ``1 - similarity`` of the longer
one's code points; so very short lines have equal copies only. For each number of edits that a length allows, a
line is cut into one segment more than that; if two lines are that close, a segment of the shorter one occurs in
the longer one, at one of a few places that its length and the number of edits allow. One scan notes the hashes of
those places (and of a line's own segments), one shuffle by hash keeps those that different lines share.
Only such lines send their text, past a bounded filter, and are verified in block pairs by banded
bit-parallel edit distance. Spanning edges of verified pairs give components (classes); inside a
component all pairs are verified, for the number of links.

Defined cases: null or empty texts, and lines of white space, belong to no class and are always kept; of a class the
line first by (name of its row, line number, hashes of the line) stays, so neither the order nor the split of the files matters;
repeated documents are copies whose lines repeat; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from railflow.llm import linking
from railflow.llm import textscan as ts
from railflow.staging import stage

EDITS = 2
SIMILARITY = 0.9
BLOCK = 512
SEEN = 400_000  # lines a task remembers, to give the keys of a repeated line once
_LF = 10
_CODES = ts.mix(np.arange(1 << 16, dtype=np.uint64) + ts.U(0x51)) | ts.U(1)
_INK = np.ones(33, bool)
_INK[[32, 9, 10, 11, 12, 13]] = False


def allowed(size: np.ndarray, edits: int, similarity: float) -> np.ndarray:
    """Edits that a longer line of ``size`` code points allows."""
    return np.minimum(edits, ((1 - similarity) * size + 1e-9).astype(np.int64))


def schemes(edits: int, similarity: float) -> list[tuple[int, int, int]]:
    """(edits ``e``, least and largest size of a longer line that allows ``e`` of them)."""
    least = [int(np.ceil(e / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 40 for e in range(1, edits + 2)]
    return [(e, lo, hi - 1 if e < edits else 1 << 40) for e, (lo, hi) in enumerate(zip(least[:-1], least[1:], strict=True), 1) if lo < hi]


class _Lines:
    """The lines with ink of a slice as code points: spans, hashes, line numbers, texts they belong to."""

    def __init__(self, s: ts.Slice, least: int = 0, second: bool = False):
        self.cp = np.frombuffer(s.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        at = ts.code_points(s.buf)[s.at]
        edge = np.zeros(len(self.cp) + 1, bool)
        edge[at] = True
        edge[1:][self.cp == _LF] = True
        start = np.flatnonzero(edge)
        start = start[start < len(self.cp)]
        end = np.append(start[1:], len(self.cp))
        end = end - (self.cp[end - 1] == _LF) if len(end) else end
        text = np.searchsorted(at, start, "right") - 1
        first = np.searchsorted(start, at[:-1])
        number = np.arange(len(start)) - first[text]
        ink = np.zeros(len(self.cp) + 1, np.int64)
        np.cumsum(_INK[np.minimum(self.cp, 32)] | (self.cp > 32), out=ink[1:])
        own = (ink[end] > ink[start]) & (end - start >= least)
        self.start, self.end, self.text, self.number = start[own], end[own], text[own], number[own]
        self.h1 = ts.span_hash(self.cp, self.start, self.end).view(np.int64)
        if second:
            self.h2 = ts.span_hash(self.cp, self.start, self.end, 1).view(np.int64)

    def prefix(self) -> np.ndarray:
        p, _ = ts.powers(len(self.cp))
        out = np.zeros(len(self.cp) + 1, ts.U)
        code = _CODES[np.minimum(self.cp, 0xFFFF)]
        high = np.flatnonzero(self.cp >= 0xFFFF)
        if len(high):
            code[high] = ts.mix(self.cp[high].astype(np.uint64) * _CODES[1])
        code *= p[: len(self.cp)]
        np.cumsum(code, out=out[1:])
        return out

    def own(self) -> np.ndarray:
        """One line of each hash (equal lines of a slice give their keys once)."""
        return np.unique(self.h1, return_index=True)[1]


def places(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) where a longer line must hold a segment of a shorter one."""
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            after = edits - i  # segments to the right
            for shift in range(max(-i, delta - after), min(i, delta + after) + 1):
                out.append((delta, i, shift))
    return out


def _keys(lines: _Lines, one: np.ndarray, edits: int, similarity: float) -> pa.ListArray:
    """Hashes of the segments of the lines ``one`` and of the places to probe in them."""
    prefix = lines.prefix()
    size_of = lines.end - lines.start
    owner, keys = [], []
    for e, lo, hi in schemes(edits, similarity):
        for delta, i, shift in places(e):
            size = size_of[one]
            short = size - delta
            # as the shorter line (delta 0) a line may be below the least size of a longer one
            fits = (size <= hi) & (size >= (lo if delta else lo - e))
            base, longer = short // (e + 1), short % (e + 1)
            # the last ``longer`` segments have one code point more
            begin = i * base + np.maximum(0, i - (e + 1 - longer)) + shift
            width = base + (i >= e + 1 - longer)
            ok = fits & (begin >= 0) & (begin + width <= size) & (base > 0)
            at = lines.start[one[ok]] + begin[ok]
            mark = short[ok].astype(ts.U) * ts.U(0x9E3779B1) + ts.U(16 * e + i)
            keys.append(ts.mix(ts.poly_hash(prefix, at, at + width[ok]) + mark))
            owner.append(one[ok])
    line = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(line, kind="stable")
    offsets = np.searchsorted(line[order], np.arange(len(lines.start) + 1)).astype(np.int32)
    key = np.concatenate(keys)[order].view(np.int64) if keys else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key))


def _occurrences(docs: DataFrame, edits: int, similarity: float) -> DataFrame:
    """One row per line with ink: ``row`` (first column of ``docs``), ``line``, hashes, ``occ`` (tells equal rows apart),
    and the ``keys`` of its segments and places (none where the task has seen an equal line)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                x = _Lines(s, second=True)
                one = x.own()
                h = x.h1[one]
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                    one, h = one[new], h[new]
                seen = h if len(seen) + len(h) > SEEN else np.union1d(seen, h)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(done + np.arange(len(x.start))), batch.column(0).take(pa.array(s.first + x.text)),
                        pa.array(x.number.astype(np.int32)), pa.array(x.h1), pa.array(x.h2), _keys(x, one, edits, similarity),
                    ],
                    ["occ", "row", "line", "h1", "h2", "keys"],
                )
                done += len(x.start)

    kind = StructField("row", docs.schema[0].dataType)
    rest = StructType.fromDDL("occ bigint, line int, h1 bigint, h2 bigint, keys array<bigint>").fields
    return docs.mapInArrow(scan, StructType([rest[0], kind, *rest[1:]]))


def _shared_keys(lines: DataFrame) -> DataFrame:
    """(``key``, ``h``) where at least two different lines have the key."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and line, one of each line whose key has another line; holds one row only."""
        last: tuple[int, int] | None = None
        given = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if last is not None:
                key, h = np.append(last[0], key), np.append(last[1], h)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            key, h = key[new], h[new]
            same = key[1:] == key[:-1]
            out = np.append(same, False)
            out[1:] |= same
            if last is not None and given:
                out[0] = False
            given = bool(out[-1]) or (given and len(key) == 1)
            last = (int(key[-1]), int(h[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(h[out])], ["key", "h"])

    rows = lines.select(F.explode("keys").alias("key"), F.col("h1").alias("h"))
    return rows.repartition("key").sortWithinPartitions("key", "h").mapInArrow(keep, "key bigint, h bigint")


def _texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(``h``, ``text`` as UTF-32) of the lines in ``wanted`` (and of a few more that the filter lets pass)."""
    some = docs.sparkSession.sparkContext.broadcast(linking.membership_filter(wanted, "h"))  # 8 MB

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                x = _Lines(s, least)
                one = x.own()
                one = one[some.value.has(x.h1[one])]
                text = [x.cp[a:b].tobytes() for a, b in zip(x.start[one], x.end[one], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x.h1[one]), pa.array(text, pa.binary())], ["h", "text"])

    return docs.mapInArrow(emit, "h bigint, text binary").groupBy("h").agg(F.first("text").alias("text"))


def within(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """Which pairs of strings (arrays of code points) are at most ``edits`` apart: banded bit-parallel
    distance, a column at a time for all pairs. Bit ``k`` of a word is the row ``edits - k`` above the column."""
    m = np.array([len(x) for x in a])
    n = np.array([len(x) for x in b])
    out = np.zeros(len(a), bool)
    todo = np.flatnonzero(np.abs(m - n) <= edits)
    todo = todo[np.argsort(np.maximum(m, n)[todo], kind="stable")]
    lo = 0
    while lo < len(todo):  # similar lengths together, a bounded number of code points at a time
        top = np.maximum(m, n)[todo[lo:]]
        hi = lo + max(1, int(np.searchsorted(top * np.arange(1, len(top) + 1), 2_000_000, "right")))
        part = todo[lo:hi]
        out[part] = _banded([a[i] if m[i] >= n[i] else b[i] for i in part], [b[i] if m[i] >= n[i] else a[i] for i in part], edits)
        lo = hi
    return out


def _banded(long: list[np.ndarray], short: list[np.ndarray], edits: int) -> np.ndarray:
    m, n = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    width = 2 * edits + 1
    rows = np.full((int(m.max(initial=0)) + 2 * width, len(long)), 0xFFFFFFFF, np.uint32)
    cols = np.full((int(n.max(initial=0)) + 1, len(long)), 0xFFFFFFFE, np.uint32)
    for p, (x, y) in enumerate(zip(long, short, strict=True)):
        rows[edits : edits + len(x), p] = x
        cols[: len(y), p] = y
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    live = np.arange(len(long))
    distance = np.full(len(long), edits, np.int64)
    plus = np.full(len(long), ((1 << width) - 1) & ~((1 << edits) - 1), np.uint64)
    minus = np.zeros(len(long), np.uint64)
    lost = np.zeros(len(long), bool)
    for j in range(int(n.max(initial=0))):
        if j % 32 == 0 and j:  # pairs that are done or out of reach leave
            lost[live] |= distance[live] > 2 * edits + m[live] - n[live]
            live = live[(n[live] > j) & ~lost[live]]
        if not len(live):
            break
        x = np.zeros(len(live), np.uint64)
        c = cols[j, live]
        for k in range(width):
            x |= (rows[j + k, live] == c).astype(np.uint64) << np.uint64(k)
        vp, vn = plus[live], minus[live]
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        down = j < m[live] - edits  # the lowest cell of the band goes down its diagonal, then along the last row
        bit = np.clip(m[live] - 1 - j + edits, 0, width - 1).astype(np.uint64)
        along = ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64)
        diagonal = 1 - ((d0 >> np.uint64(width - 1)) & one).astype(np.int64)
        distance[live] += np.where(n[live] > j, np.where(down, diagonal, along), 0)
        shifted = d0 >> one
        plus[live] = (hn | ~(shifted | hp)) & full
        minus[live] = shifted & hp
    return ~lost & (distance <= edits)


def _close(edits: int, similarity: float) -> linking.Linked:
    def linked(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        text = table["text"].combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0)
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1] // 4
        cp = np.frombuffer(data, np.uint32, count=int(at[-1]))
        size = np.diff(at)
        may = allowed(np.maximum(size[a], size[b]), edits, similarity)
        out = np.zeros(len(a), bool)
        for e in range(1, edits + 1):
            own = np.flatnonzero(may == e)
            out[own] = within([cp[at[i] : at[i + 1]] for i in a[own]], [cp[at[i] : at[i + 1]] for i in b[own]], e)
        return out

    return linked


def classes(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line with ink of ``docs`` (its first column names the row, its second is the text): ``row``, ``line``,
    ``class_id`` (a hash of the text of one of its lines), ``n_links`` (other lines that are equal or close) and
    ``kept`` (first of its class by row, line and hashes)."""
    lines = stage(_occurrences(docs, edits, similarity), "lines")
    place = F.struct("row", "line", "h1", "h2", "occ")
    exact = stage(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "exact-lines")
    near = stage(_shared_keys(lines), "shared-segments")
    least = min((lo - e for e, lo, _ in schemes(edits, similarity)), default=0)
    texts = stage(_texts(docs, near, least), "line-texts")
    dealt = linking.blocks(near.join(texts, "h"), "key", "h", BLOCK)
    close = _close(edits, similarity)
    roots = linking.components(linking.edges_within(dealt, "h", close), "near-lines")
    copies = exact.groupBy(F.col("h1").alias("h")).agg(F.sum("copies").alias("copies"))
    members = roots.withColumnRenamed("id", "h").join(texts, "h").join(copies, "h")
    found = linking.links_within(linking.blocks(members, "root", "h", BLOCK), "h", close, "copies")
    linked = found.groupBy(F.col("id").alias("h1")).agg(F.sum("n").alias("_near"))
    known = stage(
        exact.join(roots.select(F.col("id").alias("h1"), "root"), "h1", "left").join(linked, "h1", "left"), "line-classes"
    )
    first = known.filter("root is not null").groupBy("root").agg(F.min("first").alias("_first"))
    line = known.join(first, "root", "left").select(
        "h1", "h2", F.coalesce("root", "h1").alias("class_id"), F.coalesce("_first", "first").alias("_first"),
        (F.coalesce(F.col("_near"), F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return lines.join(line, ["h1", "h2"]).select("row", "line", "class_id", "n_links", (F.col("_first.occ") == F.col("occ")).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per line with ink of every document: its class, its links, and whether it stays."""
    return classes(docs.select("doc_id", "text")).withColumnRenamed("row", "doc_id")


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one line of each class left in place (the first by ``doc_id``, where there is one, and text). Texts that
    lose every line with ink go with their row; a column ``n_chars`` is counted anew."""
    rows = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "documents-rows")
    order = [*(["doc_id"] if "doc_id" in docs.columns else []), F.xxhash64("text").alias("_text_hash"), "_row"]
    found = classes(rows.select(F.struct(*order).alias("_name"), "text"), edits, similarity)
    gone = found.filter("not kept").groupBy(F.col("row._row").alias("_row")).agg(F.collect_set("line").alias("_gone"))  # lines of one text
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    new = rows.join(gone, "_row", "left").withColumn(
        "text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    )
    new = new.filter(F.col("_gone").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
