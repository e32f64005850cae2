"""Best-fit packing (9): a configuration program over the length histogram.

Documents become token ids (vocabulary file of a public tokenizer plus an end id); only documents
longer than a sequence are cut. The histogram of piece lengths, at most ``capacity`` rows whatever
the corpus, goes to the driver. There multiplicative weights solve the covering program over
sequence configurations, each priced by a knapsack dynamic program; whole copies of its
configurations are taken, and the remaining pieces fill the gaps best-fit, longest first. If plain
best-fit on the histogram needs fewer sequences, that plan is taken. Pieces find their place by
their rank among the pieces of their length: a number within the task that made them plus an
offset per (task, length), so no length is ever sorted or gathered in one task.

Defined cases: a null or empty text is the end id alone; repeated documents are packed as often as
they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railflow.llm import textscan as ts
from railflow.staging import stage

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 800_000  # distinct words a worker keeps; beyond it those that came only once go
GRID = 512  # least steps of the knapsack program
LENGTHS = 64  # different lengths per token of a step: few lengths are kept apart
STEP = 0.1
SMALL = 1 / 16
FULL = (0, 0.99, 0.998, 1)
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _rank bigint"

_SPACE = ~ts.INK_BYTES
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_CUT = np.zeros(256, bool)  # ASCII marks between which and a letter or digit the tokenizer always splits
_CUT[33:127] = ~_ALNUM[33:127]
_CUT[39] = False  # an apostrophe begins contractions


class WordIds:
    """Token ids of words, kept by the words' bytes."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(tokenizer_json)
        self.index: dict[bytes, int] = {}
        self.count = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)  # looked up again since it came, or since the last ``_trim``
        self.end = np.zeros(1, np.int32)  # in bytes
        self.ids = np.zeros(0, np.uint32)

    def _trim(self) -> None:
        """Keep the latest words that were looked up again, half as many as fit at most."""
        kept = np.flatnonzero(self.again)[-(CACHE_WORDS // 2) :]
        place = np.full(len(self.count), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.ids = self.spell(kept).copy()
        self.count = self.count[kept]
        self.end = np.concatenate([np.zeros(1, np.int32), 4 * np.cumsum(self.count, dtype=np.int32)])
        self.again = np.zeros(len(kept), bool)
        self.index = {w: at for w, i in self.index.items() if (at := int(place[i])) >= 0}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has; words hold no white space."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 20_000):
            part = [w.decode() for w in words[lo : lo + 20_000]]
            starts = np.cumsum([0, *(len(x) + 1 for x in part)])
            got = self.encoder.encode(" ".join(part), add_special_tokens=False)
            at = np.fromiter((x[0] for x in got.offsets), np.int64, len(got.offsets))
            ids.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Table index of each word."""
        if len(self.index) > CACHE_WORDS:
            self._trim()
        known = self.index.get
        found = np.array([known(w, -1) for w in words], np.int64)
        self.again[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            spelt = [words[i] for i in new.tolist()]
            ids, counts = self.encode(spelt)
            found[new] = len(self.count) + np.arange(len(new))
            self.index.update(zip(spelt, found[new].tolist(), strict=True))
            self.end = np.concatenate([self.end, self.end[-1] + 4 * np.cumsum(counts).astype(np.int32)])
            self.count = np.concatenate([self.count, counts.astype(np.int32)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def spell(self, index: np.ndarray) -> np.ndarray:
        """Ids of the words of these table indices, end to end."""
        table = pa.Array.from_buffers(pa.binary(), len(self.count), [None, pa.py_buffer(self.end), pa.py_buffer(self.ids)])
        got = table.cast(pa.large_binary()).take(pa.array(index))
        data = got.buffers()[2]
        return np.frombuffer(data, np.uint32)[: int(self.count[index].sum())] if data is not None else np.zeros(0, np.uint32)


_encoders: dict[str, WordIds] = {}


def _words(s: ts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Spans whose ids, end to end, are the ids of the text: white-space words, and ASCII ones also cut at marks."""
    starts, ends = s.runs(~_SPACE[s.buf])
    high = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(s.buf >= 128, out=high[1:])
    ascii_word = high[ends] == high[starts]
    inner = np.flatnonzero((_CUT[s.buf[1:]] & _ALNUM[s.buf[:-1]]) | (_CUT[s.buf[:-1]] & _ALNUM[s.buf[1:]])) + 1
    own = np.searchsorted(starts, inner, "right") - 1
    ok = (own >= 0) & (inner < ends[own]) & (inner > starts[own]) & ascii_word[own]
    inner = inner[ok]
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


def token_ids(s: ts.Slice, table: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a slice end to end, without end ids, and each text's number of ids."""
    starts, ends = _words(s)
    high = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(s.buf >= 128, out=high[1:])
    low = ts.LOWER[s.buf]  # the tokenizer lower-cases; in a word of ASCII alone that can be done bytewise
    other = np.flatnonzero(high[ends] != high[starts])
    size = ends[other] - starts[other]
    keep = np.repeat(starts[other] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    low[keep] = s.buf[keep]
    words, back = ts.distinct(low, starts, ends)
    index = table.lookup(words.to_numpy(zero_copy_only=False).tolist())[back]
    counts = table.count[index].astype(np.int64)
    return table.spell(index), ts.sums(counts, s.per_text(starts))


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and its rank among the
    pieces of its length in its task."""
    from pyspark.sql.types import StructType

    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file of a few MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = str(zlib.crc32(shared.value.encode()))
        table = _encoders.get(key) or _encoders.setdefault(key, WordIds(shared.value))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                ids, counts = token_ids(s, table)
                begin = np.cumsum(counts) - counts
                special = {}  # texts that may spell a special token are encoded whole
                if (mark := np.flatnonzero((s.buf[:-1] == 60) & (s.buf[1:] == 124))).size:
                    for t in np.unique(np.searchsorted(s.at, mark, "right") - 1).tolist():
                        text = s.buf[s.at[t] : s.at[t + 1]].tobytes().decode()
                        special[t] = np.array(table.encoder.encode(text, add_special_tokens=False).ids, np.uint32)
                row, piece, start, length, crc = [], [], [], [], []
                end = np.array([end_id], np.uint32)
                for t in range(s.n):
                    own = np.concatenate([special[t] if t in special else ids[begin[t] : begin[t] + counts[t]], end])
                    for p, at in enumerate(range(0, len(own), capacity)):
                        x = own[at : at + capacity]
                        row.append(t)
                        piece.append(p)
                        start.append(at)
                        length.append(len(x))
                        crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                within = np.arange(len(size)) - np.searchsorted(ranked, ranked)
                rank = np.empty(len(size), np.int64)
                rank[order] = within + seen[ranked]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.n).take(pa.array(row, pa.int32())),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()),
                        pa.array(np.full(len(size), part, np.int32)), pa.array(rank),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"],
                )

    own = docs.select("doc_id", "text")
    return own.mapInArrow(cut, StructType([own.schema["doc_id"], *StructType.fromDDL(PIECE).fields]))


Pattern = tuple[tuple[int, int], ...]  # (length, how many) pairs of a sequence


def best_fit(counts: dict[int, int], capacity: int, open_: list[tuple[Pattern, int]] = ()) -> list[tuple[Pattern, int]]:
    """Best-fit, longest first, on counts: equal sequences are one (pattern, copies) entry, so the work
    depends on the distinct lengths and not on the pieces. ``open_``: sequences with gaps to fill first."""
    room: list[list[tuple[Pattern, int]]] = [[] for _ in range(capacity + 1)]
    there = np.zeros(capacity + 1, bool)

    def put(pattern: Pattern, copies: int, rest: int) -> None:
        if copies:
            room[rest].append((pattern, copies))
            there[rest] = True

    for pattern, copies in open_:
        put(pattern, copies, capacity - sum(length * k for length, k in pattern))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            rest = length + int(np.argmax(there[length:]))
            if not there[rest]:
                each = capacity // length
                put(((length, each),), n // each, capacity - each * length)
                if n % each:
                    put(((length, n % each),), 1, capacity - n % each * length)
                break
            pattern, copies = room[rest].pop()
            there[rest] = bool(room[rest])
            each = rest // length
            full = min(copies, n // each)
            put((*pattern, (length, each)), full, rest - each * length)
            n -= full * each
            copies -= full
            if copies and n:  # fewer than fill one more sequence
                put((*pattern, (length, n)), 1, rest - n * length)
                n, copies = 0, copies - 1
            put(pattern, copies, rest)
    return [x for held in room for x in held]


def _knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> dict[int, int]:
    """Indices and numbers of the most worthy items of total size ``room`` at most (unbounded). ``sizes`` ascend; as many
    cells as the smallest of them do not depend on each other and are filled at once."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    least = int(sizes[0])
    for lo in range(max(least, 1), room + 1, max(least, 1)):
        cell = np.arange(lo, min(lo + least, room + 1))
        left = cell[:, None] - sizes
        got = np.where(left >= 0, best[np.maximum(left, 0)] + worth, -1.0)
        i = np.argmax(got, axis=1)
        value = got[np.arange(len(cell)), i]
        top = np.maximum.accumulate(np.append(best[lo - 1], value))
        best[cell] = top[1:]
        pick[cell] = np.where(value > top[:-1], i, -1)
    out: dict[int, int] = {}
    c = room
    while c > 0:
        if pick[c] < 0 or best[c] == best[c - 1]:
            c -= 1
        else:
            out[int(pick[c])] = out.get(int(pick[c]), 0) + 1
            c -= int(sizes[pick[c]])
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, room: int, step: float = STEP) -> list[tuple[dict[int, int], float]]:
    """Multiplicative weights for the covering program: fewest (fractional) sequences that hold ``need``.

    A size's weight per token falls exponentially with the share of its need that is covered. Each round
    the knapsack program prices the configuration of most weight, which is taken for ``step`` of what its
    scarcest size needs, and never beyond a need. Each round thus covers ``step`` of one size's need, or one
    sequence, or the rest of a size: there are at most ``len(sizes) * (1 / step + 1)``, however many pieces. Ends when all is covered."""
    left = need.copy()
    taken: dict[tuple[tuple[int, int], ...], float] = {}
    while len(open_ := np.flatnonzero(left > 1e-6 * need)):
        weight = sizes[open_] * np.exp(left[open_] / need[open_])
        config = _knapsack(sizes[open_], weight, room)
        scarce = min(left[open_[i]] / k for i, k in config.items())
        amount = max(step * min(need[open_[i]] / k for i, k in config.items()), 1.0)
        amount = min(amount, scarce)
        key = tuple(sorted((int(open_[i]), k) for i, k in config.items()))
        taken[key] = taken.get(key, 0) + amount
        for i, k in key:
            left[i] -= k * amount
    return [(dict(k), x) for k, x in taken.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: float = SMALL) -> list[tuple[Pattern, int]]:
    """(pattern, copies) of sequences that hold all pieces; ``counts`` maps a length to its pieces.

    The program covers lengths above ``small`` of the capacity, rounded up to a step that grows with the number of different
    lengths (to ``capacity / GRID``); the shorter
    ones fill the gaps. Rounding keeps whole copies of configurations that are full enough (the best of the levels
    ``FULL``) and packs the rest best-fit into their gaps and new sequences; best-fit alone is compared as well and
    taken if it needs fewer sequences."""
    left = {length: n for length, n in counts.items() if n}
    counts = dict(left)
    if not left:
        return []
    large = sorted((x for x in left if x > small * capacity), reverse=True)
    grain = min(-(-capacity // GRID), -(-len(large) // LENGTHS)) or 1
    room = capacity // grain
    of: dict[int, list[int]] = {}
    for length in large:
        of.setdefault(min(room, -(-length // grain)), []).append(length)
    sizes = np.array(sorted(of))
    need = np.array([sum(left[x] for x in of[s]) for s in sizes], float)
    made: list[tuple[Pattern, int]] = []
    for config, amount in sorted(configurations(sizes, need, room), key=lambda x: -x[1]):
        copies = min(int(amount + 1e-6), *(sum(left[x] for x in of[sizes[i]]) // k for i, k in config.items()))
        while copies > 0:  # runs of sequences with the same lengths
            chosen: dict[int, int] = {}
            for i, k in config.items():
                for _ in range(k):
                    length = next(x for x in of[sizes[i]] if left[x] > chosen.get(x, 0))
                    chosen[length] = chosen.get(length, 0) + 1
            if sum(x * k for x, k in chosen.items()) > capacity:
                break
            run = min(copies, *(left[x] // k for x, k in chosen.items()))
            made.append((tuple(sorted(chosen.items(), reverse=True)), run))
            for x, k in chosen.items():
                left[x] -= run * k
            copies -= run
    rounded = []
    for level in FULL:
        kept = [(p, n) for p, n in made if sum(x * k for x, k in p) >= level * capacity]
        rest = dict(counts)
        for pattern, n in kept:
            for x, k in pattern:
                rest[x] -= k * n
        rounded.append(best_fit({x: n for x, n in rest.items() if n}, capacity, kept))
    rounded.append(best_fit(counts, capacity))
    return min(rounded, key=lambda p: sum(n for _, n in p))


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` in it."""
    made = stage(pieces(docs, tokenizer_json, capacity, end_id), "pieces")
    per_task = made.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    key, first, base, each, offset = [], [], [], [], []
    used: dict[int, int] = {}
    sequences = 0
    for pattern, copies in plan(counts, capacity):
        merged: dict[int, int] = {}
        for length, k in pattern:
            merged[length] = merged.get(length, 0) + k
        at = 0
        for length, k in merged.items():
            start = used.get(length, 0)
            for column, x in ((key, (length << 44) + start), (first, start), (base, sequences), (each, k), (offset, at)):
                column.append(x)
            used[length] = start + k * copies
            at += length * k
        sequences += copies
    order = np.argsort(np.array(key, np.int64))
    places = docs.sparkSession.sparkContext.broadcast(  # a few entries per distinct length and configuration
        tuple(np.array(x, np.int64)[order] for x in (key, first, base, each, offset))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, base, each, offset = places.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth = rank - first[i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(base[i] + nth // each[i]), pa.array(offset[i] + nth % each[i] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = made.join(shifts, ["length", "_part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_shift")).alias("_rank")
    )
    from pyspark.sql.types import StructType

    schema = StructType([ranked.schema["doc_id"], *StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").fields])
    return ranked.mapInArrow(place, schema)
