"""Phrase collocation mining (12): weighted acyclic automata count the phrases of each language.

A task cuts its texts into shards of several slices and counts the n-grams of a shard. The sorted n-grams, each behind its language,
become count transducers, one per prefix range: acyclic automata over words whose last arcs weigh the count, minimised
layer by layer from the right, so that equal continuations are kept once. A range holds the n-grams whose language and first
two words hash into it; so no sample is needed to cut even ranges, and a hot first word is spread by its second.
Spark brings the transducers of a range together; their union sums the weights, a bounded number of paths at a time.

Orders are counted one after another. A phrase of ``k`` words can only be frequent if both its parts of ``k - 1`` words are, so a
scan keeps the ``k``-grams that pass a filter of fixed size (which never loses a frequent one) and ships little else.

Each frequent phrase is cut in every place. The parts are looked up by composition: the parts of a prefix range are one set of
paths, walked side by side through the automaton of that range's counts; ranges with very many look-ups are dealt out in
blocks. The lowest-scoring cut counts; a phrase that mostly occurs inside a longer one is dropped.

Defined cases: a null or empty text has no words, a null language is ``und``; repeated documents count as often as they come; equal scores
go by count, then by phrase in byte order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railflow.llm import linking
from railflow.llm import textscan as ts
from railflow.staging import stage

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
INSIDE = 80  # percent of a phrase's occurrences
SHARD_BYTES = 8 << 20
FOLD = 300_000  # paths that wait for the union
BLOCK = 100_000  # look-ups of a range that one group takes
COUNTED = "lang string, phrase string, f bigint, h bigint"

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


def group_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of equal rows, in the order of the rows' values, and one row of each group; exact."""
    columns = [c.astype(np.int64) for c in columns]
    _, one, number = np.unique(columns[0], return_index=True, return_inverse=True)
    for column in columns[1:]:
        many = int(column.max(initial=0)) + 1
        _, one, number = np.unique(number.astype(np.int64) * many + column, return_index=True, return_inverse=True)
    return number, one


class Automaton:
    """A weighted acyclic automaton of paths of one length. Layer ``d``: offsets of its states' arcs, the arcs'
    labels and their target states in the next layer; the last arcs lead to the final state and carry ``weight``."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weight: np.ndarray):
        self.layers, self.weight = layers, weight

    @staticmethod
    def of_sorted(labels: list[np.ndarray], weight: np.ndarray) -> Automaton:
        """From different label sequences (one array per place) in ascending order."""
        depth = len(labels)
        new = np.zeros(len(weight), bool)
        new[:1] = True
        starts = []
        for column in labels:  # where a prefix of d + 1 labels begins
            new = new.copy()
            new[1:] |= column[1:] != column[:-1]
            starts.append(np.flatnonzero(new))
        layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state = np.zeros(len(weight), np.int64)  # of each arc's target
        kept = weight
        for d in range(depth - 1, -1, -1):
            first = starts[d]
            label = labels[d][first]
            own = starts[d - 1] if d else np.zeros(min(1, len(weight)), np.int64)  # the states' prefixes
            off = np.append(np.searchsorted(first, own), len(first))
            same = _equal_states(off, label, state, kept if d == depth - 1 else None)
            some = np.unique(same)  # a state that stands for itself and others
            size = np.diff(off)[some]
            at = np.repeat(off[some] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            layers.append((np.append(0, np.cumsum(size)), label[at], state[at]))
            if d == depth - 1:
                kept = weight[at]
            state = np.searchsorted(some, same)
        return Automaton(layers[::-1], kept)

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All label sequences, one array per place, and their weights."""
        out: list[np.ndarray] = []
        at = np.zeros(1, np.int64)
        arc = at
        for off, label, target in self.layers:
            size = off[at + 1] - off[at]
            arc = np.repeat(off[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out = [np.repeat(x, size) for x in out] + [label[arc]]
            at = target[arc]
        return out, self.weight[arc]

    def compose(self, labels: list[np.ndarray]) -> np.ndarray:
        """Weight of each of the given label sequences, 0 where there is no such path; they are walked side by side."""
        at = np.zeros(len(labels[0]), np.int64)
        arc = at
        alive = np.ones(len(at), bool)
        for (off, label, target), asked in zip(self.layers, labels, strict=True):
            many = int(label.max(initial=0)) + 1
            key = np.repeat(np.arange(len(off) - 1), np.diff(off)) * many + label  # ascending
            want = at * many + asked
            arc = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            alive &= (asked >= 0) & (asked < many) & ((key[arc] == want) if len(key) else False)
            arc = np.where(alive, arc, 0)
            at = np.where(alive, target[arc] if len(key) else 0, 0)
        return np.where(alive, self.weight[arc], 0) if len(self.weight) else np.zeros(len(at), np.int64)

    def dump(self) -> bytes:
        body = [_packed(np.array([len(self.layers)]))]
        for d, (off, label, target) in enumerate(self.layers):
            body += [_packed(np.diff(off)), _packed(label)]
            if d < len(self.layers) - 1:  # the last arcs lead to the one final state
                body.append(_packed(target))
        return b"".join([*body, _packed(self.weight)])

    @staticmethod
    def load(data: bytes) -> Automaton:
        depth, at = _unpacked(data, 0)
        layers = []
        for d in range(int(depth[0])):
            size, at = _unpacked(data, at)
            label, at = _unpacked(data, at)
            target, at = _unpacked(data, at) if d < depth[0] - 1 else (np.zeros(len(label), np.int64), at)
            layers.append((np.append(0, np.cumsum(size)), label, target))
        return Automaton(layers, _unpacked(data, at)[0])


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest of four widths, behind width and length."""
    width = sum(int(x.max(initial=0)) > np.iinfo(t).max for t in _WIDTHS[:3])
    return np.array([width, len(x)], np.int32).tobytes() + x.astype(_WIDTHS[width]).tobytes()


def _unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers packed at a place, and the place behind them."""
    width, n = np.frombuffer(data, np.int32, 2, at).tolist()
    kind = np.dtype(_WIDTHS[width])
    return np.frombuffer(data, kind, n, at + 8).astype(np.int64), at + 8 + n * kind.itemsize


def _equal_states(off: np.ndarray, label: np.ndarray, target: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """For each state the first one with the same arcs: found by a hash of the arcs, then compared arc by arc."""
    n = len(off) - 1
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(off)
    place = np.arange(len(label)) - np.repeat(off[:-1], size)
    arcs = [label, target] if weight is None else [label, target, weight]
    h = np.zeros(len(label), ts.U)
    for x in arcs:
        h = ts.mix(h + x.astype(ts.U))
    h *= ts.keys(int(size.max(initial=1)))[place]
    _, one, back = np.unique(np.add.reduceat(h, off[:-1]) + size.astype(ts.U), return_index=True, return_inverse=True)
    like = one[back]
    like[size[like] != size] = -1
    own = np.flatnonzero(like >= 0)
    there = np.repeat(off[like[own]], size[own])
    here = np.repeat(off[own], size[own])
    step = np.arange(len(here)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
    differs = np.zeros(len(here), bool)
    for x in arcs:
        differs |= x[here + step] != x[there + step]
    wrong = np.repeat(own, size[own])[differs]
    like[wrong] = wrong
    lost = np.flatnonzero(like < 0)
    like[lost] = lost
    return like


def word_hashes(words: pa.Array) -> np.ndarray:
    return ts.span_hash(*ts.spans_of(words))


def phrase_hashes(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their language and words."""
    keys = ts.keys(len(words) + 1, 1)
    h = lang * keys[0]
    for x, key in zip(words, keys[1:], strict=False):
        h = h + x * key
    return ts.mix(h)


class _Shard:
    """Words of some slices: ``word`` numbers in ``words``, ``lang`` numbers in ``langs``, ``left`` words up to the end of the piece
    (``LONGEST`` stands for more)."""

    def __init__(self) -> None:
        self.size = 0
        self.number: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _numbers(self, which: int, names: pa.Array) -> np.ndarray:
        known = self.number[which]
        return np.array([known.setdefault(x, len(known)) for x in names.to_numpy(zero_copy_only=False).tolist()], np.int32)

    def add(self, s: ts.Slice, lang: pa.Array, longest: int) -> None:
        self.size += len(s.buf)
        starts, ends = s.runs(_WORD[s.buf])
        if not len(starts):
            return
        words, word = ts.distinct(ts.LOWER[s.buf], starts, ends)
        text = ts.owner(s.per_text(starts))
        coded = lang.cast(pa.large_binary()).dictionary_encode()
        breaks = np.zeros(len(s.buf) + 1, np.int32)
        np.cumsum(_BREAK[s.buf], out=breaks[1:])
        cut = np.ones(len(starts) + 1, bool)
        cut[1:-1] = (text[1:] != text[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
        at = np.flatnonzero(cut)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(starts))
        langs = self._numbers(1, coded.dictionary)[np.asarray(coded.indices)]
        self.parts.append((self._numbers(0, words)[word], langs[text], np.minimum(left, longest).astype(np.int8)))

    def close(self) -> None:
        empty = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8))]
        self.word, self.lang, self.left = (np.concatenate(x) for x in zip(*(self.parts or empty), strict=True))
        self.parts = []
        self.words, self.langs = (pa.array(list(x), pa.large_binary()) for x in self.number)
        self.word_hash, self.lang_hash = word_hashes(self.words), word_hashes(self.langs)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return phrase_hashes(self.lang_hash[self.lang[at]], [self.word_hash[self.word[at + j]] for j in range(k)])

    def places(self, k: int, frequent: linking.Filter | None) -> np.ndarray:
        """Where a ``k``-gram begins whose parts of ``k - 1`` words pass the filter."""
        at = np.flatnonzero(self.left >= k)
        if frequent is None or k == 1:
            return at
        part = np.flatnonzero(self.left >= k - 1)
        good = np.zeros(len(self.left) + 1, bool)
        good[part] = frequent.has(self.hashes(part, k - 1).view(np.int64))
        return at[good[at] & good[at + 1]]


def _shards(docs: DataFrame, k: int, longest: int, frequent: linking.Filter | None, ranges: int) -> DataFrame:
    """(``range``, ``words``, ``sizes``, ``automaton``): the count transducers of the ``k``-grams of each shard."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # 8 MB

    def transducers(x: _Shard) -> Iterator[pa.RecordBatch]:
        x.close()
        at = x.places(k, shared.value)
        if not len(at):
            return
        columns = [x.lang[at], *(x.word[at + j] for j in range(k))]
        number, one = group_rows(columns)
        count = np.bincount(number)
        columns = [c[one] for c in columns]
        prefix = phrase_hashes(x.lang_hash[columns[0]], [x.word_hash[c] for c in columns[1:3]])
        own = ((prefix >> ts.U(32)) * ts.U(ranges) >> ts.U(32)).astype(np.int64)
        order = np.argsort(own, kind="stable")  # within a range the rows stay in ascending order
        edges = np.flatnonzero(np.diff(own[order])) + 1
        rows = [_row(int(own[part[0]]), x, [c[part] for c in columns], count[part]) for part in np.split(order, edges)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
            ["range", "words", "sizes", "automaton"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                shard.add(s, batch.column(0).slice(s.first, s.n), longest)
                if shard.size >= SHARD_BYTES:
                    yield from transducers(shard)
                    shard = _Shard()
        yield from transducers(shard)

    return docs.mapInArrow(scan, "range int, words binary, sizes binary, automaton binary")


def _row(number: int, x: _Shard, columns: list[np.ndarray], count: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """A range's transducer over labels of its own: the languages and words that it uses, in the shard's order."""
    langs, words = np.unique(columns[0]), np.unique(np.concatenate(columns[1:]))
    labels = [np.searchsorted(langs, columns[0]), *(len(langs) + np.searchsorted(words, c) for c in columns[1:])]
    names = pa.concat_arrays([x.langs.take(pa.array(langs)), x.words.take(pa.array(words))])
    buf, starts, ends = ts.spans_of(names)
    return number, buf[: int(ends[-1])].tobytes(), _packed(ends - starts), Automaton.of_sorted(labels, count).dump()


class _Union:
    """Union of the transducers of a range with summed weights."""

    def __init__(self) -> None:
        self.names: list[pa.Array] = []
        self.rows: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.waiting = 0

    def add(self, words: bytes, sizes: bytes, automaton: bytes) -> None:
        at = np.append(0, np.cumsum(_unpacked(sizes, 0)[0]))
        self.names.append(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(words)]))
        self.rows.append(Automaton.load(automaton).paths())
        self.waiting += len(self.rows[-1][1])
        if self.waiting > FOLD:
            self.fold()
            self.waiting = 0

    def fold(self) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """Names of the labels, the paths in labels, their summed weights."""
        coded = pa.concat_arrays(self.names).dictionary_encode()
        number = np.asarray(coded.indices).astype(np.int64)
        base = np.cumsum([0, *(len(x) for x in self.names)])
        depth = len(self.rows[0][0])
        columns = [np.concatenate([number[base[i] + c[d]] for i, (c, _) in enumerate(self.rows)]) for d in range(depth)]
        weight = np.concatenate([w for _, w in self.rows])
        group, one = group_rows(columns)
        total = np.zeros(len(one), np.int64)
        np.add.at(total, group, weight)
        columns = [c[one] for c in columns]
        self.names, self.rows = [coded.dictionary], [(columns, total)]
        return coded.dictionary, columns, total


def _counted(shards: DataFrame, min_count: int, totals: bool) -> DataFrame:
    """The phrases of at least ``min_count`` occurrences with their hashes; with ``totals``, rows without a phrase that add
    up to all occurrences of a language."""

    def emit(union: _Union) -> pa.RecordBatch:
        names, columns, total = union.fold()
        own = np.flatnonzero(total >= min_count)
        h = word_hashes(names)
        text = names.cast(pa.large_string())
        lang = text.take(pa.array(columns[0][own]))
        phrase = text.take(pa.array(columns[1][own]))
        if len(columns) > 2:
            phrase = pc.binary_join_element_wise(phrase, *(text.take(pa.array(c[own])) for c in columns[2:]), pa.scalar(" ", pa.large_string()))
        f, hashes = total[own], phrase_hashes(h[columns[0][own]], [h[c[own]] for c in columns[1:]]).view(np.int64)
        if totals:
            langs, group = np.unique(columns[0], return_inverse=True)
            lang = pa.concat_arrays([lang, text.take(pa.array(langs))])
            phrase = pa.concat_arrays([phrase, pa.nulls(len(langs), pa.large_string())])
            summed = np.zeros(len(langs), np.int64)
            np.add.at(summed, group, total)
            f, hashes = np.append(f, summed), np.append(hashes, np.zeros(len(langs), np.int64))
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(f), pa.array(hashes)], ["lang", "phrase", "f", "h"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union = None, _Union()
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                if now is not None and number != now:
                    yield emit(union)
                    union = _Union()
                now = number
                union.add(*(batch.column(c)[i].as_py() for c in (1, 2, 3)))
        if now is not None:
            yield emit(union)

    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(merge, COUNTED)


def count_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``longest`` words (``lang``, ``phrase``, ``f``, ``h``), and ``n`` per ``lang``: all word occurrences.

    ``docs``: its first column is the language, its second the text."""
    lang, text = (F.col(f"`{c}`") for c in docs.columns[:2])
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text"))
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []
    totals = None
    for k in range(1, longest + 1):
        frequent = linking.membership_filter(found[-1], "h") if found else None
        shards = _shards(docs, k, longest, frequent, ranges)
        counted = stage(_counted(shards, min_count, k == 1), f"phrases-{k}")
        if totals is None:
            totals = counted.filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
        found.append(counted.filter("phrase is not null"))
    return found, totals


def _prefix(lang: str, phrase: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col(lang), F.substring_index(phrase, " ", 2)), F.lit(groups)).cast("int")


def part_counts(counts: DataFrame, lookups: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lookups`` with ``f``: the count of its ``lang`` and ``part`` in ``counts`` (``lang``, ``phrase``, ``f``), 0 if it has none."""
    groups = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = lookups.withColumn("_r", _prefix("lang", "part", groups))
    sizes = asked.groupBy("_r").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    sizes = F.broadcast(stage(sizes, "look-ups"))  # one row per range
    others = [c for c in lookups.columns if c not in ("lang", "part")]
    payload = F.struct(*others)
    left = asked.join(sizes, "_r").select(
        F.xxhash64("_r", F.pmod(F.xxhash64("part", *others), F.col("_blocks"))).alias("_g"), F.lit(True).alias("_asked"),
        "lang", F.col("part").alias("phrase"), F.lit(0).cast("bigint").alias("f"), payload.alias("_more"),
    )
    right = counts.withColumn("_r", _prefix("lang", "phrase", groups)).join(sizes, "_r").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks").cast("bigint") - 1)).alias("_b"), "_r", "lang", "phrase", "f"
    ).select(F.xxhash64("_r", "_b").alias("_g"), F.lit(False).alias("_asked"), "lang", "phrase", "f", F.lit(None).cast(left.schema["_more"].dataType).alias("_more"))
    rows = left.union(right).repartition("_g").sortWithinPartitions("_g", "_asked")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # counts of the group at hand
        now, walk = None, None
        for batch in batches:
            g, is_asked = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edge = np.flatnonzero((g[1:] != g[:-1]) | (is_asked[1:] != is_asked[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(g)], strict=True):
                if a == b:
                    continue
                if g[a] != now:
                    now, held, walk = g[a], [], None
                part = batch.slice(a, b - a)
                if not is_asked[a]:
                    held.append(part)
                    continue
                walk = walk or _Walk(held)
                f = walk.look_up(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(f), part.column(5)], ["lang", "part", "f", "_more"])

    kind = left.schema["_more"].dataType.simpleString()
    return rows.mapInArrow(compose, f"lang string, part string, f bigint, _more {kind}").select("lang", "part", "f", "_more.*")


class _Walk:
    """The automata of a group's counts, one per number of words."""

    def __init__(self, counts: list[pa.RecordBatch]):
        self.of: dict[int, Automaton] = {}
        self.names = pa.array([], pa.large_string())
        if not counts:
            return
        lang = pa.concat_arrays([x.column(2) for x in counts]).cast(pa.large_string())
        lists = pc.split_pattern(pa.concat_arrays([x.column(3) for x in counts]).cast(pa.large_string()), " ")
        f = np.concatenate([np.asarray(x.column(4)) for x in counts])
        coded = pa.concat_arrays([lang, lists.flatten()]).dictionary_encode()
        self.names = coded.dictionary
        number = np.asarray(coded.indices).astype(np.int64)
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        first = len(lang) + np.cumsum(size) - size
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            columns = [number[own], *(number[first[own] + j] for j in range(k))]
            order = np.lexsort(columns[::-1])
            self.of[k] = Automaton.of_sorted([c[order] for c in columns], f[own][order])

    def look_up(self, lang: pa.Array, phrase: pa.Array) -> np.ndarray:
        lists = pc.split_pattern(phrase.cast(pa.large_string()), " ")
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        every = pa.concat_arrays([lang.cast(pa.large_string()), lists.flatten()])
        number = np.asarray(pc.fill_null(pc.index_in(every, self.names), -1)).astype(np.int64)
        first = len(lang) + np.cumsum(size) - size
        out = np.zeros(len(size), np.int64)
        for k, automaton in self.of.items():
            own = np.flatnonzero(size == k)
            if len(own):
                out[own] = automaton.compose([number[own], *(number[first[own] + j] for j in range(k))])
        return out


def _joined(words: Column, at: int, n: int | Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE
) -> DataFrame:
    """Each language's best phrases: ``lang``, ``rank``, ``phrase``, ``a`` (occurrences), ``l`` and ``r`` (of the two parts of
    the cut that counts), ``n`` (words of the language) and ``score``; ``docs`` has columns ``lang`` and ``text``."""
    found, totals = count_phrases(docs.select("lang", "text"), longest, min_count)
    counts = candidates = None
    for k, x in enumerate(found, 1):
        x = x.select("lang", "phrase", "f")
        if k < longest:
            counts = x if counts is None else counts.union(x)
        if k > 1:
            x = x.withColumn("k", F.lit(k))
            candidates = x if candidates is None else candidates.union(x)
    words = F.split("phrase", " ")
    places = F.sequence(F.lit(1), F.col("k") - 1)
    cuts = F.flatten(F.transform(places, lambda c: F.array(
        F.struct(c.alias("cut"), F.lit(0).alias("side"), F.array_join(F.slice(words, F.lit(1), c), " ").alias("part")),
        F.struct(c.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice(words, c + 1, F.col("k") - c), " ").alias("part")),
    )))
    lookups = candidates.select("lang", F.col("phrase").alias("whole"), F.col("f").alias("a"), F.explode(cuts).alias("x")).select(
        "lang", "whole", "a", "x.cut", "x.side", "x.part"
    )
    looked = part_counts(counts, lookups)
    parts = looked.groupBy("lang", F.col("whole").alias("phrase")).agg(
        F.max("a").alias("a"),
        *[F.max(F.when((F.col("cut") == c) & (F.col("side") == side), F.col("f"))).alias(f"_{c}{side}") for c in range(1, longest) for side in (0, 1)],
    )

    def cut(c: int) -> Column:
        wide = [F.col(x).cast("decimal(20,0)") for x in ("a", f"_{c}0", f"_{c}1")]
        score = F.call_function("div", wide[0] * F.lit(2_000_000).cast("decimal(7,0)"), wide[1] + wide[2])
        return F.when(F.col(f"_{c}0").isNotNull(), F.struct(score.cast("bigint").alias("score"), F.lit(c).alias("c"), F.col(f"_{c}0").alias("l"), F.col(f"_{c}1").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[cut(c) for c in range(1, longest)])))
    scored = parts.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    spans = [(i, m) for m in range(2, longest) for i in range(1, longest - m + 2)]
    held = F.array_compact(F.array(*[F.when(F.col("k") >= F.lit(max(i + m - 1, m + 1)), _joined(words, i, m)) for i, m in spans])) if spans else F.array().cast("array<string>")
    longer = candidates.filter("k > 2").select("lang", F.explode(F.array_distinct(held)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (wide("_f") * 100 < wide("a") * inside))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = left.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_p", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order)))
    ranked = some.filter(F.col("_p") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return collocations(docs.select("lang", "text"))
