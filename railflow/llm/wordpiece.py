"""Token counts (6): greedy longest-match word pieces, counted by a linear automaton.

The vocabulary becomes a trie over bytes; pieces that begin a word begin with a space. Each node has a failure link to
the node of what is left after the pieces that greedy matching settles, and the precomputed number
of these pieces; so a word is read once, symbol by symbol, and its pieces are counted and never
built. The distinct words of a slice run side by side as NumPy arrays. The automaton (a vocabulary
file's size) is broadcast; one scan, no shuffle.

Words are runs of letters and non-ASCII bytes, of digits, or of other marks; A-Z are lower-cased if the vocabulary has no piece with them.

Defined cases: a null or empty text has no words and no tokens; a word that the vocabulary cannot
spell counts as one unknown token; repeated documents give equal rows; other columns are passed on.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from railflow.llm import textscan as ts

SYMBOLS = 256

CLASSES = np.full(256, 3, np.uint8)  # other marks
CLASSES[:33] = CLASSES[127] = 0
CLASSES[48:58] = 2
CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = 1


def byte_symbols() -> dict[str, int]:
    """The public byte-level alphabet: printable characters stand for themselves, the other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(tokenizer_json: str) -> list[bytes]:
    """Vocabulary entries as bytes; entries outside the byte alphabet (special tokens) are left out."""
    of = byte_symbols()
    vocabulary = json.loads(tokenizer_json)["model"]["vocab"]
    return [bytes(of[c] for c in piece) for piece in vocabulary if piece and all(c in of for c in piece)]


class Automaton:
    """Trie edges in an open-addressing table, failure links and popped-piece counts per node; node 0 is the root."""

    def __init__(self, pieces: list[bytes], mark: bytes = b" "):
        children: list[dict[int, int]] = [{}]
        token = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in children[node]:
                    children[node][symbol] = len(children)
                    children.append({})
                    token.append(False)
                node = children[node][symbol]
            token[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        rest = [0] * len(children)  # pieces of what is left at a node where the word ends, -1 if it can't be spelled
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for symbol, v in children[u].items():
                todo.append(v)
                if token[v]:
                    fail[v], pops[v], rest[v] = 0, 1, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and symbol not in children[z]:
                    n += pops[z]
                    z = fail[z]
                fail[v], pops[v] = (children[z][symbol], n) if z >= 0 else (-1, n)
                rest[v] = n + rest[fail[v]] if z >= 0 and rest[fail[v]] >= 0 else -1
        self.fail, self.pops, self.rest = (np.array(x, np.int64) for x in (fail, pops, rest))
        self.mark = mark
        key = np.array([u * SYMBOLS + s for u, c in enumerate(children) for s in c], np.int64)
        child = np.array([v for c in children for v in c.values()], np.int64)
        self.bits = max(4, int(4 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.to[slot[won]] = key[won], child[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * ts.U(0x9E3779B97F4A7C15) >> ts.U(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = node * SYMBOLS + symbol
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            same = found == key[left]
            out[left[same]] = self.to[slot[left[same]]]
            left = left[~same & (found >= 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word ``buf[start:end]`` behind the mark, and whether the vocabulary can spell it (else one piece)."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        node, pieces = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        dead = np.zeros(len(size), bool)
        for i in range(-len(self.mark), int(size.max(initial=0))):
            live = order if i < 0 else order[: np.searchsorted(-size[order], -i - 1, "right")]  # words with a byte at i
            live = live[~dead[live]]
            symbol = buf[starts[live] + i].astype(np.int64) if i >= 0 else np.full(len(live), self.mark[i], np.int64)
            while len(live):
                to = self.child(node[live], symbol)
                on = to >= 0
                node[live[on]] = to[on]
                live, symbol = live[~on], symbol[~on]
                pieces[live] += self.pops[node[live]]
                node[live] = self.fail[node[live]]
                lost = node[live] < 0
                dead[live[lost]] = True
                live, symbol = live[~lost], symbol[~lost]
        rest = self.rest[np.maximum(node, 0)]
        fine = ~dead & (rest >= 0)
        return np.where(fine, pieces + rest, 1), fine


def count_tokens(docs: DataFrame, tokenizer_json: str, cased: bool | None = None, classes: np.ndarray = CLASSES) -> DataFrame:
    """``doc`` (the columns of ``docs`` other than ``text``), ``n_words``, ``n_tokens``, ``n_unknown`` per row.

    ``cased``: whether A-Z keep their case; by default if the vocabulary has a piece with one of them.
    ``classes``: class of each byte; words are the longest runs of one class above 0."""
    known = pieces_of(tokenizer_json)
    if cased is None:
        cased = any(65 <= b <= 90 for piece in known for b in piece)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(known))  # as large as the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                starts, ends = s.runs(classes[s.buf])
                words, back = ts.distinct(s.buf if cased else ts.LOWER[s.buf], starts, ends)
                n, fine = automaton.count(*ts.spans_of(words))
                off = s.per_text(starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), *(pa.array(x) for x in (np.diff(off), ts.sums(n[back], off), ts.sums(~fine[back], off)))],
                    ["doc", "n_words", "n_tokens", "n_unknown"],
                )

    doc = ts.with_doc(docs)
    return doc.mapInArrow(count, StructType([doc.schema["doc"], *StructType.fromDDL("n_words bigint, n_tokens bigint, n_unknown bigint").fields]))
