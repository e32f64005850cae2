"""Language ID (8): script ranges narrow the candidates, Viterbi over words labels the spans.

The model learns from labelled texts only: for each language the scripts its letters come from, and
hashed counts of byte n-grams of its words (whole words among them). A word's score for a language is
the mean log probability ratio of its n-grams; languages that do not use the word's script are out.
Viterbi with a penalty for each switch labels the words; the label with most letters is the text's.

Training takes about ``PER_LANG`` texts of a language (all, if there are fewer; else those with the
smallest hashes of their text), each as a whole, for the ``MAX_LANGS`` languages with most texts; prediction covers
every text. What a letter is, Unicode says; the different words of a slice are scored once.

Defined cases: null text or a text without letters is ``und`` with score 0; null languages are not
learnt from; without any training text all is ``und``; a text in a script that no language uses
falls back on all languages; ties go to the language first in alphabetical order; repeated documents get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from railflow.llm import textscan as ts

PER_LANG = 2_000
MAX_LANGS = 400
TABLE = 1 << 16
GRAMS = (1, 2, 3, 4)
SWITCH = 6.0
UND = "und"

#: First code points of blocks, and the script that holds from there on (0: no letters of a script told apart).
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00BA, 1), (0x00BB, 0),
    (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1), (0x0250, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3),
    (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0E00, 10), (0x0E80, 11), (0x10A0, 12),
    (0x1100, 13), (0x1200, 14), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3041, 15), (0x3100, 16), (0x3130, 13), (0x3190, 0),
    (0x3400, 17), (0xA000, 14), (0xAC00, 13), (0xD7B0, 0), (0xF900, 17), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 15), (0xFFA0, 13), (0xFFE0, 0), (0x10000, 14), (0x1F000, 0),
    (0x20000, 17), (0x40000, 0),
]
_FIRST = np.array([x for x, _ in SCRIPTS])
_SCRIPT = np.array([x for _, x in SCRIPTS], np.uint8)
OTHER = int(_SCRIPT.max()) + 1  # letters of all other scripts
N_SCRIPTS = OTHER + 1

_LETTERISH = np.zeros(256, bool)
_LETTERISH[65:91] = _LETTERISH[97:123] = _LETTERISH[128:] = True


_letters: list[np.ndarray] = []


def letter_scripts() -> np.ndarray:
    """Script of every code point that is a letter in Unicode; 0 for all others."""
    if not _letters:
        script = _SCRIPT[np.searchsorted(_FIRST, np.arange(0x110000), "right") - 1]
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(letter, np.where(script > 0, script, OTHER), 0).astype(np.uint8))
    return _letters[0]


def _scripts(buf: np.ndarray) -> np.ndarray:
    """Script at the first byte of each code point that is a letter, else 0."""
    of = letter_scripts()
    out = np.zeros(len(buf), np.uint8)
    low = buf < 128
    out[low] = of[buf[low]]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate([buf, np.full(3, 0x80, np.uint8)]).astype(np.int32)
        first, second, third, fourth = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
        cp = np.where(
            first < 0xE0, ((first & 31) << 6) | second,
            np.where(first < 0xF0, ((first & 15) << 12) | (second << 6) | third, ((first & 7) << 18) | (second << 12) | (third << 6) | fourth),
        )
        out[lead] = of[np.minimum(cp, 0x10FFFF)]
    return out


class _Words:
    """Runs of ASCII letters and non-ASCII bytes with a letter: ``word`` is the number of each one's different word,
    ``begin``, ``end``, ``script`` and ``size`` (in letters) describe the different words, whose n-grams are taken once."""

    def __init__(self, s: ts.Slice):
        starts, ends = s.runs(_LETTERISH[s.buf])
        words, back = ts.distinct(ts.LOWER[s.buf], starts, ends)
        buf, begin, end = ts.spans_of(words)
        script = _scripts(buf)
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(script > 0, out=total[1:])
        size = total[end] - total[begin]
        own = size > 0
        ok = own[back]
        self.starts, self.ends = starts[ok], ends[ok]
        self.word = (np.cumsum(own) - 1)[back[ok]]
        self.begin, self.end, self.size = begin[own], end[own], size[own]
        self.letters = self.size[self.word]
        at = np.flatnonzero(script > 0)
        self.script = script[at[np.searchsorted(at, self.begin)]] if len(self.begin) else np.zeros(0, np.uint8)
        self.off = s.per_text(self.starts)
        self.prefix = ts.Slice(0, buf, np.array([0, len(buf)])).prefix()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Table slots of the ``k``-byte n-grams inside the different words, and the word of each."""
        size = self.end - self.begin
        count = np.maximum(size - k + 1, 0)
        word = np.repeat(np.arange(len(size)), count)
        at = self.begin[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        return _slot(ts.poly_hash(self.prefix, at, at + k), k), word

    def edges(self, k: int) -> Iterator[np.ndarray]:
        """Slots of the first and the last ``k`` bytes of each word, as such, and of the whole word."""
        size = np.minimum(self.end - self.begin, k)
        yield _slot(ts.poly_hash(self.prefix, self.begin, self.begin + size), 20 + k)
        yield _slot(ts.poly_hash(self.prefix, self.end - size, self.end), 40 + k)
        yield _slot(ts.poly_hash(self.prefix, self.begin, self.end), 60)

    def slots(self) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        for k in GRAMS:
            yield self.grams(k)
        for slot in self.edges(3):
            yield slot, None


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (ts.mix(h + ts.U(kind * 0x9E3779B9)) >> ts.U(48)).astype(np.int64)


class Model:
    """Log probability ratios per table slot and language, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        log = np.log(smooth / smooth.sum(axis=0))
        self.table = (log - log.sum(axis=1, keepdims=True) / max(1, len(langs))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = share >= 0.01  # language, script
        self.uses[:, ~self.uses.any(axis=0)] = True

    def scores(self, w: _Words) -> np.ndarray:
        """Score of each word for each language; -inf where the script rules a language out."""
        n = len(w.begin)
        out = np.zeros((n, len(self.langs)), np.float32)
        for slot, word in w.slots():
            if word is None:
                out += self.table[slot]
            else:
                first = np.searchsorted(word, np.arange(n + 1))
                for j in range(len(self.langs)):
                    total = np.zeros(len(slot) + 1, np.float64)
                    np.cumsum(self.table[slot, j], out=total[1:])
                    out[:, j] += total[first[1:]] - total[first[:-1]]
        out[~self.uses.T[w.script]] = -np.inf
        return out[w.word]

    def viterbi(self, score: np.ndarray, off: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """Best label of each word, texts side by side: step ``i`` takes the ``i``-th word of every text that has one."""
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        label = np.zeros(len(score), np.int16)
        stay = np.ones(score.shape, bool)
        best_before = np.zeros(len(score), np.int16)
        score = np.maximum(score, -1e4)
        live = order[size[order] > 0]
        state = np.zeros((len(size), score.shape[1]), np.float64)
        top = int(size.max(initial=0))
        long = np.searchsorted(-size[order], -np.arange(1, top + 1), "right")  # texts of at least i words
        for i in range(top):
            t = live[: long[i]]
            at = off[t] + i
            if i:
                best = np.argmax(state[t], axis=1)
                jump = state[t, best] - switch
                best_before[at] = best
                stay[at] = state[t] >= jump[:, None]
                state[t] = np.maximum(state[t], jump[:, None])
            state[t] += score[at]
        now = np.argmax(state, axis=1).astype(np.int16)
        for i in range(top - 1, -1, -1):
            t = live[: long[i]]
            at = off[t] + i
            label[at] = now[t]
            now[t] = np.where(stay[at, now[t]], now[t], best_before[at])
        return label


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """Learn from ``text`` and ``lang``: per language about ``per_lang`` texts, by the hash of the text; the
    ``max_langs`` languages with most texts are learnt."""
    own = docs.filter("text is not null and lang is not null").select("text", "lang")
    often = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((TABLE, 0)), np.zeros((0, N_SCRIPTS)))
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000)).cast("double") / 1_000_000
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, per_lang / sizes[lang])])
    some = own.filter(place <= F.try_element_at(share, F.col("lang")))
    rows = some.withColumn("_n", F.lit(1)).select("text", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scripts = np.zeros((len(langs), TABLE), np.int32), np.zeros((len(langs), N_SCRIPTS), np.int64)
        seen = np.zeros(len(langs), np.int64)
        for batch in batches:
            lang = np.asarray(batch.column(1)) - 1
            for s in ts.slices(batch.column(0)):
                w = _Words(s)
                of = np.repeat(lang[s.first : s.first + s.n], np.diff(w.off))
                seen += np.bincount(lang[s.first : s.first + s.n], minlength=len(langs))
                used = np.unique(of)
                often = [np.bincount(w.word[of == j], minlength=len(w.begin)) for j in used]
                for slot, word in w.slots():
                    for j, n in zip(used, often, strict=True):
                        counts[j] += np.bincount(slot, n if word is None else n[word], TABLE).astype(np.int32)
                np.add.at(scripts, (of, w.script[w.word].astype(int)), w.letters)
        for j in np.flatnonzero(seen):
            used = np.flatnonzero(counts[j])
            script = np.flatnonzero(scripts[j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) + len(script), j, np.int32)), pa.array(np.concatenate([used, TABLE + script])),
                    pa.array(np.concatenate([counts[j, used], scripts[j, script]])),
                ],
                ["l", "slot", "n"],
            )

    got = rows.mapInArrow(count, "l int, slot bigint, n bigint").groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(langs), TABLE + N_SCRIPTS))  # languages times slots, whatever the corpus
    total[np.asarray(got["l"]), np.asarray(got["slot"])] = np.asarray(got["n"])
    return Model(langs, total[:, :TABLE].T.copy(), total[:, TABLE:])


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """Per row of ``docs``: ``doc`` (its columns other than ``text``), ``lang_pred``, ``score`` (share of the letters
    that carry the label) and ``spans`` of labels in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times 2**16 slots
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = [*model.langs, UND]
        for batch in batches:
            for s in ts.slices(batch.column(1)):
                w = _Words(s)
                best, share = np.full(s.n, len(model.langs)), np.zeros(s.n)
                spans: list[list[dict]] = [[] for _ in range(s.n)]
                if model.langs and len(w.starts):
                    mark = model.viterbi(model.scores(w), w.off, switch)
                    text = ts.owner(w.off)
                    mass = np.bincount(text * len(model.langs) + mark, weights=w.letters, minlength=s.n * len(model.langs)).reshape(s.n, -1)
                    full = mass.sum(axis=1) > 0
                    best[full] = mass[full].argmax(axis=1)
                    share[full] = mass[full].max(axis=1) / mass[full].sum(axis=1)
                    chars = ts.code_points(s.buf)
                    new = np.ones(len(mark) + 1, bool)
                    new[1:-1] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
                    for a, b in zip(np.flatnonzero(new[:-1]).tolist(), (np.flatnonzero(new[1:])).tolist(), strict=True):
                        zero = chars[s.at[text[a]]]
                        spans[text[a]].append({"start": int(chars[w.starts[a]] - zero), "end": int(chars[w.ends[b]] - zero), "lang": langs[mark[a]]})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), pa.array([langs[i] for i in best], pa.string()), pa.array(share), pa.array(spans, span)],
                    ["doc", "lang_pred", "score", "spans"],
                )

    doc = ts.with_doc(docs)
    more = "lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>"
    return doc.mapInArrow(label, StructType([doc.schema["doc"], *StructType.fromDDL(more).fields]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document: learnt on the documents that are not held out, predicted for all."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    own = docs.select("doc_id", "text", "lang", F.coalesce(held, F.lit(False)).alias("held_out"))
    model = train(own.filter("not held_out"))
    return predict(own.select("doc_id", "text", "held_out"), model).select("doc.doc_id", "doc.held_out", "lang_pred", "score", "spans")
