"""Personal data (7): generators propose spans, boosted trees judge them, calibrated thresholds select.

Rules for e-mail addresses, IP addresses, card and phone numbers give the base spans. Wider
generators propose more, overlapping spans: obfuscated addresses, numbers grouped in other ways,
phone numbers without a country code, IPv6 addresses. One model of boosted trees per kind sees the format
of a span and its surroundings. It learns from the corpus itself: base spans, and the same spans
rewritten in the ways the generators know, are examples; base spans spoilt so that they are none, and candidates whose
format rules them out (``well_formed``), are the counter-examples. Other candidates, which may be
personal data in another form, are learnt neither way. On held-out examples the scores are calibrated by Platt's method; a span is added when its
probability reaches the kind's threshold (least that keeps ``PRECISION``) and it touches no base span.

Training takes the candidates of about ``TRAIN_DOCS`` documents and at most ``TRAIN_SPANS`` of them (by
hash); finding covers every whole text.

Defined cases: a null or empty text has no spans; without examples of a kind its model adds nothing; of overlapping
additions the more probable, then the earlier, wins; repeated documents give equal rows; other columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from railflow.llm import textscan as ts
from railflow.llm.boosting import Trees

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 20_000
TRAIN_SPANS = 40_000
PRECISION = 0.98

Span = tuple[str, int, int]

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?"
        r"[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,63}+){1,5}",
        re.IGNORECASE,
    ),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?: ?\. ?| dot |\[\.\]|\(\.\))){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", re.IGNORECASE),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
}
#: Words that announce a kind in some common languages.
CUES = {
    "email": {"email", "mail", "contact", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "adresse"},
    "card": {"card", "visa", "credit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "call", "telefon", "fax", "mobile", "telefono"},
}
_HINT = np.zeros(256, bool)  # bytes without which nothing can match
_HINT[48:58] = _HINT[64] = True
_AT_WORD = re.compile(r"\(at\)|\[at\]|\{at\}| at ", re.IGNORECASE)
_BRACKET_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
_DOT_WORD = re.compile(r" dot |\(dot\)|\[dot\]|\{dot\}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The rules' spans, each kind on its own; linear in the text."""
    out: list[Span] = []
    at, before, done = text.find("@"), 0, 0
    while at >= 0:
        floor = max(before, done)
        run = text[floor:at]
        start = floor + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        before = at + 1
        at = text.find("@", max(before, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data, overlapping ones too."""
    return [(kind, m.start(), m.end()) for kind in KINDS for m in _WIDE[kind].finditer(text)]


def well_formed(kind: str, own: str) -> bool:
    """Whether the format of a candidate allows it to be of its kind; those that fail are safe counter-examples."""
    digits = _digits(own)
    if kind == "email":  # a written-out "at" goes with a written-out "dot"; a full stop followed by a space ends a sentence
        return bool(_DOT_WORD.search(own)) if not _BRACKET_AT.search(own) else ". " not in own
    if kind == "ip":
        return ":" in own or all(int(p) <= 255 for p in re.findall(r"[0-9]+", own))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (own[0] in "+(" or own.startswith("00") or not own.isdigit())


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    kind, a, b = span
    own, left, right = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    digits = _digits(own)
    groups = re.findall(r"[0-9]+", own)
    marks = sum(not c.isalnum() for c in own)
    words = re.findall(r"[^\W\d_]+", left.lower())[-4:]
    upper = sum(c.isupper() for c in own)
    return [
        float(b - a), float(len(digits)), float(sum(c.isalpha() for c in own)), float(marks), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)), float(own[0] == "+"), float("(" in own),
        float(own.count(".")), float(own.count("-")), float(own.count(" ")), float("@" in own), float(bool(digits) and luhn(digits)),
        float(max((int(g) for g in groups if len(g) < 6), default=0) <= 255), float(len(set(digits))), float(upper),
        float(bool(left) and left[-1].isspace()), float(bool(right) and (right[0].isspace() or right[0] in ".,;!?")),
        float(bool(left) and (left[-1].isdigit() or left[-1] in "/=#_")), float(bool(CUES[kind].intersection(words))),
        float(sum(c.isdigit() for c in left + right) / 60), float(sum(not c.isalnum() and not c.isspace() for c in left + right) / 60),
    ]


def _rewrite(text: str, span: Span, way: int) -> tuple[str, Span]:
    """The text around a base span with the span written another way."""
    kind, a, b = span
    own = text[a:b]
    if kind == "email":
        at, dot = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" AT ", " DOT "), ("(AT)", "."), ("[at]", "[DOT]"))[way % 6]
        user, _, host = own.partition("@")
        own = (user.upper() if way % 6 == 5 else user) + at + host.replace(".", dot)
    elif kind == "ip":
        own = own.replace(".", (" . ", "[.]", " dot ")[way % 3])
    elif kind == "card":
        digits = _digits(own)
        own = (".", "/", "  ")[way % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    else:
        own = (own[1:], "00" + own[1:], re.sub(r"^\+[0-9]{1,3}[ .-]?", "", own))[way % 3]
    left = text[max(0, a - 60) : a]
    return left + own + text[b : b + 40], (kind, len(left), len(left) + len(own))


def _spoil(text: str, span: Span) -> tuple[str, Span] | None:
    """A look-alike of a base span that is none: a wrong check digit, too few digits, a part beyond 255."""
    kind, a, b = span
    own = text[a:b]
    if kind == "card":
        own = own[:-1] + str((int(own[-1]) + 1) % 10)
    elif kind == "phone":
        own = _digits(own)[-8:]
    elif kind == "ip":
        own = f"{256 + len(own) * 7}{own[own.index('.') :]}"
    else:
        return None
    left = text[max(0, a - 60) : a]
    return left + own + text[b : b + 40], (kind, len(left), len(left) + len(own))


def _touches(span: Span, others: list[Span]) -> bool:
    return any(span[1] < e and s < span[2] for _, s, e in others)


class Judge:
    """Trees, calibration and threshold per kind; empty where nothing could be learnt."""

    def __init__(self, kind: np.ndarray, x: np.ndarray, y: np.ndarray, precision: float = PRECISION):
        self.models: dict[str, tuple[Trees, float, float, float]] = {}
        for k, name in enumerate(KINDS):
            own = np.flatnonzero(kind == k)
            held = own[np.arange(len(own)) % 4 == 3]
            fit = own[np.arange(len(own)) % 4 != 3]
            if min(y[fit].sum(), y[held].sum()) < 10:
                continue
            if y[fit].all():  # no counter-examples at all: nothing to tell apart
                continue
            trees = Trees().fit(x[fit], y[fit])
            logit = self._logit(trees.probability(x[held]))
            a, b = _platt(logit, y[held])
            p = 1 / (1 + np.exp(-(a * logit + b)))
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
            ok = np.flatnonzero((right >= precision) & np.append(p[order][1:] < p[order][:-1], True))
            if len(ok):
                self.models[name] = (trees, a, b, float(max(p[order][ok[-1]], 0.5)))

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that touch neither a base span nor each other."""
        open_ = [c for c in candidates(text) if c[0] in self.models and not _touches(c, base)]
        if not open_:
            return []
        scored = []
        for name, (trees, a, b, least) in self.models.items():
            own = [c for c in open_ if c[0] == name]
            if own:
                logit = self._logit(trees.probability(np.array([features(text, c) for c in own])))
                p = 1 / (1 + np.exp(-(a * logit + b)))
                scored += [(-v, c[1], c) for v, c in zip(p.tolist(), own, strict=True) if v >= least]
        out: list[Span] = []
        for _, _, c in sorted(scored):
            if not _touches(c, out):
                out.append(c)
        return out


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated logit, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * logit + b)))
        g = np.array([((p - target) * logit).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * logit**2).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -5, 5))
    return max(a, 1e-3), b


def _texts(batch_column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts that can hold a span at all."""
    for s in ts.slices(batch_column):
        hint = ts.sums(_HINT[s.buf], s.at) > 0
        for t in range(s.n):
            text = s.buf[s.at[t] : s.at[t + 1]].tobytes().decode("utf-8", "replace")
            if hint[t] or _AT_WORD.search(text):
                yield s.first + t, text


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_spans: int = TRAIN_SPANS) -> Judge:
    """Fit on the candidates of about ``train_docs`` documents."""
    own = docs.select("text").filter("text is not null")
    n = own.count()
    some = own.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, train_docs / max(n, 1))))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, x, y = [], [], []
            for _, text in _texts(batch.column(0)):
                base = base_spans(text)
                for i, span in enumerate(base):
                    for way in (None, i + len(text)):
                        near, at = (text, span) if way is None else _rewrite(text, span, way)
                        kind.append(KINDS.index(span[0]))
                        x.append(features(near, at))
                        y.append(1.0)
                    spoilt = _spoil(text, span)
                    if spoilt:
                        kind.append(KINDS.index(span[0]))
                        x.append(features(*spoilt))
                        y.append(0.0)
                for c in candidates(text):
                    if not _touches(c, base) and not well_formed(c[0], text[c[1] : c[2]]):
                        kind.append(KINDS.index(c[0]))
                        x.append(features(text, c))
                        y.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(y, pa.float64()), pa.array(x, pa.list_(pa.float64()))], ["kind", "y", "x"]
            )

    rows = some.mapInArrow(examples, "kind int, y double, x array<double>")
    got = rows.withColumn("_o", F.xxhash64("kind", "y", "x")).orderBy("_o", "kind", "y").limit(train_spans).toArrow()
    x = np.array(got["x"].to_pylist()) if got.num_rows else np.zeros((0, 1))
    return Judge(np.asarray(got["kind"]), x, np.asarray(got["y"]))


def find(docs: DataFrame, judge: Judge, whole: bool = False) -> DataFrame:
    """``doc`` (the columns of ``docs`` other than ``text``; ``whole``: with it), the rules' ``base`` spans and all ``spans`` (kind, start, end
    in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)  # a few hundred tree nodes
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            spans: list[list[Span]] = [[] for _ in range(batch.num_rows)]
            for row, text in _texts(batch.column(1)):
                base[row] = base_spans(text)
                spans[row] = sorted([*base[row], *shared.value.added(text, base[row])], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            as_rows = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], kind) for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *as_rows], ["doc", "base", "spans"])

    doc = ts.with_doc(docs, whole)
    more = ", ".join(f"{c} array<struct<kind: string, start: bigint, end: bigint>>" for c in ("base", "spans"))
    return doc.mapInArrow(scan, StructType([doc.schema["doc"], *StructType.fromDDL(more).fields]))


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    found = find(docs, judge, whole=True)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring("doc.text", acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring("doc.text", acc["at"].cast("int") + 1, F.length("doc.text"))),
    )
    return found.select(*[F.when(F.col("doc.text").isNotNull(), cut).alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document; counts and digest are the rules', ``spans`` holds all."""
    own = docs.select("doc_id", "text")
    found = find(own, learn(own))

    def joined(column: str):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc.doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
