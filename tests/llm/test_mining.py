"""URL filters, collocations and lexical search against plain Python on small tables, and their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railflow.llm import lexical, phrases, reputation


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 11
RULES = [("com", "/", "allow"), ("b.com", "/x/", "block"), ("www.b.com", "/x/", "allow"), ("www.b.com", "/x/", "block"), ("net", "", "block"), ("a.net", "/\u00e9", "allow")]
URLS = [
    "http://b.com/x/1", "https://WWW.B.com/x/1?q#f", "http://sub.www.b.com/x/", "http://b.com/X/1", "http://xb.com/x/1", "http://b.com", "http://b.com?/x/",
    "http://a.net/\u00e9t\u00e9", "http://q.a.net/e", "no scheme", None, "", "://", "ftp://net", "http://1.2.3.4/x", "http://u@host.co.uk:80/p#://z.com/", "http://org/" + "y/" * 20_000,
]


def _parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def _rule(host, path):
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))


def test_rules_by_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([], "url string, is_bad boolean")
    got = reputation.judge(pages, reputation.rules_table(spark, RULES), outcomes).collect()
    want = [(i, *_parts(u), _rule(*_parts(u))[2], _rule(*_parts(u))[1] or "allow") for i, u, _ in rows]
    assert sorted(map(str, ((r.page.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, want))
    assert {r.page.host for r in got} == {"x"}
    none = reputation.rules_table(spark, [])
    assert {r.verdict for r in reputation.judge(pages, none, outcomes).collect()} == {"allow"}
    assert reputation.judge(pages.limit(0), none, outcomes).count() == 0


def test_beta_tails_by_integration():
    rng = np.random.default_rng(3)
    for a, b, x in [(1, 1, 0.3), (0.6, 0.7, 0.5), (30, 2, 0.9), (2000.5, 1800, 0.5), (5, 400, 0.02), *((*rng.uniform(0.5, 60, 2), rng.uniform(0.05, 0.95)) for _ in range(20))]:
        u = np.linspace(-60, 60, 2_000_001)  # log odds
        t = 1 / (1 + np.exp(-u))
        log = -a * np.logaddexp(0, -u) - b * np.logaddexp(0, u)
        w = np.exp(log - log.max())
        assert reputation.beta_tail(np.array([a]), np.array([b]), x)[0] == pytest.approx(w[t > x].sum() / w.sum(), abs=2e-4)


def _domain(host):
    labels = host.split(".")
    n = 2 if ".".join(labels[-2:]) in reputation.SUFFIXES else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def _strength(nodes):  # (n, bad, mean)
    nodes = [x for x in nodes if x[0] and 0 < x[2] < 1]
    pairs = sum(n - 1 for n, _, _ in nodes)
    if not pairs:
        return reputation.WEAKEST
    overlap = sum(n * (bad / n - m) ** 2 / (m * (1 - m)) - 1 for n, bad, m in nodes) / pairs
    return min(max(1 / overlap - 1, reputation.WEAKEST), reputation.STRONGEST) if overlap > 0 else reputation.STRONGEST


def test_reputations_by_brute_force(spark):
    random.seed(4)
    rate = {f"h{i}.d{i % 5}.{'com' if i % 2 else 'co.uk'}": (0.97 if i % 5 == 3 else 0.1) for i in range(40)}
    outcomes = [(h, random.random() < p) for h, p in rate.items() for _ in range(random.choice([1, 3, 60]))] + [("", True)] * 50 + [("h1.d1.com", None)]
    hosts = [*rate, "new.d3.com", "new.d1.com", "other.org", ""]
    got = reputation.reputations(spark.createDataFrame(outcomes, "host string, is_bad boolean"), spark.createDataFrame([(h,) for h in hosts + hosts[:3]], "host string"))
    count = defaultdict(lambda: [0, 0])
    for h, bad in outcomes:
        if h and bad is not None:
            count[h][0] += 1
            count[h][1] += bad
    levels = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for h, (n, bad) in count.items():
        for level, name in zip(levels, _domain(h), strict=True):
            level[name][0] += n
            level[name][1] += bad
    n, bad = map(sum, zip(*count.values(), strict=True))
    root = (bad + 0.5) / (n + 1)
    s = _strength([(n, b, root) for n, b in levels[1].values()])
    suffix = {x: (root * s + b) / (s + n) for x, (n, b) in levels[1].items()}
    of = {d: h.split(".")[-1] if "co.uk" not in h else "co.uk" for h in count for d in [_domain(h)[0]]}
    s = _strength([(n, b, suffix[of[x]]) for x, (n, b) in levels[0].items()])
    domain = {x: (suffix[of[x]] * s + b) / (s + n) for x, (n, b) in levels[0].items()}
    s = _strength([(n, b, domain[_domain(h)[0]]) for h, (n, b) in count.items()])
    rows = {r.host: r for r in got.collect()}
    assert len(rows) == got.count() == len(hosts)
    for h in hosts:
        d, x = _domain(h)
        m = domain.get(d, suffix.get(x, root))
        n, bad = count.get(h, (0, 0))
        assert (rows[h].alpha, rows[h].beta) == (pytest.approx(m * s + bad), pytest.approx((1 - m) * s + n - bad))
        assert rows[h].blocked == (h != "" and rows[h].p_bad >= reputation.CONFIDENCE)
    many = {h for h, (n, _) in count.items() if n == 60}
    assert {h for h in many if rows[h].blocked} == {h for h in many if rate[h] > 0.5}


# ---- 12
def _mine(rows, min_count, top, longest=4):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    random.seed(9)
    stock = "the of new york city a river \u00e9t\u00e9 x\u00a0y \U0001f600 tea pot hot".split()
    out = []
    for i in range(300):
        w = []
        while len(w) < 30:
            w += random.choice([["New", "York", "City"], ["hot", "tea", "pot", "of"], [random.choice(stock)], [random.choice(stock) + random.choice(".,;:!?\n\x0b\t")]])
        out.append((random.choice(["en", "de", "en", None]), " ".join(w)))
    return out + [(None, None), ("en", ""), ("fr", " .,\n"), out[0], out[0], ("en", "Hot tea " * 60_000), ("xx", "w" * 100_000 + " z")]


@pytest.mark.parametrize(("min_count", "top"), [(5, 2000), (30, 7)])
def test_collocations_by_brute_force(spark, texts, min_count, top):
    docs = spark.createDataFrame([(*t, "x") for t in texts], "lang string, text string, phrase string").repartition(5)
    got = phrases.collocations(docs, min_count=min_count, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _mine(texts, min_count, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_look_ups_of_a_busy_range_are_dealt_out(spark, texts):
    found, _ = phrases.count_phrases(spark.createDataFrame(texts, "lang string, text string"), longest=2, min_count=5)
    counts = found[0].union(found[1]).select("lang", "phrase", "f")
    asked = counts.select("lang", F.col("phrase").alias("part"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).union(
        spark.createDataFrame([("en", "no such", 1), ("zz", "the", 1)], "lang string, part string, i int")
    )
    got = phrases.part_counts(counts, asked, block=20)
    want = asked.join(counts.withColumnRenamed("phrase", "part"), ["lang", "part"], "left").select("lang", "part", F.coalesce("f", F.lit(0)).alias("f"), "i")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_automata_are_minimal_and_whole():
    rng = np.random.default_rng(2)
    for n, many in ((0, 3), (1, 3), (500, 4), (4000, 30)):
        rows = np.unique(rng.integers(0, many, (n, 4)), axis=0)
        weight = rng.integers(1, 3, len(rows))
        a = phrases.Automaton.of_sorted([rows[:, i] for i in range(4)], weight)
        b = phrases.Automaton.load(a.dump())
        if len(rows):
            columns, w = b.paths()
            assert np.array_equal(np.column_stack(columns), rows) and np.array_equal(w, weight)
            asked = rng.integers(0, many + 2, (300, 4))
            known = {tuple(r): x for r, x in zip(rows.tolist(), weight.tolist(), strict=True)}
            assert b.compose(list(asked.T)).tolist() == [known.get(tuple(r), 0) for r in asked.tolist()]
        off, label, _ = a.layers[-1]
        last = [tuple(zip(label[i:j].tolist(), a.weight[i:j].tolist(), strict=True)) for i, j in zip(off[:-1], off[1:], strict=True)]
        assert len(set(last)) == len(last)  # equal continuations are one state


# ---- 13
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _rank(docs, items, k=10):
    terms = [Counter(TERM.findall(_lower(t))) for _, t in docs]
    n = [sum(c.values()) for c in terms]
    n_docs, n_terms = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in terms for t in c)
    out = []
    for name, text in items:
        asked = Counter(TERM.findall(_lower(text)))
        scored = []
        for (doc, _), c, size in zip(docs, terms, n, strict=True):
            score = 0
            for t, repeats in asked.items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += repeats * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(name, i, doc, -s) for i, (s, _, doc) in enumerate(scored[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block_terms", [100_000, 15])
def test_search_by_brute_force(spark, block_terms):
    random.seed(21)
    stock = [f"w{i}" for i in range(60)] + ["\u00dcber", "\u65e5\u672c", "a1"]
    docs = [(i, " ".join(random.choice(stock[: random.choice([5, 20, 63])]) for _ in range(random.choice([1, 5, 40, 300])))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!!"), (None, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (503, "w1 " * 30_000), (504, " ".join(f"u{i}" for i in range(20_000)) + " w7")]
    items = [(1, "W1 w2 w2 w3"), (2, "w59 \u00dcber"), (2, "unknown term"), (3, None), (None, "w7"), (4, docs[9][1]), (4, docs[9][1]), (5, ".")]
    a = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, score string").repartition(6)
    b = spark.createDataFrame(items, "item_id int, text string")
    posted = lexical.stage(lexical.index(a.select("doc_id", "text")), "test-postings")
    got = lexical.search(posted, b, block_terms=block_terms)
    assert sorted(str(tuple(r)) for r in got.collect()) == _rank(docs, items)
    three = lexical.search(posted, b, k=3, block_terms=block_terms)
    assert sorted(str(tuple(r)) for r in three.collect()) == _rank(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        assert lexical.digest(a, b).count() == 0
    assert lexical.digest(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_the_scores():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    import pyarrow as pa

    from railflow.llm import textscan as ts

    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 50, 800, 9000) for _ in range(5)]
    column = lexical._posted(next(ts.slices(pa.array(texts), 1 << 30)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *column], ["id", "n", "terms", "freqs", "sketch"])
    terms, off = lexical._flat(column[1], np.uint64)
    freqs, _ = lexical._flat(column[2], np.int32)
    sketch, at = lexical._flat(column[3], np.uint8)
    assert len(batch) == len(texts)
    for i in range(len(texts)):
        own, cells = terms[off[i] : off[i + 1]], sketch[at[i] : at[i + 1]]
        one, two = lexical._cells(own, len(cells))
        assert (np.minimum(cells[one], cells[two]) >= np.minimum(freqs[off[i] : off[i + 1]], lexical.FULL)).all()
