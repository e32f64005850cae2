"""Registered queries against their DuckDB SQL, and the guard of the entry point."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from railflow.llm import chat, queries
from railflow.llm.oracle import ORACLES

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(columns, got.fetchall())


def test_entry_has_all_queries():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = min((r for r in docs.filter("lang = 'en'").collect() if len((r.text or "").split()) >= 300), key=lambda r: r.doc_id)
    words = long.text.split()[:300]  # its own near copies: the tables may have none that are left after line dedup
    near = [(10**9 + i, " ".join([*words[: 50 + i], f"{'xyz'[i] * 9}", *words[51 + i :]]), "en", "own", 0) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        ids.append({r[0] for r in out.select("doc_id").collect()})
        docs = out
    assert ids[0] >= ids[1] > ids[2] > ids[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids[3]


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import random
    import re

    from test_contracts import WORD, _classes, _distance, _lower, _quality

    random.seed(14)
    prose = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(n))
    notice, passage = "All rights reserved by the house.", prose(12)
    bodies = [prose(100) for _ in range(8)]
    rows = [(i, f"{notice}\n{x}" if i % 2 else x) for i, x in enumerate(bodies)]  # some lines go
    words = bodies[2].split()
    rows += [(20 + i, " ".join([*words[: 30 + i], "zzzzzzzzz", *words[31 + i :]])) for i in range(3)]  # near copies
    rows += [(30, bodies[3]), (31, f"{bodies[4]}\n{notice}"), (32, prose(20))]  # all lines go; too short
    rows += [(40, f"{prose(60)} {passage} {prose(30)}"), (41, "spam spam spam " * 40), (42, prose(5000))]
    rows = [(d, t, "en", "s", len(t)) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = {d: t for d, t, *_ in rows}
    want = {"quality_rules": {d: t for d, t in now.items() if not _quality(t)[-1]}}
    flat = [(d, i, x) for d, t in sorted(want["quality_rules"].items()) for i, x in enumerate(t.split("\n"))]

    def close(i, j):
        a, b = flat[i][2], flat[j][2]
        may = min(2, int(0.1 * max(len(a), len(b)) + 1e-9))
        return a == b or (abs(len(a) - len(b)) <= may and _distance(a, b) <= may)

    roots, _ = _classes(len(flat), close)
    left = {}
    for k, (d, _, x) in enumerate(flat):
        if roots[k] == k:
            left.setdefault(d, []).append(x)
    want["line_dedup"] = {d: "\n".join(x) for d, x in left.items()}
    names = sorted(want["line_dedup"])
    grams = [{tuple(w[i : i + 5]) for w in [WORD.findall(_lower(want["line_dedup"][d]))] for i in range(len(w) - 4)} for d in names]
    roots, _ = _classes(len(names), lambda i, j: 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]))
    want["near_duplicates"] = {d: want["line_dedup"][d] for k, d in enumerate(names) if roots[k] == k}
    want["benchmark"] = {d: t for d, t in want["near_duplicates"].items() if not re.search(rf"\b{' '.join(passage.split()[:10])}\b", t)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf).collect()
        assert {r.doc_id: r.text for r in got} == want[name], name
        assert all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema).coalesce(1)
    sizes = [len(want[n]) for n, _ in corpus_pipeline.STAGES[:-1]]
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > sizes[3] and any(want["line_dedup"][d] != now[d] for d in want["line_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(want["benchmark"])


SCHEMA = "conv_id bigint, turn bigint, role string, content string, call_id string, name string, arguments string, message string, position int"
TOOLS: chat.Schemas = {"f": {"a": {"type": "integer", "required": True, "min": 1}, "b": {"type": "string", "max_length": 2}, "c": {"type": "number"}}}


def test_links_order_errors_and_json(spark):
    rows = [
        (1, 0, "user", 'say "é"\n', None, None, None, None, 0),
        (1, 1, "tool", "early", "x", None, None, None, 0),
        (1, 3, "assistant", None, "x", "f", '{"b": "yy", "a": 2, "c": 1.5}', None, 0),
        (1, 4, "assistant", None, "y", "f", '{"b": 7, "z": {"k": [1, {"q": 1, "p": 2}]}}', None, 0),
        (1, 5, "tool", "lost", "q", None, None, None, 0),
        (1, 6, "assistant", None, "w", "g", "{}", None, 0),
        (1, 7, "tool", "w1", "w", None, None, None, 0),
        (1, 7, "tool", "w1", "w", None, None, None, 0),
        (2, 0, "assistant", None, "x", "f", "not json", None, 0),
        (None, None, None, None, None, None, None, None, None),
        (None, 1, "assistant", None, "n", None, None, None, None),
        (None, 2, "tool", "r", "n", None, None, None, None),
    ]
    got = chat.link(spark.createDataFrame(rows, SCHEMA).repartition(3), TOOLS).orderBy("conv_id", "position").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [r.position for r in one] == list(range(8))
    assert [(r.turn, r.kind, r.status) for r in one] == [
        (0, "message", "plain"), (3, "call", "linked"), (1, "result", "linked"), (4, "call", "unanswered"), (5, "result", "orphan"),
        (6, "call", "repeated"), (7, "result", "repeated"), (7, "result", "repeated"),
    ]
    assert [r.errors for r in one] == [[], [], [], ["missing:a", "type:b", "unexpected:z"], [], ["unknown_tool"], [], []]
    assert one[1].message == '{"arguments":{"a":2,"b":"yy","c":1.5},"call_id":"x","name":"f","role":"assistant"}'
    assert one[3].message == '{"arguments":{"b":7,"z":{"k":[1,{"p":2,"q":1}]}},"call_id":"y","name":"f","role":"assistant"}'
    assert json.loads(one[0].message) == {"content": 'say "é"\n', "role": "user"}
    assert [r.errors for r in got if r.conv_id == 2] == [["not_an_object"]]
    null = [r for r in got if r.conv_id is None]
    assert [r.position for r in null] == [0, 1, 2] and [r.status for r in null] == ["plain", "linked", "linked"]
    assert chat.link(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_numbers_have_one_form(spark):
    arguments = ['{"a": 12345678901234567890, "c": 1.0}', '{"a": 2, "c": 1e3}', '{"a": 2, "c": 1000.00}', '{"a": 2, "c": -0.0, "z": [1.50, {"k": "1.0 \\\\ \\" 2e5"}]}', '{"a": 1e30, "c": 2.5e-3}']
    rows = [(1, i, "assistant", None, f"x{i}", "f", a, None, 0) for i, a in enumerate(arguments)]
    got = chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).orderBy("position").collect()
    own = [r.message[len('{"arguments":') : r.message.index(',"call_id"')] for r in got]
    assert own == [
        '{"a":12345678901234567890,"c":1}', '{"a":2,"c":1000}', '{"a":2,"c":1000}', '{"a":2,"c":0,"z":[1.5,{"k":"1.0 \\\\ \\" 2e5"}]}',
        '{"a":1000000000000000000000000000000,"c":0.0025}',
    ]
    assert got[0].errors == [] and all(json.loads(r.message)["arguments"] is not None for r in got)
    quoted: chat.Schemas = {"f": {"it's": {"type": "integer", "required": True}}}
    row = spark.createDataFrame([(1, 0, "assistant", None, "x", "f", '{"it\'s": 3}', None, 0)], SCHEMA)
    assert chat.link(row, quoted).first().errors == []


def test_chat_with_very_long_and_clashing_rows(spark):
    long = "é\n\"" * 50_000
    rows = spark.createDataFrame([(1, 0, "user", long, None, None, None, "m", 7), (1, 1, "assistant", None, "x", "f", json.dumps({"a": 2, "b": "y", "z": long, "c": 1.5}), "m", 7)], SCHEMA)
    got = chat.link(rows, TOOLS).orderBy("position").collect()
    assert json.loads(got[0].message)["content"] == long and json.loads(got[1].message)["arguments"]["z"] == long


def test_chat_runs_no_python(spark):
    plan = queries.op10_chat(spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_long_conversation_is_spread(spark):
    rows = spark.range(3000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"),
        *[F.lit(None).cast("string").alias(c) for c in ("call_id", "name", "arguments")],
    )
    assert chat.link(rows, TOOLS).filter("turn <> position").count() == 0
