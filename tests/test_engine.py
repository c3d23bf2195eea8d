"""Registered queries against their SQL, sources, sinks, streams, the command line, and plans."""

from __future__ import annotations

import os

import duckdb
import pytest

from quern.__main__ import main
from quern.operators.queries import ORACLE_SQL, QUERIES
from quern.operators.validate import compile_schema, with_verdict
from quern.sources import documents
from quern.streaming import validate as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        at = [[d[0] for d in r.description].index(c) for c in columns]
        assert sorted(str([x[c] for c in columns]) for x in rows) == sorted(str([x[i] for i in at]) for x in r.fetchall())


def test_a_conversation_larger_than_a_variant(spark, tmp_path):
    turns = spark.range(14).selectExpr("id % 2 AS conv_id", "CAST(id AS INT) AS turn", "IF(id % 4 < 2, 'user', 'assistant') AS role", "IF(id % 2 = 0, repeat('a', 20000000), repeat('b', 20)) AS text")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["conversation_valid"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.valid) for r in got) == [(0, True), (1, True)]


def test_native_plan_has_no_python(spark):
    df = QUERIES["properties"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_sources_and_sink(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"a":\n1}')
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n[1]\n')
    schema = compile_schema('{"type":"object"}')
    assert [r.valid for r in with_verdict(documents.whole_files(spark, str(tmp_path / "a")), schema, "doc").collect()] == [True]
    lines = with_verdict(documents.lines(spark, str(tmp_path / "l.jsonl")), schema, "doc")
    documents.write_verdicts(lines, str(tmp_path / "out"))
    assert sorted(str(r.valid) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["false", "true"]
    assert documents.column(spark, f"{SF}/events.parquet", "props").where(~schema.valid("doc")).isEmpty()


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(SF + "/events.parquet*")
    schema = compile_schema('{"properties":{"k":{"maximum":50}}}')
    streaming.write(streaming.validated(stream, schema, "props"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == events.count()
    assert got.where("valid").count() == events.where(schema.valid("props")).count() == got.where("error_code = 0").count()
    counts = streaming.verdicts_by_window(stream, schema, "props", "ts")
    q = counts.writeStream.format("memory").queryName("verdicts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(documents) FROM verdicts").first()[0] == events.count()


def test_command_line(tmp_path, capsys):
    schema, doc = tmp_path / "s.json", tmp_path / "d.json"
    schema.write_text('{"properties":{"a":{"type":"integer"}}}')
    doc.write_text('{"a":1}')
    assert main(["-c", str(schema), "-r", str(doc), "-d", "ids", "-d", "sql", "-d", "schema"]) == 0
    doc.write_text('{"a":"x"}')
    assert main(["-c", str(schema), "-r", str(doc)]) == 1
    assert "/a: type" in capsys.readouterr().err
    schema.write_text('{"type":"any"}')
    assert main(["-c", str(schema)]) == 2
    assert main(["-c", str(schema), "-l", "c"]) == 2


def test_a_plain_column_expression_is_pickled_by_its_text():
    import pickle

    s = pickle.loads(pickle.dumps(compile_schema('{"minimum":3}')))
    assert s.is_valid("3") and not s.is_valid("2")
