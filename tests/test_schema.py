"""Verdicts of both tiers on authored draft-06 cases, identifiers, bad schemas, compat mode, and random schema x document pairs."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators.validate import compile_schema, error_counts, report
from quern.plans.schema import SchemaError

# (schema, valid documents, invalid documents)
CASES = [
    ({}, ["1", "null", '"x"', "[]", '{"a":{}}', " 1 "], ["", "{12:1}", "[1,]", "01", "1 2", "{} {}", "1] [2", '{"a":1,"a":1}', "NaN", "'a'"]),
    ({"type": "integer"}, ["1", "1.1e2", "200e-2", "1.0", "1e300"], ["1.1", "210e-2", '"1"', "null", "1e400"]),
    ({"type": "number"}, ["1", "1.1"], ['"1"', "null", "true"]),
    ({"type": ["number", "integer"]}, ["1.5", "2"], ['"x"']),
    ({"type": "object"}, ["{}"], ["[]", "1"]),
    ({"multipleOf": 0.5}, ["1.5", "-2", '"x"', "0"], ["0.3", "1e400"]),
    ({"minimum": 1.1, "exclusiveMaximum": 3}, ["1.1", '"x"', "2.9"], ["0.6", "3"]),
    ({"exclusiveMinimum": 0, "maximum": 2}, ["2", "0.1"], ["0", "2.1"]),
    ({"minLength": 2, "maxLength": 3}, ['"ab"', '"\\ud83d\\ude00b"', "1"], ['"a"', '"abcd"', '"\\ud83d\\ude00"']),
    ({"pattern": "^a\\d+$"}, ['"a12"', "1"], ['"a"', '"ba1"', '"a1\\n"']),
    ({"pattern": "[^]b|\\u0041\\/"}, ['"xb"', '"A/"'], ['"b"']),
    ({"enum": [1, "a", None, [1, {"b": 2}], True]}, ["1.0", '"a"', "null", '[1.0,{"b":2}]', "true"], ["2", "false", '[1]', '[1,{"b":3}]', '"1"']),
    ({"const": {"a": [], "b": {}}}, ['{"b":{},"a":[]}'], ['{"a":[],"b":{},"c":1}', '{"a":{},"b":{}}']),
    ({"const": ""}, ['""'], ['" "', "null"]),
    ({"items": {"type": "number"}}, ["[1,2]", "{}", "[]"], ['[1,"x"]']),
    ({"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, ["[]", '["a"]', '["a",1]'], ["[1]", '["a","b"]']),
    ({"additionalItems": False, "items": {}}, ["[1,2]"], []),
    ({"minItems": 1, "maxItems": 2}, ["[1]", '"x"'], ["[]", "[1,2,3]"]),
    ({"uniqueItems": True}, ["[1,2,3]", "[true,1,\"1\",null]", '[{"a":3},{"b":2,"a":3}]', "[[],[1],[1,2],[2,1]]", '["n1.0",1]'], ["[1,1.0]", "[0,-0.0]", '[{"b":2,"a":3},{"a":3,"b":2}]', "[[],[]]", "[false,false]"]),
    ({"uniqueItems": True, "items": {"type": ["string", "number"]}}, ['["1",1]', "[]"], ["[0,-0.0]", '["a","a"]']),
    ({"contains": {"minimum": 5}}, ["[1,5]", "1"], ["[]", "[1]"]),
    ({"minProperties": 1, "maxProperties": 1}, ['{"a":1}', '""'], ["{}", '{"a":1,"b":2}']),
    ({"required": ["a", "b"]}, ['{"a":null,"b":1}', "12"], ['{"a":1}']),
    ({"properties": {"foo": {"type": "number"}, "b.c": {"type": "string"}}}, ['{"quux":[]}', "[]", '{"foo":1}'], ['{"foo":"x"}', '{"b.c":1}']),
    ({"properties": {"ab": {"maximum": 5}}, "patternProperties": {"^a": {"minimum": 1}}, "additionalProperties": {"type": "null"}}, ['{"ab":3,"ax":7,"z":null}'], ['{"ab":0}', '{"ab":9}', '{"z":1}']),
    ({"properties": {"a": {}}, "required": ["r"], "additionalProperties": False}, [], ['{"r":1}', '{"a":1}']),
    ({"propertyNames": {"maxLength": 2, "enum": ["a", "bb"]}}, ['{"a":1,"bb":2}', "[]"], ['{"c":1}']),
    ({"propertyNames": False}, ["{}"], ['{"a":1}']),
    ({"dependencies": {"quux": ["foo", "bar"], "this": {"required": ["that"]}}}, ["{}", '{"quux":1,"foo":2,"bar":3}', '{"this":1,"that":2}', "[]"], ['{"quux":1,"foo":1}', '{"this":1}']),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}], "anyOf": [{"type": "integer"}, {"minimum": 1.5}], "oneOf": [{"const": 1}, {"minimum": 1.5}]}, ["1", "2"], ["1.2", "3", "0"]),
    ({"required": ["a"], "oneOf": [{"properties": {"a": {"const": 1}}}, {"properties": {"b": {"const": 1}}, "required": ["b"]}]}, ['{"a":1}', '{"a":2,"b":1}'], ['{"a":1,"b":1}', '{"b":1}']),
    ({"not": {"not": {"pattern": "fo."}}}, ['"foo"', "1"], ['"fbo"']),
    (False, [], ["1", "{}"]),
    ({"items": False}, ["[]", "1"], ["[1]"]),
    ({"definitions": {"p": {"exclusiveMinimum": 0}}, "not": {"$ref": "#/definitions/p"}}, ["0", '-1'], ["1", '"x"']),
    ({"properties": {"foo": {"$ref": "#"}}, "additionalProperties": False}, ['{"foo":{"foo":{}}}', "1"], ['{"foo":{"bar":1}}', '{"bar":1}']),
    ({"$ref": "#/definitions/a", "maximum": 0, "definitions": {"a": {"type": "integer"}}}, ["5"], ["1.5"]),
    ({"x~y/z": {"minimum": 3}, "$id": "http://a.test/b/c.json", "items": {"$ref": "#/x~0y~1z"}}, ["[3]"], ["[2]"]),
    ({"$id": "http://a.test/b/c.json", "definitions": {"d": {"$id": "d.json#frag", "type": "null"}}, "items": {"$ref": "d.json#frag"}}, ["[null]"], ["[1]"]),
]


def verdicts(spark, schema, docs: list) -> list[tuple]:
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string").coalesce(1)
    rows = df.select("i", schema.valid("doc").alias("v"), schema.error_code("doc").alias("c"), schema.violations("doc").alias("x")).collect()
    return [(r["v"], r["c"] == 0, not r["x"]) for r in sorted(rows)]


def found(spark, schema, docs: list) -> list[tuple]:
    """Error code, and all violations in order: path, keyword, code."""
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string").coalesce(1)
    rows = df.select("i", schema.error_code("doc").alias("c"), schema.violations("doc").alias("x")).collect()
    out = [(r["c"], [tuple(x) for x in r["x"]]) for r in sorted(rows)]
    layered = schema.over(df, "doc", valid="v", error_code="c", violations="x").collect()
    assert [(r["c"], [tuple(x) for x in r["x"]]) for r in sorted(layered)] == out and all(r["v"] == (r["c"] == 0) for r in layered)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(spark, i):
    raw, good, bad = CASES[i]
    schema = compile_schema(json.dumps(raw))
    docs = [*good, *bad, None]
    want = [True] * len(good) + [False] * (len(bad) + 1)
    assert [schema.is_valid(d) for d in docs] == want
    assert verdicts(spark, schema, docs) == [(w, w, w) for w in want]
    assert found(spark, schema, docs) == [(f[0][2] if f else 0, f) for f in map(schema.python.check, docs)]


def test_arrow_tier_agrees(spark):
    raw, good, bad = CASES[24]
    a, n = (compile_schema(json.dumps(raw), tier=t) for t in ("arrow", "native"))
    assert verdicts(spark, a, good + bad + [None]) == verdicts(spark, n, good + bad + [None])


scalars = st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from([0.5, 1.5, -0.0, 1e300]) | st.sampled_from(["", "a", "ab", "b1", "é"])
values = st.recursive(scalars, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "ab"]), c, max_size=3), max_leaves=6)
leaves = st.one_of(
    st.booleans(), st.fixed_dictionaries({"type": st.sampled_from(["object", "array", "string", "number", "integer", "boolean", "null"])}),
    st.fixed_dictionaries({"enum": st.lists(values, min_size=1, max_size=3)}), st.fixed_dictionaries({"minimum": st.integers(-2, 2), "multipleOf": st.sampled_from([0.5, 2])}),
    st.fixed_dictionaries({"minLength": st.integers(0, 2), "pattern": st.sampled_from(["a", "^b", "1$"])}), st.fixed_dictionaries({"required": st.lists(st.sampled_from(["a", "b"]), max_size=2), "maxProperties": st.integers(0, 2)}), st.fixed_dictionaries({"maxItems": st.integers(0, 2)}))
schemas = st.recursive(leaves, lambda c: st.one_of(
    st.fixed_dictionaries({k: st.lists(c, min_size=1, max_size=2)}) if k.endswith("Of") else st.fixed_dictionaries({k: c}) for k in ("allOf", "anyOf", "oneOf", "not", "items", "contains", "additionalProperties", "propertyNames")) | st.fixed_dictionaries({"properties": st.dictionaries(st.sampled_from(["a", "b"]), c, max_size=2), "patternProperties": st.dictionaries(st.just("b$"), c, max_size=1), "additionalProperties": c}) | st.fixed_dictionaries({"items": st.lists(c, max_size=2), "additionalItems": c}) | st.fixed_dictionaries({"dependencies": st.dictionaries(st.sampled_from(["a"]), c, max_size=1)}), max_leaves=4)


@settings(max_examples=25, deadline=None)
@given(schemas, st.lists(values, min_size=8, max_size=8))
def test_tiers_agree_on_random_pairs(spark, raw, docs):
    schema = compile_schema(json.dumps(raw), tier="native")
    texts = [json.dumps(d) for d in docs]
    want = [schema.is_valid(t) for t in texts]
    assert verdicts(spark, schema, texts) == [(w, w, w) for w in want]
    assert found(spark, schema, texts) == [(f[0][2] if f else 0, f) for f in map(schema.python.check, texts)]


@pytest.mark.parametrize("text", ["", "{", "1", '"x"', '{"type":"any"}', '{"type":[]}', '{"type":["null","null"]}', '{"multipleOf":0}', '{"minLength":-1}', '{"enum":[]}', '{"allOf":[]}', '{"$ref":"#/nowhere"}', '{"$ref":"#"}', '{"pattern":"("}', '{"pattern":"(?<=a)b"}', '{"required":"a"}', '{"properties":[]}', '{"uniqueItems":1}', '{"definitions":{"a":{"$id":"#x"},"b":{"$id":"#x"}}}'])
def test_bad_schemas(text):
    with pytest.raises(SchemaError):
        compile_schema(text)


def test_identifiers():
    assert compile_schema("{}", base_uri="http://a.test/x.json").ids() == ["http://a.test/x.json#"]
    ids = compile_schema('{"$id":"http://x.test/root.json","definitions":{"A":{"$id":"#foo"}},"properties":{"p":{"$id":"t/inner.json","items":{}}}}').ids()
    for want in ("http://x.test/root.json#", "http://x.test/root.json#/properties/p", "http://x.test/t/inner.json#", "http://x.test/t/inner.json#/items", "http://x.test/root.json#/properties/p/items"):
        assert want in ids


@pytest.mark.parametrize(("raw", "doc", "spec", "compat"), [
    ('{"type":["number","integer"]}', "1.5", True, False),
    ('{"exclusiveMaximum":3,"maximum":5}', "4", False, True),
    ('{"const":1,"enum":[2]}', "2", False, True),
    ('{"const":[1,2]}', "[1]", False, True),
    ('{"allOf":[{"properties":{"a":{}},"additionalProperties":false},{"properties":{"b":{}}}]}', '{"b":1}', False, True),
    ('{"required":["r"],"properties":{},"additionalProperties":false}', '{"r":1}', False, True),
])
def test_compat(spark, raw, doc, spec, compat):
    for mode, want in (("spec", spec), ("compat", compat)):
        if mode == "compat" and '"properties":{}' in raw:
            raw = raw.replace('"properties":{},', "")
        schema = compile_schema(raw, mode=mode)
        assert schema.is_valid(doc) == want
        assert verdicts(spark, schema, [doc])[0][0] == want


def test_reports(spark):
    schema = compile_schema('{"properties":{"a/b":{"items":[{"type":"null"},{"minimum":3}]},"c":{"maxLength":1}}}')
    df = spark.createDataFrame([('{"a/b":[1,2],"c":"xx"}',), ("{}",), ("?",)], "doc string")
    got = {(r.path, r.keyword, r.code) for r in report(df, schema, "doc").collect()}
    assert got == {("/a~1b/0", "type", 1), ("/a~1b/1", "minimum", 3), ("/c", "maxLength", 12), ("", "json", 32)}
    assert {r.error_code: r.documents for r in error_counts(df, schema, "doc").collect()} == {1: 1, 0: 1, 32: 1}


def test_deeply_nested_objects_stay_native():
    for keyword in ("items", "properties", "allOf"):
        raw = {"maximum": 1}
        for _ in range(12):
            raw = {"type": "object", "required": ["a"], "properties": {"a": raw}} if keyword == "properties" else {keyword: [raw] if keyword == "allOf" else raw}
        schema = compile_schema(json.dumps(raw))
        assert schema.tier == "native"
        assert all(len(schema.sql(what, "doc")) < 60_000 for what in ("valid", "error_code", "violations"))


def test_a_schema_too_large_for_one_expression_goes_to_the_other_tier(spark):
    raw = {"properties": {f"p{i}": {"items": {"type": "integer", "minimum": i}} for i in range(3000)}}
    schema = compile_schema(json.dumps(raw))
    assert schema.tier == "arrow"
    df = spark.createDataFrame([('{"p7":[9,3]}',)], "doc string")
    assert [(r.path, r.code) for r in report(df, schema, "doc").collect()] == [("/p7/1", 3)]


@pytest.mark.parametrize(("pattern", "good", "bad"), [
    ("^(a+)+$", ["a" * 40], ["a" * 5000 + "b"]),
    ("^(a|aa)*c$", ["aac"], ["a" * 20000]),
    ("^(x|\\u00e9|[^\\d])*$", ["xé" * 6000], ["x1"]),
    ("^([a-z]+ ?)*[.]\\S$", ["ab cd ef.x"], ["ab " * 3000 + "!"]),
])
def test_patterns_that_would_backtrack(spark, pattern, good, bad):
    schema = compile_schema(json.dumps({"items": {"pattern": pattern}}))
    assert schema.tier == "arrow"
    docs = [json.dumps([t]) for t in good + bad]
    assert verdicts(spark, schema, docs) == [(w, w, w) for w in [True] * len(good) + [False] * len(bad)]


def test_plain_patterns_stay_native():
    for p in ("^a\\d+$", "(foo|bar)", "^[A-Z]{2}-(\\d{3})+$", "(?=x)(a+)+", "a*b*c?"):
        assert compile_schema(json.dumps({"pattern": p})).tier == "native", p


@pytest.mark.parametrize(("text", "good"), [
    ("[[1],[1.0]]", False), ("[[1],[1e0]]", False), ("[[0.1],[0.1000000000000000055]]", False), ('[{"a":-0.0},{"a":0}]', False), ('["1",1,"c1"]', True),
    ('[{"a":1,"b":2},{"b":2,"a":1}]', False), ('[{"a":"x"},{"a":["x"]}]', True), ('["{}",{}]', True), ("[null,\"null\",false,\"false\"]", True), ("[12345678901234567890,12345678901234567891]", False)])
def test_deep_uniqueness_in_both_tiers(spark, text, good):
    native, arrow = (compile_schema('{"uniqueItems":true}', tier=t) for t in ("native", "arrow"))
    assert native.is_valid(text) == good
    assert verdicts(spark, native, [text]) == verdicts(spark, arrow, [text]) == [(good, good, good)]
