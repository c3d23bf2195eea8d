"""The registered validation queries, each with the plain SQL that must give the same rows."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.validate import STAGES, compile_schema, error_counts, report, valid_by_key
from quern.plans.schema import reachable
from quern.sources.documents import lines, rendered, scratch, whole_files
from quern.streaming import validate as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(name: str, table: str, key: str | list[str], doc: Callable[[], Column], schema: object, valid: str, *, mode: str = "spec") -> None:
    """A verdict for each row of a table. ``valid``: DuckDB predicate over the row."""
    keys, text = [key] if isinstance(key, str) else key, schema if isinstance(schema, str) else json.dumps(schema)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        compiled = compile_schema(text, mode=mode)
        return compiled.over(_table(spark, sf_dir, table), doc(), valid="valid").select(*keys, "valid")

    _add(name, run, f"SELECT {', '.join(keys)}, coalesce({valid}, false) AS valid FROM {table}")


def _orders(name: str, element: str, schema: object, valid: str, order: str | None = None) -> None:
    """A verdict for each order: the array of one column of its lines, sorted by value. ``valid``: DuckDB aggregate."""
    text = json.dumps(schema)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        compiled = compile_schema(text)
        by = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(element)).alias("a"))
        return compiled.over(by, F.to_json("a"), valid="valid").select("l_orderkey", "valid")

    _add(name, run, f"SELECT l_orderkey, {valid} AS valid FROM lineitem GROUP BY l_orderkey")


def _code(name: str, table: str, key: str | list[str], doc: Callable[[], Column], schema: object, code: str) -> None:
    """The error code of each row. ``code``: DuckDB CASE branches."""
    keys = [key] if isinstance(key, str) else key

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_schema(json.dumps(schema)).over(_table(spark, sf_dir, table), doc(), error_code="error_code").select(*keys, "error_code")

    _add(f"code_{name}", run, f"SELECT {', '.join(keys)}, (CASE {code} ELSE 0 END)::INT AS error_code FROM {table}")


def _order_code(name: str, element: str, schema: object, code: str) -> None:
    """As ``_code``, for the array of one column of each order's lines, sorted by value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(element)).alias("a"))
        return compile_schema(json.dumps(schema)).over(by, F.to_json("a"), error_code="error_code").select("l_orderkey", "error_code")

    _add(f"code_{name}", run, f"SELECT l_orderkey, (CASE {code} ELSE 0 END)::INT AS error_code FROM lineitem GROUP BY l_orderkey")


def _if(condition: str, then: str) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN {then} END")


# --- flagship ----------------------------------------------------------------------------------------------------------

CONVERSATION = {
    "type": "array", "minItems": 1,
    "items": {"type": "object", "required": ["role", "text"], "properties": {"role": {"enum": ["system", "user", "assistant"]}, "turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 20}}},
    "contains": {"properties": {"role": {"const": "assistant"}}, "required": ["role"]},
}


def conversation_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t"))
    docs = turns.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list("t"))).alias("doc"))
    return docs.select("conv_id", compile_schema(json.dumps(CONVERSATION)).valid("doc", large=True).alias("valid"))


_add("conversation_valid", conversation_valid, """
SELECT conv_id, coalesce(bool_and(role IN ('system', 'user', 'assistant') AND turn >= 0 AND text IS NOT NULL AND length(text) >= 20) AND bool_or(role = 'assistant'), false) AS valid
FROM conversations GROUP BY conv_id""")

# --- types, numbers, strings ---------------------------------------------------------------------------------------------

_rows("type_object", "events", "event_id", lambda: F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")), {"type": "object"}, "event_id % 3 <> 0")
_rows("type_integer", "part", "p_partkey", lambda: F.col("p_retailprice").cast("string"), {"type": "integer"}, "p_retailprice = floor(p_retailprice)")
_rows("type_union", "part", "p_partkey", lambda: F.when(F.col("p_size") % 2 == 1, F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"'))).otherwise(F.col("p_size").cast("string")), {"type": ["string", "null"]}, "p_size % 2 = 1")
for _name, _schema, _test in (("minimum", {"minimum": 10}, ">= 10"), ("exclusive_minimum", {"exclusiveMinimum": 10}, "> 10"), ("maximum", {"maximum": 40}, "<= 40"), ("exclusive_maximum", {"exclusiveMaximum": 40}, "< 40")):
    _rows(_name, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: F.col("l_quantity").cast("string"), _schema, f"l_quantity {_test}")
_rows("multiple_of", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: F.col("l_quantity").cast("string"), {"multipleOf": 5}, "l_quantity / 5 = floor(l_quantity / 5)")
_rows("min_length", "part", "p_partkey", lambda: F.to_json(F.array("p_name")), {"items": {"minLength": 10}}, "length(p_name) >= 10")
_rows("max_length", "part", "p_partkey", lambda: F.to_json(F.array("p_name")), {"items": {"maxLength": 10}}, "length(p_name) <= 10")
_rows("pattern", "customer", "c_custkey", lambda: F.to_json(F.array("c_mktsegment")), {"items": {"pattern": "^[AB]"}}, "regexp_matches(c_mktsegment, '^[AB]')")
_rows("enum", "orders", "o_orderkey", lambda: F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), {"enum": ["F", "O", 1, None, True]}, "o_orderstatus IN ('F', 'O')")
_rows("const", "orders", "o_orderkey", lambda: F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), {"const": "F"}, "o_orderstatus = 'F'")
_rows("const_object", "orders", "o_orderkey", lambda: rendered(F.col("o_orderstatus").alias("s"), F.array(F.lit(1.0), F.lit(2)).alias("l")), {"const": {"l": [1, 2.0], "s": "F"}}, "o_orderstatus = 'F'")

# --- objects -------------------------------------------------------------------------------------------------------------

_total = lambda: rendered(F.col("o_orderkey").alias("o_key"), _if("o_orderstatus = 'F'", "o_totalprice").alias("total"))
_rows("required", "orders", "o_orderkey", _total, {"required": ["total"]}, "o_orderstatus = 'F'")
_rows("properties", "events", "event_id", lambda: rendered("value", "event_type"), {"properties": {"value": {"minimum": 50}, "event_type": {"enum": ["click", "view", "purchase"]}}}, "(value IS NULL OR value >= 50) AND (event_type IS NULL OR event_type IN ('click', 'view', 'purchase'))")
_rows("pattern_properties", "customer", "c_custkey", lambda: rendered("c_custkey", "c_acctbal"), {"patternProperties": {"^c_acct": {"minimum": 0}}}, "c_acctbal >= 0")
_rows("additional_properties", "orders", "o_orderkey", _total, {"properties": {"o_key": {}}, "additionalProperties": False}, "o_orderstatus <> 'F'")
_rows("additional_properties_schema", "orders", "o_orderkey", _total, {"properties": {"o_key": {}}, "additionalProperties": {"minimum": 100000}}, "o_orderstatus <> 'F' OR o_totalprice >= 100000")
_rows("property_names", "orders", "o_orderkey", _total, {"propertyNames": {"pattern": "^o_"}}, "o_orderstatus <> 'F'")
_some = lambda: rendered(_if("l_returnflag = 'R'", "1").alias("a"), _if("l_linestatus = 'O'", "2").alias("b"), _if("l_quantity > 25", "3").alias("c"))
_count = "(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)"
_line = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"]
_rows("min_properties", "lineitem", _line, _some, {"minProperties": 2}, f"{_count} >= 2")
_rows("max_properties", "lineitem", _line, _some, {"maxProperties": 1}, f"{_count} <= 1")
_rows("dependencies_names", "lineitem", _line, _some, {"dependencies": {"a": ["b"]}}, "l_returnflag <> 'R' OR l_linestatus = 'O'")
_rows("dependencies_schema", "lineitem", _line, _some, {"dependencies": {"a": {"required": ["c"]}}}, "l_returnflag <> 'R' OR l_quantity > 25")

# --- arrays --------------------------------------------------------------------------------------------------------------

_orders("items_single", "l_quantity", {"items": {"maximum": 45}}, "bool_and(l_quantity <= 45)")
_orders("items_positional", "l_quantity", {"items": [{"maximum": 20}, {"maximum": 30}]}, "min(l_quantity) <= 20 AND (count(*) < 2 OR list_sort(list(l_quantity))[2] <= 30)")
_orders("additional_items", "l_quantity", {"items": [{}], "additionalItems": {"maximum": 45}}, "count(*) = 1 OR max(l_quantity) <= 45")
_orders("min_items", "l_quantity", {"minItems": 3}, "count(*) >= 3")
_orders("max_items", "l_quantity", {"maxItems": 4}, "count(*) <= 4")
_orders("unique_items", "l_suppkey", {"uniqueItems": True, "items": {"type": "number"}}, "count(DISTINCT l_suppkey) = count(*)")
_orders("unique_items_deep", "l_suppkey", {"uniqueItems": True}, "count(DISTINCT l_suppkey) = count(*)")
_orders("contains", "l_returnflag", {"contains": {"const": "R"}}, "bool_or(l_returnflag = 'R')")

# --- combinators ---------------------------------------------------------------------------------------------------------

_pair = lambda: rendered(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
_q = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
_big, _cheap = {"properties": {"q": {"minimum": 25}}}, {"properties": {"d": {"minimum": 0.05}}}
_rows("all_of", "lineitem", _q, _pair, {"allOf": [_big, _cheap]}, "l_quantity >= 25 AND l_discount >= 0.05::DOUBLE")
_rows("any_of", "lineitem", _q, _pair, {"anyOf": [_big, _cheap]}, "l_quantity >= 25 OR l_discount >= 0.05::DOUBLE")
_rows("one_of", "lineitem", _q, _pair, {"oneOf": [_big, _cheap]}, "(l_quantity >= 25) <> (l_discount >= 0.05::DOUBLE)")
_rows("not", "lineitem", _q, _pair, {"not": _big}, "NOT l_quantity >= 25")
_rows("number_one_of", "lineitem", _q, lambda: F.col("l_quantity").cast("string"), {"oneOf": [{"minimum": 10}, {"multipleOf": 2}, {"maximum": 30}]}, "(l_quantity >= 10)::INT + (l_quantity / 2 = floor(l_quantity / 2))::INT + (l_quantity <= 30)::INT = 1")

# --- references, constants, reports ----------------------------------------------------------------------------------------

_rows("ref_definitions", "customer", "c_custkey", lambda: rendered(F.col("c_acctbal").alias("bal")), {"definitions": {"positive": {"exclusiveMinimum": 0}}, "properties": {"bal": {"$ref": "#/definitions/positive"}}}, "c_acctbal > 0")
_rows("ref_by_id", "customer", "c_custkey", lambda: rendered(F.col("c_acctbal").alias("bal")), {"$id": "http://example.test/root.json", "definitions": {"x": {"$id": "other.json", "maximum": 5000}}, "properties": {"bal": {"$ref": "other.json"}}}, "c_acctbal <= 5000")
TREE = {"properties": {"name": {"maxLength": 12}, "children": {"items": {"$ref": "#"}}}}


def ref_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("children"))
    tree = _table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return tree.select("r_regionkey", compile_schema(json.dumps(TREE)).valid(rendered(F.col("r_name").alias("name"), "children")).alias("valid"))


_add("ref_recursive", ref_recursive, "SELECT r_regionkey, any_value(length(r_name) <= 12) AND bool_and(length(n_name) <= 12) AS valid FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
_rows("boolean_schema", "nation", "n_nationkey", lambda: F.to_json(F.array("n_name")), False, "false")
_rows("true_schema", "nation", "n_nationkey", lambda: F.to_json(F.array("n_name")), True, "true")
_rows("malformed_json", "documents", "doc_id", lambda: F.col("text"), True, "json_valid(text)")
_rows("trailing_content", "events", "event_id", lambda: F.concat("props", F.when(F.col("event_id") % 4 == 0, F.lit(" {}")).when(F.col("event_id") % 4 == 1, F.lit(" ")).otherwise(F.lit(""))), {}, "event_id % 4 <> 0")
EVENT = {"type": "object", "properties": {"event_type": {"type": "string", "minLength": 5}, "value": {"maximum": 50}}}


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "events").select(rendered("event_type", "value").alias("doc"))
    return error_counts(docs, compile_schema(json.dumps(EVENT)), "doc")


_add("error_report", error_report, "SELECT (CASE WHEN length(event_type) < 5 THEN 11 WHEN value > 50 THEN 3 ELSE 0 END)::INT AS error_code, count(*) AS documents FROM events GROUP BY 1")


def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "events").select("event_id", rendered("event_type", "value").alias("doc"))
    return report(docs, compile_schema(json.dumps(EVENT)), "doc").drop("doc")


_add("violation_report", violation_report, "SELECT event_id, '/event_type' AS path, 'minLength' AS keyword, 11::INT AS code FROM events WHERE length(event_type) < 5 UNION ALL SELECT event_id, '/value', 'maximum', 3::INT FROM events WHERE value > 50")
BY_TYPE = {"click": {"properties": {"k": {"maximum": 50}}}, "view": {"properties": {"k": {"minimum": 50}}}, "purchase": {"properties": {"k": {"multipleOf": 2}}}}


def schema_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = {k: compile_schema(json.dumps(s)) for k, s in BY_TYPE.items()}
    return _table(spark, sf_dir, "events").select("event_id", valid_by_key(_table(spark, sf_dir, "events"), schemas, "event_type", "props", default=True).alias("valid"))


_add("schema_join", schema_join, """SELECT event_id, CASE event_type WHEN 'click' THEN (props::JSON ->> 'k')::INT <= 50 WHEN 'view' THEN (props::JSON ->> 'k')::INT >= 50 WHEN 'purchase' THEN (props::JSON ->> 'k')::INT % 2 = 0 ELSE true END AS valid FROM events""")


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    compile_schema('{"properties": {"k": {"maximum": 50}}}').register(spark, "quern_small_k")
    return _table(spark, sf_dir, "events").select("event_id", F.expr("quern_small_k(props)").alias("valid"))


_add("sql_function", sql_function, "SELECT event_id, (props::JSON ->> 'k')::INT <= 50 AS valid FROM events")

# --- error codes -----------------------------------------------------------------------------------------------------------

_quoted = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
_code("unexpected_token", "part", "p_partkey", lambda: F.when(F.col("p_size") % 2 == 1, _quoted("p_brand")).otherwise(F.col("p_size").cast("string")), {"type": "number"}, "WHEN p_size % 2 = 1 THEN 1")
_code("not_integer", "part", "p_partkey", lambda: F.when(F.col("p_size") % 5 == 0, F.lit("null")).otherwise(F.col("p_retailprice").cast("string")), {"type": "integer"}, "WHEN p_size % 5 = 0 THEN 1 WHEN p_retailprice <> floor(p_retailprice) THEN 2")
_code("number", "orders", "o_orderkey", lambda: rendered(F.struct(F.col("o_totalprice").alias("price")).alias("order")), {"properties": {"order": {"properties": {"price": {"exclusiveMaximum": 150000}}}}}, "WHEN o_totalprice >= 150000 THEN 3")
_code("properties_count", "lineitem", _line, _some, {"minProperties": 1, "maxProperties": 2}, f"WHEN {_count} < 1 THEN 4 WHEN {_count} > 2 THEN 5")
_code("required", "orders", "o_orderkey", _total, {"required": ["o_key", "total"]}, "WHEN o_orderstatus <> 'F' THEN 6")
_code("split_condition", "lineitem", _q, _pair, {"anyOf": [_big, _cheap], "not": {"allOf": [_big, _cheap]}}, "WHEN (l_quantity >= 25) = (l_discount >= 0.05::DOUBLE) THEN 7")
_code("property_name", "orders", "o_orderkey", _total, {"properties": {"o_key": {}}, "additionalProperties": False}, "WHEN o_orderstatus = 'F' THEN 8")
_code("property_names", "orders", "o_orderkey", _total, {"propertyNames": {"maxLength": 4}}, "WHEN true THEN 8")
_code("string", "customer", "c_custkey", lambda: rendered("c_mktsegment"), {"patternProperties": {"^c_": {"pattern": "^[AB]"}}}, "WHEN NOT regexp_matches(c_mktsegment, '^[AB]') THEN 10")
_code("constant", "orders", "o_orderkey", lambda: F.when(F.col("o_orderkey") % 3 == 0, F.lit("[]")).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string")).otherwise(_quoted("o_orderstatus")), {"enum": ["F", 7]}, "WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 AND o_custkey <> 7 THEN 3 WHEN o_orderkey % 3 = 2 AND o_orderstatus <> 'F' THEN 10")
_code("length", "part", "p_partkey", lambda: rendered("p_name"), {"additionalProperties": {"minLength": 9, "maxLength": 11}}, "WHEN length(p_name) < 9 THEN 11 WHEN length(p_name) > 11 THEN 12")
_order_code("array", "l_quantity", {"items": [{"maximum": 20}, {}], "additionalItems": False}, "WHEN min(l_quantity) > 20 THEN 3 WHEN count(*) > 2 THEN 13")
_order_code("items_count", "l_quantity", {"minItems": 2, "maxItems": 4}, "WHEN count(*) < 2 THEN 14 WHEN count(*) > 4 THEN 15")
_order_code("contains", "l_returnflag", {"contains": {"const": "R"}}, "WHEN NOT bool_or(l_returnflag = 'R') THEN 16")
_code("not_multiple", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: F.col("l_quantity").cast("string"), {"multipleOf": 2.5}, "WHEN l_quantity / 2.5 <> floor(l_quantity / 2.5) THEN 17")
_order_code("not_unique", "l_suppkey", {"uniqueItems": True, "items": {"type": "number"}}, "WHEN count(DISTINCT l_suppkey) < count(*) THEN 18")
_code("json", "events", "event_id", lambda: F.concat("props", F.when(F.col("event_id") % 4 == 0, F.lit(",")).when(F.col("event_id") % 4 == 1, F.lit("\n")).otherwise(F.lit(""))), {}, "WHEN event_id % 4 = 0 THEN 32")

# --- shapes that nest ------------------------------------------------------------------------------------------------------

_orders("per_item_split", "l_quantity", {"contains": {"minimum": 40}, "items": {"type": "number", "maximum": 49}, "uniqueItems": True, "minItems": 2}, "bool_or(l_quantity >= 40) AND max(l_quantity) <= 49 AND count(DISTINCT l_quantity) = count(*) AND count(*) >= 2")
_orders("contains_positional", "l_quantity", {"items": [{"maximum": 10}], "additionalItems": {"minimum": 5}, "contains": {"anyOf": [{"multipleOf": 7}, {"minimum": 48}]}}, "min(l_quantity) <= 10 AND (count(*) < 2 OR list_sort(list(l_quantity))[2] >= 5) AND bool_or(l_quantity / 7 = floor(l_quantity / 7) OR l_quantity >= 48)")
_orders("not_contains", "l_returnflag", {"not": {"contains": {"not": {"enum": ["A", "N"]}}}}, "NOT bool_or(l_returnflag = 'R')")
_rows("bit_vector_split", "lineitem", _q, _pair, {"anyOf": [{"allOf": [_big, {"not": _cheap}]}, {"oneOf": [_cheap, {"properties": {"q": {"multipleOf": 3}}}]}]}, "(l_quantity >= 25 AND NOT l_discount >= 0.05::DOUBLE) OR ((l_discount >= 0.05::DOUBLE) <> (l_quantity / 3 = floor(l_quantity / 3)))")
_rows("required_next_to_one_of", "orders", "o_orderkey", _total, {"required": ["o_key"], "oneOf": [{"required": ["total"]}, {"properties": {"o_key": {"maximum": 500}}}]}, "(o_orderstatus = 'F') <> (o_orderkey <= 500)")
_rows("all_of_tuples", "orders", "o_orderkey", lambda: F.to_json(F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"))), {"allOf": [{"items": [{"minimum": 50000}]}, {"items": [{}, {"maximum": 1000}]}, {"maxItems": 2}]}, "o_totalprice >= 50000 AND o_custkey <= 1000")
_rows("nested_objects", "orders", "o_orderkey", lambda: F.to_json(F.struct(F.struct(F.struct(F.struct(F.col("o_totalprice").alias("d")).alias("c")).alias("b")).alias("a"))), {"required": ["a"], "properties": {"a": {"type": "object", "required": ["b"], "properties": {"b": {"type": "object", "required": ["c"], "properties": {"c": {"type": "object", "required": ["d"], "properties": {"d": {"type": "number", "maximum": 200000}}}}}}}}}, "o_totalprice <= 200000")
_rows("length_in_code_points", "part", "p_partkey", lambda: F.to_json(F.array(F.concat("p_name", F.lit("\u00e9\U0001f600")))), {"items": {"minLength": 12, "maxLength": 14}}, "length(p_name) + 2 BETWEEN 12 AND 14")


def unique_items_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements are objects and arrays; key order and the spelling of numbers don't count."""
    item = F.when(F.col("l_linenumber") % 2 == 0, F.format_string('{"s":%d,"l":[%d.0]}', F.expr("l_suppkey % 7"), F.expr("l_partkey % 2"))).otherwise(F.format_string('{"l":[%d],"s":%d}', F.expr("l_partkey % 2"), F.expr("l_suppkey % 7")))
    by = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.sort_array(F.collect_list(item))).alias("a"))
    return by.select("l_orderkey", compile_schema('{"uniqueItems": true}').valid(F.concat(F.lit("["), "a", F.lit("]"))).alias("valid"))


_add("unique_items_objects", unique_items_objects, "SELECT l_orderkey, count(DISTINCT (l_suppkey % 7) * 2 + l_partkey % 2) = count(*) AS valid FROM lineitem GROUP BY l_orderkey")

# --- keywords that make no check, identifiers ------------------------------------------------------------------------------

_rows("metadata_keywords", "customer", "c_custkey", lambda: rendered("c_acctbal"), {"$schema": "http://json-schema.org/draft-06/schema#", "title": "customer", "description": "by balance", "examples": [{"c_acctbal": "any"}], "default": {"c_acctbal": -1}, "properties": {"c_acctbal": {"title": "balance", "default": None, "minimum": 100}}}, "c_acctbal >= 100")
_rows("unknown_keywords", "customer", "c_custkey", lambda: rendered("c_acctbal"), {"format": "email", "if": {"required": ["none"]}, "x~y/z": {"maximum": 2500}, "properties": {"c_acctbal": {"$ref": "#/x~0y~1z"}}}, "c_acctbal <= 2500")
_rows("ref_ignores_siblings", "customer", "c_custkey", lambda: rendered("c_acctbal"), {"properties": {"c_acctbal": {"$ref": "#/definitions/n", "maximum": 0}}, "definitions": {"n": {"type": "number"}}}, "true")
_rows("id_alias", "customer", "c_custkey", lambda: rendered("c_acctbal"), {"id": "http://example.test/dir/root.json", "definitions": {"x": {"id": "sub/leaf.json", "definitions": {"y": {"id": "#spot", "minimum": 0}}}}, "properties": {"c_acctbal": {"$ref": "sub/leaf.json#spot"}}}, "c_acctbal >= 0")

# --- documented deviations ---------------------------------------------------------------------------------------------------

_rows("compat_number_integer", "part", "p_partkey", lambda: F.col("p_retailprice").cast("string"), {"type": ["number", "integer"]}, "p_retailprice = floor(p_retailprice)", mode="compat")
_rows("compat_last_bound", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], lambda: F.col("l_quantity").cast("string"), {"exclusiveMaximum": 20, "maximum": 40}, "l_quantity <= 40", mode="compat")
_rows("compat_const_or_enum", "orders", "o_orderkey", lambda: _quoted("o_orderstatus"), {"const": "F", "enum": ["O"]}, "o_orderstatus IN ('F', 'O')", mode="compat")
_rows("compat_array_prefix", "orders", "o_orderkey", lambda: F.to_json(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array() WHEN o_orderkey % 3 = 1 THEN array(o_orderstatus) ELSE array(o_orderstatus, 'x', 'y') END")), {"const": ["F", "x"]}, "o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderstatus = 'F')", mode="compat")
_rows("compat_shared_names", "orders", "o_orderkey", _total, {"allOf": [{"properties": {"o_key": {}}, "additionalProperties": False}, {"properties": {"total": {"minimum": 100000}}}]}, "o_orderstatus <> 'F' OR o_totalprice >= 100000", mode="compat")
_rows("compat_required_names", "orders", "o_orderkey", _total, {"required": ["total"], "properties": {"o_key": {}}, "additionalProperties": False}, "o_orderstatus = 'F'", mode="compat")
_rows("compat_empty_schemas", "orders", "o_orderkey", _total, {"properties": {"o_key": [], "total": 3}, "patternProperties": {"z": None, "y": "text"}, "required": ["total"]}, "o_orderstatus = 'F'", mode="compat")

# --- sources, streams, compiled schemas as values, printouts -----------------------------------------------------------------

PRICED = '{"required": ["key"], "properties": {"price": {"maximum": 150000}}}'


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON Lines and read back as documents."""
    path = scratch(spark)
    _table(spark, sf_dir, "orders").select(rendered(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))).write.text(path)
    docs = lines(spark, path)
    return docs.select(F.get_json_object("doc", "$.key").cast("long").alias("o_orderkey"), compile_schema(PRICED).valid("doc").alias("valid"))


_add("json_lines", json_lines, "SELECT o_orderkey, o_totalprice <= 150000 AS valid FROM orders")


def whole_file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, in a folder of its own, each one document over several lines."""
    path = scratch(spark)
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"name":\n'), F.get_json_object(F.to_json(F.struct(F.to_json(F.array("n_name")).alias("n"))), "$.n"), F.lit("\n}")).alias("doc"))
    nations.write.partitionBy("n_nationkey").text(path)
    files = whole_files(spark, f"{path}/*")
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), compile_schema('{"properties": {"name": {"items": {"maxLength": 7}}}}').valid("doc").alias("valid"))


_add("whole_file_documents", whole_file_documents, "SELECT n_nationkey, length(n_name) <= 7 AS valid FROM nation")


def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, validated in micro-batches and committed to Parquet."""
    path = scratch(spark)
    stream = streaming.files(spark, f"{sf_dir}/events.parquet")
    streaming.write(streaming.validated(stream, compile_schema(json.dumps(BY_TYPE["click"])), "props"), f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "valid", "error_code")


_add("stream_verdicts", stream_verdicts, "SELECT event_id, (props::JSON ->> 'k')::INT <= 50 AS valid, (CASE WHEN (props::JSON ->> 'k')::INT > 50 THEN 3 ELSE 0 END)::INT AS error_code FROM events")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by hour and error code of the same stream; windows that the watermark has closed, so the last ones are open."""
    path = scratch(spark)
    counts = streaming.verdicts_by_window(streaming.files(spark, f"{sf_dir}/events.parquet"), compile_schema(json.dumps(BY_TYPE["click"])), "props", "ts", late="0 seconds")
    streaming.write(counts, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_timestamp("start").alias("start"), "error_code", "documents")


_add("stream_counts", stream_counts, """
SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, (CASE WHEN (props::JSON ->> 'k')::INT > 50 THEN 3 ELSE 0 END)::INT AS error_code, count(*) AS documents
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) GROUP BY ALL""")


def saved_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled schema saved and loaded, as executors and jobs pass it on."""
    loaded = pickle.loads(pickle.dumps(compile_schema(PRICED)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", loaded.valid(rendered(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))).alias("valid"))


_add("saved_schema", saved_schema, "SELECT o_orderkey, o_totalprice <= 150000 AS valid FROM orders")
OUTLINE = '{"$id": "http://example.test/a.json", "type": "array", "items": {"$id": "b.json", "properties": {"n": {"$ref": "#/properties/m"}, "m": {"title": "last", "type": "null"}}}}'


def schema_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every absolute identifier of a schema, with the text printout of its subschema."""
    root = compile_schema(OUTLINE).root
    return spark.createDataFrame([(i, repr(n)[:20]) for n in reachable(root) for i in n.ids if i.startswith("http")], "id string, node string")


_add("schema_outline", schema_outline, """
SELECT * FROM (VALUES ('http://example.test/a.json#', 'SchemaNode(types=fro'), ('http://example.test/a.json#/items', 'SchemaNode(propertie'), ('http://example.test/b.json#', 'SchemaNode(propertie'),
  ('http://example.test/a.json#/items/properties/n', 'SchemaNode(ref=''http'), ('http://example.test/b.json#/properties/n', 'SchemaNode(ref=''http'),
  ('http://example.test/a.json#/items/properties/m', 'SchemaNode(types=fro'), ('http://example.test/b.json#/properties/m', 'SchemaNode(types=fro')) t(id, node)""")


def stage_printouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of a compiled schema print something."""
    schema = compile_schema(OUTLINE)
    return spark.createDataFrame([(stage, bool(schema.explain(stage))) for stage in STAGES], "stage string, printed boolean")


_add("stage_printouts", stage_printouts, "SELECT unnest(['schema', 'ids', 'refs', 'metadata', 'patterns', 'tier', 'simplified', 'forms', 'cost', 'sql', 'error_code', 'violations']) AS stage, stage <> 'patterns' AS printed")
