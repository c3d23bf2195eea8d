"""Compile a schema once on the driver and apply it to columns of JSON text."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.codes import CODES
from quern.operators.interpreter import Interpreter
from quern.plans.native import INEXACT, VIOLATION, Emitter, TooLarge, compares_texts, expression, is_native, layers
from quern.plans.schema import SchemaNode, parse_schema, reachable


#: Bytes up to which a text fits the JVM's readers: a VARIANT (at most 3.25 bytes for one of text) holds 128 MiB, a string 20,000,000 characters.
LARGE = 16_000_000


#: What ``explain`` can print: what was parsed, what it refers to, what is left of it, and the native expressions.
STAGES = ("schema", "ids", "refs", "metadata", "patterns", "tier", "simplified", "forms", "cost", "sql", "error_code", "violations")


class CompiledSchema:
    """A schema ready for use. ``tier`` is ``native`` (a JVM expression) or ``arrow`` (batches in Python workers)."""

    def __init__(self, text: str, base_uri: str, mode: str, tier: str | None):
        self.text, self.base_uri, self.mode = text, base_uri, mode
        self.root: SchemaNode = parse_schema(text, base_uri, mode)
        self.python = Interpreter(self.root)
        self._sql: dict[str, str] = {}
        self.by_text = compares_texts(self.root)
        native = is_native(self.root)
        if native:
            try:
                self._sql = {what: expression(self.root, "\0", what) for what in ("valid", "error_code", "violations")}
            except TooLarge:
                native = False
        if tier == "native" and not native:
            raise ValueError("this schema has no native form")
        self.tier = tier or ("native" if native else "arrow")

    def sql(self, what: str, column: str) -> str:
        """The native form of ``valid``, ``error_code`` or ``violations`` over the column name or SQL ``column``."""
        return self._sql[what].replace("\0", column)

    def _apply(self, what: str, doc: Column | str, large: bool) -> Column:
        doc = F.col(doc) if isinstance(doc, str) else doc
        if self.tier == "native":
            native = _bound(doc, lambda name: self.sql(what, name))
            if not large and not self.by_text:
                return native
            over = F.octet_length(doc) > LARGE if large else F.lit(False)
            over = over | doc.rlike(INEXACT) if self.by_text else over
            over = F.coalesce(over, F.lit(False))
            return F.when(over, self._arrow[what](F.when(over, doc))).otherwise(native)  # other rows send NULL to Python
        return self._arrow[what](doc)

    def valid(self, doc: Column | str, *, large: bool = False) -> Column:
        """Whether the document is valid; never NULL (a NULL document is malformed, so not valid).

        ``large``, here and below: documents of over ``LARGE`` bytes, which a VARIANT may not hold, go to the Arrow tier. So do
        documents with inexact numbers where ``uniqueItems`` compares arrays or objects; all others stay in the JVM.
        """
        return self._apply("valid", doc, large)

    def error_code(self, doc: Column | str, *, large: bool = False) -> Column:
        """0, or the code of the first check that fails, in keyword order."""
        return self._apply("error_code", doc, large)

    def violations(self, doc: Column | str, *, large: bool = False) -> Column:
        """All violations: array of struct(path, keyword, code)."""
        return self._apply("violations", doc, large)

    def over(self, df: DataFrame, doc: Column | str, **names: str) -> DataFrame:
        """``df`` with ``valid``, ``error_code`` or ``violations`` of ``doc`` as columns of the given names.

        In the native tier this runs as generated code; the columns of ``valid`` and its like hold the same, but are interpreted.
        """
        doc = F.col(doc) if isinstance(doc, str) else doc
        if self.tier != "native" or self.by_text:
            return df.withColumns({name: self._apply(what, doc, False) for what, name in names.items()})
        prefix = "_quern_" + "_" * max(map(len, df.columns), default=0)  # no column starts so
        projections, verdicts = layers(self.root, f"{prefix}text", list(names), prefix)
        out, made = df.withColumn(f"{prefix}text", F.when(F.spark_partition_id() >= 0, doc.cast("string"))), [f"{prefix}text"]
        for layer in projections:
            out = out.select("*", *(F.expr(sql).alias(name) for name, sql in layer.items()))
            made += layer
        return out.withColumns({name: F.expr(verdicts[what]) for what, name in names.items()}).drop(*made)

    @cached_property
    def _arrow(self) -> dict:
        python = self.python

        @F.pandas_udf("boolean")
        def valid(docs: pd.Series) -> pd.Series:
            return docs.map(lambda d: python.valid(d if isinstance(d, str) else None)).astype(bool)

        @F.pandas_udf("int")
        def error_code(docs: pd.Series) -> pd.Series:
            return docs.map(lambda d: next((c for _, _, c in python.check(d if isinstance(d, str) else None)), 0)).astype("int32")

        @F.pandas_udf(VIOLATION)
        def violations(docs: pd.Series) -> pd.Series:
            return docs.map(lambda d: [{"path": p, "keyword": k, "code": c} for p, k, c in python.check(d if isinstance(d, str) else None)])

        return {"valid": lambda d: F.coalesce(valid(d), F.lit(False)), "error_code": error_code, "violations": violations}

    def is_valid(self, doc: str | None) -> bool:
        """One document, on the driver."""
        return self.python.valid(doc)

    def ids(self) -> list[str]:
        """Every absolute identifier in the schema."""
        return sorted(i for n in reachable(self.root) for i in n.ids)

    def register(self, spark: SparkSession, name: str) -> None:
        """A SQL function ``name(doc)``."""
        if self.tier == "native" and not self.by_text:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(doc STRING) RETURNS BOOLEAN RETURN {self.sql('valid', 'doc')}")
        else:
            python = self.python

            @F.pandas_udf("boolean")
            def valid(docs: pd.Series) -> pd.Series:
                return docs.map(lambda d: python.valid(d if isinstance(d, str) else None)).astype(bool)

            spark.udf.register(name, valid)

    def explain(self, stage: str = "schema") -> str:
        """A printout of one of ``STAGES``."""
        if stage not in STAGES:
            raise ValueError(f"no such stage: {stage}")
        nodes = reachable(self.root)
        if stage == "schema":
            return repr(self.root)
        if stage == "ids":
            return "\n".join(self.ids())
        if stage == "refs":
            return "\n".join(f"{n.ref} -> {n.target.ids[0]}" for n in nodes if n.ref is not None)
        if stage == "metadata":
            return "\n".join(f"{n.ids[0]}: {n.metadata}" for n in nodes if n.metadata)
        if stage == "patterns":
            return "\n".join(f"{p} -> {r.pattern}" for p, r in self.python.regex.items())
        if stage == "tier":
            return self.tier + (", other tier for inexact numbers" if self.tier == "native" and self.by_text else "")
        if self.tier != "native":
            return "-- arrow tier"
        if stage == "simplified":  # subschemas that take every value make no check
            empty = Emitter().empty
            return "\n".join(f"{n.ids[0]}: {'true' if empty(n) else repr(n)}" for n in nodes if n.ids)
        if stage == "forms":  # what each value is bound as
            return "\n".join(f"{n.ids[0]}: {' '.join(sorted(need.forms)) or '-'} {need.names or ''}".rstrip() for n in nodes if n.ids for need in [Emitter().needs(n)])
        if stage == "cost":
            return "\n".join(f"{what}: {len(sql)} bytes of SQL, {sql.count(' -> ')} lambdas" for what, sql in self._sql.items())
        return self.sql({"sql": "valid"}.get(stage, stage), "doc")

    def __reduce__(self):  # noqa: ANN204
        return CompiledSchema, (self.text, self.base_uri, self.mode, self.tier)


def _bound(doc: Column, sql: Callable[[str], str]) -> Column:
    """SQL over any column: it becomes the only element of an array that a SQL lambda walks."""
    return F.call_function("transform", F.array(doc.cast("string")), F.expr(f"json_ -> {sql('json_')}"))[0]


def compile_schema(text: str, *, base_uri: str = "", mode: str = "spec", tier: str | None = None) -> CompiledSchema:
    """Compile JSON Schema (draft-06) text; raises SchemaError for a bad schema.

    ``mode``: ``spec`` for the specification, ``compat`` for documented deviations. ``tier`` forces one of the two tiers.
    """
    return CompiledSchema(text, base_uri, mode, tier)


def with_verdict(df: DataFrame, schema: CompiledSchema, doc: str, *, valid: str = "valid", error_code: str | None = None) -> DataFrame:
    return schema.over(df, doc, valid=valid, **({} if error_code is None else {"error_code": error_code}))


def report(df: DataFrame, schema: CompiledSchema, doc: str) -> DataFrame:
    """A row for each violation: the columns of ``df``, path, keyword, code."""
    found = "violation" + "_" * max(map(len, df.columns))
    return schema.over(df, doc, violations=found).withColumn(found, F.explode(found)).select(*(F.col(f"`{c}`") for c in df.columns), f"{found}.path", f"{found}.keyword", f"{found}.code")


def error_counts(df: DataFrame, schema: CompiledSchema, doc: str) -> DataFrame:
    """Documents by error code."""
    return schema.over(df.select(F.col(doc).alias("doc")), "doc", error_code="error_code").groupBy("error_code").agg(F.count("*").alias("documents"))


def valid_by_key(df: DataFrame, schemas: Mapping[str, CompiledSchema], key: str, doc: str, *, default: bool = False) -> Column:
    """The verdict of the schema that ``key`` names, without a join; ``default`` where no schema has that name."""
    out = None
    for name, schema in schemas.items():
        test = F.col(key) == name
        out = F.when(test, schema.valid(doc)) if out is None else out.when(test, schema.valid(doc))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


MALFORMED = CODES["JSON"]
