"""The native tier: a schema as one SQL expression over a document's VARIANT, evaluated in the JVM.

A value is bound once, as a struct of what the schema looks at: the members it names (``o``, one typed extraction), all entries
(``m``) where it must see every name, elements (``a``), the number (``d``), the string (``s``) and the type's name (``t``). Each
of these is NULL for values of other types. Every check is never NULL, so negation and counting are safe.

There are two renderings. ``expression`` is one SQL expression, in which a value is bound by a lambda, and so can be used
wherever a column can. ``layers`` is a stack of projections in which values that lie at fixed places are columns; it needs the
DataFrame, but runs as generated code, while lambdas are interpreted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from quern.functions import json_sql as J
from quern.functions.codes import CODES
from quern.functions.regex import linear, to_java
from quern.plans.schema import SchemaNode, escape, is_recursive, reachable

SCALARS = frozenset({"string", "number", "integer", "boolean", "null"})
#: Emitted checks beyond which the Arrow tier is the better plan.
BUDGET = 4_000
VIOLATION = "array<struct<path:string,keyword:string,code:int>>"
NONE = f"CAST(array() AS {VIOLATION})"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_ .$@:/~-]*")


class TooLarge(ValueError):
    """The expression would be larger than the budget."""


@dataclass
class Check:
    """One keyword of one value: the condition, and where failing parts have places of their own, code and violations."""

    keyword: str
    code: int
    ok: str
    kind: str | None = None  # the type that the keyword is for
    bare: str = ""  # the condition of values of that type
    inner_code: Callable[[], str] | None = None
    inner: Callable[[str], str] | None = None


@dataclass(frozen=True)
class Place:
    """Where a value is: a path below a VARIANT that is cheap to name."""

    base: str
    path: str = "$"
    layer: int | None = None  # in which projection the base is a column; None inside lambdas

    def get(self, kind: str) -> str:
        return self.base if kind == "variant" and self.path == "$" else f"try_variant_get({self.base}, '{self.path}', {J.text(kind)})"


@dataclass
class Needs:
    """The forms in which a schema looks at a value, itself or in its branches on the same value."""

    names: list[str] = field(default_factory=list)
    forms: set[str] = field(default_factory=set)


@dataclass(frozen=True)
class Bound:
    """A value that was bound to ``name`` in these forms."""

    name: str
    forms: frozenset[str]
    layer: int | None = None

    def of(self, form: str) -> str:
        return f"{self.name}{'.' if self.layer is None else '_'}{form}"

    def is_(self, kind: str) -> str:
        if kind == "object" and self.forms & {"o", "m"}:
            return f"{self.of('o' if 'o' in self.forms else 'm')} IS NOT NULL"
        if kind == "array" and "a" in self.forms:
            return f"{self.of('a')} IS NOT NULL"
        return J.is_kind(self.of("t"), kind)

    def has(self, key: str) -> str:
        return f"map_contains_key({self.of('m')}, {J.text(key)})" if "m" in self.forms else f"{self.of('o')}.{J.field(key)} IS NOT NULL"

    def at(self, key: str) -> Place:
        return self.place(f"{self.of('m')}[{J.text(key)}]" if "m" in self.forms else f"{self.of('o')}.{J.field(key)}")

    def place(self, base: str) -> Place:
        """A place that ``base``, over this value's forms, names."""
        return Place(base, layer=self.layer)


def _scalar_items(n: SchemaNode) -> bool:
    items = n.items
    while items is not None and items.ref is not None:
        items = items.target
    if items is None:
        return False
    constants = (items.const or []) + (items.values or [])
    return items.types is not None and items.types <= SCALARS or bool(constants) and not any(isinstance(c, (list, dict)) for c in constants)


def is_native(root: SchemaNode) -> bool:
    """Whether every keyword can be expressed: recursion can't, and patterns that Java might match for ever aren't."""
    return not is_recursive(root) and not any(linear(p) for n in reachable(root) for p in [n.pattern, *n.patterns, *n.known[1]] if p is not None)


#: Texts in which numbers that are equal as doubles may have different canonical texts: exponents, and more than 15 digits.
INEXACT = "[0-9][eE]|[0-9.]{16}"


def compares_texts(root: SchemaNode) -> bool:
    """Whether containers are compared by canonical text, so that documents matching ``INEXACT`` need the other tier."""
    return any(n.unique and not _scalar_items(n) for n in reachable(root))


class Emitter:
    def __init__(self, prefix: str = "") -> None:
        self.serial, self.spent, self.prefix = count(), 0, prefix
        self._empty: dict[int, bool] = {}
        self.layers: list[dict[str, str]] = []
        self._bound: dict[tuple[Place, int], tuple[SchemaNode | None, Bound]] = {}

    # --- simplification ----------------------------------------------------------------------------------------------

    def empty(self, n: SchemaNode | None) -> bool:
        """Whether a schema takes every value, as far as its keywords show; looked up once for each node."""
        if n is None:
            return True
        known = self._empty.get(id(n))
        if known is None:
            known = self._empty[id(n)] = self._takes_all(n)
        return known

    def _takes_all(self, n: SchemaNode) -> bool:
        if n.ref is not None:
            return self.empty(n.target)
        if n.always is not None:
            return n.always
        limits = (n.types, n.values, n.const, n.multiple_of, n.maximum, n.exclusive_maximum, n.minimum, n.exclusive_minimum, n.max_length, n.min_length, n.pattern, n.max_items, n.min_items, n.contains, n.max_properties, n.min_properties, n.negated)
        if any(x is not None for x in limits) or n.unique or n.required or any(n.need.values()) or n.one_of:
            return False
        if n.any_of and not any(map(self.empty, n.any_of)):
            return False
        tail = [] if n.tuple_items is None else [*n.tuple_items, n.additional_items]
        return all(map(self.empty, [*([n.items] if n.tuple_items is None else []), *tail, n.names, n.additional, *n.properties.values(), *n.patterns.values(), *n.need_schema.values(), *n.all_of]))

    def needs(self, n: SchemaNode | None) -> Needs:
        out, names, todo, seen = Needs(), {}, [n] if n else [], set()
        while todo:
            s = todo.pop()
            if id(s) in seen or s.ref is None and s.always is not None:
                continue
            seen.add(id(s))
            if s.ref is not None:
                todo.append(s.target)
                continue
            constants = [*(s.const or []), *(s.values or [])]
            types = s.types or frozenset()
            mine = [*(k for k, c in s.properties.items() if not self.empty(c)), *(s.required or ()), *(k for k, v in s.need.items() if v for k in (k, *v)), *(k for k, c in s.need_schema.items() if not self.empty(c))]
            names |= dict.fromkeys(mine)
            if mine or "object" in types:
                out.forms.add("o")
            if s.max_properties is not None or s.min_properties is not None or any(isinstance(c, dict) for c in constants) or not self.empty(s.names) or not self.empty(s.additional) or not all(map(self.empty, s.patterns.values())):
                out.forms.add("m")
            if "array" in types or s.unique or s.contains is not None or s.max_items is not None or s.min_items is not None or s.items is not None or s.tuple_items is not None or any(isinstance(c, list) for c in constants):
                out.forms.add("a")
            numeric = [s.multiple_of, s.maximum, s.exclusive_maximum, s.minimum, s.exclusive_minimum]
            if any(x is not None for x in numeric) or "integer" in types or any(isinstance(c, (int, float)) for c in constants):
                out.forms |= {"d", "t"}
            if s.max_length is not None or s.min_length is not None or s.pattern is not None or any(isinstance(c, str) for c in constants):
                out.forms |= {"s", "t"}
            if types & SCALARS or constants:
                out.forms.add("t")
            if any(isinstance(c, bool) for c in constants):
                out.forms.add("b")
            todo += [*s.all_of, *s.any_of, *s.one_of, *s.need_schema.values(), *([s.negated] if s.negated is not None else [])]
        out.names = list(names)
        if "m" in out.forms or len({k.lower() for k in names}) < len(names) or not all(_NAME.fullmatch(k) for k in names):
            out.forms = out.forms - {"o"} | ({"m"} if out.forms & {"o", "m"} else set())
        return out

    # --- values ------------------------------------------------------------------------------------------------------

    def bind(self, place: Place, n: SchemaNode | None, body: Callable[[Bound], str]) -> str:
        """``body`` over the value at ``place``, bound in the forms that schema ``n`` needs."""
        need = self.needs(n)
        if not need.forms:  # nothing but branches that take all or nothing
            return body(Bound("none", frozenset()))
        if place.layer is not None:
            return body(self._columns(place, n, need))
        if not re.fullmatch(r"[\w.`]+", place.base):  # evaluated once
            w = f"w{next(self.serial)}"
            return J.let(place.base, w, self.bind(Place(w, place.path), n, body))
        x = f"x{next(self.serial)}"
        kinds = _kinds(need)
        forms = [f for f in kinds if f in need.forms]
        parts = [f"{place.get(kinds[f])} AS {f}" for f in forms]
        holders = [f for f in "oma" if f in need.forms]
        known = Bound(x, frozenset(need.forms))
        if "t" not in need.forms:
            return J.let(f"struct({', '.join(parts)})", x, body(known))
        tag = J.tag(place.get("variant"))
        if not holders:
            return J.let(f"struct({', '.join([*parts, f'{tag} AS t'])})", x, body(known))
        # the type's name of a container says all that is in it, so it isn't asked for where the container is known
        y = f"y{next(self.serial)}"
        typed = f"CASE WHEN {' AND '.join(f'{y}.{f} IS NULL' for f in holders)} THEN {tag} ELSE '' END"
        return J.let(f"struct({', '.join(parts)})", y, J.let(f"struct({', '.join([*(f'{y}.{f} AS {f}' for f in forms), f'{typed} AS t'])})", x, body(known)))

    def _columns(self, place: Place, n: SchemaNode | None, need: Needs) -> Bound:
        """The value at ``place`` as columns, one for each form; the same columns wherever it is asked for again."""
        key = (place, id(n))
        if key not in self._bound:
            x, at, kinds = f"{self.prefix}x{next(self.serial)}", place.layer, _kinds(need)
            if not re.fullmatch(r"[\w.`]+", place.base):
                self._column(f"{x}_v", place.base, at + 1)
                place, at = Place(f"{x}_v", place.path), at + 1
            for f in kinds:
                if f in need.forms:
                    self._column(f"{x}_{f}", place.get(kinds[f]), at + 1)
            holders, last = [f for f in "oma" if f in need.forms], at + 1
            if "t" in need.forms:
                tag, last = J.tag(place.get("variant")), at + 1 + bool(holders)
                known = " AND ".join(f"{x}_{f} IS NULL" for f in holders)
                self._column(f"{x}_t", f"CASE WHEN {known} THEN {tag} ELSE '' END" if holders else tag, last)
            self._bound[key] = (n, Bound(x, frozenset(need.forms), last))  # n is held so that no other gets its id
        return self._bound[key][1]

    def _column(self, name: str, sql: str, layer: int) -> None:
        while len(self.layers) <= layer:
            self.layers.append({})
        self.layers[layer][name] = sql

    # --- verdicts ----------------------------------------------------------------------------------------------------

    def ok(self, n: SchemaNode, x: Bound) -> str:
        """Whether the bound value ``x`` is valid."""
        tests, by_kind = [], {}
        for c in self.checks(n, x):
            if c.kind:
                by_kind.setdefault(c.kind, []).append(c.bare)
            else:
                tests.append(c.ok)
        while n.ref is not None:
            n = n.target
        for kind, bare in by_kind.items():  # a type is asked for once, and not at all where no other may come
            sure = n.types is not None and n.types <= ({"number", "integer"} if kind == "number" else {kind})
            tests += bare if sure else [f"(NOT ({x.is_(kind)}) OR ({' AND '.join(bare)}))"]
        return f"({' AND '.join(tests)})" if tests else "true"

    def child(self, n: SchemaNode, place: Place) -> str:
        return "true" if self.empty(n) else self.bind(place, n, lambda x: self.ok(n, x))

    def code(self, n: SchemaNode, x: Bound) -> str:
        """The code of the first violation, 0 if there is none."""
        cases = " ".join(f"WHEN NOT {c.ok} THEN {c.inner_code() if c.inner_code else c.code}" for c in self.checks(n, x))
        return f"CASE {cases} ELSE 0 END" if cases else "0"

    def violations(self, n: SchemaNode, x: Bound, path: str) -> str:
        """All violations of the bound value at SQL string ``path``."""
        parts = []
        for c in self.checks(n, x):
            found = c.inner(path) if c.inner else _one(path, c.keyword, str(c.code))
            parts.append(f"IF({c.ok}, {NONE}, {found})")
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else NONE

    # --- keywords ----------------------------------------------------------------------------------------------------

    def checks(self, n: SchemaNode, x: Bound) -> list[Check]:
        while n.ref is not None:
            n = n.target
        self.spent += 1
        if self.spent > BUDGET:
            raise TooLarge
        if self.empty(n):
            return []
        if n.always is not None:
            return [Check("false", CODES["UNEXPECTED_TOKEN"], "false")]
        out: list[Check] = []

        def add(keyword: str, code: str, kind: str | None, ok: str, inner_code: Callable[[], str] | None = None, inner: Callable[[str], str] | None = None) -> None:
            ok = f"coalesce({ok}, false)"
            out.append(Check(keyword, CODES[code], f"(NOT ({x.is_(kind)}) OR {ok})" if kind else ok, kind, ok, inner_code, inner))

        if n.types is not None:
            among = [x.is_(k) for k in sorted(n.types - {"integer"})]
            code = str(CODES["UNEXPECTED_TOKEN"])
            if "integer" in n.types and "number" not in n.types:
                among.append(f"({x.is_('number')} AND {J.integral(x.of('d'))})")
                code = f"IF({x.is_('number')}, {CODES['NOT_INTEGER']}, {CODES['UNEXPECTED_TOKEN']})"
            add("type", "UNEXPECTED_TOKEN", None, f"({' OR '.join(among)})", lambda: code, lambda path: _one(path, "type", code))
        for word, values in (("const", n.const), ("enum", n.values)):
            if values is not None:
                told = f"CASE WHEN {x.is_('string')} THEN {CODES['STRING']} WHEN {x.is_('number')} THEN {CODES['NUMBER']} ELSE {CODES['UNEXPECTED_TOKEN']} END"
                add(word, "UNEXPECTED_TOKEN", None, self.among(x, values, n.prefix_arrays), lambda told=told: told, lambda path, word=word, told=told: _one(path, word, told))
        self._numbers(n, x, add)
        self._strings(n, x, add)
        self._arrays(n, x, add)
        self._objects(n, x, add)
        for branch in n.all_of:
            if not self.empty(branch):
                add("allOf", "SPLIT_CONDITION", None, self.ok(branch, x), lambda b=branch: self.code(b, x), lambda path, b=branch: self.violations(b, x, path))
        if n.any_of and not any(map(self.empty, n.any_of)):
            add("anyOf", "SPLIT_CONDITION", None, f"({' OR '.join(self.ok(b, x) for b in n.any_of)})")
        if n.one_of:
            add("oneOf", "SPLIT_CONDITION", None, f"({' + '.join(f'CAST({self.ok(b, x)} AS INT)' for b in n.one_of)}) = 1")
        if n.negated is not None:
            add("not", "SPLIT_CONDITION", None, f"NOT {self.ok(n.negated, x)}")
        return out

    def _numbers(self, n: SchemaNode, x: Bound, add: Callable) -> None:
        if n.multiple_of is not None:
            add("multipleOf", "NOT_MULTIPLE", "number", J.integral(f"({x.of('d')} / {J.double(n.multiple_of)})"))
        for word, bound, sign in (("maximum", n.maximum, "<="), ("exclusiveMaximum", n.exclusive_maximum, "<"), ("minimum", n.minimum, ">="), ("exclusiveMinimum", n.exclusive_minimum, ">")):
            if bound is not None:
                add(word, "NUMBER", "number", f"{x.of('d')} {sign} {J.double(bound)}")

    def _strings(self, n: SchemaNode, x: Bound, add: Callable) -> None:
        if n.max_length is not None:
            add("maxLength", "LENGTH_TOO_LONG", "string", f"char_length({x.of('s')}) <= {n.max_length}")
        if n.min_length is not None:
            add("minLength", "LENGTH_TOO_SHORT", "string", f"char_length({x.of('s')}) >= {n.min_length}")
        if n.pattern is not None:
            add("pattern", "STRING", "string", f"{x.of('s')} RLIKE {J.text(to_java(n.pattern))}")

    def _first(self, parts: str, e: str, code: str, where: str | None = None) -> str:
        """The first code that isn't 0 among ``parts``."""
        parts = f"filter({parts}, {e} -> {where})" if where else parts
        c = f"c{next(self.serial)}"
        return f"coalesce(get(filter(transform({parts}, {e} -> {code}), {c} -> {c} <> 0), 0), 0)"

    def _elements(self, a: str, n: SchemaNode, word: str, offset: int, add: Callable, tail: str) -> None:
        """``n`` for every element of ``tail``, whose first is number ``offset``."""
        e, i = f"e{next(self.serial)}", f"i{next(self.serial)}"
        banned = n.ref is None and n.always is False

        def inner(path: str) -> str:
            place = f"concat({path}, '/', {i} + {offset})"
            found = _one(place, word, str(CODES["ARRAY"])) if banned else self.bind(Place(e), n, lambda y: self.violations(n, y, place))
            return f"flatten(transform({tail}, ({e}, {i}) -> {found}))"

        code = (lambda: str(CODES["ARRAY"])) if banned else lambda: self._first(tail, e, self.bind(Place(e), n, lambda y: self.code(n, y)))
        ok = f"size({a}) <= {offset}" + ("" if banned else f" OR forall({tail}, {e} -> {self.child(n, Place(e))})")
        add(word, "ARRAY", "array", f"({ok})", code, inner)

    def _arrays(self, n: SchemaNode, x: Bound, add: Callable) -> None:
        a = x.of("a")
        if n.max_items is not None:
            add("maxItems", "TOO_MANY_ITEMS", "array", f"size({a}) <= {n.max_items}")
        if n.min_items is not None:
            add("minItems", "TOO_FEW_ITEMS", "array", f"size({a}) >= {n.min_items}")
        if n.unique:
            e, w, t = (f"{c}{next(self.serial)}" for c in "ewt")
            # equal scalars, and only they, get equal strings; adding 0 makes -0.0 and 0.0 one
            text = f"CASE WHEN {J.is_kind(t, 'number')} THEN concat('n', {J.number(e)} + 0D) WHEN {t} = 'STR' THEN concat('s', {J.string(e)}) ELSE concat('c', to_json({e})) END"
            add("uniqueItems", "NOT_UNIQUE", "array", J.let(f"transform({a}, {e} -> {J.let(J.tag(e), t, text)})", w, f"size(array_distinct({w})) = size({w})"))
        if n.contains is not None:
            e = f"e{next(self.serial)}"
            add("contains", "UNSATISFIED_CONTAINS", "array", f"exists({a}, {e} -> {self.child(n.contains, Place(e))})")
        if n.tuple_items is not None:
            k = len(n.tuple_items)
            for i, item in enumerate(n.tuple_items):
                if item.ref is None and item.always is False:
                    add("items", "ARRAY", "array", f"size({a}) <= {i}", None, lambda path, i=i: _one(f"concat({path}, '/{i}')", "items", str(CODES["ARRAY"])))
                elif not self.empty(item):
                    at = x.place(f"get({a}, {i})")
                    add("items", "ARRAY", "array", f"(size({a}) <= {i} OR {self.child(item, at)})", lambda at=at, item=item: self.bind(at, item, lambda y: self.code(item, y)),
                        lambda path, at=at, item=item, i=i: self.bind(at, item, lambda y: self.violations(item, y, f"concat({path}, '/{i}')")))
            if not self.empty(n.additional_items):
                self._elements(a, n.additional_items, "additionalItems", k, add, f"slice({a}, {k + 1}, greatest(size({a}) - {k}, 0))")
        elif not self.empty(n.items):
            self._elements(a, n.items, "items", 0, add, a)

    def _entries(self, m: str, n: SchemaNode, word: str, code: str, picked: Callable[[str], str], add: Callable) -> None:
        """``n`` for every entry whose key is picked; a picked entry under ``additionalProperties: false`` is itself the violation."""
        e, k = f"e{next(self.serial)}", f"k{next(self.serial)}"
        banned = word == "additionalProperties" and n.ref is None and n.always is False

        def inner(path: str) -> str:
            place = f"concat({path}, '/', replace(replace({e}.key, '~', '~0'), '/', '~1'))"
            found = _one(place, word, str(CODES[code])) if banned else self.bind(Place(f"{e}.value"), n, lambda y: self.violations(n, y, place))
            return f"flatten(transform(filter(map_entries({m}), {e} -> {picked(f'{e}.key')}), {e} -> {found}))"

        if banned:
            add(word, code, "object", f"NOT exists(map_keys({m}), {k} -> {picked(k)})", None, inner)
        else:
            first = lambda: self._first(f"map_entries({m})", e, self.bind(Place(f"{e}.value"), n, lambda y: self.code(n, y)), picked(f"{e}.key"))
            add(word, code, "object", f"forall(map_entries({m}), {e} -> NOT {picked(f'{e}.key')} OR {self.child(n, Place(f'{e}.value'))})", first, inner)

    def _objects(self, n: SchemaNode, x: Bound, add: Callable) -> None:
        m = x.of("m")
        if n.max_properties is not None:
            add("maxProperties", "TOO_MANY_PROPS", "object", f"size({m}) <= {n.max_properties}")
        if n.min_properties is not None:
            add("minProperties", "TOO_FEW_PROPS", "object", f"size({m}) >= {n.min_properties}")
        if n.required:
            add("required", "MISSING_REQUIRED_PROPERTIES", "object", f"({' AND '.join(x.has(k) for k in dict.fromkeys(n.required))})")
        if not self.empty(n.names):
            k = f"k{next(self.serial)}"
            # a name is a string, which a VARIANT can be made of
            add("propertyNames", "BAD_PROPERTY_NAME", "object", f"forall(map_keys({m}), {k} -> {self.child(n.names, Place(f'CAST({k} AS VARIANT)'))})")
        for key, need in n.need.items():
            if need:
                add("dependencies", "SPLIT_CONDITION", "object", f"(NOT ({x.has(key)}) OR ({' AND '.join(x.has(k) for k in need)}))")
        for key, s in n.need_schema.items():
            if not self.empty(s):
                add("dependencies", "SPLIT_CONDITION", "object", f"(NOT ({x.has(key)}) OR {self.ok(s, x)})")
        for key, s in n.properties.items():
            if not self.empty(s):
                at = x.at(key)
                add("properties", "UNEXPECTED_TOKEN", "object", f"(NOT ({x.has(key)}) OR {self.child(s, at)})", lambda s=s, at=at: self.bind(at, s, lambda y: self.code(s, y)),
                    lambda path, at=at, s=s, key=key: self.bind(at, s, lambda y: self.violations(s, y, f"concat({path}, {J.text('/' + escape(key))})")))
        for pattern, s in n.patterns.items():
            if not self.empty(s):
                self._entries(m, s, "patternProperties", "UNEXPECTED_TOKEN", lambda k, p=pattern: f"{k} RLIKE {J.text(to_java(p))}", add)
        if not self.empty(n.additional):
            names, patterns = n.known

            def other(k: str) -> str:
                tests = ([f"{k} NOT IN ({', '.join(map(J.text, sorted(names)))})"] if names else []) + [f"NOT {k} RLIKE {J.text(to_java(p))}" for p in sorted(patterns)]
                return f"({' AND '.join(tests)})" if tests else "true"

            self._entries(m, n.additional, "additionalProperties", "BAD_PROPERTY_NAME", other, add)

    # --- constants ---------------------------------------------------------------------------------------------------

    def among(self, x: Bound, values: list[Any], prefix: bool) -> str:
        """Whether the value is one of the constants; strings and numbers are tested together."""
        strings = [v for v in values if isinstance(v, str)]
        numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        tests = []
        if strings:
            tests.append(f"({x.is_('string')} AND {x.of('s')} IN ({', '.join(map(J.text, strings))}))")
        if numbers:
            tests.append(f"({x.is_('number')} AND {x.of('d')} IN ({', '.join(map(J.double, numbers))}))")
        for v in values:
            if v is None:
                tests.append(x.is_("null"))
            elif isinstance(v, bool):
                tests.append(f"({x.is_('boolean')} AND {x.of('b')} = {str(v).lower()})")
            elif isinstance(v, list):
                each = [f"(size({x.of('a')}) <= {i} OR {self.constant(x.place(f'get({x.of(chr(97))}, {i})'), c, prefix)})" for i, c in enumerate(v)]
                tests.append(f"({' AND '.join([x.is_('array'), f'size({x.of(chr(97))}) {chr(60) if prefix else str()}= {len(v)}', *each])})")
            elif isinstance(v, dict):
                each = [f"{x.has(k)} AND {self.constant(x.at(k), c, prefix)}" for k, c in v.items()]
                tests.append(f"({' AND '.join([x.is_('object'), f'size({x.of(chr(109))}) = {len(v)}', *each])})")
        return f"({' OR '.join(tests)})" if tests else "false"

    def constant(self, place: Place, value: Any, prefix: bool) -> str:
        self.spent += 1
        return f"coalesce({self.bind(place, SchemaNode(const=[value]), lambda y: self.among(y, [value], prefix))}, false)"


def _kinds(need: Needs) -> dict[str, str]:
    """The SQL type of each form."""
    members = ",".join(f"{J.field(k)}:variant" for k in need.names)
    return {"o": f"struct<{members}>", "m": "map<string,variant>", "a": "array<variant>", "d": "double", "s": "string", "b": "boolean"}


def _one(path: str, keyword: str, code: str) -> str:
    return f"array(struct({path} AS path, '{keyword}' AS keyword, {code} AS code))"


def _verdict(e: Emitter, root: SchemaNode, what: str, doc: str, place: Place) -> str:
    over = {"valid": lambda x: e.ok(root, x), "error_code": lambda x: e.code(root, x), "violations": lambda x: e.violations(root, x, "''")}[what]
    bad = {"valid": "false", "error_code": str(CODES["JSON"]), "violations": _one("''", "json", str(CODES["JSON"]))}[what]
    return f"IF({J.is_whole(place.base, doc)}, {e.bind(place, root, over)}, {bad})"


def expression(root: SchemaNode, doc: str, what: str) -> str:
    """SQL for ``valid``, ``error_code`` or ``violations`` of the JSON text ``doc``."""
    return J.let(J.wrapped(doc), "doc_", _verdict(Emitter(), root, what, doc, Place("doc_", J.FIRST)))


def layers(root: SchemaNode, doc: str, whats: list[str], prefix: str) -> tuple[list[dict[str, str]], dict[str, str]]:
    """Projections to put over each other, column by column, from the JSON text in column ``doc``, and the SQL of each of ``whats`` over them.

    Every column is marked as not deterministic (which costs nothing), so that the optimiser neither merges a projection into
    those above, which would parse a document as often as it is looked at, nor moves filters on verdicts below it.
    """
    e = Emitter(prefix)
    parsed = f"{prefix}doc"
    e._column(parsed, J.wrapped(doc), 0)
    verdicts = {what: _verdict(e, root, what, doc, Place(parsed, J.FIRST, 0)) for what in whats}
    return [{name: f"IF(spark_partition_id() < 0, NULL, {sql})" for name, sql in layer.items()} for layer in e.layers], verdicts
