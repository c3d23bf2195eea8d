"""JSON Schema text to a resolved graph of nodes, on the driver.

Identifiers follow RFC 3986: every subschema is known by its JSON pointer below each enclosing base, and by its own ``$id``
(or ``id``). Values of unknown keywords are addressable in the same way.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

#: Type names of the schema language.
TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")


class SchemaError(ValueError):
    """The schema itself is wrong; raised on the driver, never a verdict on a row."""


class Pairs(list):
    """A JSON object as read: (key, value) in order."""


@dataclass(eq=False)
class SchemaNode:
    """One (sub)schema. Absent keywords are None; ``ref`` replaces all siblings."""

    always: bool | None = None
    ref: str | None = None
    target: "SchemaNode | None" = None
    types: frozenset[str] | None = None
    values: list[Any] | None = None  # enum
    const: list[Any] | None = None  # of one value
    multiple_of: float | None = None
    maximum: float | None = None
    exclusive_maximum: float | None = None
    minimum: float | None = None
    exclusive_minimum: float | None = None
    max_length: int | None = None
    min_length: int | None = None
    pattern: str | None = None
    items: "SchemaNode | None" = None
    tuple_items: "list[SchemaNode] | None" = None
    additional_items: "SchemaNode | None" = None
    max_items: int | None = None
    min_items: int | None = None
    unique: bool = False
    contains: "SchemaNode | None" = None
    max_properties: int | None = None
    min_properties: int | None = None
    required: list[str] | None = None
    properties: "dict[str, SchemaNode]" = field(default_factory=dict)
    patterns: "dict[str, SchemaNode]" = field(default_factory=dict)
    additional: "SchemaNode | None" = None
    #: names and patterns that ``additional`` leaves alone
    known: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())
    names: "SchemaNode | None" = None
    need: dict[str, list[str]] = field(default_factory=dict)
    need_schema: "dict[str, SchemaNode]" = field(default_factory=dict)
    all_of: "list[SchemaNode]" = field(default_factory=list)
    any_of: "list[SchemaNode]" = field(default_factory=list)
    one_of: "list[SchemaNode]" = field(default_factory=list)
    negated: "SchemaNode | None" = None
    #: array constants match any prefix of themselves (compat mode)
    prefix_arrays: bool = False
    metadata: dict[str, Any] = field(default_factory=dict)
    ids: list[str] = field(default_factory=list)

    def children(self) -> "list[SchemaNode]":
        one = (self.target, self.items, self.additional_items, self.contains, self.additional, self.names, self.negated)
        many = (self.tuple_items or (), self.properties.values(), self.patterns.values(), self.need_schema.values(), self.all_of, self.any_of, self.one_of)
        return [c for c in one if c is not None] + [c for m in many for c in m]

    def __repr__(self) -> str:
        shown = {k: v for k, v in vars(self).items() if v not in (None, {}, [], False, "") and k not in ("ids", "target", "known", "metadata")}
        return f"SchemaNode({', '.join(f'{k}={v!r}' for k, v in shown.items())})"


_ONE = {"additionalItems": "additional_items", "contains": "contains", "additionalProperties": "additional", "propertyNames": "names", "not": "negated"}
_MANY = {"allOf": "all_of", "anyOf": "any_of", "oneOf": "one_of"}
_COUNTS = {"maxLength": "max_length", "minLength": "min_length", "maxItems": "max_items", "minItems": "min_items", "maxProperties": "max_properties", "minProperties": "min_properties"}
_BOUNDS = {"maximum": "maximum", "exclusiveMaximum": "exclusive_maximum", "minimum": "minimum", "exclusiveMinimum": "exclusive_minimum"}
_NOTES = ("$schema", "title", "description", "examples", "default")


def escape(token: str) -> str:
    return token.replace("~", "~0").replace("/", "~1")


def plain(value: Any) -> Any:
    """A constant without its pairs: objects become dicts."""
    if isinstance(value, Pairs):
        return {k: plain(v) for k, v in value}
    return [plain(v) for v in value] if isinstance(value, list) else value


def _text(x: Any, keyword: str) -> str:
    if not isinstance(x, str):
        raise SchemaError(f"{keyword} must be a string")
    return x


def _number(x: Any, keyword: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise SchemaError(f"{keyword} must be a number")
    return float(x)


def _list(x: Any, keyword: str, least: int = 0) -> list:
    if not isinstance(x, list) or isinstance(x, Pairs) or len(x) < least:
        raise SchemaError(f"{keyword} must be an array" + f" of {least} or more" * (least > 0))
    return x


def _object(x: Any, keyword: str) -> Pairs:
    if not isinstance(x, Pairs):
        raise SchemaError(f"{keyword} must be an object")
    return x


class _Builder:
    def __init__(self, base: str, compat: bool):
        self.compat, self.by_id, self.refs = compat, {}, []
        self.root_base = base

    def build(self, raw: Any, bases: list[tuple[str, str]]) -> SchemaNode:
        """bases: (base URI without fragment, pointer below it), the innermost last."""
        node = SchemaNode()
        if isinstance(raw, bool):
            node.always = raw
        elif not isinstance(raw, Pairs):
            if not self.compat:
                raise SchemaError("a schema must be an object, true or false")
            raw = Pairs()
        entries = dict(raw) if isinstance(raw, Pairs) else {}
        name = next((entries[k] for k in ("$id", "id") if isinstance(entries.get(k), str)), None)
        if name is not None and "$ref" not in entries:
            whole, fragment = urldefrag(urljoin(bases[-1][0], name))
            if fragment:
                self._own(node, f"{whole}#{fragment}")
            if whole != bases[-1][0] or not fragment:
                bases = [*bases, (whole, "")] if whole != bases[-1][0] else bases
        for base, pointer in bases:
            self._own(node, f"{base}#{pointer}")
        if isinstance(raw, Pairs):
            if "$ref" in entries:
                node.ref = urljoin(bases[-1][0] + "", _text(entries["$ref"], "$ref"))
                if "#" not in node.ref:
                    node.ref += "#"
                self.refs.append(node)
                if "definitions" in entries:
                    self._members(entries["definitions"], "definitions", bases)
            else:
                for keyword, value in raw:
                    self._keyword(node, keyword, value, bases)
                self._finish(node)
        return node

    def _own(self, node: SchemaNode, uri: str) -> None:
        if self.by_id.setdefault(uri, node) is not node:
            raise SchemaError(f"two schemas are named {uri}")
        if uri not in node.ids:
            node.ids.append(uri)

    def _below(self, bases: list[tuple[str, str]], *tokens: Any) -> list[tuple[str, str]]:
        tail = "".join("/" + escape(str(t)) for t in tokens)
        return [(b, p + tail) for b, p in bases]

    def _members(self, value: Any, keyword: str, bases: list) -> dict[str, SchemaNode]:
        return {k: self.build(v, self._below(bases, keyword, k)) for k, v in _object(value, keyword)}

    def _keyword(self, n: SchemaNode, keyword: str, value: Any, bases: list) -> None:
        if keyword in _NOTES:
            if keyword in ("$schema", "title", "description"):
                _text(value, keyword)
            n.metadata[keyword] = plain(value)
        elif keyword in ("$id", "id"):
            _text(value, keyword)
        elif keyword == "definitions":
            self._members(value, keyword, bases)
        elif keyword == "type":
            names = value if isinstance(value, list) and not isinstance(value, Pairs) else [value]
            if not names or len(set(map(str, names))) < len(names) or any(t not in TYPES for t in names):
                raise SchemaError("type must be a name or a non-empty array of different names")
            n.types = frozenset(names)
        elif keyword == "enum":
            n.values = [plain(v) for v in _list(value, keyword, 1)]
        elif keyword == "const":
            n.const = [plain(value)]
        elif keyword == "multipleOf":
            n.multiple_of = _number(value, keyword)
            if n.multiple_of <= 0:
                raise SchemaError("multipleOf must be positive")
        elif keyword in _BOUNDS:
            if self.compat:  # the two forms of one bound share a slot: the last one counts
                side = keyword.removeprefix("exclusive").lower()
                setattr(n, side, None)
                setattr(n, "exclusive_" + side, None)
            setattr(n, _BOUNDS[keyword], _number(value, keyword))
        elif keyword in _COUNTS:
            count = _number(value, keyword)
            if count < 0:
                raise SchemaError(f"{keyword} must not be negative")
            setattr(n, _COUNTS[keyword], int(count))
        elif keyword == "pattern":
            n.pattern = _text(value, keyword)
        elif keyword == "items":
            if isinstance(value, list) and not isinstance(value, Pairs):
                n.tuple_items = [self.build(v, self._below(bases, keyword, i)) for i, v in enumerate(_list(value, keyword, self.compat))]
            else:
                n.items = self.build(value, self._below(bases, keyword))
        elif keyword in _ONE:
            setattr(n, _ONE[keyword], self.build(value, self._below(bases, keyword)))
        elif keyword in _MANY:
            setattr(n, _MANY[keyword], [self.build(v, self._below(bases, keyword, i)) for i, v in enumerate(_list(value, keyword, 1))])
        elif keyword == "uniqueItems":
            if not isinstance(value, bool):
                raise SchemaError("uniqueItems must be true or false")
            n.unique = value
        elif keyword == "required":
            n.required = [_text(v, keyword) for v in _list(value, keyword, self.compat)]
        elif keyword == "properties":
            n.properties = self._members(value, keyword, bases)
        elif keyword == "patternProperties":
            n.patterns = self._members(value, keyword, bases)
        elif keyword == "dependencies":
            for k, v in _object(value, keyword):
                if isinstance(v, list) and not isinstance(v, Pairs):
                    n.need[k] = [_text(x, keyword) for x in v]
                else:
                    n.need_schema[k] = self.build(v, self._below(bases, keyword, k))
        else:
            self._addressable(keyword, value, bases)

    def _addressable(self, keyword: str, value: Any, bases: list) -> None:
        """An unknown keyword constrains nothing; what looks like a schema in it can be referred to."""
        if isinstance(value, (Pairs, bool)):
            known = len(self.refs)
            try:
                self.build(value, self._below(bases, keyword))
            except SchemaError:
                del self.refs[known:]

    def _finish(self, n: SchemaNode) -> None:
        if self.compat:
            if n.types and {"number", "integer"} <= n.types:
                n.types -= {"number"}
            if n.const is not None and n.values is not None:
                n.values, n.const = n.values + n.const, None
            n.prefix_arrays = True

    def resolve(self) -> None:
        for node in self.refs:
            base, fragment = urldefrag(node.ref)
            node.target = next((self.by_id[u] for u in (node.ref, f"{base}#{unquote(fragment)}") if u in self.by_id), None)
            if node.target is None:
                raise SchemaError(f"$ref leads nowhere: {node.ref}")
        for node in self.refs:
            seen, at = {id(node)}, node.target
            while at.ref is not None:
                if id(at) in seen:
                    raise SchemaError(f"$ref leads to itself: {node.ref}")
                seen.add(id(at))
                at = at.target


def reachable(root: SchemaNode) -> list[SchemaNode]:
    found, todo = {}, [root]
    while todo:
        n = todo.pop()
        if id(n) not in found:
            found[id(n)] = n
            todo += n.children()
    return list(found.values())


def is_recursive(root: SchemaNode) -> bool:
    """Whether some node contains itself."""
    state: dict[int, int] = {}
    todo = [(root, False)]
    while todo:
        n, leaving = todo.pop()
        if leaving:
            state[id(n)] = 2
        elif state.get(id(n)) == 1:
            return True
        elif id(n) not in state:
            state[id(n)] = 1
            todo.append((n, True))
            for c in n.children():
                if state.get(id(c)) == 1:
                    return True
                if id(c) not in state:
                    todo.append((c, False))
    return False


def _share_names(node: SchemaNode, compat: bool) -> None:
    """What ``additional`` leaves alone; in compat mode also names of ``required`` and of the other branches of allOf."""
    group, todo = [], [node]
    while todo:
        n = todo.pop()
        group.append(n)
        todo += n.all_of if compat else []
    names = frozenset(k for n in group for k in [*n.properties, *((n.required or []) if compat else [])])
    patterns = frozenset(k for n in group for k in n.patterns)
    for n in group:
        n.known = (n.known[0] | names, n.known[1] | patterns)


def parse_schema(text: str, base_uri: str = "", mode: str = "spec") -> SchemaNode:
    """The root of the resolved graph; raises SchemaError for a bad schema."""
    if mode not in ("spec", "compat"):
        raise ValueError("mode is spec or compat")

    def reject(token: str) -> None:
        raise SchemaError(f"not JSON: {token}")

    try:
        raw = json.loads(text, object_pairs_hook=Pairs, parse_constant=reject)
    except json.JSONDecodeError as e:
        raise SchemaError(f"not JSON: {e}") from None
    except RecursionError:
        raise SchemaError("nested too deeply") from None
    builder = _Builder(base_uri, mode == "compat")
    root = builder.build(raw, [(urldefrag(base_uri)[0], "")])
    builder.resolve()
    for n in reachable(root):
        _share_names(n, mode == "compat")
    return root
