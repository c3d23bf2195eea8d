"""SQL fragments over VARIANT values. Every fragment is a scalar expression that Catalyst evaluates in the JVM."""

from __future__ import annotations

import math


def text(s: str) -> str:
    """A string literal, whatever the session's escape settings."""
    return f"'{s}'" if s.isascii() and s.isprintable() and not set(s) & {"'", "\\"} else f"CAST(X'{s.encode('utf-8', 'surrogatepass').hex()}' AS STRING)"


def double(x: float) -> str:
    if math.isinf(x):
        return "double('Infinity')" if x > 0 else "double('-Infinity')"
    return f"CAST('{x!r}' AS DOUBLE)"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: The path of the document in what ``wrapped`` parses.
FIRST = "$[0]"


def wrapped(doc: str) -> str:
    """The VARIANT of an array of the document and of the document's own hash.

    The parser takes trailing content; content that closes the array early can't bring that hash along.
    """
    return f"try_parse_json(concat('[', {doc}, ',', xxhash64({doc}), ']'))"


def is_whole(parsed: str, doc: str) -> str:
    """Whether the document that was ``wrapped`` is exactly one JSON text."""
    return f"coalesce(try_variant_get({parsed}, '$[1]', 'bigint') = xxhash64({doc}), false)"


def field(key: str) -> str:
    """A key as a field of a struct type, and after a dot."""
    return f"`{key}`"


#: What the name of a VARIANT's type starts with; numbers have several names.
TAGS = {"object": "OBJ", "array": "ARR", "string": "STR", "boolean": "BOO", "null": "VOI"}


def tag(v: str) -> str:
    """A short name of a VARIANT's type."""
    return f"substring(schema_of_variant({v}), 1, 3)"


def is_kind(tag_: str, kind: str) -> str:
    if kind == "number":  # '' is an object or array that is known already
        return f"{tag_} NOT IN ({', '.join(map(text, [*TAGS.values(), '']))})"
    return f"{tag_} = '{TAGS[kind]}'"


def number(v: str) -> str:
    return f"try_variant_get({v}, '$', 'double')"


def string(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def integral(d: str) -> str:
    """Whether a double is a finite whole number."""
    return f"({d} = rint({d}) AND abs({d}) < double('Infinity'))"
