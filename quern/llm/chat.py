"""Chat formatting with a grammar round trip (operator 9), in DataFrame and SQL functions only.

A turn is rendered as ``### Role: text</turn>`` and a newline. Roles of the fixed set are spelled out; any other role is
``=`` and its URL-encoded form. The parser splits at ``</turn>`` and a newline, cuts each part at its first ``: `` and
takes back the escapes. Every turn is rendered as it is, parsed, and compared with its source; where they differ, its
text is escaped (backslashes doubled, control strings broken by a backslash). Then the whole conversation is parsed and compared;
where it differs, all its turns are escaped and it is parsed and compared once more. Escaping leaves nothing that the grammar
could take for its own, so this must be identical; if it is not, the query fails rather than give altered text.

Null text or role: empty. Rows are ordered by turn, role, text, nulls first, so ties and repeated rows have one order and
all stay. Null conv_id: a conversation of its own. Empty table: no rows. Extra columns are ignored. A conversation is one
output row, so its size is that of one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How known roles are written, and the end of a turn.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "</turn>"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def head(role: str) -> str:
    """SQL: the marker that opens a turn of ``role``."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items())
    return f"concat('### ', CASE {role} {names} ELSE concat('=', url_encode({role})) END, ': ')"


def escaped(text: str) -> str:
    """SQL: ``text`` with no control string left in it."""
    return rf"replace(replace(replace({text}, r'\', r'\\'), '</turn>', r'<\/turn>'), '###', r'#\#\#')"


def restored(text: str) -> str:
    return rf"regexp_replace({text}, r'(?s)\\(.)', '$1')"


def parsed(rendered: str) -> str:
    """SQL: array of struct(role, text, raw) that the grammar finds in ``rendered``; raw is the text before unescaping."""
    names = " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in ROLES.items())
    name = "substring(part, 5, instr(part, ': ') - 5)"
    raw = "substring(part, instr(part, ': ') + 2)"
    role = f"CASE {name} {names} ELSE try_url_decode(substring({name}, 2)) END"
    turn = _let(raw, "r", f"struct({role} AS role, {restored('r')} AS text, r AS raw)")
    parts = rf"split({rendered}, r'\Q{END}\E\n')"
    return f"transform(filter({parts}, (part, i) -> part <> ''), part -> {turn})"


def escaped_turn(role: str, text: str) -> str:
    return rf"concat({head(role)}, {escaped(text)}, '{END}\n')"


def render_turn(role: str, text: str) -> str:
    """SQL: one turn as it is where it parses back, else escaped."""
    same = _let(parsed("plain"), "p", f"size(p) = 1 AND coalesce(p[0].role = {role} AND p[0].text = {text}, false) AND instr({text}, '###') = 0 AND instr({text}, '{END}') = 0")
    return _let(rf"concat({head(role)}, {text}, '{END}\n')", "plain", f"CASE WHEN {same} THEN plain ELSE {escaped_turn(role, text)} END")


def formatted(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """conv_id, source (turns), formatted, mask (array of start, length of the trained texts in ``formatted``, from 0), turns (parsed from it) and exact (always true)."""
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = turns.withColumn("shown", F.expr(render_turn("t.role", "t.text")))
    one = F.struct("t.turn", "t.role", "t.text", "shown")
    c = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("source"))
    # parsing drops empty parts only, and every turn has a marker
    join = "array_join(transform(source, x -> x.shown), '')"
    exact = "coalesce(transform(source, x -> struct(x.role, x.text)) = transform(turns, x -> struct(x.role, x.text)), false)"
    c = c.withColumn("formatted", F.expr(join)).withColumn("turns", F.expr(parsed("formatted"))).withColumn("exact", F.expr(exact))
    again = f"transform(source, x -> struct(x.turn AS turn, x.role AS role, x.text AS text, {escaped_turn('x.role', 'x.text')} AS shown))"
    c = c.withColumn("source", F.expr(f"IF(exact, source, {again})")).withColumn("formatted", F.expr(f"IF(exact, formatted, {join})"))
    c = c.withColumn("turns", F.expr(f"IF(exact, turns, {parsed('formatted')})"))
    c = c.withColumn("exact", F.expr(f"IF({exact}, true, CAST(raise_error(concat('no reversible format for conversation ', conv_id)) AS BOOLEAN))"))
    place = rf"struct(a.at + char_length(x.shown) AS at, CASE WHEN x.role = '{train_on}' THEN array_append(a.spans, struct(a.at + char_length({head('x.role')}) AS start, char_length(x.shown) - char_length({head('x.role')}) - {len(END) + 1} AS length)) ELSE a.spans END AS spans)"
    c = c.withColumn("mask", F.expr(f"aggregate(source, struct(0 AS at, CAST(array() AS array<struct<start:int,length:int>>) AS spans), (a, x) -> {place}, a -> a.spans)"))
    return c.select("conv_id", F.expr("transform(source, x -> struct(x.turn, x.role, x.text))").alias("source"), "formatted", "mask", "turns", "exact")


def digests(c: DataFrame) -> DataFrame:
    """What the contract asks for, read back from ``formatted`` and ``mask`` alone."""
    back = "array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '')"
    loss = f"array_join(transform(mask, m -> {restored('substring(formatted, m.start + 1, m.length)')}), '')"
    return (c.withColumn("loss", F.expr(loss)).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.expr(f"sha2({back}, 256)").alias("turns_sha256"),
            F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "exact"))
