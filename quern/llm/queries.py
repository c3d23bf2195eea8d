"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, jpeg, minhash, packing, pii, quality, repeats, rules, sstable

LIBRARY_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), length=50)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(table(spark, sf_dir, "documents"), LIBRARY_VOCABULARY, end_id=2)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_table(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), LIBRARY_VOCABULARY, size=2048, end_id=0)


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat.digests(chat.formatted(rows.unionByName(extra))).drop("exact")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_quality_rules, op3_repeated_passages, op4_quality_classifier, op5_token_shards, op6_media, op7_best_fit_packing, op8_byte_pairs, op9_chat_format, op10_personal_data)}

_BLANK = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(%s, '{_BLANK}'), lambda w: w <> '')"

_OP1 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS % "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(na.n) AS x, any_value(nb.n) AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (x + y - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_tests = [(rule, ratio, cut) for rule, (ratio, grid) in rules.RULES.items() for cut in grid]
_ratio_of = lambda ratio: " / nullif(".join(ratio.split(" / ")) + ", 0)"
_OP2 = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t FROM documents
), d AS (SELECT *, {_WORDS % 't'} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t
), g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3
), r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), c AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, stratum, len(w) AS n_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN c USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), q AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), v AS (SELECT doc_id, stratum, rule, ratio FROM (SELECT doc_id, stratum, base_failed, {', '.join(f'({_ratio_of(ratio)})::DOUBLE AS {rule}' for rule, (ratio, _) in rules.RULES.items())} FROM b) UNPIVOT (ratio FOR rule IN ({', '.join(rules.RULES)})) WHERE NOT base_failed
), cuts(rule, cutoff) AS (VALUES {', '.join(f"('{rule}', {cut}::DOUBLE)" for rule, _, cut in _tests)}
), h AS (SELECT doc_id, stratum, q, md5(doc_id::VARCHAR) < '8' AS proposes FROM b JOIN q USING (doc_id) WHERE NOT base_failed
), net AS (
  SELECT v.stratum, rule, cutoff, count(*) FILTER (q = 0) - {rules.GOOD_WEIGHT} * count(*) FILTER (q = 1) AS net
  FROM v JOIN h USING (doc_id) JOIN cuts USING (rule) WHERE proposes AND ratio > cutoff GROUP BY ALL HAVING net > 0
), best AS (SELECT stratum, rule, max(struct_pack(net := net, cutoff := cutoff)) AS x FROM net GROUP BY ALL
), proposed AS (SELECT stratum, rule, x.cutoff AS cutoff, row_number() OVER (PARTITION BY stratum ORDER BY x.net DESC, rule) AS place FROM best
), fell AS (SELECT v.stratum, doc_id, min(place) AS place FROM v JOIN h USING (doc_id) JOIN proposed p ON p.stratum = v.stratum AND p.rule = v.rule WHERE NOT proposes AND q = 1 AND ratio > cutoff GROUP BY ALL
), n AS (SELECT stratum, count(*) AS n FROM h WHERE NOT proposes AND q = 1 GROUP BY stratum
), k AS (SELECT p.stratum, p.rule, p.cutoff, n.n, (SELECT count(*) FROM fell f WHERE f.stratum = p.stratum AND f.place <= p.place) AS k FROM proposed p JOIN n ON n.stratum = p.stratum
), best_set AS (
  SELECT stratum, rule, cutoff FROM k WHERE k < n * 0.05::DOUBLE
    AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / (SELECT count(DISTINCT stratum) FROM b)
), broken AS (SELECT DISTINCT doc_id FROM v JOIN best_set USING (stratum, rule) WHERE ratio > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM b
"""

_OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents
), w AS (
  SELECT doc_id, unnest(list_transform(range(0, octet_length(h)), lambda i: struct_pack(i := i, b := hex(h[i + 1:i + 1]), g := CASE WHEN i + 50 <= octet_length(h) THEN h[i + 1:i + 50] END)), recursive := true) FROM d
), f AS (SELECT g, min(doc_id) AS first FROM w WHERE g IS NOT NULL GROUP BY g
), m AS (SELECT w.doc_id, w.i, w.b, max(CASE WHEN first < w.doc_id THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS s FROM w LEFT JOIN f ON w.g = f.g
), r AS (SELECT *, coalesce(s > i - 50, false) AS gone FROM m
), x AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM r
), o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""

_OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, CASE WHEN contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>') THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\#\#') ELSE text END AS shown,
    CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '=' || url_encode(role) END AS head FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || head || ': ' || shown || '</turn>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE_SQL = {"op1_near_duplicates": _OP1, "op2_quality_rules": _OP2, "op3_repeated_passages": _OP3, "op9_chat_format": _OP9}
