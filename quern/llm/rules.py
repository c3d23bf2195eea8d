"""Quality rules with risk-controlled thresholds (operator 2), in DataFrame and SQL functions only.

Every rule compares one ratio with a cutoff. In each stratum (language) the labelled documents that pass the base rules are
split in two by a hash of doc_id. The first half proposes: of a fixed grid, each rule takes the cutoff that rejects most bad
documents net of ``GOOD_WEIGHT`` times the good ones, and rules that gain something are put in order of that gain. The second
half certifies, in that order, ever larger sets of rules: ``k`` of its ``n`` good documents break some rule of the set, and the
set is certified while the exact binomial tail P(Bin(n, alpha) <= k) is at most ``delta`` divided by the number of strata. Sets
are tested in a fixed sequence that ends at the first failure, so within a stratum no more correction is due, and Bonferroni
covers the strata: with probability 1 - delta no stratum loses more than ``alpha`` of its good documents to the largest
certified set, which is the one in force. About ln(delta / strata) / ln(1 - alpha) good labels (86 for four strata) must be in
the second half before anything can be certified; below that, only the base rules hold.

Null text: no words, so base_failed. Null language: a stratum of its own. Null quality: no label; repeated labels of a
document count once, as the lowest. Repeated documents: each row is judged and counted. Equal gains: rules go by name, and of
equal cutoffs' gains the larger cutoff. Very long texts: read whole, as arrays of their words and word windows. No labels or an
empty table: only the base rules hold. Extra columns are ignored, whatever their names, unless ``carry`` keeps whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: ratio by name, and the cutoffs that may be certified, ascending
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "bangs": ("n_bangs / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "capitals": ("n_capitals / word_chars", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "dup_lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / n_words", (0.1, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
}
GOOD_WEIGHT = 20
BLANK = r"[\x20\x09-\x0D]+"


def _let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeats() -> str:
    """Words within a 3-word window that the text has twice or more: sort the windows, keep those with an equal neighbour, add up what they cover.

    Windows whose hashes all differ all differ; most texts end there.
    """
    windows = "transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i))"
    twice = "filter(s, (x, j) -> coalesce(get(s, j - 1).g = x.g, false) OR coalesce(get(s, j + 1).g = x.g, false))"
    covered = f"aggregate(sort_array(transform({twice}, x -> x.i)), struct(-3 AS last, 0L AS n), (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n), a -> a.n)"
    hashes = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    alone = _let(hashes, "h", "size(array_distinct(h)) = size(h)")
    return f"CASE WHEN size(w) < 4 OR {alone} THEN 0L ELSE {_let(f'sort_array({windows})', 's', covered)} END"


def features(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """Statistics of every whole text, one narrow pass; with ``carry``, each row of ``docs`` as it is in column ``row``."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    also = ["row"] if carry else []
    d = docs.select(*row, F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(stratum).cast("string"), F.lit("?")).alias("stratum"))
    blank = r" \t\n\u000B\u000C\r"
    squeezed = f"trim(BOTH '{blank}' FROM t)"
    words = _let(squeezed, "x", rf"IF(x = '', array(), split(x, r'{BLANK}'))")
    counted = _let(words, "w", f"struct(CAST(size(w) AS BIGINT) AS n_words, {_repeats()} AS n_repeat_words)")
    lines = _let(r"filter(split(t, '\n'), l -> l RLIKE r'[^\x20\x09-\x0D]')", "l", "struct(CAST(size(l) AS BIGINT) AS n_lines, CAST(size(l) - size(array_distinct(l)) AS BIGINT) AS n_dup_lines)")
    without = lambda chars: f"CAST(char_length(t) - char_length(translate(t, '{chars}', '')) AS BIGINT)"
    d = d.select(*also, "doc_id", "stratum", F.expr(counted).alias("c"), F.expr(lines).alias("l"),
                 F.expr(f"CAST(char_length(translate(t, '{blank}', '')) AS BIGINT)").alias("word_chars"),
                 F.expr(without("#*$%&|<>")).alias("n_symbols"), F.expr(without("!")).alias("n_bangs"), F.expr(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"))
    d = d.select(*also, "doc_id", "stratum", "c.*", "l.*", "word_chars", "n_symbols", "n_bangs", "n_capitals")
    return d.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def _ratio(rule: str) -> Column:
    return F.expr(f"CAST(try_divide({RULES[rule][0].replace(' / ', ', ')}) AS DOUBLE)")


def _log_gamma(x: str) -> str:
    """SQL: ln Gamma of a positive double, by Stirling's series at x + 7."""
    y = f"({x} + 7D)"
    series = f"({y} - 0.5D) * ln({y}) - {y} + 0.91893853320467274178D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - 1D / (1680D * pow({y}, 7))"
    return f"({series} - ln({' * '.join(f'({x} + {i}D)' for i in range(7))}))"


def log_tail(p: float) -> Column:
    """log P(Bin(n, p) <= k) of columns n and k; 0 where k >= n p, as no test would pass there.

    The largest term comes from ln Gamma and the others from it downwards, until twelve standard deviations below, where they
    are lost in a double's last place; so the work grows with the root of n.
    """
    top = f"{_log_gamma('(n + 1D)')} - {_log_gamma('(k + 1D)')} - {_log_gamma('(n - k + 1D)')} + k * ln({p}D) + (n - k) * ln(1 - {p}D)"
    steps = f"least(k, CAST(ceil(12 * sqrt(n * {p}D)) AS BIGINT) + 50)"
    grow = f"a.r * (k - i + 1) * (1 - {p}D) / ((n - k + i) * {p}D)"
    add = f"transform(array({grow}), r -> struct(r AS r, a.s + r AS s))[0]"
    return F.expr(f"CASE WHEN n = 0 OR k >= n * {p}D THEN 0D WHEN k = 0 THEN n * ln(1 - {p}D) ELSE {top} + ln(aggregate(sequence(1L, {steps}), struct(1D AS r, 1D AS s), (a, i) -> {add}, a -> a.s)) END")


def thresholds(table: DataFrame, labels: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff."""
    marked = labels.where(F.col(quality).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.min(quality).alias("q"))
    ratios = [_ratio(rule).alias(f"r_{rule}") for rule in RULES]
    held = written(table.where(~F.col("base_failed")).join(marked, "doc_id").select("stratum", "q", (F.md5(F.col("doc_id").cast("string")) < "8").alias("proposes"), *ratios))
    strata = table.select("stratum").distinct().count()  # one number

    # the first half proposes a cutoff for each rule
    tests = [(rule, cut) for rule, (_, grid) in RULES.items() for cut in grid]
    net = lambda rule, cut: F.sum(F.when(F.col(f"r_{rule}") > cut, F.when(F.col("q") == 1, -GOOD_WEIGHT).when(F.col("q") == 0, 1)).cast("long"))
    by = held.where("proposes").groupBy("stratum").agg(*(net(*t).alias(f"net{i}") for i, t in enumerate(tests)))  # a row for each stratum
    rows = ", ".join(f"struct('{rule}' AS rule, {cut}D AS cutoff, net{i} AS net)" for i, (rule, cut) in enumerate(tests))
    long = by.select("stratum", F.expr(f"inline(array({rows}))")).where("net > 0")
    best = long.groupBy("stratum", "rule").agg(F.max(F.struct("net", "cutoff")).alias("best")).select("stratum", "rule", "best.*")
    proposed = written(best.withColumn("place", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("net"), "rule"))))

    # the second half certifies the first rules in that order
    wide = proposed.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.struct("cutoff", "place"))).alias(f"p_{r}") for r in RULES))
    good = held.where("NOT proposes AND q = 1").join(written(wide), "stratum")
    first = F.least(F.lit(len(RULES) + 1), *(F.when(F.col(f"r_{r}") > F.col(f"p_{r}.cutoff"), F.col(f"p_{r}.place")) for r in RULES))  # of the places whose rule it breaks
    fell = good.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((first <= j).cast("long")).alias(f"k{j}") for j in range(1, len(RULES) + 1)))
    tried = proposed.join(fell, "stratum").withColumn("k", F.expr(f"CASE place {' '.join(f'WHEN {j} THEN k{j}' for j in range(1, len(RULES) + 1))} END"))
    # a larger set rejects no fewer, so what passes is a beginning of the sequence
    return tried.where(log_tail(alpha) <= F.log(F.lit(delta / max(1, strata)))).select("stratum", "rule", "cutoff")


def judged(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """Statistics, base_failed, the rules that a document breaks (failed_rules) and kept, one row for each document; ``carry`` as in features."""
    table = written(features(docs, key=key, text=text, stratum=stratum, carry=carry))
    cuts = thresholds(table, labels, alpha=alpha, delta=delta, key=key)
    wide = cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    out = table.join(written(wide), "stratum", "left")  # its size is known, so Spark broadcasts it where it is small
    broken = F.array_compact(F.array(*(F.when(_ratio(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    out = out.withColumn("failed_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("stratum", *(f"cut_{r}" for r in RULES))
