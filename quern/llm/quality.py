"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 4).

Statistics are computed for every whole text; trees are fitted on the driver from at most ``sample`` labelled rows (those
with the smallest hash of doc_id and row number, a documented bound that does not grow) and flattened into arrays, which
executors traverse with numpy, all rows at a time. So many rows at most, and a tenth more, leave the executors: where more are
labelled, a cut through the hash's range leaves about that many.

Null text: empty, scored like any other. Null quality or doc_id: not a label, and a null doc_id is not held out. Repeated labels
count once, as the lowest; repeated rows are scored alike, and learnt from once each. Rows whose hash ties are taken by their
statistics. No usable labels, or labels of one class only: the score is that class's share (0.5 without any). Very long texts
are read whole, in linear time. Empty table: no rows. Extra columns are ignored, whatever their names, so labels, language,
source and ids never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_bytes, written

_SPACES = [0x20, *range(0x09, 0x0E)]
#: Byte classes whose shares are statistics.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": _SPACES, "newline": [10],
    "markup": b"#*$%&|<>", "stop": b".?", "bang": b"!", "pause": b",;:", "bracket": b"()[]{}", "high": range(128, 256),
}
NAMES = ["log_bytes", *CLASSES, "log_words", "word_length", "longest_word", "distinct_words", "top_word", "log_lines", "dup_lines", "line_length", "empty_lines", "upper_words", "marked_words"]
_MEMBER = np.zeros((256, len(CLASSES)), np.float64)
for _i, _c in enumerate(CLASSES.values()):
    _MEMBER[list(_c), _i] = 1


def statistics(data: bytes) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    n = len(data)
    share = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBER / max(1, n)).tolist()
    words, lines = data.split(), data.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    full = [x for x in lines if x.strip()]
    m = max(1, len(words))
    marked = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128)
    upper = sum(c for w, c in counts.items() if w.isupper())
    return [float(np.log1p(n)), *share, float(np.log1p(len(words))), sum(map(len, words)) / m, float(max(map(len, words), default=0)), len(counts) / m, max(counts.values(), default=0) / m,
            float(np.log1p(len(full))), 1 - len(set(full)) / max(1, len(full)), n / max(1, len(full)), 1 - len(full) / len(lines), upper / m, marked / m]


def statistics_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (array of statistics)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8 << 20):
            flat, off = text_bytes(part.column(1))
            raw, off = flat.tobytes(), off.tolist()
            x = [statistics(raw[a:b]) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Trees:
    """Gradient-boosted trees for a 0/1 target under logistic loss, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1) if n else 0.5
        if n and y.min() == y.max():
            p = float(y[0])
        self.base = float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((0, nodes), np.int64)
        self.cut = np.full((0, nodes), np.inf)
        self.value = np.zeros((0, nodes))
        if not n or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(m) * self.bins
        score, trees = np.full(n, self.base), []
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, prob * (1 - prob)
            feature, cut, value, at = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes), np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, width = 2**level - 1, 2**level
                local = at - first
                value[first : first + width] = -np.bincount(local, g, width) / (np.bincount(local, h, width) + self.l2)
                if level == self.depth:
                    break
                cell = (local[:, None] * (m * self.bins) + flat).ravel()
                total = width * m * self.bins
                hist = [np.bincount(cell, np.repeat(v, m) if v is not None else None, total).reshape(width, m, self.bins).cumsum(2) for v in (g, h, None)]
                gl, hl, cl = hist
                gt, ht, ct = (v[:, :, -1:] for v in hist)
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(cl < self.least) | (ct - cl < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-9:
                        feature[first + k], cut[first + k] = j, edges[j][b]
                right = x[np.arange(n), feature[at]] > cut[at]
                at = 2 * at + 1 + right
                stay = cut[(at - 1) // 2] == np.inf
                value_of = (at - 1) // 2
                value[at[stay]] = value[value_of[stay]]
            trees.append((feature, cut, value * self.rate))
            score += trees[-1][2][at]
        self.feature, self.cut, self.value = (np.stack(v) for v in zip(*trees))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: every row walks down every tree, one level of all trees at a time."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))


def held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = 20_000, folds: int = 5, key: str = "doc_id", text: str = "text", target: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learns from the folds that aren't held out."""
    table = written(statistics_table(docs, key=key, text=text))
    marked = labels.where(F.col(target).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key), folds)).groupBy(F.col(key).alias("doc_id")).agg(F.min(target).alias("y"))
    rows = table.withColumn("h", F.xxhash64("doc_id", F.monotonically_increasing_id())).join(marked, "doc_id").select("x", "y", "h")
    count = rows.count()
    if count > 1.1 * sample + 1000:
        rows = rows.where(F.col("h") < int((1.1 * sample / count - 0.5) * 2**64))
    learn = rows.orderBy("h", "x").limit(sample).collect()
    x = np.array([r["x"] for r in learn]).reshape(-1, len(NAMES))
    trees = Trees().fit(x, np.array([float(r["y"]) for r in learn]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(flat))], ["doc_id", "score"])

    out = table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), folds), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
