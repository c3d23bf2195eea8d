"""Bulk-synchronous best-fit packing of token sequences (operator 7).

Pieces are range-sorted by length and ranked by a distributed count. The open sequences are a table too, each with the
width of its gap. A superstep takes the pieces of one band of lengths, the longest first:

1. the gaps are range-sorted by width and ranked within each width;
2. a successor sweep walks down the band's lengths: each run of equal pieces goes to the narrowest gaps that take it, and gaps
   that it narrowed are in the sweep again; where no gap is left, sequences are opened;
3. equal pieces would all choose the same gap, so rank decides: the k-th piece of a run gets the k-th gap of the run of gaps;
4. the tasks that hold the gaps look their ranks up, write which piece goes where, and narrow the gaps.

The next superstep starts from the gaps so updated. The sweep itself sees only how many pieces and gaps there are of each
size, at most ``size`` numbers of either kind however many documents there are; pieces and gaps stay distributed. Since bands
descend, the result is that of best-fit decreasing.

Null text: empty, so one end id. An added token spelled out in a text gets its own id. Ties between equal lengths go by
doc_id, piece, start, ids, then row number, so repeated rows are packed one by one and split over tasks. Very long texts: cut
into pieces in one pass over them. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, small_batches, tidy, written
from .tokens import library_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise and cut: only documents longer than ``size`` are cut, and only their first piece may be shorter."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary)
        for part in slices(batches, "text", 4 << 20):
            flat, off = encode(part.column(1))
            flat, end = flat.astype("<u4", copy=False), np.array([end_id], "<u4").tobytes()
            out: list[list] = [[], [], [], [], []]
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                data = flat[off[i] : off[i + 1]].tobytes() + end
                n, at, k = len(data) // 4, 0, 0
                while at < n:
                    length = (n - at) % size or size
                    for column, v in zip(out, (doc_id, k, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]))):
                        column.append(v)
                    at, k = at + length, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, PIECE)


def bands(size: int) -> list[int]:
    """The least length of each superstep's pieces, descending to 1."""
    return sorted({max(1, size // d) for d in (2, 3, 5, 12, 48)} | {1}, reverse=True)


def sweep(counts: dict[int, int], size: int, gaps: dict[int, int] | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over runs of pieces (length: how many) and of gaps (width: how many).

    Returns slots (width, first gap, pieces, length, first piece, offset) and the number of sequences opened: the k-th piece of
    a slot, counted within its length, goes to the k-th of its gaps, counted within the width that they had before the sweep, at
    the slot's offset. Width 0 stands for opened sequences. Runs are cut, never merged: there are a few for each length.
    """
    slots, opened = [], 0
    runs: dict[int, list[tuple[int, int, int]]] = {w: [(w, 0, n)] for w, n in (gaps or {}).items() if n}  # width now: (width before, first gap, gaps)
    widths = sorted(runs)

    def leave(width: int, before: int, first: int, n: int) -> None:
        if width:
            if width not in runs:
                runs[width] = []
                insort(widths, width)
            runs[width].append((before, first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(widths, length)
            fresh = at == len(widths)
            if fresh:  # no gap takes it: open sequences, each filled with as many as fit
                width, before, first, n = size, 0, opened, -(-left // (size // length))
                opened += n
            else:
                width = widths[at]
                before, first, n = runs[width].pop()
            # a narrowed gap that still takes the length is the successor again, so each gap is filled before the next
            full, rest = divmod(left, width // length)
            full = min(full, n)
            for take, use in ((full, width // length), (1, rest if full < n else 0)):
                if take and use:
                    for k in range(use):
                        slots.append((before, first, take, length, rank, size - width + k * length))
                        rank, left = rank + take, left - take
                    leave(width - use * length, before, first, take)
                    first, n = first + take, n - take
            if n:
                runs[width].append((before, first, n))
            elif not fresh and not runs[width]:
                del runs[width]
                widths.remove(width)
    return slots, opened


def ranked(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add ``rank``, from 0 within each value of ``by``: a range sort, counts by partition, and running sums of the counts.

    Also returns how many rows each value has: by, n.
    """
    rows = rows.withColumn("__row", F.monotonically_increasing_id())  # splits rows that tie on all else
    keys = [by, *order, "__row"]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, current, seen = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            value = b.column(b.schema.get_field_index(by)).to_numpy()
            if not len(value):
                continue
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            local = np.arange(len(value)) - np.repeat(starts, np.diff(np.r_[starts, len(value)]))
            if value[0] == current:
                local[: starts[1] if len(starts) > 1 else len(value)] += seen
            current, seen = value[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(value), part, np.int32)), pa.array(local)], [*b.schema.names, "part", "local"])

    counted = written(spread.mapInArrow(count, schema + ", part int, local long"))
    # a row for each partition and value in it: at most partitions + values, as the rows are sorted by value
    ends = counted.groupBy("part", by).agg(F.count("*").alias("n"))
    before = ends.withColumn("before", F.sum("n").over(Window.partitionBy(by).orderBy("part")) - F.col("n"))
    out = counted.join(F.broadcast(before.drop("n")), ["part", by]).withColumn("rank", F.col("before") + F.col("local"))
    return out.select(*spread.columns, "rank"), ends.groupBy(by).agg(F.sum("n").alias("n"))


def superstep(gaps: DataFrame, counts: dict[int, int], opened: int, size: int) -> tuple[DataFrame, int]:
    """Place ``counts`` pieces (by length) in ``gaps`` (sequence_id, width) and in opened sequences, numbered from ``opened`` on.

    Returns one table of placements (length, rank, sequence_id, offset) and of the gaps as they are now (length 0; offset: the
    width), and the number of sequences now.
    """
    spark = gaps.sparkSession
    held, widths = ranked(gaps, "width", ["sequence_id"])
    slots, new = sweep(counts, size, {r["width"]: r["n"] for r in widths.collect()})  # ``size`` numbers at most
    by_width: dict[int, list[tuple]] = {}
    for before, *slot in slots:
        by_width.setdefault(before, []).append(slot)
    tables = {before: np.array(some, np.int64) for before, some in by_width.items()}
    lookup = spark.sparkContext.broadcast(tables)  # its size follows ``size``, not the documents
    fresh = spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("width"), (F.col("id") - opened).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, width, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("sequence_id", "width", "rank"))
            now, out = np.where(width, width, size), []
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                mine = mine[np.argsort(rank[mine])]
                for first, n, length, piece, offset in lookup.value.get(int(w), ()):
                    i, j = np.searchsorted(rank[mine], (first, first + n))
                    if i < j:
                        some = mine[i:j]
                        now[some] -= length
                        out.append(np.stack([np.full(j - i, length), piece + rank[some] - first, seq[some], np.full(j - i, offset)]))
            out.append(np.stack([np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64), seq, now]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], ["length", "rank", "sequence_id", "offset"])

    both = held.select("sequence_id", "width", "rank").unionByName(fresh)
    return written(both.mapInArrow(place, "length long, rank long, sequence_id long, offset long")), opened + new


def pack(pieces: DataFrame, *, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (of ``token_pieces``)."""
    spark = pieces.sparkSession
    tidy(spark)
    placed, lengths = ranked(written(pieces), "length", ["doc_id", "piece", "start", "ids_crc32"])
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # ``size`` numbers at most
    gaps, opened, steps, top = spark.createDataFrame([], "sequence_id long, width long"), 0, [], size + 1
    for least in bands(size):
        band = {k: n for k, n in counts.items() if least <= k < top}
        top = least
        if band:
            step, opened = superstep(gaps, band, opened, size)
            steps.append(step.where("length > 0"))
            useful = max(1, min((k for k in counts if k < least), default=size + 1))  # narrower gaps take nothing more
            gaps = step.where(f"length = 0 AND offset >= {useful}").select("sequence_id", F.col("offset").alias("width"))
    if not steps:
        return placed.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)
    return placed.join(found, ["length", "rank"]).select(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, vocabulary: str, *, size: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    return pack(token_pieces(docs, vocabulary, size=size, end_id=end_id, key=key, text=text), size=size)
