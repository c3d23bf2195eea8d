"""Repeated passages by a run-length BWT index (operator 3).

A byte goes where a window of ``length`` bytes that covers it also starts in a document with a smaller doc_id.

Partitioning. Of the grams inside a window the one with the least hash is its anchor, so equal windows have equal anchors at
equal places; all windows of one anchor lie in its context, the bytes around it. Rows are dealt to chunks by a hash of id, text
and row number, so that no id, null included, and no group of copies fills a chunk. Chunks send sorted hashes of (anchor,
context), each with the least doc_id that has it, to buckets; buckets answer, entry by entry: no smaller doc_id anywhere has the
context, and its anchor has no other; a smaller doc_id has it; an anchor with several different contexts; or an anchor with more
than ``HOT`` contexts. Repeats of one whole context collapse to the least doc_id. Only contexts whose anchor has other contexts
too go to the index, from their least doc_id; for hot anchors their single windows go there instead, spread by content, so no
group is unbounded. Whole contexts are taken for equal when 32 bits of the gram's hash, 48 of the context's and the bucket agree:
at 100 TB (10^13 contexts, 8 million buckets) 5e-6 wrong pairs are to be expected; partial repeats are compared byte by byte.

Index. For the texts of a bucket, in anchor groups: a suffix array by prefix doubling gives the Burrows-Wheeler transform,
which is kept as runs, plus the rows at which matching statistics fall below ``length``. Each text is then streamed backwards
through the runs by LF steps; a row inside a stretch of matches of ``length`` bytes and more, in which the least doc_id is
smaller than the text's, marks its window. The suffix array is sampled at run ends: where a row is the end of its run, the
sample must be the text's own place, which checks the walk.

Null text: empty. Null doc_id: smaller than any other. Equal doc_ids: none is smaller, so such rows don't affect each other;
repeated rows lose the same bytes. Empty table: no rows. Texts are read whole, as UTF-8; a very long text is in one chunk,
indexed a context at a time. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, ragged, release_caches, small_batches, text_bytes, tidy

GRAM = 20
HOT = 20_000
INDEXED = 4_000  # texts in one index
NO_ID = -(1 << 63)
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
COLD, SEEN, MANY, FLOOD = range(4)


# --- the index -------------------------------------------------------------------------------------------------------

def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks (from 1) of tuples of non-negative integers."""
    key = keys[0]
    for k in keys[1:]:
        key = key.astype(np.int64)
        key *= np.int64(int(k.max()) + 1)
        key += k
    flat, shape, small = key.ravel(), key.shape, _small(key.size)
    del key
    order = np.argsort(flat)
    flat = flat[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    del flat
    out = np.empty(len(order), small)
    out[order] = np.cumsum(new, dtype=small)
    return out.reshape(shape)


def _small(count: int) -> type:
    """The integers that count so far take half the memory where they can."""
    return np.int32 if count < (1 << 31) - 1 else np.int64


def _ahead(rank: np.ndarray, places: int) -> np.ndarray:
    """Each row moved ``places`` to the left, zeros coming in."""
    out = np.zeros_like(rank)
    if places < rank.shape[1]:
        out[:, : rank.shape[1] - places] = rank[:, places:]
    return out


class RunIndex:
    """Run-length BWT of texts (rows of ``padded``, whose bytes are 1 to 255, ends being 0) with sampled run ends."""

    def __init__(self, padded: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int):
        m, width = padded.shape
        self.size, self.length = size, length
        inside = np.arange(width + 1) <= size[:, None]  # the end of a text is a suffix as well
        # ranks of eight bytes, then of twice as many at a time
        first = np.zeros((m, width + 9), np.uint8)
        first[:, :width] = padded
        eight = np.ndarray((m, width + 1), ">u8", first.data, strides=(width + 9, 1)).astype(np.uint64)
        block, rank = 8, _ranks(eight)
        del eight, first
        rank[~inside] = 0
        part, shared = (rank, 8) if length >= 8 else (None, 0)  # the longest ranks that ``length`` bytes cover
        while block * 2 < width + 1:
            rank = _ranks(rank, _ahead(rank, block))
            rank[~inside] = 0
            block *= 2
            if block <= length:
                part, shared = rank, block
        # the last doubling sorts; equal suffixes go by text
        key = rank[inside].astype(np.int64)
        key *= np.int64(int(rank.max()) + 1)
        key += _ahead(rank, block)[inside]
        del rank
        bits = len(key).bit_length()
        if int(key.max()) < 1 << 62 - bits:
            key <<= bits
            key |= np.arange(len(key))
            order = np.argsort(key)
        else:
            order = np.argsort(key, kind="stable")
        del key
        small = _small(m * (width + 1))
        order = order.astype(small)
        text = np.repeat(np.arange(m, dtype=small), size + 1)
        at = ragged(np.zeros(m, np.int64), size + 1).astype(small)
        text, at = text[order], at[order]
        del order, inside
        before = np.where(at > 0, padded[text, at - 1], 0)
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]]).astype(small)
        self.rows, self.head, self.char = len(text), head, before[head]
        del before
        run = np.diff(head, append=small(len(text)))
        self.last, self.places = head + run - 1, small(width + 1)
        self.sample = text[self.last] * self.places + at[self.last]  # the suffix array at run ends
        by = np.argsort(self.char, kind="stable")
        self.to = np.empty(len(head), small)  # LF of each run's first row
        self.to[by] = np.cumsum(run[by], dtype=small) - run[by]  # runs in order of their characters follow each other
        del by
        # stretches of rows whose suffixes share ``length`` bytes, and the least owner in each
        long = at + length <= size[text]
        place = text * small(width + 1) + at  # below m * (width + 1)
        flat, other = part.ravel(), np.zeros(len(text), bool)
        for ahead in [*range(0, length - shared, shared), length - shared]:  # these blocks cover ``length`` bytes
            r = flat[np.minimum(place + ahead, len(flat) - 1)]
            other[1:] |= r[1:] != r[:-1]
        other[0] = True
        other[1:] |= ~long[1:] | ~long[:-1]
        cut = np.flatnonzero(other)
        del place, r, flat, part, other
        least, most = np.minimum.reduceat(owner[text], cut), np.maximum.reduceat(owner[text], cut)
        some = long[cut] & (least < most)  # only these can mark anything
        # a directory of the rows, which saves searching: the run of each, and the stretch (0: none)
        ends = np.r_[cut[1:], len(text)]
        self.run = np.repeat(np.arange(len(head), dtype=np.int32), run)
        self.stretch = np.repeat(np.where(some, np.cumsum(some), 0).astype(np.int32), ends - cut)
        self.least = np.r_[np.iinfo(np.int64).max, least[some]]  # by stretch

    def lf(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are one byte longer, from rows and their runs."""
        return self.to[run] + row - self.head[run]

    def marks(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream all texts backwards: (text, place) where ``length`` bytes also occur in a text of a smaller owner."""
        text, row, at = np.arange(len(self.size)), np.arange(len(self.size)), self.size.copy()
        found_text, found_at = [], []
        while True:
            run = self.run[row]
            end = np.flatnonzero(self.last[run] == row)
            if (self.sample[run[end]] != text[end] * self.places + at[end]).any():
                raise AssertionError("the run-length index is damaged")
            go = self.char[run] > 0
            text, row, at = text[go], self.lf(row[go], run[go]), at[go] - 1
            if not len(text):
                break
            hit = self.least[self.stretch[row]] < owner[text]
            found_text.append(text[hit])
            found_at.append(at[hit])
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_text), np.concatenate(found_at)) if found_text else (none, none)


# --- anchors ---------------------------------------------------------------------------------------------------------

def _stir(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x + y) * K2
    return (x ^ (x >> np.uint64(29))) * K3


def _loads(flat: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one integer (zeros past the end)."""
    padded = np.r_[flat, np.zeros(8, np.uint8)]
    return np.ndarray(len(flat), "<u8", padded.data, strides=(1,)), padded


def anchors(flat: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: place, text, gram hash, start and end of the context, context hash."""
    import xxhash

    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64, np.uint64))
    width = length - GRAM + 1  # grams in a window
    n = np.diff(off)
    windows = np.maximum(0, n - length + 1)
    if not windows.any():
        return none
    load, hold = _loads(flat)
    count = len(flat) - GRAM + 1
    gram = load[:count] * K1
    gram ^= gram >> np.uint64(32)
    gram = _stir(_stir(gram, load[8 : count + 8]), load[12 : count + 12])
    gram ^= gram >> np.uint64(32)
    least = (gram & ~np.uint64(0x7FFFFFFF)) | np.arange(count, dtype=np.uint64)  # ties go to the left
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    start = ragged(off[:-1], windows)
    at = (least[start] & np.uint64(0x7FFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    text = np.searchsorted(off, at, side="right") - 1
    a, b = np.maximum(off[text], at - (width - 1)), np.minimum(off[text + 1], at + length)
    span = width - 1 + length
    whole = b - a == span
    context = np.zeros(len(at), np.uint64)
    first = a[whole]
    x = np.full(len(first), span, np.uint64) * K1
    for j in [*range(0, span - 7, 8), span - 8]:
        x = _stir(x, load[first + j])
    context[whole] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(~whole):
        context[i] = xxhash.xxh3_64_intdigest(flat[a[i] : b[i]].tobytes(), int(at[i] - a[i]) + 1)
    del hold
    return at, text, gram[at], a, b, context


def _sorted_chunk(table: pa.Table) -> pa.Table:
    """Rows by doc_id, then hash of the row: an order that every pass over a chunk repeats."""
    order = np.lexsort((table.column("__hash").to_numpy(), table.column("__id").to_numpy()))
    return table.take(pa.array(order)) if len(order) else table


class Chunk:
    """The anchors of a chunk's texts and its distinct (bucket, gram, context) entries."""

    def __init__(self, table: pa.Table, text: str, length: int, buckets: int):
        self.table = table = _sorted_chunk(table)
        self.ids = table.column("__id").to_numpy()
        self.flat, self.off = text_bytes(table.column(text).combine_chunks() if table.num_rows else pa.array([], pa.string()))
        parts, i, n = [], 0, len(self.ids)
        while i < n:  # a megabyte at a time
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + (1 << 20), side="right")) - 1)
            at, doc, gram, a, b, context = anchors(self.flat[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i], length)
            parts.append((at + self.off[i], doc + i, gram, a + self.off[i], b + self.off[i], context))
            i = j
        self.at, self.doc, gram, self.a, self.b, context = (np.concatenate(c) for c in zip(*parts)) if parts else anchors(self.flat, self.off, length)
        del parts
        bucket, self.gram = (gram % np.uint64(buckets)).astype(np.int64), (gram >> np.uint64(32)).astype(np.int64)
        context = (context >> np.uint64(16)).astype(np.int64)  # 48 bits within one gram
        order = np.lexsort((self.doc, context, self.gram, bucket))
        new = np.ones(len(order), bool)
        if len(order):
            s = [x[order] for x in (bucket, self.gram, context)]
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in s])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        lead = order[new]
        self.e_bucket, self.e_gram, self.e_context, self.e_id = bucket[lead], self.gram[lead], context[lead], self.ids[self.doc[lead]]
        # at most ``hot`` entries of one gram are sent; more than that is hot anyway
        g = np.r_[True, (self.e_gram[1:] != self.e_gram[:-1]) | (self.e_bucket[1:] != self.e_bucket[:-1])] if len(lead) else np.zeros(0, bool)
        heads = np.flatnonzero(g)
        self.nth = np.arange(len(lead)) - np.repeat(heads, np.diff(np.r_[heads, len(lead)]))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes compressed."""
    import zstandard

    raw = np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        k = np.dtype(t)
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return [*out, raw[at:]]


def _low6(x: np.ndarray) -> np.ndarray:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]


def _rows(columns: dict, types: list) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in zip(columns.values(), types)], list(columns))


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans, by doc."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order].astype(np.int64), a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(doc):
        return doc, a, b
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + doc * far)
    head = np.r_[True, a[1:] + doc[1:] * far > reach[:-1]]
    starts = np.flatnonzero(head)
    return doc[starts], a[starts], reach[np.r_[starts[1:] - 1, len(doc) - 1]] - doc[starts] * far


PASS = "part long, chunk int, data binary"
_PASS = [pa.int64(), pa.int32(), pa.binary()]


def _planes(ids: np.ndarray) -> np.ndarray:
    """Integers as eight byte planes, of which the high ones compress to nothing."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).reshape(-1, 8)


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries that chunks sent to one bucket: chunk, gram, context, least doc_id."""
    chunk, gram, context, least = [], [], [], []
    for c, data in zip(table.column("chunk").to_pylist(), table.column("data")):
        delta, low, planes, _ = _unpack(data.as_py(), "<u4", "6u1", "8u1")
        gram.append(np.cumsum(delta, dtype=np.int64))
        low = np.pad(low.reshape(-1, 6), ((0, 0), (0, 2))).reshape(-1).view("<i8")
        context.append(low)
        least.append(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view("<i8"))
        chunk.append(np.full(len(delta), c, np.int64))
    return tuple(np.concatenate(x) for x in (chunk, gram, context, least))


def _judge(gram: np.ndarray, context: np.ndarray, least: np.ndarray, hot: int) -> np.ndarray:
    """The answer to each entry."""
    order = np.lexsort((least, context, gram))
    g, c, d = gram[order], context[order], least[order]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new = new_gram | np.r_[True, c[1:] != c[:-1]]
    heads, firsts = np.flatnonzero(new_gram), np.flatnonzero(new)
    size = np.diff(np.r_[heads, len(g)])
    kinds = np.add.reduceat(new.astype(np.int64), heads)
    smallest = np.repeat(d[firsts], np.diff(np.r_[firsts, len(g)]))
    answer = np.where(d == smallest, np.where(np.repeat(kinds > 1, size), MANY, COLD), SEEN)
    answer[np.repeat(size >= hot, size) & (answer != SEEN)] = FLOOD  # what a smaller doc_id has is settled in any group
    out = np.empty(len(g), np.uint8)
    out[order] = answer
    return out


def _index_spans(ids: np.ndarray, groups: np.ndarray, size: np.ndarray, raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of repeated passages among texts of a bucket; texts of one group share an index.

    Equal texts are indexed once, under their least id: the others' whole texts also occur there, those of the least id have its spans.
    """
    at = np.cumsum(size) - size
    flat = np.frombuffer(raw, np.uint8)
    order = np.argsort(groups, kind="stable")
    head = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]])
    cuts, last = [0], 0
    for h, nxt in zip(head, np.r_[head[1:], len(order)]):
        if nxt - last > INDEXED and h > last:
            cuts.append(int(h))
            last = h
    found = []
    for i, j in zip(cuts, [*cuts[1:], len(order)]):
        mine = order[i:j]
        padded = np.zeros((len(mine), int(size[mine].max())), np.uint8)
        rows = np.repeat(np.arange(len(mine)), size[mine])
        padded[rows, ragged(np.zeros(len(mine), np.int64), size[mine])] = flat[ragged(at[mine], size[mine])] + 1  # UTF-8 has no byte 255
        _, one, same = np.unique(padded.view(f"V{padded.shape[1]}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids[mine])
        text, place = RunIndex(padded[one], size[mine[one]], least, length).marks(least)
        text, start, end = _merged(text, place, place + length)
        own = ids[mine] == least[same]
        copies, first = mine[~own], np.searchsorted(text, same[own])
        spans = np.searchsorted(text, same[own], side="right") - first
        at_span = ragged(first, spans)
        found.append((np.repeat(mine[own], spans), start[at_span], end[at_span]))
        found.append((copies, np.zeros(len(copies), np.int64), size[copies]))
    return tuple(np.concatenate(x) for x in zip(*found))


Finish = Callable[[pa.Table, list[bytes], list[list[tuple[int, int]]]], pa.Table]


def without_repeats(docs: DataFrame, finish: Finish, schema: str, *, length: int = 50, chunk_bytes: int = 12 << 20, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``finish`` to each chunk: its rows, the bytes they keep, and the spans they lose. ``schema``: of what it returns.

    ``docs`` is read several times, so it should be a table or cheap to make anew, and the same each time.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    small_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no column's name clashes
    key, text = f"c{names.index(key)}", f"c{names.index(text)}"
    total = docs.agg(F.sum(F.octet_length(names[int(text[1:])]))).first()[0] or 0
    chunks = buckets = max(1, -(-total // chunk_bytes))
    base = plain.withColumn("__id", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64(key, text))
    base = base.withColumn("__chunk", F.pmod(F.xxhash64("__hash", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    # every pass reads the same exchange of the documents, by chunk
    spread = base.repartition(chunks, "__chunk")

    def send(table: pa.Table) -> pa.Table:
        release_caches()
        give_back()
        chunk = table.column("__chunk")[0].as_py()
        c = Chunk(table, text, length, buckets)
        sent = c.nth < hot
        part, data = [], []
        edges = np.searchsorted(c.e_bucket, np.arange(buckets + 1))
        for b in range(buckets):
            some = np.flatnonzero(sent[edges[b] : edges[b + 1]]) + edges[b]
            if len(some):
                part.append(b)
                data.append(_pack(np.diff(c.e_gram[some], prepend=0).astype("<u4"), _low6(c.e_context[some]), _planes(c.e_id[some])))
        return _rows({"part": part, "chunk": [chunk] * len(part), "data": data}, _PASS)

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        part = table.column("part")[0].as_py()
        chunk, gram, context, least = _answers(table)
        said = _judge(gram, context, least, hot)
        edges = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        return _rows({"part": [part] * (len(edges) - 1), "chunk": chunk[edges[:-1]].tolist(), "data": [_pack(said[a:b]) for a, b in zip(edges, edges[1:])]}, _PASS)

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows({"part": [], "chunk": [], "data": []}, _PASS)
        give_back()
        chunk = left.column("__chunk")[0].as_py()
        c = Chunk(left, text, length, buckets)
        said = np.full(len(c.e_gram), FLOOD, np.uint8)
        edges = np.searchsorted(c.e_bucket, np.arange(buckets + 1))
        for b, data in zip(right.column("part").to_pylist(), right.column("data")):
            own = np.flatnonzero(c.nth[edges[b] : edges[b + 1]] < hot) + edges[b]
            said[own] = _unpack(data.as_py(), "u1")[0]
        status, lead = said[c.entry], c.e_id[c.entry]
        mine = c.ids[c.doc]
        gone = (status == SEEN) | (mine > lead)
        doc, a, b = c.doc[gone], c.a[gone], c.b[gone]
        part, out = [], []
        # contexts for the index
        ship = np.flatnonzero((status == MANY) & ~gone)
        kinds = [(c.e_bucket[c.entry[ship]], c.gram[ship], c.doc[ship], c.a[ship], c.b[ship] - c.a[ship])]
        # windows of hot anchors
        flood = np.flatnonzero((status == FLOOD) & ~gone)
        if len(flood):
            n = c.b[flood] - c.a[flood] - length + 1
            start, owner = ragged(c.a[flood], n), np.repeat(c.doc[flood], n)
            load, hold = _loads(c.flat)
            x = np.full(len(start), length, np.uint64) * K1
            for j in [*range(0, length - 7, 8), length - 8]:
                x = _stir(x, load[start + j])
            x ^= x >> np.uint64(32)
            del hold
            order = np.lexsort((start, c.ids[owner], x))
            x, start, owner = x[order], start[order], owner[order]
            head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            first = np.repeat(c.ids[owner[head]], np.diff(np.r_[head, len(x)]))
            later = c.ids[owner] > first
            doc, a, b = np.r_[doc, owner[later]], np.r_[a, start[later]], np.r_[b, start[later] + length]
            x, start, owner = x[~later], start[~later], owner[~later]
            kinds.append(((x % np.uint64(buckets)).astype(np.int64), (x >> np.uint64(32)).astype(np.int64), owner, start, np.full(len(x), length)))
        to, group, owner, start, size = (np.concatenate(k) for k in zip(*kinds))
        order = np.lexsort((group, to))
        to, group, owner, start, size = (k[order] for k in (to, group, owner, start, size))
        ends = np.searchsorted(to, np.arange(buckets + 1))
        for k in range(buckets):
            i, j = ends[k], ends[k + 1]
            if i < j:
                head = _pack(group[i:j].astype("<u4"), c.ids[owner[i:j]].astype("<i8"), owner[i:j].astype("<u4"), (start[i:j] - c.off[owner[i:j]]).astype("<u4"), size[i:j].astype("<u4"), np.zeros(j - i, "u1"))
                body = _pack(c.flat[ragged(start[i:j], size[i:j])])
                part.append(k)
                out.append(len(head).to_bytes(8, "little") + head + body)
        if len(doc):
            doc, a, b = _merged(doc, a - c.off[doc], b - c.off[doc])
            part.append(-1 - chunk)
            out.append(_pack(doc.astype("<u4"), a.astype("<u4"), b.astype("<u4")))
        return _rows({"part": part, "chunk": [chunk] * len(part), "data": out}, _PASS)

    def match(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:  # spans that are known already
            return table
        give_back()
        cols, raw = [], []
        for chunk, data in zip(table.column("chunk").to_pylist(), table.column("data")):
            data = data.as_py()
            n = int.from_bytes(data[:8], "little")
            got = _unpack(data[8 : 8 + n], "<u4", "<i8", "<u4", "<u4", "<u4")[:5]
            cols.append([*(x.astype(np.int64) for x in got), np.full(len(got[0]), chunk)])
            raw.append(_unpack(data[8 + n :], "u1")[0].tobytes())
        group, ids, owner, start, size, chunk = (np.concatenate(c) for c in zip(*cols))
        t, a, b = _index_spans(ids, group, size, b"".join(raw), length)
        rows = {"part": [], "chunk": [], "data": []}
        for k in np.unique(chunk[t]):
            some = chunk[t] == k
            doc, lost, end = _merged(owner[t[some]], start[t[some]] + a[some], start[t[some]] + b[some])
            rows["part"].append(-1 - int(k))
            rows["chunk"].append(int(k))
            rows["data"].append(_pack(doc.astype("<u4"), lost.astype("<u4"), end.astype("<u4")))
        return _rows(rows, _PASS)

    def cut(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        give_back()
        table = _sorted_chunk(left)
        flat, off = text_bytes(table.column(text).combine_chunks() if table.num_rows else pa.array([], pa.string()))
        got = [_unpack(d.as_py(), "<u4", "<u4", "<u4")[:3] for d in right.column("data")]
        doc, a, b = _merged(*(np.concatenate(x).astype(np.int64) for x in zip(*got))) if got else (np.zeros(0, np.int64),) * 3
        edges = np.searchsorted(doc, np.arange(len(off)))
        kept, spans, raw = [], [], flat.tobytes()
        for i in range(len(off) - 1):
            at, pieces, own = int(off[i]), [], []
            for j in range(edges[i], edges[i + 1]):
                own.append((int(a[j]), int(b[j])))
                pieces.append(raw[at : off[i] + a[j]])
                at = int(off[i] + b[j])
            kept.append(b"".join(pieces) + raw[at : off[i + 1]] if pieces else raw[off[i] : off[i + 1]])
            spans.append(own)
        return finish(table.drop_columns(["__id", "__hash", "__chunk"]).rename_columns(names), kept, spans)

    entries = spread.groupBy("__chunk").applyInArrow(send, PASS)
    answers = entries.groupBy("part").applyInArrow(answer, PASS)
    found = spread.groupBy("__chunk").cogroup(answers.groupBy("chunk")).applyInArrow(collect, PASS)
    spans = found.groupBy("part").applyInArrow(match, PASS)
    return spread.groupBy("__chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, schema)


def digests(docs: DataFrame, *, length: int = 50, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""

    def finish(table: pa.Table, kept: list[bytes], spans: list) -> pa.Table:
        lost = [sum(b - a for a, b in s) for s in spans]
        return pa.table({"doc_id": table.column(key).cast(pa.int64()), "n_bytes": pa.array([len(k) + n for k, n in zip(kept, lost)], pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(list(map(len, spans)), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())})

    return without_repeats(docs.select(key, text), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length, key=key, text=text, **options)


def cleaned(docs: DataFrame, *, length: int = 50, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; characters that were cut through go too, null texts stay null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def finish(table: pa.Table, kept: list[bytes], spans: list) -> pa.Table:
        old = table.column(text)
        new = pa.array([None if not o.is_valid else k.decode("utf-8", "ignore") for o, k in zip(old, kept)], pa.string())
        return table.set_column(table.schema.get_field_index(text), text, new)

    return without_repeats(docs, finish, schema, length=length, key=key, text=text, **options)
