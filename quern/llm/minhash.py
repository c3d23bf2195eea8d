"""Near-duplicate groups by circulant MinHash and exact Jaccard verification (operator 1).

Two permutations make every signature coordinate: the first spreads shingles over a ring of 2^32 places, the second is
applied after a shift of 1, 2, 3 ... places along the ring; coordinate k is the least value under shift k. Bands of
coordinates give buckets. Links are confirmed on full shingle sets.

No link is lost to hot buckets, and no bucket emits all its pairs. Documents with equal sets are one class. Each class is
first verified against the hub (least class) it shares most bands with. In each bucket that still holds several components, the
classes outside the largest are tested against one member of the largest, some rounds long with other members; what then is
still outside is compared with all the bucket's classes in other components, by sketches first and then on full sets. With 30
bands of 5 a pair at the threshold of 0.8 shares no bucket with probability 7e-6; the sketch rules it out with 1e-5, or never
with ``exact``.

Rows are told apart by their row number, not by doc_id, so null or repeated ids meet nothing but their own row. Rows of equal
sets and classes of one component are joined by keys that may hold a third of all rows; the few keys that do are broadcast.

Null text, empty text, no words: an empty set, a component of its own. Fewer words than the width: the whole sequence is one
shingle. Repeated rows: one output row each, linked as equal sets. Null doc_id: judged like any row; it does not count for the
least doc_id unless the whole group has none. Very long texts: read whole, one at a time. Empty table: no rows. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined_by_key, ragged, release_caches, settled, slices, small_batches, tidy, written

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, flat, and where each text's start (and the last end)."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    off = lists.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    some = np.array([w != "" for w in words], bool)
    kept = some[codes] if len(words) else np.zeros(0, bool)
    off = np.r_[0, np.cumsum(kept)][off]
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[codes[kept]]
    n = np.diff(off)
    full, part = np.maximum(0, n - width + 1), (n > 0) & (n < width)
    at = ragged(off[:-1], full)
    h = np.full(len(at), width, np.uint64) * M1
    for j in range(width):
        h = _stir(h + word[at + j]) * M1
    owner = np.repeat(np.arange(len(n)), full)
    if part.any():
        short = []
        for i in np.flatnonzero(part):
            x = np.array([n[i]], np.uint64) * M1
            for j in range(int(n[i])):
                x = _stir(x + word[off[i] + j : off[i] + j + 1]) * M1
            short.append(x)
        h, owner = np.concatenate([h, *short]), np.r_[owner, np.flatnonzero(part)]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(h: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """Circulant MinHash coordinates [texts, count] of non-empty sets (rows of empty sets are meaningless)."""
    ring = (_stir(h) >> np.uint64(32)).astype(np.uint32)  # first permutation: places on the ring
    out = np.zeros((len(off) - 1, count), np.uint32)
    if not len(ring):
        return out
    x, y = np.empty_like(ring), np.empty_like(ring)
    full = np.diff(off) > 0
    starts = off[:-1][full]
    for k in range(count):
        np.add(ring, np.uint32(k + 1), out=x)  # the shift; what follows is the second permutation, one-to-one on 32 bits
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[full, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each text and band."""
    s = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * M1, s.shape[:2]).copy()
    for j in range(rows):
        h = _stir(h + s[:, :, j]) * M1
    return h.view(np.int64)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, root: connected components of edges (a, b), by hooking roots to smaller neighbours and jumping pointers.

    Every edge is looked at until its ends agree; links and components stay distributed.
    """
    labels = nodes.select(F.col(node).alias("node"), F.col(node).alias("root"))
    while True:
        a, b = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = edges.join(a, "a").join(b, "b").where("ra <> rb")
        hooks = written(open_.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("up")))
        if hooks.isEmpty():
            return labels
        for _ in range(2):
            above = hooks.select(F.col("root").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(above, "up", "left").select("root", F.coalesce("top", "up").alias("up"))
        labels = written(labels.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root")))


def links_within(mixed: DataFrame, percent: int, block: int, exact: bool = False) -> DataFrame:
    """Links a < b of one bucket between different components, one end being outside the bucket's largest.

    A sketch holds the low bytes of coordinates; a pair is ruled out where its agreement lies more than 4.3 standard deviations
    below that of a pair at the threshold (never, if ``exact``); the others are confirmed on full sets. The classes outside the
    largest component and those inside are each cut into blocks of about ``block`` shingles. An outside block meets every inside
    block and every outside block; inside blocks don't meet each other, so where one block holds all that is outside, an inside
    class is sent once; an outside block meets itself where it meets the first inside block. Blocks are compared within numpy, so only links become rows. A pair that shares several buckets comes
    from the first.
    """
    out = F.col("root") != F.col("main")
    blocks = lambda rows: F.ceil(F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0)) / block).cast("int")
    sizes = mixed.groupBy("band").agg(blocks(out).alias("outer"), blocks(~out).alias("inner"))
    cut = mixed.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.when(out, F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    within = F.transform(numbers("inner"), lambda j: cell(0, F.col("own"), j))
    among = F.transform(F.filter(numbers("outer"), lambda j: j != F.col("own")), lambda j: cell(1, F.least("own", j), F.greatest("own", j)))
    met = F.transform(numbers("outer"), lambda i: cell(0, i, F.col("own")))
    cut = cut.withColumn("cell", F.explode(F.when(out, F.concat(within, among)).otherwise(met))).select("*", "cell.*")

    def compare(table: pa.Table) -> pa.Table:
        node, n, root, own = (table.column(c).to_numpy() for c in ("node", "n", "root", "own"))
        band, kind, i, j, main = (table.column(c)[0].as_py() for c in ("band", "kind", "i", "j", "main"))
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        lists = table.column("shingles").combine_chunks()
        value, off = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        width, t = sketch.shape[1], percent / 100
        least = width * (t - 4.3 * np.sqrt(t * (1 - t) / width))
        out_a, out_b = [], []
        outside = root != main
        left = np.flatnonzero(outside & ((kind == 0) | (own == i)))
        right = ~outside | (j == 0) if kind == 0 else own == j
        for x in left:
            with_ = np.flatnonzero(right & (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])) & ((node > node[x]) | ~outside | (kind == 1)))
            if len(with_) and not exact:
                with_ = with_[(sketch[with_] == sketch[x]).sum(1) >= least]
            if len(with_):
                same = keys[with_] == keys[x]
                with_ = with_[keys[x][same.argmax(1)] == band]
            if len(with_):
                own_set, theirs = np.sort(value[off[x] : off[x + 1]]), value[ragged(off[with_], n[with_])]
                at = np.minimum(np.searchsorted(own_set, theirs), len(own_set) - 1)
                common = np.add.reduceat((own_set[at] == theirs).astype(np.int64), np.cumsum(n[with_]) - n[with_])
                with_ = with_[100 * common >= percent * (n[x] + n[with_] - common)]
                out_a.append(np.full(len(with_), node[x]))
                out_b.append(node[with_])
        a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # a pair may be outside the largest component in two ways in different buckets, so it may still come twice
    return cut.groupBy("band", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, rounds: int = 2, sketch: int = 300, block: int = 2_000_000, exact: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each document.

    ``docs`` is read twice, so it should be a table or cheap to make anew, and in the same order each time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tidy(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_caches()
        for part in slices(batches, "text", 1 << 20):
            h, off = shingles(part.column(1), width)
            coordinates = signatures(h, off, max(sketch, bands * rows))
            keys = band_keys(coordinates[:, : bands * rows], bands, rows)
            sketches = [x.tobytes() for x in coordinates[:, :sketch].astype(np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            whole = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(off)), pa.array(whole, pa.binary()), lists, pa.array(sketches, pa.binary())], ["doc_id", "row", "n", "content", "bands", "sketch"])

    signed = written(source.mapInArrow(sign, "doc_id long, row long, n long, content binary, bands array<long>, sketch binary"))
    by_root = settled(spark, lambda: _rooted(source, signed, width, percent, rounds, block, exact))
    total, rows_ = by_root.count(), signed.count()
    least = by_root.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("classes"))
    of_class = joined_by_key(by_root.select("root", "content", "copies"), least, "root", "classes", total).drop("root")
    out = joined_by_key(signed.where("n > 0").select("doc_id", "n", "content"), written(of_class), "content", "copies", rows_).drop("content")
    out = out.unionByName(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _rooted(source: DataFrame, signed: DataFrame, width: int, percent: int, rounds: int, block: int, exact: bool) -> DataFrame:
    """The classes of equal sets, each with the root of its component: node, content, least_id, copies, root."""
    classes = signed.where("n > 0").groupBy("content").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    members = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = written(members.join(buckets.select("band", "hub"), "band"))
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"  # what sizes alone allow
    hubs = classes.select(F.col("node").alias("hub"), F.col("n").alias("m"))
    star = members.where("node <> hub").groupBy("node", "hub", "n").agg(F.count("*").alias("common")).join(hubs, "hub").where(near)
    first = written(star.groupBy("node").agg(F.max_by("hub", F.struct("common", -F.col("hub"))).alias("b")).withColumnRenamed("node", "a"))

    # sets of the classes that share a bucket, made anew from their texts
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "content", "row")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release_caches()
        for part in slices(batches, "text", 1 << 20):
            h, off = shingles(part.column(1), width)
            content = part.column(2).to_pylist()
            if any(xxhash.xxh3_128_digest(h[a:b].tobytes()) != c for a, b, c in zip(off, off[1:], content)):
                raise ValueError("the documents came in another order when they were read again")
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "shingles"])

    texts = source.join(wanted, "row")
    full = written(texts.select("node", "text", "content").mapInArrow(sets, "node long, shingles array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("s"))
        return both.where(f"100 * i >= {percent} * (s - i)").select("a", "b")

    nodes = classes.select("node")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tested, edges = first.select(*ordered), verified(first.select("a", "b"))
    edges = written(edges)
    roots = components(nodes, edges)
    for turn in range(rounds + 1):
        placed = members.join(roots, "node").select("band", "node", "n", "root")
        # the largest component of each bucket that holds several
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("size")).groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"))
        mixed = written(placed.join(sizes.where("roots > 1").select("band", "main"), "band"))
        rest = mixed.where("root <> main").select("band", F.col("node").alias("a"), "n")
        if turn < rounds:  # one member of the main component for each bucket, another one each time
            some = mixed.where("root = main").groupBy("band").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "band", F.lit(turn))).alias("x"))
            others = some.select("band", F.col("x.node").alias("b"), F.col("x.n").alias("m"))
            pairs = written(rest.join(others, "band").where(near).select(*ordered).distinct().join(tested, ["a", "b"], "left_anti"))
            tested, found = tested.unionByName(pairs), verified(pairs)
        else:
            found = links_within(mixed.join(classes.select("node", "bands", "sketch"), "node").join(full, "node"), percent, block, exact)
        found = written(found)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            roots = components(nodes, edges)

    return classes.select("node", "content", "least_id", "copies").join(roots, "node")
