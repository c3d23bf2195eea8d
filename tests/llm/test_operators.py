"""Operators against brute force, round trips, held-out accuracy, and edge rows: nulls, empties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import bpe, chat, jpeg, minhash, packing, pii, quality, repeats, rules, sstable, tokens
from quern.llm.queries import LIBRARY_VOCABULARY, RANKS

SF = "/root/testdata/sf0.001"
rng = random.Random(7)
LONG = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(i % 97) for i in range(4000))
EDGE = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, "one"), (6, "one"), (6, "one"), (7, "A\nB\n\nA x  y\t z"), (None, "no id here"), (8, LONG[:900] + "!"), (9, "a" * 300), (10, " \n ")]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("rank", T.StringType())])


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", k, "c", "r") for k, (i, t) in enumerate(EDGE)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1)], "doc_id long, quality int")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def components(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, edge, width):
    base = LONG.split()
    near = [(100 + i, " ".join(w if rng.random() > 0.04 else "x" for w in base[:120])) for i in range(40)]
    rows = EDGE + near
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.groups(df, width=width).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == components(rows, width)
    assert minhash.groups(edge.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{"block": 300, "rounds": 0}, {"block": 300, "rounds": 0, "exact": True}, {}])
def test_near_duplicates_of_many_rows_without_ids(spark, options):
    r = random.Random(3)
    seeds = [[f"w{k}x{r.randrange(40)}" for _ in range(60)] for k in range(4)]
    rows = [(None if i % 3 else i // 90, " ".join(w if r.random() > 0.03 else f"n{r.randrange(9)}" for w in seeds[r.randrange(4)])) for i in range(400)]
    rows += [(None, ""), (None, None), (3, " ")] * 5 + [(None, "the same words again")] * 30
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, row int, node int, content string")
    got = minhash.groups(df, width=2, **options).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got) == components(rows, 2)


def repeated(rows, length=50):
    first = {}
    order = lambda d: -(1 << 63) if d is None else d
    for d, t in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append(str((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_passages(spark, edge, hot):
    shared = [LONG[i * 300 : i * 300 + 55 + i] for i in range(6)]
    rows = EDGE + [(50 + i, f"{i} start {rng.choice(shared)} mid{i * i} {rng.choice(shared)}{'é' * i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.digests(df, chunk_bytes=20_000, hot=hot).collect()
    assert sorted(str(tuple(r)) for r in got) == repeated(rows)
    clean = repeats.cleaned(edge)
    assert clean.columns == edge.columns and clean.count() == len(EDGE) and clean.where("text IS NULL").count() == 1
    assert repeats.digests(edge.limit(0)).count() == 0


def test_rows_of_one_id_are_dealt_to_many_chunks(spark):
    shared = [LONG[i * 300 : i * 300 + 120] for i in range(5)]
    rows = [(None if i % 3 else 7 + i % 2, f"{i}x {rng.choice(shared)} {'y' * (i % 60)} {rng.choice(shared)}") for i in range(90)] + [(None, "same text over and over, longer than fifty bytes " * 3)] * 40
    df = spark.createDataFrame([(d, t, "a", "b", 1) for d, t in rows], "doc_id long, text string, __id string, c0 string, __chunk int")
    got = repeats.digests(df, chunk_bytes=1_000).collect()
    assert sorted(str(tuple(r)) for r in got) == repeated(rows)
    clean = repeats.cleaned(df, chunk_bytes=1_000)
    assert clean.columns == df.columns and clean.where("__id = 'a' AND c0 = 'b' AND __chunk = 1").count() == len(rows)


def test_equal_texts_of_a_bucket_are_indexed_once(monkeypatch):
    texts = [rng.choice(b"abcdefgh").to_bytes() * 30 + bytes(rng.choice(b"xyz") for _ in range(50)) for _ in range(20)] * 30
    texts += [t[10:] for t in texts[:20]]
    ids, size = np.array([rng.randint(-5, 400) for _ in texts]), np.array(list(map(len, texts)))
    rows, plain = [], repeats.RunIndex
    monkeypatch.setattr(repeats, "RunIndex", lambda padded, *rest: rows.append(len(padded)) or plain(padded, *rest))
    found = repeats._index_spans(ids, np.zeros(len(texts), np.int64), size, b"".join(texts), 50)
    assert sum(rows) <= 40
    lost = [set() for _ in texts]
    for t, a, b in zip(*map(np.ndarray.tolist, found)):
        lost[t] |= set(range(a, b))
    first: dict = {}
    for i, t in zip(ids.tolist(), texts):
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    for i, t, gone in zip(ids.tolist(), texts, lost):
        assert gone == {q for p in range(len(t) - 49) if first[t[p : p + 50]] < i for q in range(p, p + 50)}


def test_run_index_takes_bounded_memory_a_suffix():
    import tracemalloc

    r = np.random.default_rng(3)
    padded, size = r.integers(97, 123, (5_000, 80), np.uint8), np.full(5_000, 80)
    tracemalloc.start()
    repeats.RunIndex(padded, size, np.arange(5_000), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 5_000 * 81


def test_contexts_that_a_smaller_id_has_are_settled_in_hot_groups_too():
    gram, context, least = np.full(9, 4), np.repeat([1, 2, 3], 3), np.array([5, 2, 9, 1, 1, 8, 6, 7, 7])
    S, F_ = repeats.SEEN, repeats.FLOOD
    assert repeats._judge(gram, context, least, 3).tolist() == [S, F_, S, F_, F_, S, F_, S, S]


def test_run_index_walks_back_through_texts():
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 70))) for _ in range(30)]
    size = np.array(list(map(len, texts)))
    padded = np.zeros((30, size.max()), np.uint8)
    for i, t in enumerate(texts):
        padded[i, : len(t)] = np.frombuffer(t, np.uint8)
    index = repeats.RunIndex(padded, size, np.arange(30), 20)
    row, back = np.arange(30), [b""] * 30
    for _ in range(int(size.max())):
        run = index.run[row]
        row, char = index.lf(row, run), index.char[run]
        back = [bytes([c]) + b if c else b for c, b in zip(char, back)]
        row = np.where(char > 0, row, 0)
    assert all(b.endswith(t) for b, t in zip(back, texts))
    marks = set(zip(*map(np.ndarray.tolist, index.marks(np.arange(30)))))
    seen: dict = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 19):
            assert ((i, p) in marks) == (seen.setdefault(t[p : p + 20], i) < i)


def test_quality_rules(spark, edge, labels):
    got = {(r.doc_id, r.n_words): r for r in rules.judged(edge, labels).collect()}
    assert got[(3, 0)].base_failed and not got[(3, 0)].kept and got[(7, 6)].n_dup_lines == 0 and got[(1, 4000)].base_failed
    text = "a b c a b c x\na b c a b c x\n#|> ff"
    r = rules.features(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.n_symbols, r.word_chars) == (16, 14, 1, 3, 19)
    from math import comb, log

    for n, k, p in ((50, 0, 0.1), (200, 7, 0.1), (400, 39, 0.1), (5000, 180, 0.05)):
        exact = log(sum(comb(n, i) * round(1 / p - 1) ** (n - i) for i in range(k + 1))) - n * log(round(1 / p))
        assert spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k")).select(rules.log_tail(p)).first()[0] == pytest.approx(exact)
    huge = spark.range(1).select(F.lit(10**9).alias("n"), F.lit(49_900_000).alias("k")).select(rules.log_tail(0.05)).first()[0]
    assert -111 < huge < -108  # 14.5 standard deviations below the mean
    assert rules.judged(edge.limit(0), labels).count() == 0


def _duck(sql, **tables):
    import duckdb

    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t)
    return c.execute(sql).fetchall()


def test_thresholds_hold_back_where_labels_are_few(spark):
    """Each language has its own rate of marks among good and bad documents; SQL and rules must agree on all rows."""
    from quern.llm.queries import ORACLE_SQL

    r = random.Random(11)
    rows = []
    for i in range(3000):
        lang = ("en", "de", "fr", None)[i % 4]
        bad = r.random() < 0.2
        marks = r.random() < (0.8 if bad else {"en": 0.0, "de": 0.01, "fr": 0.3, None: 0.0}[lang])
        shout = r.random() < (0.5 if bad else 0.0 if lang == "en" else 0.2)
        words_ = [f"{chr(97 + i % 26)}{j}" + ("$" if marks else "") + ("!" if shout else "") for j in range(60)]
        rows.append((i, "word " * 9 + " ".join(words_), lang, int(not bad)))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    marked = spark.createDataFrame([(x[0], x[3]) for x in rows if x[2] is not None or x[0] % 40 == 3], "doc_id long, quality int")
    got = {x.doc_id: x.failed_rules for x in rules.judged(docs, marked).collect()}
    langs = {lang: {f for x in rows if x[2] == lang for f in got[x[0]]} for lang in ("en", "de", "fr", None)}
    assert langs == {"en": {"symbols", "bangs"}, "de": {"symbols"}, "fr": set(), None: set()}
    good = {lang: [bool(got[x[0]]) for x in rows if x[2] == lang and x[3]] for lang in langs}
    assert all(sum(v) <= 0.05 * len(v) for v in good.values())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    own = sorted(tuple(x) for x in rules.judged(docs, marked).select(*columns).collect())
    want = sorted(_duck(ORACLE_SQL["op2_quality_rules"], documents=docs.toArrow(), labels=marked.toArrow()))
    assert own == want and 100 < sum(not x[-1] for x in own) < 700


def test_classifier(spark, edge, labels):
    from quern.llm import queries as q

    got = q.op4_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    few = quality.scored(edge, labels).collect()
    assert len(few) == len(EDGE) and all(0 <= r.score <= 1 for r in few)
    assert quality.scored(edge.limit(0), labels).count() == 0


def test_statistics_are_those_of_a_plain_reading(spark, edge, labels):
    for _, t in EDGE + [(0, "AB ab!\n\nAB ab!\n x.y, 12 %")]:
        raw, text = (t or "").encode(), t or ""
        got = dict(zip(quality.NAMES, quality.statistics(raw)))
        words_, lines_ = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        n, m = max(1, len(raw)), max(1, len(words_))
        want = {
            "log_bytes": np.log1p(len(raw)), "upper": sum(c in range(65, 91) for c in raw) / n, "digit": sum(chr(c).isdigit() for c in raw if c < 128) / n, "newline": raw.count(b"\n") / n,
            "markup": sum(text.count(c) for c in "#*$%&|<>") / n, "stop": (text.count(".") + text.count("?")) / n, "bang": text.count("!") / n, "high": sum(c > 127 for c in raw) / n,
            "log_words": np.log1p(len(words_)), "word_length": sum(map(len, words_)) / m, "longest_word": max(map(len, words_), default=0), "distinct_words": len(set(words_)) / m,
            "top_word": max((words_.count(w) for w in set(words_[:50])), default=0) / m if len(words_) < 50 else got["top_word"], "log_lines": np.log1p(len(lines_)),
            "dup_lines": 1 - len(set(lines_)) / max(1, len(lines_)), "line_length": len(raw) / max(1, len(lines_)), "upper_words": sum(w.isupper() for w in words_) / m,
        }
        assert {k: got[k] for k in want} == pytest.approx(want), t
    scored = quality.scored(edge, labels).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in scored)
    assert len({r.score for r in scored if r.doc_id == 6}) == 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (i % 40 + 1) + "$" * (i % 3)) for i in range(400)], "doc_id long, text string")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    one = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    other = spark.createDataFrame([(i, int(i % 3 == 0) if i in held else int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    few = quality.scored(docs, one, sample=50).collect()
    assert len(few) == 400
    a, b = (sorted(quality.scored(docs, x).collect()) for x in (one, other))
    assert a == b and {r.doc_id for r in a if r.held_out} == set(held)


def test_trees_separate_what_can_be_separated():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    p = quality.Trees().fit(x[:1500], y[:1500]).score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(RANKS, P.PATTERN)[0].ranks, special_tokens={})


def foreign_jpeg(blocks, width, height, dc_len, ac_len, restart, quantiser):
    """A baseline file written bit by bit, with tables of its own; blocks: zigzag coefficients."""
    (dc, dc_body), (ac, ac_body) = jpeg._codes(dc_len), jpeg._codes(ac_len)
    seg = lambda m, b: bytes((0xFF, m)) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, b"\x13" + b"".join(q.to_bytes(2, "big") for q in quantiser))
    out += seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\1\1\x11\3") + b"\xff" + seg(0xC4, b"\1" + dc_body + b"\x12" + ac_body)
    out += (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, b"\1\1\x12\0\x3f\0")

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    bits, last, nth, step = "", 0, 0, restart or len(blocks)
    for i in range(0, len(blocks), step):
        for block in blocks[i : i + step]:
            n, tail = number(block[0] - last)
            last = block[0]
            bits += format(dc[n], f"0{dc_len[n]}b") + tail
            run = 0
            for k in range(1, 64):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + format(ac[0xF0], f"0{ac_len[0xF0]}b"), run - 16
                n, tail = number(block[k])
                bits, run = bits + format(ac[run << 4 | n], f"0{ac_len[run << 4 | n]}b") + tail, 0
            if run:
                bits += format(ac[0], f"0{ac_len[0]}b")
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits, last = "", 0
        if i + step < len(blocks):
            out += bytes((0xFF, 0xD0 + nth % 8))
            nth += 1
    return out + b"\xff\xd9trailing bytes"


def test_foreign_files_with_their_own_tables_in_one_batch():
    r = random.Random(4)
    ac_one = {run << 4 | n: 9 + (run % 3) for run in range(16) for n in range(1, 11)} | {0xF0: 11, 0: 3}
    ac_two = {run << 4 | n: 12 for run in range(16) for n in range(1, 11)} | {0xF0: 5, 0: 2}
    files, want = [], []
    for k in range(6):
        w, h = r.choice([(8, 8), (17, 9), (40, 33), (64, 16)])
        blocks = [[r.randint(-900, 900)] + [r.choice([0] * 9 + [r.randint(-500, 500)]) for _ in range(63)] for _ in range(-(-w // 8) * -(-h // 8))]
        files.append(foreign_jpeg(blocks, w, h, {n: 4 + (n > 5) * (k % 2) for n in range(12)}, (ac_one, ac_two)[k % 2], (0, 3)[k // 3], [300 + k] * 64))
        want.append(blocks)
    payload = np.arange(640, dtype=np.int64).astype(np.uint8)
    files.insert(2, jpeg.encode(payload, np.array([0, 640]))[0])
    coef, at, heads = jpeg.coefficients(files)
    ends = [*at.tolist()[1:], len(coef)]
    assert coef[at[2] : ends[2]].astype(np.uint8).tobytes()[:640] == payload.tobytes()
    for i, blocks in zip([0, 1, 3, 4, 5, 6], want):
        assert coef[at[i] : ends[i]].tolist() == blocks
        light = [min(255, max(0, (b[0] * heads[i]["dqt"][3][0] + 4) // 8 + 128)) for b in blocks]
        assert jpeg.thumbnail(coef[at[i] : ends[i]], heads[i]).ravel().tolist() == light
    for bad in (b"GIF89a", files[0].replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def test_long_payloads_are_encoded_a_group_at_a_time(monkeypatch):
    r = np.random.default_rng(8)
    payloads = [r.choice([0, 0, 97, 255], 64 * n).astype(np.uint8) for n in (1, 300, 17, 1000)]
    off = np.r_[0, np.cumsum(list(map(len, payloads)))]
    whole = jpeg.encode(np.concatenate(payloads), off)
    monkeypatch.setattr(jpeg, "GROUP", 64)
    assert jpeg.encode(np.concatenate(payloads), off) == whole


LITERALS = [(20, "see <|endoftext|> here"), (21, "see<|endoftext|>here  <|endoftext|>"), (22, "a\n <|endoftext|>\n b <|endoftext"), (23, " <|endoftext|>"), (6, "another text of id six"), (None, "and another without id")]


@pytest.fixture(scope="module")
def spelled(spark, edge):
    return edge.unionByName(spark.createDataFrame([(i, t, "en", 0, "c", "r") for i, t in LITERALS], SCHEMA))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(LIBRARY_VOCABULARY)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards(spark, edge, spelled, library):
    import xxhash

    order = lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64), r[1] or "")
    want, at = [], 0
    for d, t in sorted(EDGE + LITERALS, key=order):
        ids = library(t) + [2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    for size in (24 << 20, 2000):
        got = sstable.token_table(spelled, LIBRARY_VOCABULARY, shard_bytes=size, block_bytes=500).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sstable.token_table(edge.limit(0), LIBRARY_VOCABULARY).count() == 0


def test_one_id_is_cut_into_several_shards_in_order_of_their_numbers(spark, library, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BLOCK", 3)
    rows = [(None if i % 2 else 5, f"text {i} " * 30) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sstable.token_table(df, LIBRARY_VOCABULARY, shard_bytes=3000).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(library(t)) + 1, crc(library(t) + [2])) for _, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None) == (r.start < sum(x.n_tokens for x in got if x.doc_id is None))
        at += r.n_tokens


@pytest.mark.parametrize("texts", [["", None, ""], [None], ["a"], ["", "one two  three", None, "one two", " ", "one two  three", "é" * 300 + " <|endoftext|> x"], [LONG, "", LONG[7:9000]]])
def test_columns_are_encoded_like_single_texts(library, texts):
    flat, off = tokens.library_encoder(LIBRARY_VOCABULARY)(pa.chunked_array([pa.array(["before", *texts, "after"])]).combine_chunks().slice(1, len(texts)))
    assert off[0] == 0 and len(off) == len(texts) + 1 and len(flat) == off[-1]
    for t, a, b in zip(texts, off[:-1], off[1:]):
        assert flat[a:b].tolist() == library(t)


def test_pieces_become_strings_without_a_scalar_each():
    import time

    column = pa.array([f" w{i}" for i in range(200_000)])
    times = []
    for make in (tokens._strings, pa.Array.to_pylist):
        made, best = None, 9.0
        for _ in range(3):
            t = time.thread_time()
            made = make(column)
            best = min(best, time.thread_time() - t)
        times.append(best)
        assert made[::50_000] == [" w0", " w50000", " w100000", " w150000"]
    assert times[0] < 0.6 * times[1]


def test_shard_numbers_pass_the_width_of_file_names():
    data = [b"".join(x + b"\n" for x in sstable.sections(iter([(i, b"\1\0")]), 2, 100, i)) for i in (99_999, 100_000)]
    assert [sstable.Shard(d).number for d in data] == [99_999, 100_000]


def test_shard_lookup():
    rows = [(i * 3 - 50, np.arange(i % 7, dtype="<u2").tobytes()) for i in range(500)]
    shard = sstable.Shard(b"".join(s + b"\n" for s in sstable.sections(iter(rows), 2, 200)))
    assert [(i, x.tobytes()) for i, x in shard] == rows and len(shard.index) > 5
    assert all(shard.get(i).tobytes() == x for i, x in rows)
    assert all(shard.get(i + 1) is None for i, _ in rows) and shard.get(None) is None


def test_media(edge):
    got = {r.doc_id: r for r in jpeg.media_table(edge).where("doc_id IS NOT NULL").collect()}
    for d, t in EDGE:
        if d is not None:
            raw = (t or "").encode()
            padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            r = got[d]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[1].media_sha256 == got[2].media_sha256 and got[1].feature == got[2].feature
    assert jpeg.media_table(edge.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jpeg_round_trip(seed):
    r = np.random.default_rng(seed)
    payloads = [r.choice([0, 0, 0, 255, 128, 97], 64 * int(n)).astype(np.uint8) for n in r.integers(1, 90, 20)]
    off = np.r_[0, np.cumsum(list(map(len, payloads)))]
    coef, at, heads = jpeg.coefficients(jpeg.encode(np.concatenate(payloads), off))
    for p, a, h in zip(payloads, at, heads):
        assert coef.astype(np.uint8).tobytes()[a * 64 : a * 64 + h["size"]] == p.tobytes()


def cut(rows, library, size):
    """Every piece that packing must make."""
    out = []
    for d, t in rows:
        ids = library(t) + [0]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % size or size
            out.append((d, k, at, n, crc(ids[at : at + n])))
            at, k = at + n, k + 1
    return out


def best_fit_decreasing(lengths, size):
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else size) - n)
    return gaps


def packed(rows, size):
    """Places are gapless from 0 and within ``size``; the number of sequences."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [100, 2048])
def test_packing(spark, edge, spelled, library, size):
    many = [(1000 + i, "word " * rng.choice([1, 3, 3, 17, 40, 60, 61, 300])) for i in range(150)]
    rows = EDGE + LITERALS + many
    docs = spelled.unionByName(spark.createDataFrame([(i, t, "en", 0, "c", "r") for i, t in many], SCHEMA))
    got = packing.packed_documents(docs, LIBRARY_VOCABULARY, size=size).collect()
    want = cut(rows, library, size)
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(str, want))
    assert packed(got, size) == len(best_fit_decreasing([w[3] for w in want], size))
    assert packing.packed_documents(edge.limit(0), LIBRARY_VOCABULARY).count() == 0


def test_supersteps_over_many_partitions_pack_like_one_sweep(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lengths = [rng.choice([7, 7, 7, rng.randint(1, 60), rng.randint(1, 20)]) for _ in range(3000)]
        rows = [(None if i % 3 else i, 0, 0, n, n) for i, n in enumerate(lengths)]
        got = packing.pack(spark.createDataFrame(rows, packing.PIECE).repartition(7), size=60).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.length for r in got) == sorted(lengths)
    assert packed(got, 60) == len(best_fit_decreasing(lengths, 60))


def test_sweep_is_best_fit_decreasing():
    for _ in range(200):
        size = rng.randint(5, 60)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 80))]
        gaps = best_fit_decreasing(lengths, size)
        slots, opened = packing.sweep({n: lengths.count(n) for n in lengths}, size)
        assert opened == len(gaps)
        used: dict = {}
        for before, first, n, length, _, offset in slots:
            assert before == 0
            for k in range(n):
                assert used.get(first + k, 0) == offset
                used[first + k] = offset + length
        assert sorted(size - u for u in used.values()) == sorted(gaps)


def test_byte_pairs(edge, tiktoken_encoding):
    got = sorted(str(tuple(r)) for r in bpe.digests(edge, RANKS, P.PATTERN).collect())
    want = []
    for d, t in EDGE:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append(str((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)
    own, encode = bpe.codec(RANKS, P.PATTERN)
    tokens = list(own.ranks)
    for _ in range(3000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
        assert own.encode_piece(piece) == tiktoken_encoding._core_bpe.encode_single_piece(piece)
    texts = ["".join(rng.choice(["a", " ", "  ", "\n", "\t", "　", "\xa0", "'s", "é", "1", "!", "漢"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids, off = encode(pa.array(texts))
    assert all(ids[off[i] : off[i + 1]].tolist() == tiktoken_encoding.encode_ordinary(t) for i, t in enumerate(texts))


def test_chat(spark):
    hard = [r"\### Assistant: </turn> ok", "", None, "a</turn>\n### User: b", "\\", "</turn", "x: y\n", "#" * 7]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool: x", None, "User"]), rng.choice(hard)) for c in range(30) for t in range(rng.randint(1, 6))] + [(None, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.formatted(df).collect()
    assert all(r.exact for r in got) and len(got) == 31
    loss = {r.conv_id: r.loss_sha256 for r in chat.digests(chat.formatted(df)).collect()}
    for r in got:
        assert loss[r.conv_id] == hashlib.sha256("".join(t.text for t in r.source if t.role == "assistant").encode()).hexdigest()
        assert r.formatted.count("</turn>") >= len(r.source)
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
    clash = df.withColumns({c: F.lit("x") for c in ("source", "formatted", "mask", "turns", "exact", "t", "shown")})
    assert sorted(map(str, chat.formatted(clash).collect())) == sorted(map(str, got))


def test_chat_escapes_whole_conversations_until_they_are_identical(spark, monkeypatch):
    hard = [r"\### Assistant: </turn> ok", "a</turn>\n### User: b", "plain"]
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(hard)], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "render_turn", lambda role, text: f"concat({chat.head(role)}, {text}, '</turn>\\n')")  # escapes nothing
    got = chat.formatted(df).first()
    assert got.exact and [t.text for t in got.source] == hard and [t.text for t in got.turns] == hard
    assert chat.digests(chat.formatted(df)).first().loss_sha256 == hashlib.sha256("".join(hard).encode()).hexdigest()
    monkeypatch.setattr(chat, "escaped_turn", chat.render_turn)
    with pytest.raises(Exception, match="no reversible format"):
        chat.formatted(df).collect()


PLAIN = {  # the base patterns as they are given, with their tests
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_spans(text):
    out = [(m.start(), k, m.end()) for k, (pattern, test) in enumerate(PLAIN.values()) for m in re.finditer(pattern, text) if test(m[0])]
    return sorted(out)


def test_base_spans_are_those_of_the_plain_patterns():
    text = "mail a.b@c.de, x@y no; 1.2.3.4 and 1.2.3.400; 4111 1111 1111 1111 4111111111111112; +1 (555) 555-0100. "
    assert pii.written_out(pii.base_spans(text)) == "email:5:13,ip:23:30,phone:84:101"
    assert pii.written_out(pii.base_spans("4111 1111 1111 1111, 378282246310005.")) == "card:0:19,card:21:36"
    r = random.Random(2)
    bits = ["a@b.c", "@", ".", "..", "1.2.3.4", "01.02.003.4", "256.1.1.1", "1", "12", "999", " ", "-", "+", "+1", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "\n", "x", "_", "%", "5500-0000-0000-0004", "+49 30 1234567", "0", "٣"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data_of_every_row(spark, edge):
    r = random.Random(9)
    rows = [(i, pii.labelled_text(r)[0]) for i in range(60)] + [(60, None), (61, ""), (None, "call +1 (555) 555-0100"), (None, "call +1 (555) 555-0100"), (62, "1" * 5000 + "@" * 3000), (63, "word " * 5000 + "a@b.co")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = sorted(str(tuple(x)[:-1]) for x in pii.detected(df).collect())
    want = []
    for d, t in rows:
        base = plain_spans(t or "")
        want.append(str((d, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())))
    assert got == sorted(want)
    for x in pii.detected(df).collect():
        spans = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in x.spans.split(",") if s)]
        assert spans == sorted(spans) and all(a < b for a, _, b in spans)
        assert {s[1] for s in spans} >= {k for k in pii.KINDS if x[f"n_{k}"]}
    assert pii.detected(edge).count() == len(EDGE) and pii.detected(edge.limit(0)).count() == 0
    masked = pii.redacted(df)
    assert masked.columns == df.columns and masked.where("text IS NULL").count() == 1
    assert [x.text for x in masked.where("doc_id = 63").collect()] == ["word " * 5000 + "[EMAIL]"]


# labelled by hand; spans between braces are personal data that the base rules don't know
LOOK_ALIKES = """
Please ring the office at {(212) 555-0147} before noon, or leave a note.
Our fax is {415-555-2671} and the desk opens at 9:30.
The night shift answers on {0049 30 5550182} until 22:15.
Dial {030/5550199} and ask for room 12.
Contact {maria.lopez (at) rivera.org} for the minutes of 2019-04-12.
Write to {jo_doe[at]mail.example.com} with ticket 8841.
The donor paid with {4111.1111.1111.1111} on 3.5.2021.
Her old card {5500/0000/0000/0004} was cut in two.
Support: {646.555-0190} (weekdays), chapter 3, pp. 110-118.
For the choir call {0171-5550123} after six.
Released as version 10.4.2 on 2020-11-30 with 48 fixes.
The years 1914-1918 and 1939-1945 are treated in volume 2.
ISBN 978-3-16-148410-0 is out of print since 1999.
Order 20231130004512 was shipped in 3 parcels of 12.5 kg.
The budget rose from $45.10 to $1,204,300.50 in 2018.
See section 4.2.1 and figure 12 (page 301) for details.
token = "9f86d081884c7d659a2feaa0c55ad015" expires at 23:59:59
He finished in 2:04:11, ahead of 1500 runners (85%).
id 4111111111111112 fails its check digit, as does no. 1234567890123.
Follow @teacher42 or ask user@localhost about build 7.
"""


def test_the_tagger_finds_what_the_rules_do_not_know():
    texts, gold = [], []
    for line in LOOK_ALIKES.strip().split("\n"):
        at = [m.start() for m in re.finditer("[{}]", line)]
        gold.append([(a - 2 * k, b - 2 * k - 1) for k, (a, b) in enumerate(zip(at[::2], at[1::2]))])
        texts.append(re.sub("[{}]", "", line))
    assert not any(map(plain_spans, texts))
    found = [[(s[0], s[2]) for s in spans] for _, spans in pii.find(texts, pii.trained())]
    hits = sum(len(set(f) & set(g)) for f, g in zip(found, gold))
    assert hits >= 0.8 * sum(map(len, gold)), (found, gold)  # recall beyond the rules
    assert hits >= 0.8 * sum(map(len, found)), (found, gold)  # and precision


def test_the_tagger_on_held_out_texts():
    r = random.Random(5)
    texts, gold = zip(*(pii.labelled_text(r) for _ in range(80)))
    found = [[s for s in f if pii.possible(t, s)] for t, f in zip(texts, pii.model_spans(list(texts), pii.trained()))]
    hits = sum(len(set(g) & set(f)) for g, f in zip(gold, found))
    assert hits / sum(map(len, gold)) > 0.9 and hits / sum(map(len, found)) > 0.9


def test_the_path_of_stretches_is_the_path_of_the_whole_text():
    """Viterbi over whole texts, with all windows computed and the tags of other characters ruled out, one text at a time."""
    r, tagger = random.Random(6), pii.trained()
    texts = [pii.labelled_text(r)[0] * k for k in (1, 2, 3)] + ["", "no mark at all " * 20, "7" * 400]
    for text, got in zip(texts, pii.model_spans(texts, tagger)):
        code = pii.points(text)
        total, weights = np.zeros((len(text), tagger.tags)), np.zeros(len(text))
        for k in range(max(0, -(-(len(text) - pii.WINDOW) // pii.STRIDE)) + 1):
            x = np.zeros((1, pii.WINDOW), np.int64)
            part = code[k * pii.STRIDE : k * pii.STRIDE + pii.WINDOW]
            x[0, : len(part)] = pii.classes(part)
            e = tagger.emissions(x)[0][0]
            for i in range(len(part)):
                w = min(i + 1, pii.WINDOW - i)
                total[k * pii.STRIDE + i] += e[i] * w
                weights[k * pii.STRIDE + i] += w
        free = np.zeros(len(text), bool)
        for a, b in zip(*pii.stretches(code)):
            free[a:b] = True
        trans = tagger.p["trans"] + tagger.order
        best, back = np.r_[0.0, np.full(tagger.tags - 1, -1e9)], []
        for i in range(len(text)):
            s = best[:, None] + trans
            back.append(s.argmax(0))
            best = s.max(0) + (total[i] / weights[i] if free[i] else np.r_[0.0, np.full(tagger.tags - 1, -1e9)])
        tag, line = int((best + trans[:, 0]).argmax()), []
        for i in range(len(text) - 1, -1, -1):
            line.append(tag)
            tag = int(back[i][tag])
        line.reverse()
        want = np.zeros(len(text), np.int64)
        for a, k, b in got:
            want[a:b], want[a] = 2 + 2 * k, 1 + 2 * k
        assert want.tolist() == line


def test_pipeline_keeps_columns_and_loses_no_token(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
    assert c.STAGES[-1][1](spark, docs, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_pipeline_judges_rows_whose_ids_are_null_or_repeated(spark):
    import corpus_pipeline as c

    text = {k: " ".join(random.Random(k).choice(["amber", "birch", "cedar", "delta", "ember", "fjord", "grove"]) + chr(97 + random.Random(f"{k}{i}").randrange(26)) for i in range(80)) for k in "ABCDE"}
    given = [(None, text["A"]), (None, text["B"]), (None, "too short"), (7, text["C"]), (7, text["D"]), (7, text["D"]), (9, text["A"]), (None, text["E"]), (None, text["E"] + " end"), (7, "short too")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], spark.read.parquet(f"{SF}/documents.parquet").schema)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    good = c.quality_rules(spark, docs, SF)
    assert rows(good) == sorted((x for x in given if "short" not in x[1]), key=str)
    left = rows(c.near_duplicates(spark, good, SF))
    assert [x for x in left if x[1][:300] != text["E"][:300]] == sorted([(None, text["B"]), (7, text["C"]), (7, text["D"]), (9, text["A"])], key=str)
    assert len(left) == 5


def test_pipeline_stages_on_edge_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and extra columns whose names the stages use themselves."""
    import corpus_pipeline as c

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    extra = ["__row", "__id", "__hash", "__chunk", "row", "stratum", "kept", "content", "node", "c0", "t", "rank"]
    wide = T.StructType([*schema.fields, *(T.StructField(n, T.StringType()) for n in extra)])
    long = " ".join(f"w{i}" for i in range(60_000))
    clean = " ".join(f"clean{i}" for i in range(70))
    texts = [(1, None), (2, ""), (3, " \n "), (4, long), (5, clean), (5, clean), (None, clean), (6, "short"), (7, clean + " call +1 (555) 555-0100 now"), (None, None)]
    docs = spark.createDataFrame([(d, t, None, None, None, *["x"] * len(extra)) for d, t in texts], wide)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        rows = out.collect()
        assert all(r[n] == "x" for r in rows for n in extra) and all(r.lang is None and r.source is None for r in rows), name
        kept = sorted(((r.doc_id, r.text) for r in rows), key=str)
        if name == "quality_rules":
            assert kept == sorted(((d, t) for d, t in texts if t and len(t) > 10), key=str)
        elif name == "near_duplicates":
            assert [d for d, t in kept if t == clean] == [5] and len(kept) == len(texts) - 3
        elif name == "repeated_passages":
            assert [t for d, t in kept if d == 5] == ["", ""] and (None, clean) in kept and (4, long) in kept and (1, None) in kept
        else:
            assert (7, clean + " call [PHONE] now") in kept and len(kept) == len(texts) and (1, None) in kept
    packed_ = c.best_fit_packing(spark, docs, SF)
    assert packed_.select("doc_id").distinct().count() == 8 and packed_.where("piece = 0").count() == len(texts)
    assert c.best_fit_packing(spark, docs.limit(0), SF).count() == 0


def test_pipeline_run_against_its_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = sorted((r.doc_id, r.text) for r in docs.collect())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(LIBRARY_VOCABULARY)
    pieces = cut(want, lambda t: tok.encode(t, add_special_tokens=False).ids, 2048)
    got = c.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    assert packed(got, 2048) == len(best_fit_decreasing([p[3] for p in pieces], 2048))


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op2_quality_rules", "op3_repeated_passages", "op9_chat_format"])
def test_registered_queries_against_their_sql(spark, name):
    import os

    import duckdb

    from quern.llm import queries as q

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = q.QUERIES[name](spark, SF)
    r = c.execute(q.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(x) for x in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
