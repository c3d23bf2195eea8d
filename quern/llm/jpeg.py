"""Baseline JPEG media columns (operator 6): bytes as quantised coefficients, read back by a vectorised decoder.

A payload's bytes, as signed 8-bit numbers, are the zigzag coefficients of 8x8 luminance blocks under a quantiser of
ones, so a baseline file holds them without loss although baseline JPEG has no lossless mode. Restart markers every
``INTERVAL`` blocks cut the scan into segments that numpy decodes side by side, one symbol of each at a step.

Features: width x height, SHA-1 and average hash of the thumbnail made of the DC coefficients. The decoder also reads other
baseline files of one 8-bit component, each with its own Huffman and quantisation tables, in one batch with ours.

Null text: empty, so one block of zeros. Repeated rows and equal texts: equal values. Very long texts: one file each, encoded
``GROUP`` blocks at a time, so beyond the text and its file some 40 MB are held; texts over 4 GB would pass JPEG's 65,535 lines.
Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ragged, slices, text_bytes, written

INTERVAL = 16
GROUP = 1 << 15  # blocks that are entropy-coded at a time


def _tables() -> tuple[dict[int, int], dict[int, int]]:
    """Code lengths by symbol: DC categories, and AC run/size pairs made for the sizes of text bytes."""
    dc = {s: 4 for s in range(12)}
    ac = {r << 4 | s: 10 for r in range(16) for s in range(1, 9)} | {0xF0: 10}
    return dc, ac | {0x00: 6} | {s: 6 for s in (1, 2, 3, 4, 5, 8)} | {6: 2, 7: 1}


def _codes(lengths: dict[int, int]) -> tuple[dict[int, int], bytes]:
    """Canonical codes, and the body of a DHT segment without its class byte."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    out, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        out[s], last, code = code, lengths[s], code + 1
    return out, bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order)


DC_LEN, AC_LEN = _tables()
DC_CODE, DC_DHT = _codes(DC_LEN)
AC_CODE, AC_DHT = _codes(AC_LEN)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int, size: int) -> bytes:
    return (b"\xff\xd8" + _segment(0xFE, b"payload" + struct.pack(">Q", size)) + _segment(0xDB, b"\0" + b"\1" * 64)
            + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0") + _segment(0xC4, b"\0" + DC_DHT)
            + _segment(0xC4, b"\x10" + AC_DHT) + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, b"\1\1\0\0\x3f\0"))


def grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down: near square, at most one row of padding."""
    across = min(8191, max(1, int(np.ceil(np.sqrt(blocks)))))
    return across, -(-blocks // across)


def _by_value(lengths: dict[int, int], codes: dict[int, int], values: range, run: int = 0) -> tuple[list[int], list[int]]:
    """Bits and word (code, then the value's bits) for each value; none where the symbol has no code."""
    bits, words = [], []
    for v in values:
        s = abs(v).bit_length()
        symbol = run << 4 | s
        bits.append(lengths[symbol] + s if symbol in lengths else 0)
        words.append(codes[symbol] << s | (v + (1 << s) - 1 if v < 0 else v) if symbol in lengths else 0)
    return bits, words


_BYTES = [*range(128), *range(-128, 0)]  # by unsigned byte
_AC = [_by_value({k: v for k, v in AC_LEN.items() if k & 15}, AC_CODE, _BYTES, run) for run in range(16)]
_AC_BITS, _AC_WORD = np.array([a for a, _ in _AC], np.uint8), np.array([w for _, w in _AC], np.uint32)
_DC_BITS, _DC_WORD = (np.array(x) for x in _by_value(DC_LEN, DC_CODE, range(-255, 256)))


def _scan(coef: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-code blocks of int8; first: the block at which each segment starts. Stuffed bytes, and where segments start."""
    n = len(coef)
    bits, word = np.zeros((n, 65), np.uint8), np.zeros((n, 65), np.uint64)
    dc = coef[:, 0].astype(np.int64)
    diff = np.diff(dc, prepend=0)
    diff[first] = dc[first]
    bits[:, 0], word[:, 0] = _DC_BITS[diff + 255], _DC_WORD[diff + 255]
    plain = coef.view(np.uint8)
    bits[:, 1:64], word[:, 1:64] = _AC_BITS[0][plain[:, 1:]], _AC_WORD[0][plain[:, 1:]]
    rows = np.flatnonzero((plain[:, 1:63] == 0).any(1))  # only these have runs
    if len(rows):
        some = plain[rows, 1:] != 0
        k = np.arange(1, 64)
        last = np.maximum.accumulate(np.where(some, k, 0), 1)
        r, c = np.nonzero(some)
        run = c - np.where(c, last[r, c - 1], 0)
        after = run > 0
        r, c, run = rows[r[after]], c[after] + 1, run[after]
        v = plain[r, c]
        bits[r, c], word[r, c] = _AC_BITS[run & 15, v], _AC_WORD[run & 15, v]
        for j in (1, 2, 3):  # runs of 16 zeros and more
            long = run >= 16 * j
            word[r[long], c[long]] |= np.uint64(AC_CODE[0xF0]) << bits[r[long], c[long]].astype(np.uint64)
            bits[r[long], c[long]] += AC_LEN[0xF0]
    end = plain[:, 63] == 0
    bits[end, 64], word[end, 64] = AC_LEN[0], AC_CODE[0]
    per = np.add.reduceat(bits.sum(1, dtype=np.int64), first)
    size_of = (per + 7) >> 3
    start = np.cumsum(size_of) - size_of
    keep = np.flatnonzero(bits.ravel())
    events = np.add.reduceat((bits > 0).sum(1), first)
    bits, word = bits.ravel()[keep].astype(np.int64), word.ravel()[keep]
    pos = np.cumsum(bits) - bits
    pos += np.repeat(start * 8 - (np.cumsum(per) - per), events)
    at = pos >> 3
    word <<= (64 - bits - (pos & 7)).astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    joined, at = np.bitwise_or.reduceat(word, heads), at[heads]
    out = np.zeros(int(size_of.sum()) + 8, np.uint8)
    for j in range((int(bits.max()) + 14) >> 3):
        out[at + j] |= (joined >> np.uint64(56 - 8 * j)).astype(np.uint8)
    out = out[: int(size_of.sum())]
    spare = size_of * 8 - per  # fill the last byte with ones
    out[start + size_of - 1] |= ((1 << spare) - 1).astype(np.uint8)
    ff = out == 0xFF
    shift = np.cumsum(ff) - ff
    stuffed = np.zeros(len(out) + int(ff.sum()), np.uint8)
    stuffed[np.arange(len(out)) + shift] = out
    return stuffed, np.r_[start + shift[start], len(stuffed)]


def encode(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A JPEG file for each payload data[off[i]:off[i+1]], whose sizes are multiples of 64."""
    blocks = np.diff(off) // 64
    shapes = [grid(int(n)) for n in blocks]
    held = np.array([a * d for a, d in shapes], np.int64)
    first_of = np.cumsum(held) - held
    coef = np.zeros((int(held.sum()), 64), np.int8)
    coef[ragged(first_of, blocks)] = data.view(np.int8).reshape(-1, 64)
    parts = -(-held // INTERVAL)
    segment_of = np.cumsum(parts) - parts
    first = np.repeat(first_of, parts) + (np.arange(int(parts.sum())) - np.repeat(segment_of, parts)) * INTERVAL
    scans, begins, done = [], [], 0
    cuts = np.unique(np.r_[np.searchsorted(first, np.arange(0, len(coef), GROUP)), len(first)])
    for i, j in zip(cuts, cuts[1:]):  # segments end at whole bytes
        a, b = first[i], first[j] if j < len(first) else len(coef)
        scan, begin = _scan(coef[a:b], first[i:j] - a)
        scans.append(scan.tobytes())
        begins.append(begin[:-1] + done)
        done += len(scan)
    raw, begin, out = b"".join(scans), np.concatenate([*begins, [done]]).astype(np.int64), []
    for i, (a, d) in enumerate(shapes):
        s, n = int(segment_of[i]), int(parts[i])
        pieces = [_header(a * 8, d * 8, int(off[i + 1] - off[i]))]
        for j in range(n):
            pieces.append(raw[begin[s + j] : begin[s + j + 1]])
            pieces.append(bytes((0xFF, 0xD0 + j % 8 if j < n - 1 else 0xD9)))
        out.append(b"".join(pieces))
    return out


@lru_cache(maxsize=64)
def _lut(body: bytes) -> np.ndarray:
    """16 bits ahead: code length | size << 5 | run << 9, or 0 for no code."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            s = body[at]
            table[code << 16 - n : (code + 1) << 16 - n] = n | (s & 15) << 5 | (s >> 4) << 9
            at, code = at + 1, code + 1
        code <<= 1
    return table


def parse(data: bytes) -> dict:
    """The markers of a baseline file with one luminance component."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out: dict = {"restart": 0, "size": None, "dht": {}, "dqt": {}}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        while data[at + 1] == 0xFF:  # fill bytes
            at += 1
        kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xC0:
            out["bits"], out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if out["bits"] != 8 or parts != 1 or not out["height"]:
                raise ValueError("only 8-bit files of one component and known height")
            out["quantiser"] = body[8]
        elif kind in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not baseline")
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["dht"][body[0]], body = body[1:n], body[n:]
        elif kind == 0xDB:
            while body:
                n = 1 + 64 * (1 + (body[0] >> 4))
                out["dqt"][body[0] & 15], body = struct.unpack(">64H" if body[0] >> 4 else "64B", body[1:n]), body[n:]
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif kind == 0xFE and body[:7] == b"payload":
            out["size"] = struct.unpack(">Q", body[7:])[0]
        elif kind == 0xDA:
            end = data.rfind(b"\xff\xd9")
            out["scan"] = (at, end if end >= at else len(data))
            out["tables"] = (bytes(out["dht"][0x10 | body[2] & 15]), bytes(out["dht"][body[2] >> 4]))  # AC, DC
            return out


def coefficients(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Quantised zigzag coefficients of all files' blocks, where each file's blocks start, and the parsed headers."""
    heads = [parse(f) for f in files]
    scan = np.frombuffer(b"".join(f[slice(*h["scan"])] for f, h in zip(files, heads)), np.uint8)
    size = np.array([h["scan"][1] - h["scan"][0] for h in heads], np.int64)
    file_at = np.cumsum(size) - size
    blocks = np.array([-(-h["width"] // 8) * -(-h["height"] // 8) for h in heads], np.int64)
    block_at = np.cumsum(blocks) - blocks
    ff = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
    ff = ff[~np.isin(ff + 1, file_at)]
    after = scan[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(scan), bool)
    drop[ff[after == 0] + 1] = True
    drop[marks] = drop[marks + 1] = True
    starts = np.sort(np.r_[file_at, marks + 2])
    gone = np.cumsum(drop) - drop
    seg_at = starts - gone[starts]
    clean = np.r_[scan[~drop], np.zeros(16, np.uint8)]
    owner = np.searchsorted(file_at, starts, side="right") - 1
    every = np.array([h["restart"] or 1 << 62 for h in heads], np.int64)[owner]
    nth = np.arange(len(starts)) - np.searchsorted(owner, owner, side="left")
    n_blocks = np.minimum(every, blocks[owner] - nth * every)
    if (n_blocks <= 0).any():
        raise ValueError("restart intervals don't match the frame")
    block = block_at[owner] + nth * every
    first_block, last = block.copy(), block + n_blocks
    kinds = {t: i for i, t in enumerate(dict.fromkeys(h["tables"] for h in heads))}
    lut = np.concatenate([_lut(t) for pair in kinds for t in pair])
    base = np.array([kinds[h["tables"]] for h in heads], np.int64)[owner] << 17
    out = np.zeros((int(blocks.sum()), 64), np.int16).ravel()
    view = np.ndarray(len(clean) - 8, "<u8", clean.data, strides=(1,))
    pos, k = seg_at * 8, np.zeros(len(starts), np.int64)
    u6, u1 = np.uint64(63), np.uint64(1)
    step = 0
    while len(pos):
        w = view[pos >> 3].byteswap() << (pos & 7).astype(np.uint64)
        e = lut[(w >> np.uint64(48)).astype(np.int64) + ((k == 0) << 16) + base]
        if (e == 0).any():
            raise ValueError("no such code")
        length, bits, run = e & 31, e >> 5 & 15, e >> 9
        v = ((w << length.astype(np.uint64)) >> u1 >> (u6 - bits.astype(np.uint64))).astype(np.int64)
        v = np.where(v < (1 << bits) >> 1, v - (1 << bits) + 1, v)
        at = k + run
        some = bits > 0
        out[(block * 64 + at)[some]] = v[some]
        pos += length + bits
        k = np.where(some | (k == 0) | (run == 15), at + 1, 64)
        full = k >= 64
        if full.any():
            block += full
            k[full] = 0
        step += 1
        if step % 64 == 0 or len(pos) < 64:
            left = block < last
            if not left.all():
                pos, k, block, last, base = pos[left], k[left], block[left], last[left], base[left]
        else:  # finished segments must stand still until the next clearing
            done = block >= last
            if done.any():
                left = ~done
                pos, k, block, last, base = pos[left], k[left], block[left], last[left], base[left]
    out = out.reshape(-1, 64)
    total = np.cumsum(out[:, 0].astype(np.int64))
    n = np.diff(np.r_[first_block, len(out)])
    out[:, 0] = total - np.repeat(np.r_[0, total][first_block], n)
    return out, block_at, heads


def thumbnail(coef: np.ndarray, head: dict) -> np.ndarray:
    """Luminance by block from the DC coefficients alone."""
    q = head["dqt"][head["quantiser"]][0]
    light = np.clip((coef[:, 0].astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return light.reshape(-(-head["height"] // 8), -1)


def feature(thumb: np.ndarray, head: dict) -> str:
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), np.unique(rows), 0), np.unique(cols), 1)
    bits = int("".join("1" if x else "0" for x in (cells.ravel() * cells.size >= cells.sum())), 2)
    return f"{head['width']}x{head['height']}:{hashlib.sha1(thumb.tobytes()).hexdigest()}:{bits:x}"


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a JPEG file."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 19):
            flat, off = text_bytes(part.column(1))
            size = np.diff(off)
            padded = np.maximum(64, -(-size // 64) * 64)
            to = np.cumsum(padded) - padded
            data = np.zeros(int(padded.sum()), np.uint8)
            data[ragged(to, size)] = flat
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(encode(data, np.r_[to, len(data)]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(table: DataFrame) -> DataFrame:
    """Decode the media column: payload digests, dimensions, thumbnail and its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 2 << 20):
            files = part.column(2).to_pylist()
            coef, at, heads = coefficients(files)
            data, at, cols = coef.astype(np.uint8).tobytes(), [*at.tolist(), len(coef)], [[] for _ in range(6)]
            for i, (file, head) in enumerate(zip(files, heads)):
                payload = data[at[i] * 64 : at[i] * 64 + head["size"]]
                thumb = thumbnail(coef[at[i] : at[i + 1]], head)
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(thumb, head))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame, **options) -> DataFrame:
    """Store the media column as a table in the shared folder and read features from what is stored."""
    return read_media(written(media_column(docs, **options)))
