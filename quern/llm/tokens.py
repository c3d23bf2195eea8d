"""Tokenising whole Arrow columns: text is cut where the byte-level pattern always cuts, and each piece is encoded once.

A cut before a space is safe unless white space stands on both sides of that space: every alternative of the
pattern ends before white space that follows something else, and a single space joins only what follows it. Texts
in which some space has white space on both sides, and texts that spell out an added token (which the library cuts out before
the pattern is applied), are encoded in one go instead, so results are always those of encoding the whole text.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import cached_until_release

SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
STARTS, ENDS = rf"^[{SPACE}]|^\z", rf"[{SPACE}]\z|^\z"


def _strings(column: pa.Array) -> list[str]:
    """What ``to_pylist`` gives where no value is null, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Encodes string columns through ``encode_many`` with a memory of at most ``room`` pieces.

    ``encode_many`` takes pieces and, for each, its bytes if it may stand between others of this kind (one space, then neither end
    is white space), else 0; it gives ids as unsigned 32-bit bytes.
    ``literals``: strings that are matched before the pattern; texts that hold one are encoded in one go.
    """

    def __init__(self, encode_many: Callable[[list[str], list[int]], list[bytes]], room: int = 600_000, literals: list[str] | None = None):
        self.encode_many, self.room, self.known, self.literals = encode_many, room, {}, literals or []

    def _ids(self, pieces: list[str], sizes: list[int]) -> list[bytes]:
        out = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            wanted = [pieces[i] for i in missing]
            new = dict(zip(wanted, [sizes[i] for i in missing]))
            if len(self.known) + len(new) > self.room:
                self.known.clear()
            found = dict(zip(new, self.encode_many(list(new), list(new.values()))))
            for i, ids in zip(missing, map(found.__getitem__, wanted)):
                out[i] = ids
            self.known.update(found if max(map(len, new)) < 200 else {p: x for p, x in found.items() if len(p) < 200})
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and where each text's ids start (and the last end)."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        starts = pc.match_substring_regex(words, STARTS).to_numpy(zero_copy_only=False)
        ends = pc.match_substring_regex(words, ENDS).to_numpy(zero_copy_only=False)
        bad = np.zeros(len(codes), bool)
        bad[1:] = ends[codes[:-1]] & starts[codes[1:]]
        first = off[:-1]
        bad[first] = False
        whole = np.add.reduceat(bad, first).astype(bool)
        for literal in self.literals:
            whole |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        pieces = _strings(pc.binary_join_element_wise("", words, " "))
        heads = _strings(words.take(pa.array(codes[first])))
        for i in np.flatnonzero(whole):
            heads[i] = texts[int(i)].as_py()
        u = len(pieces)
        keep = ~np.repeat(whole, np.diff(off))
        codes[~keep] = u + n
        codes[first] = u + np.arange(n)
        sizes = np.where(starts | ends, 0, pc.binary_length(words).to_numpy() + 1).tolist()
        ids = self._ids(pieces + heads, sizes + [0] * n)
        ids.append(b"")
        placed = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(placed.buffers()[1], np.int64)[: len(codes) + 1] // 4
        flat = np.frombuffer(placed.buffers()[2], np.uint32, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint32)
        return flat, ends[off]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's encoder for the byte-level vocabulary file at ``path``, as with ``add_special_tokens=False``.

    Nothing is added to a text; an added token that a text spells out gets its own id, as the library's default is.
    Pieces that may follow each other go to the library some hundreds at a time, laid end to end; the bytes that ids stand for
    tell where each piece's ids end.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    literals = [t.content for t in tok.get_added_tokens_decoder().values()]
    size = np.zeros(tok.get_vocab_size(), np.int64)
    for token, i in tok.get_vocab().items():
        size[i] = len(token)  # one character for each byte

    def plain(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def many(texts: list[str], sizes: list[int]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        joined = [i for i, n in enumerate(sizes) if n]
        alone = [i for i, n in enumerate(sizes) if not n]
        for at in range(0, len(joined), 300):
            part = joined[at : at + 300]
            group = "".join([texts[i] for i in part])
            ids = np.array(tok.encode_batch_fast([group], add_special_tokens=False)[0].ids, "<u4")
            reach = np.cumsum(size[ids])
            ends = np.cumsum([sizes[i] for i in part])
            cut = np.searchsorted(reach, ends) + 1
            if not len(reach) or reach[-1] != ends[-1] or (reach[cut - 1] != ends).any():
                alone += part  # no such case is known
                continue
            raw, a = ids.tobytes(), 0
            for i, b in zip(part, (4 * cut).tolist()):
                out[i], a = raw[a:b], b
        for at in range(0, len(alone), 1000):
            part = alone[at : at + 1000]
            for i, x in zip(part, plain([texts[i] for i in part])):
                out[i] = x
        return out

    cached_until_release(library_encoder.cache_clear)
    return PieceEncoder(many, literals=literals)
