"""Byte-level BPE by longest matches and backtracking over compatible neighbours (operator 8).

Bytes are mapped to the Latin-1 characters of the same numbers, so an Aho-Corasick automaton over characters finds
the vocabulary's byte strings. A text's BPE encoding is the only token sequence whose neighbouring tokens are all
compatible (encode the concatenation of the two and the two come back), so the encoder takes the longest match at each
place, checks it against the token before, and falls back to the token's next shorter prefix, or to the token before
it, where they don't go together. Places that turned out dead are remembered: linear time in the bytes of a pre-token.

Null text: empty, no ids, digests of nothing. Repeated rows: equal results, one row each. Special tokens spelled out in a text
are plain text. Empty table: no rows. Extra columns are ignored, whatever their names. Long texts are encoded whole: pre-tokens
are independent, and a long pre-token takes linear time and memory.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices
from .tokens import PieceEncoder


class BytePairs:
    """Encoder and decoder for tiktoken-style ranks, where a token's id is its rank."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.words = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.words.add_word(token.decode("latin-1"), rank)
        self.words.make_automaton()
        top = max(self.ranks.values()) + 1
        self.length = [0] * top
        self.shorter: list[int] = [-1] * top  # the longest token that is a proper prefix
        self.halves: list[tuple[int, int]] = [(-1, -1)] * top  # the last merge that makes the token
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)
            self.shorter[rank] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._merge(token, rank)) and len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.pairs[parts[0], parts[1]] = rank
        self.fits: dict[int, bool] = {}

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging by ranks under ``below``, for vocabulary tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens: no merge across the border comes first."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            known, limit, a, b = True, 1 << 30, left, right
            while True:
                merged = self.pairs.get((a, b))
                if merged is not None and merged < limit:
                    known = False
                    break
                # undo the later of the two last merges; the border's tokens before it must not have merged earlier
                (al, ar), (bl, br) = self.halves[a], self.halves[b]
                if a > b if ar >= 0 and bl >= 0 else ar >= 0:
                    limit, a = a, ar
                elif bl >= 0:
                    # at equal ranks the merge further left comes first
                    limit, b = b + 1, bl
                else:
                    break
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def longest(self, data: bytes) -> list[int]:
        """For each place, the longest token that starts there."""
        out = [self.ranks[data[i : i + 1]] for i in range(len(data))]
        length = self.length
        for end, rank in self.words.iter(data.decode("latin-1")):
            # iter yields all tokens that end here, the longest first
            start = end - length[rank] + 1
            if length[rank] > length[out[start]]:
                out[start] = rank
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """The BPE tokens of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, best, length, shorter = len(data), self.longest(data), self.length, self.shorter
        tokens: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, best[0]
        while True:
            end = at + length[token]
            if alive[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at == n:
                    return tokens
                token = best[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = tokens.pop()
                at -= length[token]

    def encode_texts(self, texts: list[str], sizes: list[int] | None = None) -> list[bytes]:
        out = []
        for text in texts:
            ids: list[int] = []
            for word in self.split.findall(text):
                ids += self.encode_piece(word.encode())
            out.append(array("I", ids).tobytes())
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[BytePairs, PieceEncoder]:
    own = BytePairs(path, pattern)
    return own, PieceEncoder(own.encode_texts)


def encoded(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary) and decoded (binary) of every whole text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, encode = codec(path, pattern)
        for part in slices(batches, "text", 4 << 20):
            ids, off = encode(part.column(1))
            ids = ids.astype("<u4", copy=False)
            each = [ids[off[i] : off[i + 1]] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in each], pa.binary()), pa.array([own.decode(x) for x in each], pa.binary())], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    e = encoded(docs, path, pattern, key=key, text=text)
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
