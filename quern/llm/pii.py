"""Personal data by rules and a character-level bidirectional LSTM with a CRF (operator 10).

The rules find the base spans. The model, trained in numpy on labelled spans made from a fixed seed, reads every whole text in
windows of 128 characters that start every 64, so each character lies in two. Both windows' emissions are added, weighted by
how centrally the character lies, and one Viterbi path is decoded for the whole text. The path is kept to what spans are made
of: characters outside their alphabet are outside, spaces count only next to digits or brackets, and a span holds a digit, an
at sign or "(at)". Between characters that can't be in a span the path falls apart into stretches, so decoding them one by
one is decoding the whole; windows without any such stretch can't change it and are not computed. Model spans that touch a
base span, or lack what their kind can't do without (see ``possible``), are dropped; base spans always stay.

Null text: empty, no spans. Empty table: no rows. Repeated rows are judged alike, equal scores going to the lower tag. Extra
columns are ignored, or stay as they are in ``redacted``, whatever their names. Long texts are read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ragged, release_caches, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, LEARNT = 128, 64, 64  # LEARNT: characters of a training window
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match starts at the first digit of a run, and no digit can be given back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test; by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += ((a, 0, b) for a, b in _emails(text))
    if _MARK.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the model -------------------------------------------------------------------------------------------------------

_VISIBLE = {c: i + 8 for i, c in enumerate("@.+-_%()[] ,:;/=\"'#\n")}
SYMBOLS = 8 + len(_VISIBLE)


def _class(c: str) -> int:
    """0 pads; 1 digit, 2 lower, 3 upper, 4 other letter, 5 white space, 6 punctuation, 7 anything else."""
    if c in _VISIBLE:
        return _VISIBLE[c]
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    return 4 if c.isalpha() else 5 if c.isspace() else 6 if c.isascii() and c.isprintable() else 7


_KNOWN = np.array([_class(chr(i)) for i in range(128)], np.int64)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def classes(code: np.ndarray) -> np.ndarray:
    out = np.full(len(code), 4, np.int64)
    plain = code < 128
    out[plain] = _KNOWN[code[plain]]
    return out


def labelled_text(rng: random.Random) -> tuple[str, list[Span]]:
    """A text with its labelled spans: personal data, also in forms that the rules don't know, among words and look-alikes."""
    letters = "aeinorstlhdcumü"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    name = lambda: word().replace("ü", "u")
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    top = lambda: rng.choice(["example.com", "org", "net", "com", "co.uk", "de"])

    def item() -> tuple[int, str]:
        kind = rng.randrange(-5, 4)
        if kind == 0:
            who = name() + rng.choice(["", f".{digits(2)}", f"_{name()}", f".{name()}", digits(1)])
            if rng.random() < 0.3:
                gap = rng.choice([" ", ""])
                return 0, f"{who}{gap}{rng.choice(['(at)', '[at]'])}{gap}{name()}.{top()}"
            return 0, f"{who}@{rng.choice(['mail', 'post', name()])}{rng.choice(['', digits(1)])}.{top()}"
        if kind == 1:
            return 1, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            body = rng.choice("3456") + digits(rng.choice([13, 14, 14, 14]))
            body += next(c for c in "0123456789" if luhn(body + c))
            gap = rng.choice(["", "", " ", "-", ".", "/"])
            return 2, gap.join(body[i : i + 4] for i in range(0, len(body), 4))
        if kind == 3:
            gap = rng.choice([" ", "-", ".", "/"])
            return 3, rng.choice([
                lambda: f"+{digits(rng.randint(1, 2))}{rng.choice([' ', ' (', '-'])}{digits(3)}{rng.choice([') ', ' ', '-'])}{digits(3)}{rng.choice(['-', ' '])}{digits(4)}",
                lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}{rng.choice('-.')}{digits(3)}-{digits(4)}", lambda: f"00{digits(2)} {digits(2)} {digits(rng.randint(6, 8))}",
                lambda: f"0{digits(rng.randint(2, 4))}{gap}{digits(rng.randint(6, 8))}"])()
        return -1, rng.choice([
            lambda: f"password={hexes(18)}", lambda: f'token = "{hexes(32)}"', lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 1999)}-{rng.randint(2000, 2030)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: digits(rng.randint(1, 6)), lambda: f"{rng.choice(['order', 'no.', 'id', 'ticket'])} {digits(rng.randint(7, 20))}", lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
            lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: f"AKIA{word().upper()}{digits(3)}", lambda: f"{word()}@{word()}", lambda: f"@{word()}{digits(2)}",
            lambda: f"{rng.randint(1, 20)}:{digits(2)}", lambda: f"{digits(2)}%", lambda: f"({digits(rng.randint(1, 4))})", lambda: f"{word()}{digits(2)}", lambda: f"pp. {digits(3)}-{digits(3)}", lambda: hexes(40)])()

    parts, spans, at = [], [], 0
    while at < 150:
        kind, piece = (-1, word()) if rng.random() < 0.6 else item()
        if kind >= 0:
            spans.append((at, kind, at + len(piece)))
        piece += rng.choice([" ", " ", " ", ", ", ".\n", " | "])
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Tags: 0 outside, 1 + 2 k the first character of kind k, 2 + 2 k a later one."""

    tags = 1 + 2 * len(KINDS)
    #: a later character follows one of its own kind
    order = np.array([[-1e4 if b and b % 2 == 0 and a not in (b - 1, b) else 0.0 for b in range(1 + 2 * len(KINDS))] for a in range(1 + 2 * len(KINDS))])

    def __init__(self, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        h, t = hidden, self.tags
        self.hidden = h
        self.p = {"trans": np.zeros((t, t)), "out": r.normal(0, 0.2, (2 * h, t)), "bias": np.zeros(t)}
        for d in "fb":
            self.p |= {f"in_{d}": r.normal(0, 0.3, (SYMBOLS, 4 * h)), f"rec_{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"b_{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """One direction over x [rows, time]; gates in the order in, forget, out, cell."""
        n, steps = x.shape
        kind = self.p["out"].dtype
        h, c = np.zeros((n, self.hidden), kind), np.zeros((n, self.hidden), kind)
        table, rec, w = self.p[f"in_{d}"] + self.p[f"b_{d}"], self.p[f"rec_{d}"], self.hidden
        out, cache = np.zeros((n, steps, w), kind), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + h @ rec
            gate, cell = _sigmoid(z[:, : 3 * w]), np.tanh(z[:, 3 * w :])
            before, prev = c, h
            c = gate[:, w : 2 * w] * c + gate[:, :w] * cell
            tc = np.tanh(c)
            h = gate[:, 2 * w :] * tc
            out[:, t] = h
            if keep:
                cache.append((t, gate, cell, before, prev, tc))
        return out, cache

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, cf = self._run(x, "f", keep)
        b, cb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["bias"], both, {"f": cf, "b": cb}

    def decode(self, e: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Viterbi tags of stretches ``start`` .. ``start + size`` of emissions e [places, tags], outside tags lying around each."""
        trans = self.p["trans"] + self.order
        out = np.zeros(len(e), np.int64)
        by = np.argsort(size, kind="stable")
        for part in np.split(by, range(4096, len(by), 4096)):
            steps, n = int(size[part].max()), len(part)
            first, last = start[part], size[part] - 1
            best, back = trans[0] + e[first], np.zeros((steps, n, self.tags), np.int8)
            ends = np.zeros((n, self.tags))
            ends[last == 0] = best[last == 0]
            for t in range(1, steps):
                some = np.flatnonzero(last >= t)  # sorted by size, so these are the last ones
                s = best[some][:, :, None] + trans
                back[t, some] = s.argmax(1)
                best[some] = s.max(1) + e[first[some] + t]
                done = some[last[some] == t]
                ends[done] = best[done]
            tag = (ends + trans[:, 0]).argmax(1)
            for t in range(steps - 1, -1, -1):
                some = np.flatnonzero(last >= t)
                out[first[some] + t] = tag[some]
                tag[some] = back[t, some, tag[some]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tag sequences y, and its gradients."""
        e, both, caches = self.emissions(x, True)
        n, steps, k = e.shape
        trans = self.p["trans"] + self.order
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + trans, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        row = np.arange(n)[:, None]
        gold = e[row, np.arange(steps), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[row, np.arange(steps), y] -= 1
        g = {key: np.zeros_like(v) for key, v in self.p.items()}
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        g["trans"] = pair.sum((0, 1))
        np.add.at(g["trans"], (y[:, :-1], y[:, 1:]), -1)
        g["out"], g["bias"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k), de.sum((0, 1))
        dboth, w = de @ self.p["out"].T, self.hidden
        shown = (x.T[:, None, :] == np.arange(SYMBOLS)[:, None]).astype(float)  # [time, symbols, rows]
        for i, d in enumerate("fb"):
            dh, dc, rec = np.zeros((n, w)), np.zeros((n, w)), self.p[f"rec_{d}"]
            for t, gate, cell, before, prev, tc in reversed(caches[d]):
                dh = dh + dboth[:, t, i * w : (i + 1) * w]
                dc = dc + dh * gate[:, 2 * w :] * (1 - tc**2)
                dgate = np.concatenate([dc * cell, dc * before, dh * tc], 1) * gate * (1 - gate)
                dz = np.concatenate([dgate, dc * gate[:, :w] * (1 - cell**2)], 1)
                g[f"in_{d}"] += shown[t] @ dz
                g[f"rec_{d}"] += prev.T @ dz
                g[f"b_{d}"] += dz.sum(0)
                dh, dc = dz @ rec.T, dc * gate[:, w : 2 * w]
        return float((z - gold).mean()), {key: v / n for key, v in g.items()}

    def fit(self, steps: int = 400, rows: int = 64, seed: int = 1, rate: float = 0.02) -> "Tagger":
        """Adam on windows of labelled texts."""
        rng = random.Random(seed)
        m, v = ({key: np.zeros_like(a) for key, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, y = np.zeros((rows, LEARNT), np.int64), np.zeros((rows, LEARNT), np.int64)
            for i in range(rows):
                text, spans = labelled_text(rng)
                tags = np.zeros(len(text), np.int64)
                for a, kind, b in spans:
                    tags[a:b] = 2 + 2 * kind
                    tags[a] = 1 + 2 * kind
                at = rng.randint(0, len(text) - LEARNT)
                x[i], y[i] = classes(points(text[at : at + LEARNT])), tags[at : at + LEARNT]
            _, g = self.gradients(x, y)
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            for key, a in g.items():
                a = a * min(1, 5 / max(norm, 1e-9))
                m[key] = 0.9 * m[key] + 0.1 * a
                v[key] = 0.99 * v[key] + 0.01 * a * a
                self.p[key] -= rate * (1 - 0.9 * step / steps) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
        self.p = {key: a.astype(np.float32) for key, a in self.p.items()}  # precise enough to read with
        return self


@lru_cache(maxsize=2)
def trained(steps: int = 400) -> Tagger:
    return Tagger().fit(steps)


_MEMBER = np.zeros(128, bool)  # what spans are made of, but for spaces
_MEMBER[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@()[]/"]] = True
_BESIDE = np.zeros(128, bool)  # what a space within a span lies beside
_BESIDE[[ord(c) for c in "0123456789+()[]"]] = True


def stretches(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest runs that may hold a span."""
    n = len(code)
    plain = np.minimum(code, 127)  # 127 is no member
    inside, beside = _MEMBER[plain], _BESIDE[plain]
    inside |= (code == 32) & (np.r_[False, beside[:-1]] | np.r_[beside[1:], False])
    mark = (code >= 48) & (code <= 57) | (code == 64)
    for k in np.flatnonzero((code == 40) | (code == 91)):
        if k + 3 < n and code[k + 1] == 97 and code[k + 2] == 116 and code[k + 3] in (41, 93):
            mark[k] = True
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edge[::2], edge[1::2]
    marks = np.r_[0, np.cumsum(mark)]
    some = marks[end] > marks[start]
    return start[some], end[some]


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans on the best path through each whole text, over the summed emissions of its overlapping windows."""
    out: list[list[Span]] = [[] for _ in texts]
    code = points("\n".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size - 1  # of each text
    start, end = stretches(code)  # none holds a line break, so none crosses texts
    if not len(start):
        return out
    owner = np.searchsorted(first, start, side="right") - 1
    n = end - start
    place = ragged(start, n)  # of the characters to tag
    row = np.full(len(code), -1, np.int64)
    row[place] = np.arange(len(place))
    # the windows in which they lie, as (text, number)
    base, most = first[owner], np.maximum(0, -(-(size[owner] - WINDOW) // STRIDE))
    lo, hi = np.clip((start - base) // STRIDE - 1, 0, most), np.minimum((end - 1 - base) // STRIDE, most)
    wide = int(most.max()) + 1
    window = np.unique(ragged(owner * wide + lo, hi - lo + 1))
    text, number = window // wide, window % wide
    symbols = classes(code)
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    total, weights = np.zeros((len(place), tagger.tags), np.float32), np.zeros(len(place), np.float32)
    for odd in (0, 1):  # windows of one parity don't overlap
        mine = np.flatnonzero(number % 2 == odd)
        for group in range(0, len(mine), 2048):
            w = mine[group : group + 2048]
            at = first[text[w]] + number[w] * STRIDE
            where = at[:, None] + np.arange(WINDOW)
            here = where < (first[text[w]] + size[text[w]])[:, None]
            x = np.where(here, symbols[np.minimum(where, len(code) - 1)], 0)
            e = tagger.emissions(x)[0]
            r = np.where(here, row[np.minimum(where, len(code) - 1)], -1)
            i, j = np.nonzero(r >= 0)
            total[r[i, j]] += e[i, j] * weight[j][:, None]
            weights[r[i, j]] += weight[j]
    line = tagger.decode(total / weights[:, None], np.cumsum(n) - n, n)
    kind = np.where(line > 0, (line - 1) >> 1, -1)
    new = np.r_[True, (kind[1:] != kind[:-1]) | (line[1:] % 2 == 1) | (place[1:] != place[:-1] + 1)]
    heads = np.flatnonzero(new)
    for h, past in zip(heads, np.r_[heads[1:], len(line)]):
        if kind[h] >= 0:
            i = int(np.searchsorted(first, place[h], side="right")) - 1
            out[i].append((int(place[h] - first[i]), int(kind[h]), int(place[past - 1] + 1 - first[i])))
    return out


def possible(text: str, span: Span) -> bool:
    """Whether a model span has what its kind can't do without: a host, four numbers up to 255, a valid check digit, enough digits."""
    part = text[span[0] : span[2]]
    digits = "".join(c for c in part if "0" <= c <= "9")
    if span[1] == 0:
        return "." in part and ("@" in part[1:-1] or "(at)" in part or "[at]" in part)
    if span[1] == 1:
        return len(numbers := re.split("[^0-9]+", part)) == 4 and all(x and len(x) <= 3 and int(x) <= 255 for x in numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if span[1] == 2 else 7 <= len(digits) <= 15


def find(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    out = []
    for text, base, extra in zip(texts, map(base_spans, texts), model_spans(texts, tagger)):
        more = [s for s in extra if possible(text, s) and all(s[2] <= a or s[0] >= b for a, _, b in base)]
        out.append((base, sorted(base + more)))
    return out


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span (overlaps joined) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detected(docs: DataFrame, *, key: str = "doc_id", text: str = "text", steps: int = 400) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, of every whole text."""
    small_batches(docs.sparkSession)
    tagger = trained(steps)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches, "text", 8 << 20):
            cols: list[list] = [[] for _ in range(6)]
            for base, spans in find(part.column(1).to_pylist(), tagger):
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(written_out(base).encode()).hexdigest())
                cols[5].append(written_out(spans))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, *, text: str = "text", steps: int = 400) -> DataFrame:
    """``docs`` with every span of ``text`` masked; null texts stay null, all other columns as they are."""
    small_batches(docs.sparkSession)
    tagger = trained(steps)

    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        release_caches()
        texts = ["" if t is None else t for t in column]
        out = [masked(t, spans) for t, (_, spans) in zip(texts, find(texts, tagger))]
        return pd.Series([None if t is None else o for t, o in zip(column, out)], dtype=object)

    return docs.withColumn(text, mask(F.col(text)))
