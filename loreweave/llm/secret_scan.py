"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Patterns give the base spans.  The battery looks at every other token of at
least ``MIN_LENGTH`` characters, infers its encoding (the narrowest alphabet that
has all its characters) and computes three standard deviates under randomness:

* chi-squared: are the symbols of the alphabet uniformly used?
* runs: do kinds of characters (upper, lower, digit, sign; for alphabets of one
  kind the halves of it) alternate as chance has it?
* serial correlation: is a symbol's value independent of the one before?

The sum of their squares is small for a random string (chi-squared with three
degrees of freedom; beyond ``NOT_RANDOM`` a token is not random) and grows with
the length for ordinary text.  What ordinary text of an encoding and length
gives is not guessed: transitions between letters are counted over all
documents, identifiers are simulated from them (words run together, in camel
case, with numbers, with signs), and the p-value of a token is the share of
simulated ones that look as random.  A class of lengths is judged by its
shortest one.  Over the tokens of a document Benjamini-Hochberg keeps the
expected share of ordinary tokens among those reported under ``FALSE_DISCOVERY``.

Digits alone are not tested: ordinary numbers are as random as secret ones.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordvec as W

# Kinds in order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
FALSE_DISCOVERY = 0.01
#: The 0.999 quantile of chi-squared with three degrees of freedom, and its mean: less is no further evidence.
NOT_RANDOM, TYPICAL = 16.27, 3.0
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH)

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Encoding -> alphabet in value order, narrow ones first.
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "upper_hex": _DIGITS + "ABCDEF",
    "lower26": _LOWER,
    "upper26": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "letters52": _UPPER + _LOWER,
    "alnum62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "signs66": _UPPER + _LOWER + _DIGITS + "+/-_",
}
#: Shortest length of each class of lengths.
LENGTHS = (20, 22, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256)
#: Simulated identifiers of each encoding.
SIMULATED = 1500


def _tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Byte -> value (-1 outside) and kind, for each alphabet."""
    kind = {c: k for k, group in enumerate((_UPPER, _LOWER, _DIGITS, "+/-_")) for c in group}
    out = {}
    for name, alphabet in ALPHABETS.items():
        value, kinds = np.full(256, -1, dtype=np.int64), np.zeros(256, dtype=np.int64)
        single = len({kind[c] for c in alphabet}) == 1
        for i, c in enumerate(alphabet):
            value[ord(c)] = i
            kinds[ord(c)] = 2 * i >= len(alphabet) if single else kind[c]
        out[name] = value, kinds
    return out


_TABLES = _tables()


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that has all characters; None for digits alone or if no encoding fits."""
    characters = set(token.rstrip("="))
    if characters <= set(_DIGITS):
        return None
    return next((name for name, alphabet in ALPHABETS.items() if characters <= set(alphabet)), None)


def deviates(tokens: np.ndarray, encoding: str) -> np.ndarray:
    """Chi-squared, runs and serial correlation of tokens of one length (rows of bytes), each under randomness."""
    value, kinds = _TABLES[encoding][0][tokens], _TABLES[encoding][1][tokens]
    (m, n), size = value.shape, len(ALPHABETS[encoding])
    rows = np.arange(m)[:, None]
    used = np.bincount((rows * size + value).ravel(), minlength=m * size).reshape(m, size)
    # Exact mean and variance of Pearson's statistic for multinomial counts.
    uniform = ((used.astype(float) ** 2).sum(axis=1) * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    # Runs of several kinds, given how often each occurs.
    each = np.bincount((rows * 4 + kinds).ravel(), minlength=m * 4).reshape(m, 4).astype(float)
    two, three = (each**2).sum(axis=1), (each**3).sum(axis=1)
    spread = np.sqrt(np.maximum(two * (two + n * (n + 1)) - 2 * n * three - n**3, 0) / (n * n * (n - 1)))
    runs = 1 + (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1)
    alternate = np.where(spread > 1e-9, (runs - (n * (n + 1) - two) / n) / np.maximum(spread, 1e-9), -math.sqrt(n))
    off = value - value.mean(axis=1, keepdims=True)
    square = (off**2).sum(axis=1)
    serial = np.where(square > 0, (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.maximum(square, 1e-9), 1.0) * math.sqrt(n)
    return np.stack([uniform, alternate, serial], axis=1)


def statistic(tokens: list[str], encoding: str) -> np.ndarray:
    """Sum of the squared deviates of tokens of one length."""
    raw = np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8).reshape(len(tokens), -1)
    return (deviates(raw, encoding) ** 2).sum(axis=1)


# -- ordinary text -------------------------------------------------------------------
_LETTER = np.zeros(256, dtype=np.int64)
for _c in _LOWER:
    _LETTER[ord(_c)] = _LETTER[ord(_c.upper())] = ord(_c) - 96


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(27 * 27, dtype=np.int64)
    for batch in batches:
        for _, _, raw, _ in W.blocks(batch.column(0)):
            for at in range(0, len(raw), W.SEGMENT_BYTES):
                code = _LETTER[raw[at : at + W.SEGMENT_BYTES + 1]]
                counts += np.bincount(code[:-1] * 27 + code[1:], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["at", "n"])


def transitions(texts: DataFrame) -> np.ndarray:
    """How often each letter (0: anything else) follows each, over all texts; 27 x 27 numbers."""
    counts = np.zeros(27 * 27, dtype=np.int64)
    for r in texts.mapInArrow(_transitions, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts.reshape(27, 27)


def _words(counts: np.ndarray, rng: np.random.Generator, rows: int, steps: int = 340) -> list[list[str]]:
    """Words by the transitions, some hundred letters a row."""
    chain = counts.astype(float) + np.where(np.arange(27) > 0, 0.01, 0.0)
    chain[0, 0] = 0  # words follow words
    upto = np.cumsum(chain / chain.sum(axis=1, keepdims=True), axis=1)
    state = np.zeros((rows, steps), dtype=np.int64)
    for k in range(1, steps):
        state[:, k] = np.minimum((rng.random(rows)[:, None] > upto[state[:, k - 1]]).sum(axis=1), 26)
    letters = np.frombuffer((" " + _LOWER).encode(), dtype=np.uint8)[state]
    return [bytes(row).decode().split() for row in letters]


def _number(rng: random.Random) -> str:
    """A date or year, a round number, or a counter."""
    kind = rng.random()
    if kind < 0.4:
        year = f"{rng.randint(1990, 2029)}"
        return year if rng.random() < 0.5 else f"{year}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
    if kind < 0.6:
        return f"{rng.randint(1, 9)}{'0' * rng.randint(1, 4)}"
    return f"{rng.randint(0, 10 ** rng.randint(1, 3)):0{rng.randint(1, 4)}d}"


def _identifier(words: list[str], encoding: str, rng: random.Random) -> str:
    """The words as an ordinary token of an encoding."""
    alphabet = ALPHABETS[encoding]
    digits = [c for c in alphabet if c.isdigit()]
    signs = [c for c in alphabet if c in "+/-_"]
    number = lambda: "".join(c if c in digits else "2" for c in _number(rng))
    if encoding in ("hex", "upper_hex"):
        few = [c for w in words for c in w if c in "abcdef"] or ["a"]
        out = "".join(number() + "".join(few[(3 * i + k) % len(few)] for k in range(rng.randint(1, 3))) for i in range(120))
        return out.upper() if encoding == "upper_hex" else out
    camel = rng.random() < 0.5
    sign = rng.choice(signs) if signs else ""
    out = []
    for w in words:
        both = any(c.isupper() for c in alphabet) and any(c.islower() for c in alphabet)
        out.append(w.capitalize() if both and (camel or encoding in ("letters52", "alnum62")) else w)
        if digits and rng.random() < 0.3:
            out.append(number())
    joined = sign.join(out)
    return joined if any(c.islower() for c in alphabet) else joined.upper()


class Ordinary:
    """What ordinary tokens give: sorted statistics by encoding and class of lengths."""

    def __init__(self, counts: np.ndarray, simulated: int = SIMULATED, seed: int = 17) -> None:
        rng = random.Random(seed)
        words = _words(counts, np.random.default_rng(seed), simulated)
        self.sorted: dict[tuple[str, int], np.ndarray] = {}
        self.tail: dict[tuple[str, int], tuple[float, float]] = {}
        for encoding in ALPHABETS:
            tokens = [t for t in (_identifier(w, encoding, rng) for w in words) if len(t) >= LENGTHS[-1]] or ["a" * LENGTHS[-1]]
            for n in LENGTHS:
                # Those of other alphabets when cut would be judged by theirs.
                cut = [t[:n] for t in tokens]
                own = [t for t in cut if encoding_of(t) == encoding]
                found = np.sort(statistic(own if len(own) >= 200 else cut, encoding))
                self.sorted[encoding, n] = found
                log = np.log(np.maximum(found, 1e-9))
                self.tail[encoding, n] = float(log.mean()), float(log.std() + 1e-6)

    def p(self, value: float, encoding: str, length: int) -> float:
        """Chance that an ordinary token looks at least as random."""
        if value > NOT_RANDOM:
            return 1.0
        value = max(value, TYPICAL)
        key = encoding, max(n for n in LENGTHS if n <= max(length, LENGTHS[0]))
        found = self.sorted[key]
        below = int(np.searchsorted(found, value, side="right"))
        if below >= 20:
            return below / len(found)
        # Beyond what was simulated, the tail of a log-normal law.
        mean, spread = self.tail[key]
        return max(0.5 * math.erfc((mean - math.log(value)) / (spread * math.sqrt(2))), below / len(found))


def random_spans(text: str, taken: list[tuple[int, int]], ordinary: Ordinary, rate: float = FALSE_DISCOVERY) -> list[tuple[int, int]]:
    """Spans of tokens that are too random for ordinary text, outside ``taken``."""
    tests = []
    for m in _TOKEN.finditer(text):
        encoding = encoding_of(m.group())
        bare = m.group().rstrip("=")
        if encoding and not any(a < m.end() and m.start() < b for a, b in taken):
            tests.append((ordinary.p(float(statistic([bare], encoding)[0]), encoding, len(bare)), m.start(), m.end()))
    tests.sort()
    upto = max((i for i, t in enumerate(tests, 1) if t[0] <= rate * i / len(tests)), default=0)
    return [(a, b) for _, a, b in tests[:upto]]


_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, in order of start, then kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def scan(text: str | None, ordinary: Ordinary, rate: float = FALSE_DISCOVERY) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(a, b, KINDS[3]) for a, b in random_spans(text, [(a, b) for a, b, _ in base], ordinary, rate)]
    both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
    return base, both


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(ordinary: Ordinary, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [scan(t, ordinary, rate) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s[2] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS[:3]]
                digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows])
                spans = pa.array([_joined(both) for _, both in rows])
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, spans], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``docs`` are read twice: once for what ordinary text is like, then to scan.
    Null and empty texts have no spans; repeated rows and null ids are returned
    as they come; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordinary = Ordinary(transitions(texts.select("text")))
    return texts.mapInArrow(_scan(ordinary, rate), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
