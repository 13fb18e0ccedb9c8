"""Byte-pair encoding by speculation and verification, and decoding.

A word is proposed as greedy longest matches in the vocabulary, all distinct
words of a batch in step.  A sequence of tokens is what the merges make of its
word exactly if each token is what they make of its own letters and no merge
ever crosses the border of two neighbours; the latter depends on the two tokens
only.  So every pair of neighbours is tested, all pairs of a batch in step, by
taking both tokens apart in reverse order of their merges and asking at each
step whether a merge across the border would have come first.  Only words with
a failing pair are merged: those of similar length in step, a merge of each at a
time, long ones one by one.

Normalisation, words and special strings are those of the vocabulary's
``tokenizers`` file.  Texts of letters below U+0180 are split here, others by
the library's own normaliser and splitter; tests compare the two on all code
points.  Vocabularies with byte letters, a suffix at the end of words and the
splitting pattern of ``word_bpe_49k`` are understood, others are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import balanced

#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 1 << 18
#: Words of more bytes are merged one by one without a proposal.
LONG_WORD = 4096
#: Failing words of more bytes are merged one by one, others in step.
STEP_WORD = 64
#: Longer texts are split and encoded in parts of about this many characters, cut at blanks.
PART_CHARS = 1 << 20

_END = 256  # the end of a word, a letter after its bytes
_NEVER = np.int64(1) << 40
_NO_RANK = np.iinfo(np.int32).max
_BLANK = re.compile(r"\s")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the pattern of the vocabulary


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _simple_splitter() -> tuple[re.Pattern, re.Pattern]:
    """What is beyond simple texts, and the words of a simple text in lower case."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(0x180)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    blank = "\t-\r \x85\xa0"
    beyond = re.compile("[^\x00-įı-ſ]")  # U+0130 becomes two letters in lower case
    letters, digits = re.escape(kinds["L"]), re.escape(kinds["N"])
    return beyond, re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")


class Vocabulary:
    """Tables of one vocabulary file; made once in each process."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not suffix or model["unk_token"] or spec["decoder"] or steps[0]["pattern"]["Regex"] != _SPLIT:
            raise ValueError(f"{path} is not a vocabulary of this kind")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.beyond, self.simple_words = _simple_splitter()
        self.letters = byte_letters()

        ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        size = max([*ids.values(), *special.values()]) + 1
        self.strings = [""] * size
        for s, i in chain(ids.items(), special.items()):
            self.strings[i] = s
        self.numbers = [str(i) for i in range(size)]
        self.size = size

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(left * size + right)
        self.pairs, self.pair_rank, self.pair_made = (left * size + right)[order], order, made[order]
        self.made = made
        self.rank = np.full(size, -1, dtype=np.int64)
        self.rank[made] = np.arange(len(made))
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[made], self.right[made] = left, right
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("merges are not in the order in which tokens arise")
        self.by_pair = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}

        self.first, self.last = np.full(256, -1), np.full(256, -1)
        for c, b in self.letters.items():
            self.first[b], self.last[b] = ids[c], ids[c + suffix]
        sound = np.ones(size, dtype=bool)
        own = ~self._crossed(left, right, inside=True)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), own.tolist(), strict=True):
            sound[m] = ok and sound[a] and sound[b]
        self._trie({i: [self.letters[c] for c in s.removesuffix(suffix)] + [_END] * s.endswith(suffix) for s, i in ids.items() if sound[i]})
        self.known: dict[str, tuple[int, ...]] = {}

    def _trie(self, tokens: dict[int, list[int]]) -> None:
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, letters in tokens.items():
            node = 0
            for x in letters:
                node = children.setdefault(node * 257 + x, len(children) + 1)
            ends[node] = i
        self.edges = np.array(sorted(children), dtype=np.int64)
        self.targets = np.array([children[k] for k in self.edges.tolist()], dtype=np.int64)
        self.token = np.full(len(children) + 1, -1, dtype=np.int64)
        self.token[list(ends)] = list(ends.values())

    def _crossed(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of tokens ``a`` and ``b``; ``inside``: one other than that which joins the two."""
        out = np.zeros(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a, b
        until_x, until_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            key = x * self.size + y
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[place] == key, self.pair_rank[place], _NEVER)
            # Of two equal pairs that overlap the left one is merged.
            crossing = (rank < until_x) & (rank <= until_y) & (rank < _NEVER)
            if inside:
                crossing[:] = False
                inside = False
            out[at[crossing]] = True
            take_x = self.rank[x] > self.rank[y]
            go = ~crossing & (np.maximum(self.rank[x], self.rank[y]) >= 0)
            until_x, until_y = np.where(take_x, self.rank[x], until_x)[go], np.where(take_x, until_y, self.rank[y])[go]
            x, y, at = np.where(take_x, self.right[x], x)[go], np.where(take_x, y, self.left[y])[go], at[go]
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of non-empty words: ids of all words, and their number in each."""
        lengths = np.array([len(w) for w in words], dtype=np.int64) + 1
        end = np.cumsum(lengths)
        data = np.full(end[-1] + 1, _END, dtype=np.int64)
        inner = np.ones(end[-1] + 1, dtype=bool)
        inner[end - 1] = inner[-1] = False
        data[inner] = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.arange(len(words))
        place, node = end - lengths, np.zeros(len(words), dtype=np.int64)
        best, best_end = np.full(len(words), -1), place.copy()
        who, what = [], []
        while len(at):
            letter = data[place]
            key = node * 257 + letter
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = (self.edges[edge] == key) & (place < end[at])
            node = np.where(on, self.targets[edge], 0)
            place = place + on
            token = self.token[node]
            # A token that stops before the end of the word would leave it alone.
            good = on & (token >= 0) & ((letter == _END) | (data[place] != _END))
            best, best_end = np.where(good, token, best), np.where(good, place, best_end)
            out = np.flatnonzero(~on)
            who.append(at[out])
            what.append(best[out])
            place[out] = best_end[out]
            best[out] = -1
            go = on | (place < end[at])
            at, place, node, best, best_end = at[go], place[go], node[go], best[go], best_end[go]
        who = np.concatenate(who)
        return np.concatenate(what)[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word by its merges in order of rank, the leftmost of equal ones first."""
        n = len(word)
        ids = [*self.first[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        by_pair = self.by_pair
        heap = [found[0] << 40 | i for i in range(n - 1) if (found := by_pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 40, top & (1 << 40) - 1
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = by_pair.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if more := by_pair.get((ids[i], ids[k])):
                    heapq.heappush(heap, more[0] << 40 | i)
            if before[i] >= 0 and (more := by_pair.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, more[0] << 40 | before[i])
        return tuple(x for x in ids if x >= 0)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of ids ``a`` and ``b``; an id of -1 has none."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[place] == key) & (a >= 0) & (b >= 0), self.pair_rank[place], _NO_RANK).astype(np.int32)

    def _merge_in_step(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of each of some words, one row of a matrix each; a round takes the first merge of every row."""
        n, lengths = len(words), np.array([len(w) for w in words], dtype=np.int64)
        width = int(lengths.max())
        none = n * width  # the place before a word and after it
        inside = np.arange(width) < lengths[:, None]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        end = np.arange(n) * width + lengths - 1
        ids = np.full(none + 1, -1, dtype=np.int64)
        ids[:-1][inside.ravel()] = self.first[data]
        ids[end] = self.last[data[np.cumsum(lengths) - 1]]
        after, before = np.arange(1, none + 2), np.arange(-1, none)
        after[end], before[np.arange(n) * width] = none, none
        rank = np.full(none + 1, _NO_RANK, dtype=np.int32)
        rank[:-1] = self._ranks(ids[:-1], ids[after[:-1]])
        rows, live = rank[:-1].reshape(n, width), np.arange(n)
        while len(live):
            held = rows[live]
            first = held.argmin(axis=1)  # the leftmost of equal ones
            least = held[np.arange(len(live)), first]
            go = least < _NO_RANK
            live, i = live[go], (live * width + first)[go]
            j = after[i]
            ids[i], ids[j], rank[j] = self.made[least[go]], -1, _NO_RANK
            after[i] = k = after[j]
            before[k] = i
            rank[i] = self._ranks(ids[i], ids[k])
            h = before[i]
            rank[h] = self._ranks(ids[h], ids[i])
        left = ids[:-1].reshape(n, width)
        stop = np.cumsum((left >= 0).sum(axis=1)).tolist()
        flat = left[left >= 0].tolist()
        return [tuple(flat[low:high]) for low, high in zip([0, *stop], stop)]  # noqa: B905

    def merge_all(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of each of some non-empty words."""
        out: list[tuple[int, ...]] = [()] * len(words)
        alike: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > STEP_WORD:
                out[i] = self.merge(w)
            else:
                alike.setdefault((len(w) - 1).bit_length(), []).append(i)
        for group in alike.values():
            for i, ids in zip(group, self._merge_in_step([words[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def word_ids(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of some non-empty words: proposals, those with a failing pair merged anew."""
        out: list[tuple[int, ...]] = [()] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i in range(len(words)) if len(short) < len(words) else ():
            if len(words[i]) > LONG_WORD:
                out[i] = self.merge(words[i])
        if not short:
            return out
        ids, counts = self.propose([words[i] for i in short])
        stop = np.cumsum(counts)
        border = np.ones(len(ids), dtype=bool)
        border[stop - 1] = False  # the last token of a word has no neighbour
        first = np.flatnonzero(border)
        pairs, back = np.unique(ids[first] * self.size + ids[first + 1], return_inverse=True)
        crossed = self._crossed(pairs // self.size, pairs % self.size)[back]
        word_of = np.repeat(np.arange(len(short)), counts)
        failed = np.zeros(len(short), dtype=bool)
        failed[word_of[first[crossed]]] = True
        flat, stop = ids.tolist(), stop.tolist()
        anew = []
        for k, bad in enumerate(failed.tolist()):
            i = short[k]
            if bad:
                anew.append(i)
            else:
                out[i] = tuple(flat[stop[k - 1] if k else 0 : stop[k]])
        for i, merged in zip(anew, self.merge_all([words[i] for i in anew]), strict=True):
            out[i] = merged
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised."""
        if not self.beyond.search(text):
            return self.simple_words.findall(text.lower())
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.letters.__getitem__, p)).decode() for p, _ in pieces]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, all new words of the batch encoded together."""
        cut: list[list[list[str] | int]] = []
        for t in texts:
            parts, at = [], 0
            for m in self.specials.finditer(t) if self.specials else ():
                parts += [self.words(t[at : m.start()]), self.special[m[0]]]
                at = m.end()
            cut.append([*parts, self.words(t[at:] if at else t)])
        used = {w for parts in cut for p in parts if not isinstance(p, int) for w in p}
        if len(self.known) + len(used) > REMEMBERED:
            self.known.clear()
        new = [w for w in used if w not in self.known]
        if new:
            self.known.update(zip(new, self.word_ids([w.encode() for w in new]), strict=True))
        known = self.known.__getitem__
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(known, p)) for p in parts)) for parts in cut]

    def text(self, ids: Iterable[int]) -> str:
        """Decoded ids: this kind of vocabulary has no decoder, so tokens are joined by blanks."""
        return " ".join(map(self.strings.__getitem__, ids))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str = "word_bpe_49k", folder: str | None = None) -> Vocabulary:
    import public_tokenizers

    path = f"{folder}/{name}.json" if folder else public_tokenizers.path(f"{name}.json")
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """``text`` in parts cut before a blank, which no word or special string goes across."""
    size, at = size or PART_CHARS, 0
    while len(text) - at > size and (cut := _BLANK.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _encoded(column: pa.Array, words: Vocabulary) -> Iterator[tuple[int, list[int]]]:
    """(row, ids of a part of it), rows in order; a long text comes in several parts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for low, high in balanced(sizes):
        texts = [t or "" for t in column.slice(low, high - low).to_pylist()]
        if high - low == 1:
            for p in parts(texts[0]):
                yield low, words.ids([p])[0]
        else:
            yield from enumerate(words.ids(texts), low)


def _ids(name: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name, folder)
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i, ids in _encoded(batch.column(1), words):
                rows[i] += ids
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(name: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name, folder)
        for batch in batches:
            texts = [words.text(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digests(name: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name, folder)
        for batch in batches:
            counts = [0] * batch.num_rows
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in counts]
            for i, ids in _encoded(batch.column(1), words):
                if ids:
                    joint = b" " if counts[i] else b""
                    sums[i][0].update(joint + " ".join(map(words.numbers.__getitem__, ids)).encode())
                    sums[i][1].update(joint + words.text(ids).encode())
                    counts[i] += len(ids)
            columns = [pa.array(counts, pa.int64()), *(pa.array([s[k].hexdigest() for s in sums], pa.string()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _two(df: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(col).cast(kind).alias(col))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (array of int); null and empty texts have none.  No shuffle."""
    return _two(docs, id_col, text_col, "string").mapInArrow(_ids(name, folder), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = "word_bpe_49k", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, text of the ids; null ids count as none."""
    return _two(encoded, id_col, ids_col, "array<int>").mapInArrow(_texts(name, folder), "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "word_bpe_49k", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by a blank), decoded_sha256 (the decoded ids).

    No shuffle: rows stay in the partitions of the scan, and only digests leave
    the Python workers.  Null and empty texts have no tokens; null ids and
    repeated rows are returned as they come; other columns are ignored.
    """
    return _two(docs, id_col, text_col, "string").mapInArrow(_digests(name, folder), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
