"""Token ids and counts of whole texts with a public byte-level BPE vocabulary.

The vocabulary exists as a ``tokenizers`` file and, identically, as merge ranks.
The rank engine gives the same ids four times as fast; tests compare the two on
code points, special strings and a whole table.  Special strings
inside a text are taken as the ``tokenizers`` file takes them: as the special
token.

Long texts are cut at safe boundaries before encoding: at a space with a
character other than white space on both sides.  The pattern that splits text
before the merges never joins characters across such a place, so the ids of the
parts are the ids of the whole.  A text without such a place stays whole.  A run
of ``LONG_RUN`` blanks is a part too, without its last blank where something
other than a special string follows: the pattern takes exactly that as one
piece, but its engine goes back over every blank of it and gives up on a million.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a long text, in characters.
PART_CHARS = 1 << 16
#: Bytes of text encoded together.
BATCH_BYTES = 1 << 20

#: Blanks in a row that are taken out of a text beyond PART_CHARS.
LONG_RUN = 4096

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # white space to the pattern
_RUN = re.compile(f"[{_BLANKS}]{{{LONG_RUN},}}")
_engines: dict[tuple[str, str | None], object] = {}


def _file(name: str, folder: str | None) -> str:
    import public_tokenizers

    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def engine(name: str = "byte_bpe_50k", folder: str | None = None):
    """The encoder of a vocabulary, made once in each process.

    Ranks come from ``<name>.tiktoken``, special strings and their ids from
    ``<name>.json``, the pattern from the package of the vocabularies.
    """
    import public_tokenizers
    import tiktoken

    if (name, folder) not in _engines:
        with open(_file(f"{name}.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(_file(f"{name}.json", folder), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _engines[name, folder] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _engines[name, folder]


def parts(text: str, size: int = PART_CHARS, special: tuple[str, ...] = ()) -> Iterator[str]:
    """``text`` in order, cut at safe boundaries into parts of about ``size`` characters, long runs of blanks by themselves."""
    if len(text) <= size:
        yield text
        return
    low = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text) and not text.startswith(special, run.end()))
        yield from _cut(text[low : run.start()], size)
        yield text[run.start() : end]
        low = end
    yield from _cut(text[low:], size)


def _cut(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:]


def _is_run(part: str) -> bool:
    return len(part) >= LONG_RUN - 1 and not part.strip(_BLANKS)


def token_ids(text: str | None, encoder) -> np.ndarray:
    """All ids of a text, as unsigned 32-bit numbers; null counts as empty."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if len(text) <= PART_CHARS:
        return encoder.encode_to_numpy(text, allowed_special="all")
    cut = parts(text, PART_CHARS, tuple(encoder.special_tokens_set))
    return np.concatenate([np.array(encoder._encode_single_piece(p), dtype=np.uint32) if _is_run(p) else encoder.encode_to_numpy(p, allowed_special="all") for p in cut])


def batch_lengths(texts: list[str | None], encoder) -> np.ndarray:
    """Number of ids of each text: one batch call over the parts of all of them."""
    special = tuple(encoder.special_tokens_set)
    cut = [(i, p) for i, t in enumerate(texts) if t for p in parts(t, PART_CHARS, special)]
    runs = [(i, len(encoder._encode_single_piece(p))) for i, p in cut if _is_run(p)]
    rest = [(i, p) for i, p in cut if not _is_run(p)]
    ids = encoder.encode_batch([p for _, p in rest], num_threads=1, allowed_special="all")
    owner = [i for i, _ in runs] + [i for i, _ in rest]
    return np.bincount(np.array(owner, dtype=np.int64), [n for _, n in runs] + [len(x) for x in ids], len(texts)).astype(np.int64)


def balanced(sizes: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together, a larger row by itself."""
    low, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and total + n > limit:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def _lengths(name: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        encoder = engine(name, folder)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for low, high in balanced(sizes):
                texts = batch.column(1).slice(low, high - low).to_pylist()
                counts = batch_lengths(texts, encoder)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes[low:high].astype(np.int64)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Only lengths leave the Python workers.  No shuffle: rows stay in the
    partitions of the scan.  Null and empty texts have 0 bytes and 0 tokens; null
    ids and repeated rows are returned as they come; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_lengths(vocabulary, folder), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
