"""Token counts of texts by a public byte-level BPE vocabulary, computed over columns of words.

Words (pre-tokens) never depend on what precedes them, so a text's tokens are the sum over its words.  Word borders are
found with array operations on code points, different words are encoded once, and texts look up the sums.  This is
exact: ``test_tokens`` holds it against the tokenizer itself.

The vocabulary file is a parameter; executors read it from that path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the word pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 1_000_000  # characters looked at together
CACHED = 400_000  # words whose counts a worker keeps

OTHER, SPACE, LETTER, DIGIT = 0, 1, 2, 3


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a vocabulary file of ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(vocabulary: str):
    """The tokenizer's encode function for ordinary text."""
    return encoding(vocabulary).encode_ordinary


def token_bytes(vocabulary: str, text: str) -> list[bytes]:
    """The bytes of each token of a text."""
    e = encoding(vocabulary)
    return e.decode_tokens_bytes(e.encode_ordinary(text))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, digit, space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for code, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[low + m.start() : low + m.end()] = code
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions where words begin in texts that lie one after the other and begin at ``begins``."""
    n = len(points)
    kind = classes()[points]
    change = np.zeros(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[begins] = True
    change[n] = True
    space = kind == SPACE
    mark = change[:n].copy()
    # a blank before a run of letters, digits or others belongs to it
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 32) & ~space[1:] & change[1:n]
    after_blank[begins] = False
    mark &= ~after_blank
    # the last space of a run that something follows stands apart
    follows = np.zeros(n, bool)
    follows[:-1] = space[:-1] & ~space[1:]
    if len(begins) > 1:
        follows[begins[1:] - 1] = False
    mark |= follows
    mark[begins] = True
    # contractions: an apostrophe that begins a word, alone in its run, before s t m d or re ve ll
    quote = np.flatnonzero((points == 39) & mark)
    quote = quote[quote + 1 < n]
    if len(quote):
        ends = np.searchsorted(begins, quote, side="right")
        limit = np.where(ends < len(begins), begins[np.minimum(ends, len(begins) - 1)], n)
        one = points[quote + 1]
        two = np.where(quote + 2 < limit, points[np.minimum(quote + 2, n - 1)], 0)
        room = quote + 1 < limit
        short = room & np.isin(one, [115, 116, 109, 100])
        long = room & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for some, size in ((short, 2), (long & ~short, 3)):
            at = quote[some]
            mark[at + 1] = False
            past = at + size
            past = past[past < n]
            mark[past] = True
    return np.flatnonzero(mark)


class Counter:
    """Counts tokens of texts; keeps the counts of words it has met."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.encode = encoder(vocabulary)
        self.known: dict[bytes, int] = {}

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, where texts begin, where words begin and the words' token counts."""
        points = code_points("".join(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        filled = begins[sizes > 0]
        if not len(points):
            return points, begins, np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = word_starts(points, filled)
        return points, begins, starts, self.counts(points, starts)

    def counts(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        offsets = np.concatenate([starts, [len(points)]]).astype(np.int64) * 4
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(points))])
        coded = column.dictionary_encode()
        different = coded.dictionary.to_pylist()
        known, encode = self.known, self.encode
        sums = np.empty(len(different), np.int64)
        for i, word in enumerate(different):
            count = known.get(word)
            if count is None:
                count = len(encode(word.decode("utf-32-le", "surrogatepass")))
                if len(known) < CACHED and len(word) < 128:
                    known[word] = count
            sums[i] = count
        return sums[coded.indices.to_numpy(zero_copy_only=False)]

    def totals(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for low, high in slices(texts):
            points, begins, starts, counts = self.words(texts[low:high])
            if len(starts):
                running = np.concatenate([[0], np.cumsum(counts)])
                first = np.searchsorted(starts, begins)
                out[low:high] = running[np.concatenate([first[1:], [len(starts)]])] - running[first]
        return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters; one longer text is a range of its own."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield low, i
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def with_sizes(documents: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole text; a null text has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema) + ", n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counter.totals(texts), pa.int64())], names=[*keep, "n_tokens"])

    return documents.select(*keep, text).mapInArrow(count, schema)
