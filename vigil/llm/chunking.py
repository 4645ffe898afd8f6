"""Splitting oversized texts at natural boundaries.

A text over the limit is bisected: near the middle of the stretch at hand the strongest boundary is looked for
(end of paragraph, line, sentence, white space, word), the stretch is cut there, and halves that still exceed the limit
minus the overlap are cut again.  Then each piece but the first is led by the end of the text before it.

Cuts lie between words of the tokenizer, never inside a sign made of several code points; only words of more than
``LONG_WORD`` tokens (stretches without blanks) may be cut between their tokens.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm.tokens import SPACE, VOCABULARY, Counter, classes, slices, token_bytes

LONG_WORD = 48
LONGEST_SIGN = 64  # tokens of a sign of several code points that is kept whole
PARAGRAPH, LINE, SENTENCE, BLANK, WORD = 4, 3, 2, 1, 0

# fixed values: code points that end lines and sentences, and that may follow the end of a sentence
LINE_ENDS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
SENTENCE_ENDS = tuple(map(ord, ".!?…。！？｡।؟"))
WIDE_ENDS = tuple(map(ord, "。！？｡"))
CLOSERS = tuple(map(ord, "\"')]}»”’）」』】"))


@lru_cache(maxsize=1)
def joined_to_previous() -> np.ndarray:
    """Whether a code point continues the sign before it: marks, joiners, variation selectors, skin tones, jamo."""
    import regex

    table = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(r"[\p{M}‌‍︎️\U0001F3FB-\U0001F3FF\U000E0020-\U000E007Fᅠ-ᇿ]+", "".join(map(chr, range(low, high)))):
            table[low + m.start() : low + m.end()] = True
    return table


@lru_cache(maxsize=1)
def roles() -> np.ndarray:
    """Bits of every code point: 1 ends a line, 2 ends a sentence, 4 does so without a blank, 8 may follow such an end."""
    table = np.zeros(0x110000, np.uint8)
    for bit, some in ((1, LINE_ENDS), (2, SENTENCE_ENDS), (4, WIDE_ENDS), (8, CLOSERS)):
        table[list(some)] |= bit
    return table


def inside_sign(points: np.ndarray) -> np.ndarray:
    """Positions before which a cut would split a sign."""
    inside = joined_to_previous()[points]
    inside[1:] |= (points[:-1] == 0x200D) | ((points[:-1] == 0x0D) & (points[1:] == 0x0A))
    flag = (points >= 0x1F1E6) & (points <= 0x1F1FF)  # pairs of regional indicators are flags
    if flag.any():
        starts = np.flatnonzero(flag & ~np.r_[False, flag[:-1]])
        at = np.flatnonzero(flag)
        inside[at] |= (at - starts[np.searchsorted(starts, at, side="right") - 1]) % 2 == 1
    return inside


def _strengths(points: np.ndarray, begins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strength of a cut before each position ``at``, and where the white space before it begins."""
    n = len(points)
    space = classes()[points] == SPACE
    enders = roles()[points] & 1 > 0
    enders[:-1] &= ~((points[:-1] == 0x0D) & (points[1:] == 0x0A))  # a pair is one line end
    lines = np.concatenate([[0], np.cumsum(enders)])
    # for each position the start of the run of white space that ends before it
    bounds = np.zeros(n, bool)
    bounds[begins[begins < n]] = True
    solid = ~space
    # the last solid place, or the begin of the text, before each position
    place = np.arange(n)
    since = np.maximum.accumulate(np.where(solid, place + 1, np.where(bounds, place, 0)))
    run = np.where(at > 0, since[np.maximum(at - 1, 0)], 0)
    ended = lines[at] - lines[run]
    prev = np.maximum(run - 1, 0)
    closed = (roles()[points[prev]] & 8 > 0) & (prev > 0)
    end = roles()[points[np.where(closed, prev - 1, prev)]]
    blank = (run < at) | space[np.minimum(at, n - 1)]
    sentence = (end & 2 > 0) & (blank | (end & 4 > 0))
    return np.where(ended >= 2, PARAGRAPH, np.where(ended == 1, LINE, np.where(sentence, SENTENCE, np.where(blank, BLANK, WORD)))), run


class _Text:
    """A text as units between which it may be cut: where they begin, the tokens up to them, and strengths."""

    def __init__(self, at: np.ndarray, counts: np.ndarray, strength: np.ndarray, soft: np.ndarray, tail: np.ndarray, length: int):
        # looked up one by one, which is faster in lists than in arrays
        self.at = [*at.tolist(), length]
        self.soft = [*soft.tolist(), False]  # inside a long word, where sums of tokens are only estimates
        upto = np.concatenate([[0], np.cumsum(counts)])
        self.upto = upto.tolist()
        self.tail = tail.tolist()  # tokens more or less if the text ended there
        order = strength[1:]
        self.ranked = []
        for s in (PARAGRAPH, LINE, SENTENCE, BLANK):
            units = np.flatnonzero(order == s) + 1
            if len(units):
                self.ranked.append((units.tolist(), upto[units].tolist()))

    def cut(self, i: int, j: int) -> int:
        """The unit before which the stretch i..j is best cut: the strongest boundary in its middle half."""
        low, high = self.upto[i], self.upto[j]
        middle, quarter = (low + high) / 2, (high - low) / 4
        for units, sums in self.ranked:
            k = bisect_left(sums, middle)
            near = [x for x in (k - 1, k) if 0 <= x < len(sums) and abs(sums[x] - middle) <= quarter and i < units[x] < j]
            if near:
                return units[min(near, key=lambda x: abs(sums[x] - middle))]
        k = bisect_left(self.upto, middle, i, j + 1)
        return min((x for x in (k - 1, k) if i < x < j), key=lambda x: abs(self.upto[x] - middle), default=min(max(k, i + 1), j - 1))

    def size(self, i: int, j: int) -> int:
        return self.upto[j] - self.upto[i] + self.tail[j]

    def cores(self, room: int) -> list[tuple[int, int]]:
        done, todo = [], [(0, len(self.at) - 1)]
        while todo:
            i, j = todo.pop()
            if self.size(i, j) <= room or j - i == 1:
                done.append((i, j))
            else:
                k = self.cut(i, j)
                todo += [(k, j), (i, k)]
        return done

    def lead(self, i: int, overlap: int) -> int:
        """Where a piece begins whose core begins at ``i``: at the last unit from which at least ``overlap`` tokens lead there."""
        if not i or not overlap:
            return i
        u = max(bisect_right(self.upto, self.upto[i] - overlap, 0, i + 1) - 1, 0)
        while u and self.size(u, i) < overlap:
            u -= 1
        return u


PIECES = "limit_tokens int, {id} long, piece_no int, char_start long, core_start long, char_end long, n_tokens long, overlap_tokens long, text string"


class Cutter:
    """Cuts texts; exact token counts by ``Counter``."""

    def __init__(self, vocabulary: str = VOCABULARY, room: int = 2 * LONGEST_SIGN):
        """``room``: the least tokens of a core; no unit may have more."""
        self.counter = Counter(vocabulary)
        self.vocabulary = vocabulary
        self.long_word, self.longest_sign = max(1, min(LONG_WORD, room // 4)), min(LONGEST_SIGN, room)
        self.runs: dict[str, int] = {}

    def _count(self, text: str) -> int:
        got = self.runs.get(text)
        if got is None:
            got = len(self.counter.encode(text))
            if len(text) < 64 and len(self.runs) < 100_000:
                self.runs[text] = got
        return got

    def texts(self, batch: list[str], least: int) -> Iterator[tuple[int, _Text]]:
        """(index, units) of the texts of the batch with more than ``least`` tokens."""
        points, begins, starts, counts = self.counter.words(batch)
        if not len(starts):
            return
        running = np.concatenate([[0], np.cumsum(counts)])
        first = np.concatenate([np.searchsorted(starts, begins), [len(starts)]])
        large = np.flatnonzero(running[first[1:]] - running[first[:-1]] > least)
        if not len(large):
            return
        glued = inside_sign(points)
        strength, run = _strengths(points, begins, starts)
        for d in large.tolist():
            a, z, begin, text = first[d], first[d + 1], int(begins[d]), batch[d]
            yield d, self._units(text, starts[a:z] - begin, counts[a:z], strength[a:z], run[a:z] - begin, glued[begin : begin + len(text)])

    def _units(self, text, at, counts, strength, run, glued) -> _Text:
        odd = np.flatnonzero(counts > self.long_word)
        soft = np.zeros(len(at), bool)
        if len(odd):
            parts, last = [], 0
            for w in odd.tolist():
                end = int(at[w + 1]) if w + 1 < len(at) else len(text)
                inner, sizes = self._token_borders(text[int(at[w]) : end])
                parts.append((at[last:w], counts[last:w], strength[last:w], run[last:w], soft[last:w]))
                k = len(inner)
                parts.append((at[w] + inner, sizes, np.r_[strength[w], np.full(k - 1, WORD)], np.r_[run[w], at[w] + inner[1:]], np.arange(k) > 0))
                last = w + 1
            parts.append((at[last:], counts[last:], strength[last:], run[last:], soft[last:]))
            at, counts, strength, run, soft = (np.concatenate([p[q] for p in parts]) for q in range(5))
        bad = glued[at]
        bad[0] = False
        if bad.any():
            keep = ~bad
            for i in np.flatnonzero(bad).tolist():  # long signs are taken apart
                first = i - 1
                while not keep[first]:
                    first -= 1
                keep[i] = int(counts[first : i + 1].sum()) > self.longest_sign
            counts = np.add.reduceat(counts, np.flatnonzero(keep))
            at, strength, run, soft = at[keep], strength[keep], run[keep], soft[keep]
        # a text that ends after several spaces has them in one word
        tail = np.zeros(len(at) + 1, np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])
        for i in np.flatnonzero(at - run >= 2).tolist():
            u = int(np.searchsorted(at, run[i]))
            if u < i and at[u] == run[i]:
                tail[i] = self._count(text[int(run[i]) : int(at[i])]) - int(upto[i] - upto[u])
        return _Text(at, counts, strength, soft, tail, len(text))

    def _token_borders(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens of a word begin that begin with a character, and the tokens from there to the next such place."""
        starts, sizes, chars_at, offset = [], [], {}, 0
        for i, c in enumerate(word):
            chars_at[offset] = i
            offset += len(c.encode())
        offset = 0
        for piece in token_bytes(self.vocabulary, word):
            if offset in chars_at:
                starts.append(chars_at[offset])
                sizes.append(1)
            else:
                sizes[-1] += 1
            offset += len(piece)
        return np.array(starts, np.int64), np.array(sizes, np.int64)

    def checked(self, text: str, units: _Text, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
        """(start, core start, end, tokens, overlapping tokens) of the pieces of a text over the limit.

        A core that leaves no room for the overlap is cut once more.  Pieces that begin or end inside a long word are counted
        anew.  Only where a core of one unit and the overlap exceed the limit together is the overlap shorter.
        """
        out, todo = [], list(reversed(units.cores(limit - overlap)))
        while todo:
            i, j = todo.pop()
            u = units.lead(i, overlap)
            c, e = units.at[i], units.at[j]
            exact = lambda: len(self.counter.encode(text[units.at[u] : e])) if units.soft[u] or units.soft[j] else units.size(u, j)  # noqa: E731, B023
            size = exact()
            if size > limit and j - i > 1:
                k = units.cut(i, j)
                todo += [(k, j), (i, k)]
                continue
            while size > limit and u < i:
                u += 1
                size = exact()
            out.append((units.at[u], c, e, size, units.size(u, i) if u < i else 0))
        return out


def split_oversized(documents: DataFrame, doc_id: str, text: str, limits: list[tuple[int, int]], vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts that exceed a limit, for each (limit, overlap): columns PIECES.

    ``text`` is the text from ``char_start`` to ``char_end``; from ``core_start`` on it is new, before it stands the overlap.
    The cores of a document, one after the other, are its text.  Texts within a limit, null and empty texts give no
    pieces for it.  Documents must have distinct ids.
    """
    limits = sorted({(int(a), int(b)) for a, b in limits})
    if any(a <= 0 or b < 0 or 2 * b > a for a, b in limits):
        raise ValueError("a limit must be positive and at least twice the overlap")
    least = min((a for a, _ in limits), default=0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(vocabulary, min(a - o for a, o in limits))
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            # a token has at least one byte
            long = [(i, t) for i, t in zip(ids, texts) if t and len(t) * 4 > least and len(t.encode()) > least]
            for low, high in slices([t for _, t in long]):
                rows = []
                part = long[low:high]
                for d, units in cutter.texts([t for _, t in part], least):
                    key, whole = part[d]
                    total = int(units.upto[-1])
                    for limit, overlap in limits:
                        if total > limit:
                            found = cutter.checked(whole, units, limit, overlap)
                            rows += [(limit, key, n, s, c, e, k, o, whole[s:e]) for n, (s, c, e, k, o) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names=names)

    names = [c.split()[0] for c in PIECES.format(id=doc_id).split(", ")]
    TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    return documents.select(doc_id, text).mapInArrow(cut, PIECES.format(id=doc_id))
