"""Token counts against the tokenizer, and pieces of texts: whole, within limits, at boundaries, overlapping."""

import random

import pytest

from vigil.llm import chunking, tokens
from vigil.llm.documents import once
from vigil.session import Scratch

PARTS = ["word ", "a", "B9", "  ", "\n", "\r\n", "\n\n", "\t", "'s ", "'re", "'", "好", "。", "! ", "　", "é́", "👩‍👩‍👧", "🇩🇪🇫🇷", "x" * 50, "ab0" * 30, "́" * 5, "aGVsbG8gd29ybGQ" * 12, " ", "_", "١"]


def _texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_are_the_tokenizers():
    texts = _texts(3000, 14) + _texts(20, 500, 2) + ["", " ", "\n\n", "'s", "don't we'll THEY'RE", "x" * 3_000_000]
    encode = tokens.encoder(tokens.VOCABULARY)
    assert tokens.Counter().totals(texts).tolist() == [len(encode(t)) for t in texts]


def test_sizes_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "two words", 5)], "doc_id long, text string, n_tokens int")
    assert {(r.doc_id, r.n_tokens) for r in tokens.with_sizes(df, "text", ["doc_id"]).collect()} == {(1, 0), (2, 0), (3, 2)}
    assert tokens.with_sizes(df.limit(0), "text", ["doc_id"]).count() == 0


def _check(rows, texts, limits):
    """Pieces put together are the text; each is within the limit, counted rightly and doesn't split a sign."""
    encode = tokens.encoder(tokens.VOCABULARY)
    by = {}
    for r in rows:
        by.setdefault((r.limit_tokens, r.doc_id), []).append(r)
    for (limit, doc), pieces in by.items():
        text, end = texts[doc], 0
        for n, p in enumerate(sorted(pieces, key=lambda r: r.piece_no)):
            assert p.piece_no == n and p.core_start == end and p.char_start <= p.core_start and p.text == text[p.char_start : p.char_end]
            assert len(encode(p.text)) == p.n_tokens <= limit
            end = p.char_end
        assert end == len(text)
    for limit, _ in limits:
        assert {d for (k, d) in by if k == limit} == {d for d, t in texts.items() if t and len(encode(t)) > limit}


@pytest.mark.parametrize("limits", [[(64, 8)], [(256, 32), (30, 5)]])
def test_pieces(spark, limits):
    texts = dict(enumerate(_texts(250, 300, 3) + ["", None, "z" * 20_000, "好" * 3000, "a\r\n" * 900, "é́" * 700, "no end " * 2000]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, piece_no string, limit_tokens int")
    _check(chunking.split_oversized(df, "doc_id", "text", limits).collect(), texts, limits)


def test_boundaries_and_overlap(spark):
    sentence = "The gate was closed at noon and nobody went in. "
    text = "\n\n".join((sentence * 6).strip() for _ in range(8))
    rows = sorted(chunking.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", [(200, 16)]).collect(), key=lambda r: r.piece_no)
    assert len(rows) >= 4 and all(text[: r.core_start].endswith("\n\n") for r in rows[1:])
    assert all(16 <= r.overlap_tokens <= 20 for r in rows[1:]) and rows[0].overlap_tokens == 0
    one = "\n".join(["line of text without end"] * 60)
    assert all(one[: r.core_start].endswith("\n") for r in chunking.split_oversized(spark.createDataFrame([(1, one)], "doc_id long, text string"), "doc_id", "text", [(100, 10)]).collect() if r.piece_no)


def test_signs_stay_whole(spark):
    family = "👩‍👩‍👧"
    text = family * 200
    rows = chunking.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", [(128, 16)]).collect()
    assert len(rows) > 5 and all(r.core_start % len(family) == 0 and r.char_start % len(family) == 0 for r in rows)


def test_bad_limits(spark):
    with pytest.raises(ValueError):
        chunking.split_oversized(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", [(10, 6)])


def test_once(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "x"), (3, "c"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in once(df, "doc_id", Scratch(spark)).collect()) == [(1, "a"), (2, None), (3, "c")]
