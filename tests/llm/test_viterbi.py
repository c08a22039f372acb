"""Operator 5 against the sentencepiece library, a whole-text search, and exact round trips."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from florilege.llm import segments, viterbi

FILE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_ids int"


def texts(n=400):
    rng = random.Random(3)
    bits = ["a", "b", "the", "ing", " ", "  ", ".", "..", '"', "\n", "\t", "é", "ß", "日", "1", "0", "_", "(", ");", "-", "²", '²."', "'s", "😀", "\r", "\x00", "ŉ"]
    return ["", " ", "a" * 3000, "ab" * 3000, "-" * 500, " " * 500, "ﬁ", "﻿x"] + ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return viterbi.Codec(FILE)


def test_ids_are_the_librarys_and_decode_exactly(codec):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for _ in range(2):  # unknown, then known
        ids, ends, exact = codec.encode_column(pa.array(texts()))
        assert exact.all() and len(ids) == ends[-1]
        for t, got in zip(texts(), codec.encode_texts(texts()), strict=True):
            assert got == sp.encode(t)
            assert codec.decode(got) == t
    for t in texts(60):
        assert codec.encode_texts([t, None, "", t]) == [sp.encode(t), [], [], sp.encode(t)]
    assert codec.encode_texts([]) == []
    assert codec.encode_texts(["a▁b", "▁"]) == sp.encode(["a▁b", "▁"])


def test_stream_in_parts_is_bounded(codec):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 9))) for _ in range(20000))
    search, out, at = viterbi.StreamingViterbi(codec.m), [], 0
    marked = viterbi.BLANK + text.replace(" ", viterbi.BLANK)
    while at < len(marked):
        n = rng.randrange(1, 200)
        out += search.push(marked[at : at + n])
        at += n
    assert out + search.finish() == sp.encode(text)
    assert search.peak < 400


def test_parts_of_a_long_text(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for lot, part in ((7, 1), (64, 3), (1 << 19, 2)):
        monkeypatch.setattr(segments, "LOT", lot)
        monkeypatch.setattr(viterbi, "PART", part)
        assert viterbi.Codec(FILE).encode_texts(texts(80)) == sp.encode(texts(80))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\nab×÷éɏȿ'1.日"), st.characters(exclude_categories=["Cs"], exclude_characters="▁")), max_size=60), max_size=5))
def test_any_text(column):
    c, sp = viterbi.codec(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert c.encode_texts(column) == sp.encode(column)
    assert c.encode_column(pa.array(column, pa.string()))[2].all()


def test_batches_commit_before_their_end_in_a_bounded_window(spark, monkeypatch):
    """What the query runs: the search over ordinary text commits as it goes, and never holds more than a few pieces' lengths."""
    seen = []

    class Watched(viterbi.StreamingViterbi):
        def push(self, text):
            ids = super().push(text)
            seen.append((len(text), len(ids), self.peak))
            return ids

    monkeypatch.setattr(viterbi, "StreamingViterbi", Watched)
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    fresh, sp = viterbi.Codec(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert fresh.encode_texts(rows) == sp.encode(rows)
    long = [(n, k) for n, k, _ in seen if n > 1000]
    assert long and all(k > n / 20 for n, k in long)
    # a text without a border between units is one unit, in the same window
    run = "Ab" * 40_000
    assert fresh.encode_texts([run]) == [sp.encode(run)]
    assert max(n for n, *_ in seen) > 80_000 and max(peak for *_, peak in seen) <= 8 * fresh.m.longest


def test_units_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(viterbi, "REMEMBERED", 50)
    fresh, sp = viterbi.Codec(FILE), sentencepiece.SentencePieceProcessor(model_file=FILE)
    for k in range(0, 60, 5):
        batch = texts(60)[k : k + 5] + ["the same words again"]
        assert fresh.encode_texts(batch) == sp.encode(batch)


def test_what_does_not_come_back_is_told(codec):
    """A model without bytes for a sign loses it: `exact` is false for that text alone."""
    lossy = viterbi.Codec(FILE)
    lossy.m.bytes = {}
    assert lossy.encode_column(pa.array(["plain", "ꙮ text", "", None, "plain too"]))[2].tolist() == [True, False, True, True, True]


def test_unigram_scores_against_whole_text_search():
    m = viterbi.Model(FILE, kind="unigram")
    m.score = [-float(len(p) % 3 + 1) - i / 1e6 for i, p in enumerate(m.text)]
    for t in texts(60):
        marked = viterbi.BLANK + t.replace(" ", viterbi.BLANK)
        best = [0.0] + [-1e18] * len(marked)
        for end in range(1, len(marked) + 1):
            best[end] = best[end - 1] + viterbi.LOST
            for start in range(max(0, end - m.longest), end):
                if (p := m.id.get(marked[start:end])) is not None:
                    best[end] = max(best[end], best[start] + m.score[p])
        search = viterbi.StreamingViterbi(m)
        ids = search.push(marked) + search.finish()
        lost = sum(c not in m.id for c in marked)
        got = sum(m.score[i] for i in ids if i not in m.byte_of) + lost * viterbi.LOST
        if all(i not in m.byte_of for i in ids) or lost:
            assert abs(got - best[-1]) < 1e-6 * max(1, abs(best[-1]))


def test_encode_and_decode_frames(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(50))] + [(None, None, "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = viterbi.encode(df)
    seen = sorted((str(r.doc_id), list(r.ids), r.n_ids, r.exact) for r in got.collect())
    assert seen == sorted((str(i), sp.encode(t or ""), len(sp.encode(t or "")), True) for i, t, *_ in rows)
    assert sorted(map(str, viterbi.decode(got).collect())) == sorted(map(str, df.selectExpr("doc_id", "coalesce(text, '') AS text").collect()))
    assert viterbi.encode(spark.createDataFrame([], SCHEMA)).count() == 0
