"""Operator 3: exact round trips through the store, against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from florilege.llm import idstore, segments

SCHEMA = "doc_id long, text string, start long, n string, root int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(6)
    bits = ["the ", "quick", " word", " and", " it's", "  ", "\n", "\t", "é", "ß²", "12", "½", "__a", "#$%", "\xa0", " ", "日本", "😀", "\x85", "\x1c", "<|endoftext|>", "'ll", "ª", "ŉ", "ǅ"]
    shared = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000))
    out = [None, "", " ", "a", shared, "x " + shared, shared + " y", "z" * 20000, "w " * 40000]
    return out + ["".join(rng.choices(bits, k=rng.randrange(1, 80))) for _ in range(200)]


def check_column(enc, tokenizer, column):
    ids, ends = enc.encode(pa.array(column, pa.string()))
    at = 0
    for t, end in zip(column, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t[:100]
        at = end
    assert at == len(ids)


def test_encoder_is_the_library(tokenizer, monkeypatch):
    enc = segments.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for lot in (segments.LOT, 300):
        monkeypatch.setattr(segments, "LOT", lot)
        for _ in range(2):  # unknown, then known
            check_column(enc, tokenizer, texts())
            for t in texts():
                check_column(enc, tokenizer, [t])
    check_column(enc, tokenizer, [])
    check_column(enc, tokenizer, [None, "", None])


def test_encoder_with_a_full_table(tokenizer, monkeypatch):
    monkeypatch.setattr(segments, "REMEMBERED", 50)
    enc = segments.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(0, 200, 7):
        check_column(enc, tokenizer, texts()[k : k + 7])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0\u2003ab'1.é日"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_encoder_on_any_text(column):
    check_column(segments.encoder(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), column)


def test_added_token_is_the_librarys(spark, tokenizer):
    rows = [(1, "one <|endoftext|> two"), (2, "a<|endoftext|>b <|endoftext|>"), (3, "<|endoftext|>")]
    assert 50256 in tokenizer.encode(rows[0][1], add_special_tokens=False).ids
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in idstore.store_and_read(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_crc_of_parts():
    raw = random.Random(1).randbytes(5000)
    for at in ([], [1], [7, 7, 4000]):
        ends = [0, *at, len(raw)]
        assert idstore.join_crcs([(zlib.crc32(raw[a:b]), b - a) for a, b in zip(ends, ends[1:])]) == zlib.crc32(raw)


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 50000, 60000).astype("<u2")
    ends = idstore.cuts(ids)
    assert ends[-1] == len(ids) and all(b - a <= idstore.MOST for a, b in zip([0, *ends], ends))
    moved = idstore.cuts(np.concatenate([ids[:100], ids]))
    assert len({e - 100 for e in moved} & set(ends)) > 0.8 * len(ends)


def test_store_round_trip(spark, tmp_path, tokenizer):
    rows = [(i * 3 % 1009, t, 1, "q", 2) for i, t in enumerate(texts())] + [(None, "last", 1, "q", 2), (4, "twice", 1, "q", 2), (4, "twice", 1, "q", 2)]
    path = idstore.write_store(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/s")
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted(idstore.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in order]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r[0]), len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    full = idstore.read_ids(spark, path).collect()
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in full))) == sorted(str((r[0], ids[r[1]])) for r in rows)
    chunks = idstore.cut_files(spark, path, True)
    assert chunks.count() == chunks.select("digests").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").agg({"n_tokens": "sum", "n_docs": "sum"}).first()
    assert set(manifest) == {at, len(rows)}


def test_empty_store(spark):
    assert idstore.store_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_side_by_side_cuts_as_alone():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50000, n).astype("<u2") for n in (1, 5, 3000, 20000, 256, 1)]
    ids, ends = idstore.with_ends(np.concatenate(docs), np.cumsum([len(d) for d in docs]), 2)
    allowed, at = idstore.marks(ids).tolist(), 0
    for d, end in zip(docs, ends.tolist()):
        assert [e - at for e in idstore.chunk_ends([m for m in allowed if at < m <= end], at, end)] == idstore.cuts(np.append(d, 2).astype("<u2"))
        at = end


def lose(folder, which=0):
    files = sorted(p for p in folder.rglob("*.parquet") if pq.read_metadata(p).num_rows)
    files[which].unlink()


@pytest.mark.parametrize("part", ["recipes", "manifest", "head", "cut"])
@pytest.mark.parametrize("which", [0, -1])
def test_lost_files_raise(spark, tmp_path, part, which):
    rows = [(i, " ".join(str((i * k) % 991) for k in range(900))) for i in range(60)]
    path = idstore.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s")
    assert idstore.read_documents(spark, path).count() == 60
    lose(tmp_path / "s" / part, which)
    with pytest.raises(Exception, match="match|start where|recipe|PATH_NOT_FOUND|UNABLE_TO_INFER"):
        idstore.read_documents(spark, path).collect()
