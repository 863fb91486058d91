"""Encoding, token files and packing against the library itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from flowtally.llm import pack, token_files
from flowtally.llm.common import vocabulary
from flowtally.llm.tokens import PieceEncoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  a  b\n\n c", "a \n b\t\tc  ", "x<|endoftext|> y", "  <|endoftext|>\n", "é́ \x1c\x1d a\x85b c", "a\x0b\x0c b'll don't 12 3", "IT'S don'T We'RE", "İstanbul Σας ΣΑΣ", "1²3 Ⅷ½", "a…,b", "日本 語　テ", "\r\n \r\nz", "Ça éà’s “q” — x", " \x85\xa0b", "x" * 3000]


@pytest.fixture(scope="module", params=[(WORD, False), (BYTE, True)], ids=["word", "byte"])
def coder(request):
    return PieceEncoder(*request.param)


def same(coder, texts):
    flat, sizes = coder.encode(texts)
    ends = np.cumsum(sizes)
    for text, s, e in zip(texts, ends - sizes, ends):
        assert flat[s:e].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_odd_texts(coder):
    same(coder, ODD)
    same(coder, ODD[::-1])
    same(coder, [":\U0003d000", "a\u0558b", ":\u0558"])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sStTlLdD.,|<>é́ÄßΣİ1²\x1c\x85\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_any_text(coder, texts):
    same(coder, texts)


def test_memo_is_bounded():
    small = PieceEncoder(BYTE, True, max_pieces=10)
    for k in range(5):
        same(small, [f"some text number {k} with words {k * 7}"])
    assert len(small.index) <= 30


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_token_files_round_trip(spark):
    docs = rows_of(spark, [*ODD, None]).unionByName(rows_of(spark, ["again"]))
    plain, at = Tokenizer.from_file(WORD), 0
    got = sorted(token_files.token_index(docs, WORD).collect(), key=lambda r: (r.doc_id, r.start))
    found = {}
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        found.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(x for v in found.values() for x in v) == sorted((r.n_tokens, r.ids_crc32) for r in got)
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_files_can_be_read_in_part(spark, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(rows_of(spark, [f"text number {k}" for k in range(50)]), path, WORD)
    meta = [pq.ParquetFile(p).metadata.row_group(0) for p in sorted((tmp_path / "tokens").glob("*.parquet"))]
    columns = {g.column(k).path_in_schema: g.column(k) for g in meta for k in range(g.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert any("DELTA" in e for e in columns["doc_id"].encodings)
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_empty_table(spark):
    none = rows_of(spark, [])
    assert token_files.token_index(none, WORD).count() == 0
    assert pack.packed(none, BYTE).count() == 0


@given(st.integers(1, 20_000))
def test_cuts_cover_a_document(n):
    cuts = pack.cut_points(n)
    assert cuts[0] == 0 and cuts[-1] == n and all(0 < q - p <= 2048 for p, q in zip(cuts, cuts[1:]))


@settings(deadline=None)
@given(st.lists(st.integers(1, 2048), min_size=1, max_size=60))
def test_windows_fit(sizes):
    found = pack.windows(np.array(sizes))
    assert np.bincount(found, sizes).max() <= 2048 and len(found) == len(sizes)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 512, 400)
    sums = np.bincount(pack.differencing(sizes, 50), sizes, 50)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8


def test_packing_keeps_every_id(spark):
    texts = [*ODD, None, "word " * 5000, "again", "again"]
    docs = rows_of(spark, texts)
    plain = Tokenizer.from_file(BYTE)
    want = {k: plain.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    rows = pack.packed(docs, BYTE).collect()
    covered = {k: [] for k in want}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
    for k, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(want[k])
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    whole = pack.sequences(docs, BYTE).collect()
    assert sorted(len(w.ids) for w in whole) == sorted(sum(n for _, n in p) for p in by.values())
