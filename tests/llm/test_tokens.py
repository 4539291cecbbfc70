"""Tokenizing, Huffman files and packing against the library and against plain loops."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from drawfield.llm import huffman, packing
from drawfield.llm.common import tokenizer_path
from drawfield.llm.wordtable import WordTable

ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "x \n y", "it's 's <|endoftext|> y", "a<|endoftext|>", "\tq", "ﬁ É  é",
       "Σας ΑΣ ΑΣ.", "a\x1cb c", "12 3 x,y ..!\nab\nc", "a　b c", "\r\n a", "\rA b", "ab\n", "!\x85 x", "thing.\nThe THING, 'it'",
       "a\x01b \x01 c", "²x ½ y_z __ a", "x" * 5000, "?!. ...a b--c ''s 't"]


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def words(request):
    return WordTable(tokenizer_path(request.param[0]), request.param[1], most=400)


def _encoded(words, texts):
    ids, counts = words.encode(pa.array(texts, pa.string()))
    assert counts.sum() == len(ids) and len(counts) == len(texts)
    return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def _library(words, text):
    return words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_same_ids_as_library(words):
    for _ in range(2):
        for text, ids in zip(ODD, _encoded(words, ODD)):
            assert ids.tolist() == _library(words, text), text
    column = pa.array(["before", *ODD, "after"], pa.string()).slice(1, len(ODD))
    ids, _ = words.encode(column)
    assert ids.tolist() == [i for t in ODD for i in _library(words, t)]
    assert len(words.encode(pa.array([None, ""], pa.string()))[0]) == 0


def test_words_that_differ_in_one_byte_or_their_length(words):
    texts = ["a" * n + c for n in range(30) for c in ("", "b", "\0", "é")] + ["x\0", "x", "x\0\0"]
    for text, ids in zip(texts, _encoded(words, texts)):
        assert ids.tolist() == _library(words, text), repr(text)


def test_more_words_than_the_table_keeps(words):
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(12)]
    for text, ids in zip(texts * 2, _encoded(words, texts * 2)):
        assert ids.tolist() == _library(words, text)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aBé ß.\n,'s0ΣİǅÁ\t!")), max_size=5))
def test_same_ids_on_random_texts(words, texts):
    for text, ids in zip(texts, _encoded(words, texts)):
        assert ids.tolist() == _library(words, text), repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 18))
def test_code_lengths_are_optimal_or_limited(counts, longest):
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest and sum(2.0 ** -lengths) <= 1
    if longest == 18 and len(counts) > 1:
        import heapq
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            cost += pair
            heapq.heappush(heap, pair)
        assert (lengths * np.array(counts)).sum() >= cost
        if huffman.code_lengths(counts, 40).max() <= 18:
            assert (lengths * np.array(counts)).sum() == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=700), min_size=1, max_size=8))
def test_blocks_come_back(docs):
    ids = np.concatenate([np.array(d) for d in docs])
    seen, counts = np.unique(ids, return_counts=True)
    code = huffman.Code(seen, huffman.code_lengths(counts, 12))
    sizes = [len(d) for d in docs]
    payload, length, marks = code.encode(ids, sizes)
    assert length.sum() == len(payload)
    assert code.decode(payload, sizes, marks).tolist() == ids.tolist()


DOCS = [(5, "b a. c"), (1, None), (3, ""), (2, "words and more words. " * 700), (5, "b a. c"), (9, "no marks here " * 900), (None, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in DOCS], "doc_id long, text string, ids string, start long")


def test_ids_on_disk(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    huffman.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in huffman.read_ids(spark, path).collect()), key=lambda r: r[1])
    words = WordTable(tokenizer_path("byte_bpe_50k.json"), True)
    ordered = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    start = 0
    for (doc_id, text), row in zip(ordered, got, strict=True):
        ids = np.array(_library(words, text) + [2], "<u4").tobytes()
        assert row == (doc_id, start, len(ids) // 4, ids)
        start += len(ids) // 4


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    huffman.write_ids(none, str(tmp_path / "none"), tokenizer_path("byte_bpe_50k.json"))
    assert huffman.read_ids(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("window", [16, 64, 4096])
def test_pieces_tile_documents_and_windows(docs, window):
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), window=window).collect()
    words = WordTable(tokenizer_path("word_bpe_49k.json"), False)
    want = sorted((np.array(_library(words, t) + [2], "<u4").tobytes() for _, t in DOCS), key=len)
    by_doc, by_window = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ordered = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    whole, k = [], 0
    while k < len(ordered):
        part = b""
        total = ordered[k].doc_tokens
        while len(part) < 4 * total:
            assert ordered[k].start * 4 == len(part)
            part += bytes(ordered[k].ids)
            k += 1
        whole.append(part)
    assert sorted(whole, key=len) == want
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)  # the order is kept
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert by_doc == {}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 3, 7])), min_size=1, max_size=14), st.integers(9, 20))
def test_cuts_are_the_cheapest(steps, window):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    extra = np.array([0] + [p for _, p in steps])
    cuts = packing.cut(at, extra, window)

    def cost(ends):
        total, before = 0, 0
        for j in ends:
            total += window - (at[j] - at[before]) + extra[j]
            before = j
        return total

    best = [0] + [None] * len(steps)
    for j in range(1, len(at)):
        best[j] = min(best[i] + window - (at[j] - at[i]) + extra[j] for i in range(j) if at[j] - at[i] <= window)
    assert cuts[-1] == len(steps) and cost(cuts) == best[-1]


def test_little_padding(spark, sf_dir):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
    used = [r[1] for r in rows.groupBy("sequence_id").agg({"length": "sum"}).collect()]
    assert max(used) <= 4096 and len(used) <= 1.01 * sum(used) / 4096 + 2


def test_queries_agree_with_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    words = WordTable(tokenizer_path("byte_bpe_50k.json"), True)
    start = 0
    got = {r.doc_id: r for r in huffman.op7_token_ids(spark, sf_dir).collect()}
    for doc_id in sorted(text):
        ids = np.array(_library(words, text[doc_id]) + [2], "<u4")
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    words = WordTable(tokenizer_path("word_bpe_49k.json"), False)
    pieces = packing.op8_packing(spark, sf_dir).collect()
    for r in pieces:
        ids = np.array(_library(words, text[r.doc_id]) + [2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
