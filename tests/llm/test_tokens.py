import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kinmesh.llm import packing, piece_codec, token_counts
from kinmesh.llm.encoding import default_vocabulary, encoder
from tests.llm.helpers import edge_docs, no_docs

ODD = ["", " ", "it's  a test\n\n", "<|endoftext|> x", "naïve Ça", "日本語 text", "a" * 2500, " " * 1500 + "x", "tab\tnbsp    ;", "1234567 !!??", "😀 ok", "\x00"]


def reference(text):
    return encoder(default_vocabulary()).exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_fast_ids_equal_the_library(text):
    assert encoder(default_vocabulary()).ids(text) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab e'ts.,\n\t12é ß-", max_size=60))
def test_fast_ids_equal_the_library_on_any_text(text):
    assert encoder(default_vocabulary()).ids(text) == reference(text)


def test_length_answers_equal_brute_force(spark):
    docs = edge_docs(spark)
    lengths = [len(reference(r["text"])) if r["text"] else 0 for r in docs.collect()]
    out = token_counts.limits(token_counts.histogram(docs))
    rows = {r["context_limit"]: r for r in out.collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r["n_docs"] == lengths.count(limit)
        assert (r["docs_longer"], r["tokens_longer"]) == (sum(x > limit for x in lengths), sum(x for x in lengths if x > limit))
        assert r["tokens_truncated"] == sum(min(x, limit) for x in lengths)
        assert r["tokens_lost"] == sum(lengths) - r["tokens_truncated"]
        assert r["docs_within"] + r["docs_longer"] == len(lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(out, q) == min(x for x in lengths if sum(y <= x for y in lengths) >= q * len(lengths) - 1e-12)
    nothing = token_counts.limits(token_counts.histogram(no_docs(spark)))
    assert nothing.count() == 0 and token_counts.quantile(nothing, 0.5) is None


def check_packed(pieces, ids_of, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    total = pad = 0
    for seq in by_sequence.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        total += at
        pad += 0 if at & (at - 1) == 0 else capacity - at
    for doc_id, copies in ids_of.items():
        want = Counter()
        for ids in copies:
            want.update([len(ids)])
        held = sorted(by_doc[doc_id], key=lambda p: p["start"])
        assert sum(p["length"] for p in held) == sum(map(len, copies))
        for p in held:
            ids = next(c for c in copies if len(c) == p["doc_tokens"])
            part = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
    assert set(by_doc) == set(ids_of)
    return total, pad


def test_packing_keeps_every_id_once(spark):
    docs = edge_docs(spark)
    ids_of = defaultdict(list)
    for r in docs.collect():
        ids_of[r["doc_id"]].append([*(reference(r["text"]) if r["text"] else ()), 1])
    check_packed(packing.pack(docs).collect(), ids_of)
    check_packed(packing.pack(docs, capacity=64, piece=16, block=32).collect(), ids_of, 64)
    assert packing.pack(no_docs(spark)).count() == 0


def test_documents_are_cut_only_where_a_window_needs_it(spark):
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 1500, 500)
    k = -(-int(sizes.sum()) // 2048)
    parts = packing.level(sizes, packing.differencing(sizes, k), 2048)
    held = defaultdict(int)
    for w, i, low, high in parts:
        held[w] += high - low
        assert 0 <= low < high <= sizes[i]
    assert max(held.values()) <= 2048 and sum(held.values()) == sizes.sum()
    assert len(parts) <= len(sizes) + 2 * k
    for i, n in enumerate(sizes):
        own = sorted((low, high) for _, j, low, high in parts if j == i)
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own[:-1], own[1:], strict=True))
    docs = edge_docs(spark)
    ids_of = defaultdict(list)
    for r in docs.collect():
        ids_of[r["doc_id"]].append([*(reference(r["text"]) if r["text"] else ()), 1])
    pieces = packing.pack(docs, cut=False).collect()
    check_packed(pieces, ids_of)
    whole = sum(-(-len(x) // 2048) for copies in ids_of.values() for x in copies)
    assert len(pieces) == whole  # longer documents give whole windows and a rest, others stay whole


def test_packing_of_a_table_has_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids_of = {r["doc_id"]: [[*reference(r["text"]), 1]] for r in docs.collect()}
    total, pad = check_packed(packing.op8_packing(spark, sf).collect(), ids_of)
    assert pad < 0.01 * total


def test_differencing_balances_and_rises():
    sizes = np.random.default_rng(3).integers(1, 513, 1500)
    k = -(-int(sizes.sum()) // 2040)
    held = np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)
    assert np.ptp(held) <= 16
    assert list(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [16.0, 14.0]  # the textbook instance
    # 3 pieces of 60 fit only one to a window of 100, although two windows would hold their sum
    assert len(set(packing.windows(np.array([60, 60, 60]), 100))) == 3


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaabcdetinorsh  ,.\n_é日=-/▁", max_size=80))
def test_pieces_equal_the_library(text):
    own = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    vocab = piece_codec.vocabulary(piece_codec.default_model())
    ids = piece_codec.encode(vocab, text)
    assert ids == own.encode(text)
    assert piece_codec.decode(vocab, ids) == text.replace("▁", " ")


def test_stream_window_is_bounded(sp):
    vocab = piece_codec.vocabulary(piece_codec.default_model())
    text = "".join(np.random.default_rng(2).choice(list("abcdefghij"), 20_000))
    stream = piece_codec.Stream(vocab)
    for low in range(0, len(text), 777):
        stream.feed(("▁" + text if not low else text)[low : low + 777] if not low else text[low - 1 : low + 776])
    stream.feed(text[low + 776 :])
    assert stream.widest <= 4 * vocab.longest
    assert stream.finish() == sp.encode(text)


def test_codec_of_documents(spark, sf, sp):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: sp.encode(r["text"]) for r in docs.collect()}
    for r in piece_codec.op9_piece_codec(spark, sf).collect():
        ids = want[r["doc_id"]]
        assert r["n_ids"] == len(ids) and r["round_trip"] and r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_codec_edges(spark, sp):
    docs = edge_docs(spark)
    out = piece_codec.decode_column(piece_codec.encode_column(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        assert list(r["ids"]) == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "").replace("▁", " ")
    assert piece_codec.digest(no_docs(spark)).count() == 0


def test_limits_between_lengths(spark):
    from kinmesh.llm import token_counts

    counts = {0: 2, 3: 1, 10: 4, 5000: 2}
    hist = spark.createDataFrame(list(counts.items()), "n_tokens long, n_docs long")
    got = {r["context_limit"]: r for r in token_counts.answers_at(hist, [2, 2, 10, 2048, 4096, 9000]).collect()}
    assert sorted(got) == [2, 10, 2048, 4096, 9000]
    for x, r in got.items():
        longer = {n: d for n, d in counts.items() if n > x}
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"]) == (counts.get(x, 0), sum(longer.values()), sum(n * d for n, d in longer.items()))
        assert r["tokens_truncated"] == sum(min(n, x) * d for n, d in counts.items())
        assert r["tokens_lost"] == sum(max(n - x, 0) * d for n, d in counts.items())
        assert r["share_within"] == sum(d for n, d in counts.items() if n <= x) / 9
    known = {r["context_limit"]: r.asDict() for r in token_counts.limits(hist).collect()}
    assert got[10].asDict() == known[10]
    assert token_counts.answers_at(hist.limit(0), [5]).count() == 0
