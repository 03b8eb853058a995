"""op6: ids equal the library's; compression is an exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocellus.llm import token_store as S
from ocellus.llm.tokens import TextEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "don't I'LL '''s x's 123 a1b2 _x_ É À ſ ß", "Σας ΣΑΣ İ", "日本語 テキスト", "x<|endoftext|>y <|startoftext|>", "“q”—5€ ½ ²", "\x1c\x85\x00", "a" * 5000, "café", "🙂🙂", *("".join(map(chr, range(i, i + 64))) for i in range(0, 0x240, 64))]


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(PATH, max_pieces=50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_equals_library(encoder, texts):
    every = texts + ODD
    ids, n = encoder.encode(every)
    want = [e.ids for e in encoder.tokenizer.encode_batch(every, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("_-.'(s1é—é €\n", max_size=12), max_size=5))
def test_underscores_equal_library(encoder, texts):
    every = [*texts, "__init__ (_x_) ____ -_-", "_. [_] _'s '_s _1_ _—_ a_b __a1__"]
    ids, n = encoder.encode(every)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in encoder.tokenizer.encode_batch(every, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.sampled_from([49_408, 70_000, 7, 65_535]), st.data())
def test_compression_round_trip(ids, vocabulary, data):
    a = np.array(ids * 3, np.uint32)
    shard = S.Shard(S.to_bytes(a, np.array([len(a)]), vocabulary))
    assert np.array_equal(shard.ids(), a)
    start = data.draw(st.integers(0, len(a)))
    length = data.draw(st.integers(0, len(a) - start))
    if length:
        assert np.array_equal(shard.stretch(start, length), a[start : start + length])


def test_compression_shrinks():
    a = np.random.default_rng(0).integers(0, 30, 50_000).astype(np.uint32)
    symbols, pairs, lengths = S.compress(a, 49_408)
    assert len(symbols) < 0.6 * len(a) and len(pairs)
    assert np.array_equal(S.expand(symbols, pairs, lengths, 49_408), a)
    assert all(lengths[i] == len(S.unfold(np.array([49_408 + i]), pairs, 49_408)) for i in range(0, len(pairs), 97))


def test_files(spark, encoder, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (-5, None), (None, "x"), (900, "word " * 100_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    S.write_tokens(docs, str(tmp_path / "t"), PATH, shard_ids=300)
    got = sorted(S.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in got:
        assert r.start == at and any(len(w) == r.n_tokens and zlib.crc32(w.tobytes()) == r.ids_crc32 for w in want[r.doc_id])
        at += r.n_tokens
    one = S.Shard(bytes(spark.read.parquet(str(tmp_path / "t")).where("array_contains(doc_ids, 3)").first().payload))
    assert one.counts.sum() == one.n_ids and np.array_equal(one.document(len(one.counts) - 1), one.ids()[-int(one.counts[-1]) :])


def test_ids_must_be_in_the_vocabulary():
    with pytest.raises(ValueError):
        S.to_bytes(np.array([3, 10], np.uint32), np.array([2]), 10)


def test_repeated_passages_fold_to_few_symbols():
    passage = np.random.default_rng(1).permutation(4000).astype(np.uint32)
    symbols, pairs, _ = S.compress(np.tile(passage, 50), 49_408)
    assert len(symbols) <= 50 * 20 and np.array_equal(S.unfold(symbols, pairs, 49_408), np.tile(passage, 50))


def test_equally_frequent_pairs_are_taken_by_key():
    keys = np.random.default_rng(2).permutation(np.concatenate([np.repeat(np.arange(5000), 6), np.repeat([4100, 4200], 3), np.arange(9000, 9500)])).astype(np.uint32)
    assert S.frequent_pairs(keys, 1000, 6).tolist() == [*range(998), 4100, 4200]
    assert S.frequent_pairs(keys, 1, 6).tolist() == [4100] and S.frequent_pairs(keys, 5000, 6).tolist() == [*range(5000)]


def test_empty_table(spark):
    assert S.store_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
