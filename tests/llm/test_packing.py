"""op9: every id once, no gap, little padding; the tree against a plain scan."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ocellus.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, offsets = P.first_fit_decreasing(np.array(lengths, np.int64), 20)
    used, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, u in enumerate(used) if u + lengths[i] <= 20), len(used))
        if b == len(used):
            used.append(0)
        want[i] = (b, used[b])
        used[b] += lengths[i]
    assert {i: (int(bins[i]), int(offsets[i])) for i in range(len(lengths))} == want


def test_every_id_once(spark):
    rows = [(i, f"word{i} " * (i * 7 % 90)) for i in range(300)] + [(900, "long text here " * 4000), (901, None), (902, ""), (None, "null id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    got = P.pack(docs, PATH, capacity=512, group_pieces=100).collect()
    tok = Tokenizer.from_file(PATH)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    whole = {d: sorted((r.start, r.length) for r in got if r.doc_id == d) for d in (900,)}[900]
    assert [s for s, _ in whole] == [512 * i for i in range(len(whole))]
    assert sum(r.length for r in got) > 0.9 * 512 * len(by)


def test_large_ids_beside_null_ids(spark):
    rows = [(2**53 + 1, "a b"), (None, "c"), (-(2**62), "d"), (2**53 + 1, "a b")]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), PATH).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [-(2**62), 2**53 + 1, 2**53 + 1] and len(got) == 4
    assert sorted((r.sequence_id, r.offset) for r in got)[0] == (0, 0)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
