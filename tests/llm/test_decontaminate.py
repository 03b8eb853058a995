"""op1 against brute force over words."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def brute(docs, items, window=10):
    wins = []
    for name, text in items:
        w = words(text)
        if len(w) >= window:
            wins += [(name, w[i : i + window]) for i in range(len(w) - window + 1)]
        elif w:
            wins.append((name, w))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for name, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add("null" if name is None else str(name))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed=3):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA", "über", "x1", "7", "the", "of", "naïve", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "!\n"]) for _ in range(n))
    items = [(i, text(r.randint(10, 40))) for i in range(12)] + [(20, "one two three"), (21, "zeta"), (22, ""), (23, None), (24, "...")]
    docs = [(i, text(r.randint(0, 60))) for i in range(40)]
    docs += [(100, f"{text(20)} {items[3][1]} {text(5)}"), (101, "say one-TWO, three. one two four"), (102, None), (103, ""), (None, items[5][1]), (104, items[4][1] * 30), (104, items[4][1] * 30), (105, "ZETA")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_chars": 60}, {"window": 3}])
def test_report_is_brute_force(spark, options):
    docs, items = made()
    got = D.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **options)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows, key=str) == brute(docs, items, options.get("window", 10))


def test_removal_keeps_clean_rows_and_columns(spark):
    docs, items = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").select(F.lit("x").alias("n_hit"), "doc_id", "text")
    got = D.remove_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block_chars=200)
    assert got.columns == frame.columns
    clean = sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)
    assert sorted((r.doc_id for r in got.collect()), key=str) == clean


def test_longest_matches_and_locations(spark):
    item = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, "z b c d e f g h i j k l z"), (2, f"q {item} {item}"), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = sorted(tuple(r) for r in D.matches(docs, bench).collect())
    assert found == [(1, "5", 1, 1, 11), (2, "5", 0, 1, 12), (2, "5", 0, 13, 12)]
    top = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item) for r in D.report(docs, bench).collect()}
    assert top == {1: (11, 1, "5"), 2: (12, 1, "5"), 3: (0, None, None)}


def test_suffix_array_is_sorted():
    r = np.random.default_rng(1)
    ids = r.integers(0, 4, 400)
    at = np.flatnonzero(ids)
    order = D.suffix_array(ids, at, 60, 3)
    ends = [*np.flatnonzero(ids == 0), 400]

    def suffix(p):
        end = next(e for e in ends if e >= p)
        return list(ids[p : min(end, p + 60)])

    keys = [suffix(p) for p in order]
    assert keys == sorted(keys) and sorted(order) == sorted(at)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.report(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in D.report(one, bench).collect()] == [(1, 2, 0)]
    assert D.remove_contaminated(one, bench).count() == 1


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = "pad " * 300_000 + item
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = D.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit) == (300_030, 30)


def test_one_word_repeated(spark):
    docs = [(1, "a " * 300_000), (2, "b a a a"), (3, None), (4, "a " * 10)]
    items = [(i, "a " * n) for i, n in ((1, 400), (2, 12), (3, 3))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.longest_match) for r in D.report(*frames).collect()}
    assert got == {1: (300_000, 300_000, 3, 400), 2: (4, 3, 1, 3), 3: (0, 0, 0, 0), 4: (10, 10, 3, 10)}
    assert [r.doc_id for r in D.remove_contaminated(*frames).collect()] == [3]
