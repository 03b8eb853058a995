"""op5 against brute force; the binomial bound against exact sums."""

import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocellus.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {t for t in tri if tri.count(t) > 1}
    words = {k for i, t in enumerate(tri) if t in again for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(words)


TEXTS = [None, "", " ", "a", "a a a a a", "a b c a b c x a b c", "\n\n a\n a\n a\n", "x\x0by\x0cz\r\nq", "# * $ % & | < >", "é ü 日本 \xa0 x", "one two three " * 400, "a b\na b\n\ta b\na b"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), min_size=1, max_size=10))
def test_base_counts(spark, texts):
    every = texts + TEXTS
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(every)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.measured(frame).collect()}
    for i, t in enumerate(every):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)


def test_binomial_tail(spark):
    cases = [(100, 0), (100, 3), (500, 2), (5000, 30), (0, 0), (10, 10), (100000, 900)]
    frame = spark.createDataFrame(cases, "n long, k long")
    for r in frame.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99) for j in range(r.k + 1)] if r.k <= r.n else []
        want = 1.0 if r.k >= r.n * 0.01 else sum(map(math.exp, logs))
        assert math.isclose(r.p, want, rel_tol=1e-6), r


def made(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
        bad = i % 4 == 3
        if bad:
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), "en" if i % 2 else "de"))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_cutoffs_reject_junk_and_keep_clean(spark):
    docs, labels = made(2000)
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = Q.measured(frame).persist()
    cuts = Q.cutoffs(seen, known)
    assert {r.stratum for r in cuts.collect()} == {"en", "de"}
    got = {r.doc_id: r.kept for r in Q.judge(seen, cuts).collect()}
    assert all(got[i] == (i % 4 != 3) for i in range(2000) if i % 2)
    assert Q.keep(frame, known).count() == 1500


def test_too_few_labels_give_no_cutoffs(spark):
    docs, labels = made(100)
    frame = spark.createDataFrame([(*d, "k") for d in docs] + [(None, None, None, "k"), (5, docs[5][1], None, "k")], "doc_id long, text string, lang string, kept string")
    cuts = Q.cutoffs(Q.measured(frame), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert cuts.count() == 0
    rows = Q.judge(Q.measured(frame), cuts).collect()
    assert len(rows) == 102 and all(r.kept == (not r.base_failed) for r in rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert Q.keep(frame, known).columns == frame.columns and Q.keep(frame, known.limit(0)).count() == sum(r.kept for r in rows)
    assert Q.keep(frame.limit(0), known).count() == 0
    assert Q.judge(Q.measured(frame.limit(0)), cuts).count() == 0


def test_cutoffs_write_a_file_a_stratum(spark, monkeypatch):
    docs, labels = made(400)
    docs = [(i, " ".join([*t.split(), *["#"] * (i % 20)]), lang) for i, t, lang in docs]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    written, tables = Q.written, []
    monkeypatch.setattr(Q, "written", lambda df: tables.append(written(df)) or tables[-1])
    settings_ = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        Q.cutoffs(Q.measured(frame), known).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # An empty first partition makes a file too.
    assert sum(len(t.inputFiles()) for t in tables) <= 2 + 1


def brute_level(good, risk, gap, strata):
    """The strictest level that an exact test proves, by plain sums."""
    best = None
    for g in Q.GRID:
        n, k = len(good), sum(v > g for v in good)
        tail = sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
        if k < n * risk and tail <= gap / strata:
            best = g if best is None else min(best, g)
    return best


def test_levels_are_the_strictest_proven(spark):
    r = random.Random(9)
    rows, labels, good = [], [], {}
    for i in range(900):
        lang, n = r.choice(["en", "en", "de", "fr"]), 100
        symbols = r.choice([0] * 12 + [1, 2, 4, 8, 20])
        good.setdefault(lang, []).append(symbols / n / Q.RULES["symbols"])
        rows.append((i, lang, n, 500, symbols, 0, 0, 1, 0, 0))
        labels.append((i, 1))
    rows.append((10_000, "xx", 100, 500, 3, 0, 0, 1, 0, 0))
    labels.append((10_000, 1))
    columns = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_exclamations long, n_capitals long"
    for risk in (0.03, 0.1, 0.3):
        got = {c.stratum: c._ocellus_cut for c in Q.cutoffs(spark.createDataFrame(rows, columns), spark.createDataFrame(labels, "doc_id long, quality int"), risk).collect()}
        want = {lang: brute_level(v, risk, Q.CONFIDENCE_GAP, 4) for lang, v in good.items()}
        assert got == {lang: g for lang, g in want.items() if g is not None}
        assert risk < 0.1 or got


def test_long_texts(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    frame = spark.createDataFrame([(1, words, "en"), (2, "same " * 200_000, "en"), (2, "same " * 200_000, "en")], "doc_id long, text string, lang string")
    got = [tuple(r) for r in Q.measured(frame).select("doc_id", "n_words", "n_repeat_words").orderBy("doc_id").collect()]
    assert got == [(1, 200_000, 0), (2, 200_000, 200_000), (2, 200_000, 200_000)]
