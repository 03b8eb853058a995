"""op8 against brute force over shingle sets."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from ocellus.llm import jaccard_join as J

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


NO_KEYS = J.HotKeys.of(np.zeros(0, np.int64), np.zeros(0, np.int64))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, (d, s) in enumerate(sets)), key=str)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(seed, groups=25, shared=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(55)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([5, 6, 9, 20, 60, 200]))]
        rows += [" ".join(edited(r, base, r.randint(0, max(1, len(base) // 25)))) for _ in range(r.randint(1, 5))]
    rows += [" ".join([*(word() for _ in range(r.randint(10, 120))), *passage]) for _ in range(shared)]
    big = [word() for _ in range(80)]
    rows += [" ".join(edited(r, big, r.choice([0, 1, 1, 2, 3]))) for _ in range(60)]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "A b C d", "a b c d", "a b c d e", "é É x y z w"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    rows += [rows[4], rows[9], (None, rows[3][1]), (None, None)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted((tuple(r) for r in J.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_keep_one(spark):
    rows = corpus(5, groups=6, shared=5)
    frame = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string")
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if c == d)


def test_keep_one_of_repeated_rows(spark):
    w, z = "a b c d e f", "q r s t u v"
    rows = [(1, w), (1, w), (5, w), (5, z), (None, w), (None, "x y z"), (None, "x y z"), (7, None), (7, None), (8, " ")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(1, w), (5, z), (None, "x y z"), (7, None), (7, None), (8, " ")], key=str)
    assert J.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def family(seed, copies, edits, words=140):
    """Copies of one text with many edits each: most link with few others, and all share hot keys."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    rows = [" ".join(edited(r, base, r.choice(edits))) for _ in range(copies)]
    for text in rows[: copies // 8]:
        rows.append(" ".join(edited(r, text.split(" "), 1)))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_a_large_group_of_which_few_link(spark, seed, monkeypatch):
    rows = family(seed, 400, [0, 1, 4, 5, 6, 7])
    made = []
    across = J.across

    def counted(*args):
        out = across(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(J, "across", counted)
    monkeypatch.setattr(J, "FEW", 0 if seed == 3 else 64)
    got = sorted((tuple(r) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 20 and made[0] < 10 * len(rows)


def test_counting_repeated_keys_holds_them_twice_at_most():
    r = np.random.default_rng(4)
    for size, most in ((1, 5), (2, 1), (7, 3), (400_000, 300_000)):
        keys = r.integers(-most, most, size)
        want, counts = np.unique(keys, return_counts=True)
        parts = [x.copy() for x in np.array_split(keys, min(size, 50))]
        tracemalloc.start()
        key, count = J.repeated(parts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(key, want[counts > 1]) and np.array_equal(count, counts[counts > 1]) and not parts
        assert size < 1000 or peak < 2 * keys.nbytes


def test_near_copies_move_in_passes(spark, monkeypatch):
    rows = [(100 * g + i, t) for g in range(30) for i, t in family(g, 3, [1])]
    sizes = {d: len(shingles(t)) for d, t in rows}
    moved = []
    sets = J._sets

    def counted(*args):
        out = sets(*args)
        moved.append(out.selectExpr("sum(size(hashes))").first()[0] or 0)
        return out

    monkeypatch.setattr(J, "_sets", counted)
    monkeypatch.setattr(J, "PASS_LEAST", 1, raising=False)
    got = sorted((tuple(r) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) == 30 and 0 < max(moved) < 0.6 * sum(sizes.values()) <= sum(moved)


def test_a_group_around_a_centre_moves_in_passes(spark, monkeypatch):
    rows = family(5, 200, [0, 1, 4, 5, 6, 7])
    monkeypatch.setattr(J, "FEW", 0)
    monkeypatch.setattr(J, "_passes", lambda *_: 3, raising=False)
    got = sorted((tuple(r) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_linked_sets_share_a_difference():
    r = np.random.default_rng(8)
    linked = 0
    for _ in range(3000):
        x = np.unique(r.integers(0, 2**63, 120, dtype=np.uint64))
        far = np.sort(np.concatenate([r.permutation(x)[int(r.integers(15, 60)) :], np.unique(r.integers(0, 2**63, int(r.integers(0, 40)), dtype=np.uint64))]))
        a, b = (np.sort(np.concatenate([r.permutation(far)[int(r.integers(0, 9)) :], np.unique(r.integers(0, 2**63, int(r.integers(0, 9)), dtype=np.uint64))])) for _ in range(2))
        link = lambda p, q: 7 * len(np.setxor1d(p, q)) <= len(p) + len(q)
        if link(a, b) and not link(a, x):
            linked += 1
            (d, m), (e, k) = J.differences(a, x, True, NO_KEYS), J.differences(b, x, not link(b, x), NO_KEYS)
            both, at, to = np.intersect1d(d, e, return_indices=True)
            assert len(both) and (7 * (at + to + abs((m - at) - (k - to))) <= len(a) + len(b)).any()
    assert linked > 300


def test_long_texts(spark):
    r = random.Random(6)
    long = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(r, long, 2000))), (3, "same " * 300_000), (4, "same " * 7), (5, " ".join(long[:150_000]))]
    got = {d: c for d, _, c in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets_share_a_leading_key():
    r = np.random.default_rng(3)
    for n in (3, 4, 7, 15, 16, 30, 190, 250, 255, 256, 1000, 4090, 4200):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(r.integers(0, n // 4 + 1))
            b = np.sort(np.concatenate([r.permutation(a)[drop:], np.unique(r.integers(0, 2**63, int(r.integers(0, n // 8 + 1)), dtype=np.uint64))]))
            both = len(np.intersect1d(a, b))
            hot = np.unique(np.concatenate([J.sketch_keys(a, k)[0][::3] for k in J.bands(len(a))]))
            hot = J.HotKeys.of(hot, r.integers(40, 60, len(hot)))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                for h in (NO_KEYS, hot):
                    (x, i), (y, j) = J.leading_keys(a, h), J.leading_keys(b, h)
                    both_keys, at, to = np.intersect1d(x, y, return_indices=True)
                    assert len(both_keys) and J._first(i[at], j[to]).any() and J._alike(i[at], j[to]).all(), (n, len(b))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_grouper_is_independent_of_batches(size):
    r = np.random.default_rng(2)
    key = np.sort(r.choice([1, 2, 3, 4, 5], 400, p=[0.02, 0.5, 0.03, 0.4, 0.05]))
    sig, n = r.integers(0, 10**6, 400), np.array([int(J.packed(int(r.integers(80, 100)), r.integers(0, 20))) for _ in range(400)])
    by = np.lexsort((sig, n, key))
    key, sig, n = key[by], sig[by], n[by]
    g, pairs, rows = J.Grouper(), set(), 0
    for i in range(0, 400, size):
        p, m = g.feed(key[i : i + size], sig[i : i + size], n[i : i + size])
        pairs |= {tuple(x) for x in p.tolist()}
        rows += len(m)
    p, m = g.feed(key[:0], sig[:0], n[:0], last=True)
    pairs |= {tuple(x) for x in p.tolist()}
    one = J.Grouper()
    want, large = one.feed(key, sig, n, last=True)
    assert pairs == {tuple(x) for x in want.tolist()} and rows + len(m) == len(large)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in J.components(spark, edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
