"""op2: hosts, paths and rules by hand; the trees on held-out labelled URLs and against plain sums."""

import random

import numpy as np

from ocellus.llm import url_filter as U

CASES = [
    (1, "https://Www.Example.COM/en/7?x=1", "www.example.com", "/en/7", "example.com/en/7", "allow"),
    (2, "http://a.com/en/1#t", "a.com", "/en/1", "com/en/", "block"),
    (3, "http://a.example.net/de/81", "a.example.net", "/de/81", "example.net/de/8", "block"),
    (4, "http://net/de/", "net", "/de/", "net/de/", "block"),
    (5, "http://xnet/de/", "xnet", "/de/", None, None),
    (6, "http://a.org?x=://b.org/es/", "a.org", "", None, None),
    (7, "no scheme", "", "", None, None),
    (8, None, "", "", None, None),
    (9, "ftp://b.org/es/x\ny", "b.org", "/es/x\ny", "org/es/", "block"),
    (10, "http://example.com/en/", "example.com", "/en/", "com/en/", "block"),
    (11, "", "", "", None, None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(c[0], c[1], "x") for c in CASES], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(pages, U.fit(spark.createDataFrame(made(600, 5), "url string, blocked int"))).collect()}
    for page, _, host, path, rule, verdict in CASES:
        r = got[page]
        assert (r.host, r.path, r.rule) == (host, path, rule), page
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def made(n, seed):
    """URLs in which hyphenated hosts are allowed and long digits in paths are blocked."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9)))
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        host = word() if bad else f"{word()}-{word()}"
        rows.append((f"http{r.choice(['', 's'])}://{host}.{r.choice(['com', 'net', 'org'])}/{word()}/{r.randint(10**8, 10**9) if bad else r.randint(1, 99)}", int(bad)))
    return rows


def test_trees_learn_from_labels(spark):
    model = U.fit(spark.createDataFrame(made(1500, 1), "url string, blocked int"))
    fresh = made(600, 2)
    right = (model.score([u for u, _ in fresh]) >= 0.5).astype(int) == np.array([b for _, b in fresh])
    assert right.mean() > 0.97
    assert model.score(["http://jean-pierre.com/abcdef/5"])[0] < 0.5 < model.score(["http://jeanpierre.com/abcdef/555555555"])[0]


def test_suffix_share_leaves_out_a_urls_own_label(spark):
    rows = [(f"http://a.x{i}/", i % 2) for i in range(400)]
    model = U.fit(spark.createDataFrame(rows, "url string, blocked int"))
    own = [int(np.flatnonzero(model.suffix[U.suffix_bucket(f"a.x{i}")].sum(axis=1))[0]) for i in range(50)]
    x = U.features([u for u, _ in rows[:50]], model.suffix, own)
    alone = [i for i in range(50) if model.suffix[U.suffix_bucket(f"a.x{i}")].sum() == 1]
    assert len(alone) > 30 and all(x[i, -2] == 0.5 and x[i, -1] == 0 for i in alone)


def test_a_tree_takes_the_best_split():
    """The first split against all cuts of all features, by plain sums."""
    r = np.random.default_rng(4)
    x = r.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (r.random(300) < 0.1)).astype(float)
    model = U.BoostedTrees(rounds=1, depth=1).fit(x, y)
    (feature, cut, value), p = model.trees[0], y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + model.ridge)
    cuts = [(j, c) for j in range(3) for c in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]))]
    best = max(gain(x[:, j] <= c) + gain(x[:, j] > c) for j, c in cuts)
    assert np.isclose(gain(x[:, feature[0]] <= cut[0]) + gain(x[:, feature[0]] > cut[0]), best)
    left = x[:, feature[0]] <= cut[0]
    assert np.isclose(value[1], -model.rate * g[left].sum() / (h[left].sum() + model.ridge))


def test_long_and_repeated_urls(spark):
    model = U.fit(spark.createDataFrame(made(300, 3), "url string, blocked int"))
    long = "http://a.com/" + "x/" * 100_000 + "?" + "k=v&" * 50_000
    rows = U.judge(spark.createDataFrame([(1, long), (1, long), (2, None)], "page_id long, url string"), model).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2 and all(r.verdict in ("allow", "block") for r in rows)


def test_degenerate_training(spark):
    empty = U.fit(spark.createDataFrame([], "url string, blocked int"))
    assert np.allclose(empty.score(["http://a.b/c", None]), 0.5)
    same = U.fit(spark.createDataFrame([("http://a.b/", 1)] * 5 + [(None, None)], "url string, blocked int"))
    assert same.score(["http://a.b/"])[0] > 0.9


def test_empty_pages(spark):
    model = U.fit(spark.createDataFrame(made(100, 6), "url string, blocked int"))
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), model).count() == 0


def test_labels_of_rules(spark):
    pages = spark.createDataFrame([(c[0], c[1]) for c in CASES], "page_id long, url string")
    got = {r.url: r.blocked for r in U.labelled_by_rules(pages).collect()}
    assert all(got[url] == int(verdict == "block") for _, url, _, _, _, verdict in CASES)


#: The contract's list, word by word.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_verdicts_of_the_contracts_rules(spark):
    """Each rule's own word, on its host and on a subdomain; example.net has the verdict of net/de/ where /de/8 does not fit."""
    assert {f"{h}{p}": verdict for verdict, h, p in U.RULES} == {rule: verdict for verdict, rule in (r.split() for r in CONTRACT.split(", "))}
    cases = [(f"https://{sub}{rule}x", rule, verdict) for verdict, rule in (r.split() for r in CONTRACT.split(", ")) for sub in ("", "a.b.")]
    cases.append(("http://example.net/de/7", "net/de/", "allow"))
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, U.fit(U.labelled_by_rules(pages))).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    assert [r.blocked for r in U.labelled_by_rules(pages).collect()] == [int(c[2] == "block") for c in cases]
