"""op10: base phrases against brute force; labels of known texts."""

import itertools
import re
from re import _parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocellus.llm import license_scan as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "...", "Under the MIT license", "x under the mit-license y under the MIT License.", "under the mit licenses", "Apache License, Version 2.0", "CC BY-NC 4.0 and CC-BY-NC-SA", "cc by nc cc by nc", "under the mit license " * 3000, "é under the mit license ü"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc x é".split()), max_size=30).map(" ".join), max_size=8))
def test_base(spark, texts):
    every = texts + TEXTS
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in L.scan(frame).collect()}
    for i, t in enumerate(every):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the GNU General Public License, version 3", "gpl-3.0"),
        ("This is released under the BSD 3-Clause License.", "bsd-3-clause"),
        ("Distributed under the terms of the Mozilla Public License 2.0", "mpl-2.0"),
        ("SPDX-License-Identifier: ISC", "isc"),
        ("This work is under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"),
        ("dedicated to the public domain", "public-domain"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("The lesser artistic boost of python under two rivers", ""),
        ("He has a license to drive; a mit is a glove", ""),
        ("according to MIT researchers", ""),
        ("Apache License, Version 2.0", "apache-2"),
        ("the GNU Lesser General Public License, version 3", "lgpl-3.0"),
        ("GPLv2", "gpl-2.0"),
        ("under the terms of the GPLv3 license", "gpl-3.0"),
        ("SPDX-License-Identifier: AGPLv3", "agpl-3.0"),
        ("Licensed under LGPLv2.1", "lgpl-2.1"),
        ("Licensed under the GNU Affero General Public License", "agpl"),
        ("You may not use this file except in compliance with the License.", "apache-2"),
        ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
    ],
)
def test_labels(spark, text, labels):
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == labels and (r.score > 0) == bool(labels) and 0 <= r.score <= 1


def strings(parsed):
    """One string for each choice of alternatives and optional parts of a parsed pattern."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append(["1"] if str(arg[0][0]) == "CATEGORY" else [chr(c) for _, c in arg])
        elif name == "BRANCH":
            parts.append([s for one in arg[1] for s in strings(one)])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "SUBPATTERN":
            parts.append(list(strings(arg[3])))
        else:
            assert name == "MAX_REPEAT" and arg[0] in (0, 1), name
            parts.append(["", *strings(arg[2])] if arg[0] == 0 else ["x y"])
    return ["".join(p) for p in itertools.product(*parts)]


def test_keywords_are_in_every_match():
    single = [r for r in L.rules() if not any(r["rx"] == form.replace("{name}", name) for _, form in L.FORMS for _, _, name in L.FAMILIES)]
    assert len(single) == len(L.SINGLE) + 2 * len(L.CC_KINDS)
    checks = [(r["kw"], r["rx"], r["rx"]) for r in single]
    checks += [(r["kw"], name, r["rx"]) for _, _, name in L.FAMILIES for r in L.rules() if r["rx"] == f"spdx license identifier {name}(?: or later| only)?"]
    assert len(checks) == len(single) + len(L.FAMILIES)
    for keywords, pattern, rx in checks:
        for s in strings(_parser.parse(pattern)):
            text = f" {s} " if pattern == rx else f" spdx license identifier {s} "
            assert re.search(f"(?<= )({rx})(?= )", text), text
            assert any(k in text for k in keywords), (keywords, text)
            assert any(g in text for g in L.GATE), text


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the GPL v2", "gpl-2.0"),
        ("SPDX-License-Identifier: GPL2", "gpl-2.0"),
        ("Licensed under the GNU General Public License v3", "gpl-3.0"),
        ("Licensed under the LGPL v2.1", "lgpl-2.1"),
        ("Licensed under the GNU Library General Public License v3", "lgpl-3.0"),
        ("SPDX-License-Identifier: 0BSD", "0bsd"),
        ("under the FreeBSD license", "bsd-2-clause"),
        ("under the Berkeley license", "bsd"),
        ("under the Open Data Commons Database License", "odbl-1.0"),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ],
)
def test_labels_by_each_alternative(spark, text, labels):
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == labels and r.score > 0.5


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 6), st.integers(0, 4)), max_size=8), min_size=1, max_size=6))
def test_surviving_is_brute_force(spark, cases):
    labels = ["a", "b", "a", "c", "b"]
    rows = [(i, [(f, f + n, p, 0.5, labels[p]) for f, n, p in case]) for i, case in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, found array<struct<first:int,last:int,priority:int,score:double,label:string>>")
    got = {r.i: sorted(tuple(x) for x in r.s) for r in frame.select("i", L.surviving(L.F.col("found")).alias("s")).collect()}
    for i, found in rows:
        want = []
        for x in found:
            inside = [y for y in found if y[0] <= x[0] and y[1] >= x[1]]
            if not any(y[2] < x[2] if y[4] != x[4] else y[1] - y[0] > x[1] - x[0] for y in inside):
                want.append(x)
        assert got[i] == sorted(want)


def test_very_long_text(spark):
    text = "plain words " * 100_000 + "licensed under the gpl v2 " + "and more " * 100_000
    r = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.labels) == (400_005, "gpl-2.0")


def test_rules_are_hundreds_and_compile():
    rules = L.rules()
    assert len(rules) > 250 and len({r["priority"] for r in rules}) == len(rules)
    for r in rules:
        re.compile(r["rx"])


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "under the MIT license"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert len(L.scan(frame).collect()) == 3 and L.scan(frame.limit(0)).count() == 0
