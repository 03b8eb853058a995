"""License scan with ordered signature rules.

Texts are reduced to lower-case words.  Three base phrases are counted where
they stand.  The texts that hold one of a few broad keywords go on to the
signature rules: regular expressions over the words, each tried only where
one of its own keywords occurs; every match of a rule holds one of them.
Rules are ordered: full texts and headers first, then licenses by family with
the more specific ones first.  A detection that lies within one of an earlier
rule, or within a longer one of the same label, is suppressed.  All of it is
DataFrame expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import let

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Fixed values: (label, keywords divided by |, name pattern); words are separated by one space, digits of versions stand apart.
FAMILIES = [
    ("mit", " mit ", r"mit(?: x11| expat)?"),
    ("x11", " x11 ", r"x11"),
    ("isc", " isc ", r"isc"),
    ("0bsd", " bsd | 0bsd ", r"(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)"),
    ("bsd-2-clause", " bsd | freebsd ", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", " bsd ", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", " bsd ", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd", " bsd | berkeley ", r"(?:bsd|bsd style|berkeley)"),
    ("apache-1.1", " apache ", r"apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-2", " apache ", r"apache(?: software)?(?: license)?(?: version| v)? (?:2 0|2)"),
    ("apache", " apache ", r"apache(?: software)?"),
    ("agpl-3.0", " affero | agpl", r"(?:gnu )?(?:affero general public(?: license)?|agpl)(?: version| v|v)? ?(?:3 0|3)"),
    ("agpl", " affero ", r"(?:gnu )?affero general public"),
    ("agpl", " agpl ", r"(?:gnu )?agpl"),
    ("lgpl-2.1", " lgpl| lesser general public| library general public", r"(?:gnu )?(?:(?:lesser|library) general public(?: license)?|lgpl)(?: version| v|v)? ?2 1"),
    ("lgpl-3.0", " lgpl| lesser general public| library general public", r"(?:gnu )?(?:(?:lesser|library) general public(?: license)?|lgpl)(?: version| v|v)? ?(?:3 0|3)"),
    ("lgpl", " lgpl ", r"(?:gnu )?lgpl"),
    ("lgpl", " lesser general public | library general public ", r"(?:gnu )?(?:lesser|library) general public"),
    ("gpl-2.0", " gpl| general public", r"(?:gnu )?(?:general public(?: license)?|gpl)(?: version| v|v)? ?(?:2 0|2)"),
    ("gpl-3.0", " gpl| general public", r"(?:gnu )?(?:general public(?: license)?|gpl)(?: version| v|v)? ?(?:3 0|3)"),
    ("gpl", " gpl ", r"(?:gnu )?gpl"),
    ("gpl", " general public ", r"(?:gnu )?general public"),
    ("gfdl", " free documentation ", r"(?:gnu )?free documentation"),
    ("mpl-1.1", " mozilla ", r"mozilla public(?: license)?(?: version| v)? ?1 1"),
    ("mpl-2.0", " mozilla ", r"mozilla public(?: license)?(?: version| v)? ?(?:2 0|2)"),
    ("mpl", " mpl ", r"mpl"),
    ("epl-1.0", " eclipse ", r"eclipse public(?: license)?(?: version| v)? ?1 0"),
    ("epl-2.0", " eclipse ", r"eclipse public(?: license)?(?: version| v)? ?2 0"),
    ("cddl-1.0", " common development ", r"common development and distribution"),
    ("cpl-1.0", " common public ", r"common public"),
    ("eupl-1.2", " european union public ", r"european union public"),
    ("artistic-2.0", " artistic", r"artistic(?: license)?(?: version| v)? ?2 0"),
    ("artistic", " artistic ", r"(?:clarified )?artistic"),
    ("zlib", " zlib ", r"zlib(?: libpng)?"),
    ("libpng", " libpng ", r"libpng"),
    ("bsl-1.0", " boost ", r"boost software"),
    ("unlicense", " unlicense ", r"unlicense"),
    ("wtfpl", " wtfpl ", r"wtfpl"),
    ("postgresql", " postgresql ", r"postgresql"),
    ("python-2.0", " python ", r"python(?: software foundation)?"),
    ("php-3.0", " php ", r"php"),
    ("ruby", " ruby ", r"ruby"),
    ("openssl", " openssl ", r"openssl"),
    ("ofl-1.1", " open font ", r"(?:sil )?open font"),
    ("ms-pl", " microsoft public ", r"microsoft public"),
    ("odbl-1.0", " open database | open data commons ", r"open (?:data commons )?(?:open )?database"),
]
#: Fixed values: (confidence, form); each family is tried in each form.
FORMS = [
    (0.95, r"(?:licensed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?{name}(?: (?:public )?licen[cs]e)?(?: version| v)?(?: \d)?(?: \d)?"),
    (0.9, r"under (?:the )?(?:terms of )?(?:the )?{name} (?:public )?licen[cs]e"),
    (0.9, r"spdx license identifier {name}(?: or later| only)?"),
    (0.8, r"(?:subject to|governed by|covered by|according to) (?:the )?(?:terms of )?(?:the )?{name}(?: public)? licen[cs]e"),
    (0.75, r"licen[cs]es? (?:is |type |name )?(?:the )?{name}"),
    (0.7, r"{name}(?: public)? licen[cs]e(?: version| v)?(?: \d)?(?: \d)?"),
]
#: Single signatures (label, keywords, pattern, confidence): grants, conditions, headers and versioned names as people write them.
SINGLE = [
    ("mit", " permission is hereby granted ", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("mit", " permission notice ", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("isc", " permission to use ", r"permission to use copy modify and (?:or )?distribute this software for any purpose", 0.9),
    ("bsd", " redistribution and use ", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", " redistributions of source code ", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", " redistributions in binary form ", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-4-clause", " redistribut| advertising materials mentioning features ", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 0.9),
    ("apache-2", " except in compliance with the license ", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2", " distributed under the license is distributed ", r"software distributed under the license is distributed on an as is basis", 0.8),
    ("agpl", " affero ", r"under the terms of the gnu affero general public license", 0.95),
    ("lgpl", " lesser general public | library general public ", r"under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("gpl", " redistribute it and ", r"redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("mpl-2.0", " source code form ", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("mpl-2.0", " copy of the mpl ", r"if a copy of the mpl was not distributed with this file you can obtain one", 0.9),
    ("epl", " accompanying materials ", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ("bsl-1.0", " boost software license ", r"distributed under the boost software license version 1 0", 0.95),
    ("zlib", " express or implied warranty ", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("unlicense", " free and unencumbered ", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", " what the fuck ", r"do what the fuck you want to public license", 0.95),
    ("ofl-1.1", " font software ", r"this font software is licensed under the sil open font license version 1 1", 0.95),
    ("cc0-1.0", " possible under law ", r"to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights", 0.9),
    ("apache-2", " apache license | apache software license ", r"apache(?: software)? license(?: version | v ?| )(?:2 0|2)", 0.8),
    ("apache-1.1", " apache license | apache software license ", r"apache(?: software)? license(?: version | v ?| )1 1", 0.8),
    ("agpl-3.0", " affero ", r"(?:gnu )?affero general public license(?: version | v ?| )(?:3 0|3)", 0.8),
    ("lgpl-2.1", " lesser general public | library general public ", r"(?:gnu )?(?:lesser|library) general public license(?: version | v ?| )2 1", 0.8),
    ("lgpl-3.0", " lesser general public | library general public ", r"(?:gnu )?(?:lesser|library) general public license(?: version | v ?| )(?:3 0|3)", 0.8),
    ("gpl-2.0", " general public license ", r"(?:gnu )?general public license(?: version | v ?| )(?:2 0|2)", 0.8),
    ("gpl-3.0", " general public license ", r"(?:gnu )?general public license(?: version | v ?| )(?:3 0|3)", 0.8),
    ("mpl-1.1", " mozilla public license ", r"mozilla public license(?: version | v ?| )1 1", 0.8),
    ("mpl-2.0", " mozilla public license ", r"mozilla public license(?: version | v ?| )(?:2 0|2)", 0.8),
    ("epl-2.0", " eclipse public license ", r"eclipse public license(?: version | v ?| )2 0", 0.8),
    ("epl-1.0", " eclipse public license ", r"eclipse public license(?: version | v ?| )1 0", 0.8),
    ("lgpl-2.1", " lgplv2 1 ", r"lgplv2 1", 0.75),
    ("lgpl-3.0", " lgplv3 ", r"lgplv3", 0.75),
    ("agpl-3.0", " agplv3 ", r"agplv3", 0.75),
    ("gpl-2.0", " gplv2 ", r"gplv2", 0.75),
    ("gpl-3.0", " gplv3 ", r"gplv3", 0.75),
    ("public-domain", " public domain ", r"(?:dedicated|released|placed) (?:in)?to the public domain|in the public domain", 0.8),
    ("cc0-1.0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?", 0.9),
    ("all-rights-reserved", " all rights reserved ", r"all rights reserved", 0.5),
    ("proprietary", " proprietary ", r"proprietary (?:and|or) confidential", 0.6),
]
CC_PARTS = [("by", "attribution"), ("nc", "non ?commercial"), ("nd", "no ?derivatives|no ?derivs"), ("sa", "share ?alike")]
CC_KINDS = ["by-nc-nd", "by-nc-sa", "by-nc", "by-nd", "by-sa", "by"]
#: Broad keywords: a text without any of them matches no rule.
GATE = ["licen", "copyright", "gpl ", "cc by", "cc0", "creative commons", "public domain", "permission ", "redistribut", "all rights reserved", "proprietary ", "public license", "fuck", "warranty ", "gplv", "copy of the mpl", "advertising materials", "spdx ", "subject to ", "governed by ", "covered by ", "according to ", " under "]


def rules() -> list[dict]:
    """All signature rules in their order: the first has priority 0, which wins."""
    out = [{"label": label, "kw": kw, "rx": rx, "score": score} for label, kw, rx, score in SINGLE]
    words = dict(CC_PARTS)
    for kind in CC_KINDS:
        parts = kind.split("-")
        long = "creative commons " + " ".join(f"(?:{words[p]})" for p in parts)
        out.append({"label": f"cc-{kind}", "kw": " cc by ", "rx": f"cc {' '.join(parts)}(?: licen[cs]e)?(?: \\d \\d)?", "score": 0.9})
        out.append({"label": f"cc-{kind}", "kw": " creative commons ", "rx": f"{long}(?: \\d \\d)?(?: international| unported)?(?: licen[cs]e)?", "score": 0.9})
    for label, kw, name in FAMILIES:
        out += [{"label": label, "kw": kw, "rx": form.replace("{name}", name), "score": score} for score, form in FORMS]
    return [r | {"kw": r["kw"].split("|"), "priority": i} for i, r in enumerate(out)]


def normalized(text: Column) -> Column:
    """The words of a text, lower-cased A-Z, between single spaces, with one before and one behind."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _starts(text: Column, mark: str) -> Column:
    """Words that begin with a mark, from 0, of a text with a space before each word."""
    places = F.transform(F.split(F.substring(text, 2, 1 << 30), " "), lambda w, i: F.when(w.startswith(mark), i))
    return F.array_compact(places)


def detections(words: Column) -> Column:
    """All rules' detections in a normalized text: label, first and last word, priority, score."""
    known = F.from_json(F.lit(json.dumps(rules())), "array<struct<label:string,kw:array<string>,rx:string,score:double,priority:int>>")

    def of(rule: Column) -> Column:
        # `!` is in no normalized text: it marks where the pattern matches.
        pattern = F.concat(F.lit("(?<= )("), rule["rx"], F.lit(")(?= )"))
        starts = _starts(F.regexp_replace(words, pattern, F.lit("!$1")), "!")
        sizes = F.transform(F.regexp_extract_all(words, pattern, F.lit(1)), lambda m: _spaces(m) + 1)
        return F.zip_with(starts, sizes, lambda a, n: F.struct(a.alias("first"), (a + n - 1).alias("last"), rule["priority"].alias("priority"), rule["score"].alias("score"), rule["label"].alias("label")))

    return F.flatten(F.transform(F.filter(known, lambda r: F.exists(r["kw"], lambda kw: F.contains(words, kw))), of))


def surviving(found: Column) -> Column:
    """Detections that lie in none of another label and an earlier rule, nor in a longer one of their own label."""

    def beaten(x: Column, by: Column) -> Column:
        around = (by["first"] <= x["first"]) & (by["last"] >= x["last"])
        longer = (by["last"] - by["first"]) > (x["last"] - x["first"])
        return around & F.when(by["label"] == x["label"], longer).otherwise(by["priority"] < x["priority"])

    return let(found, lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda by: beaten(x, by))))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: base phrases' places, base labels, all labels, and a score.

    ``first_word`` and ``last_word`` are the smallest and largest word at which
    a base phrase begins, null without one.  The score is the highest
    confidence of a detection, 1 for a base phrase, 0 for none.  Null and empty
    texts have no words; each row gives one row, repeated rows too; null
    doc_ids stay; an empty table has no rows.
    """
    text = docs.select(F.col("doc_id").cast("long"), normalized(F.col("text").cast("string")).alias("words"))
    phrases = "|".join(p for p, _ in BASE)
    has_base = F.lit(False)
    for phrase, _ in BASE:
        has_base = has_base | F.contains("words", F.lit(f" {phrase} "))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains("words", F.lit(word))
    starts = F.when(has_base, _starts(F.regexp_replace("words", rf"(?<= )(?=(?:{phrases}) )", "!"), "!"))
    none = F.array().cast("array<struct<first:int,last:int,priority:int,score:double,label:string>>")
    base = F.array_compact(F.array(*[F.when(F.contains("words", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE]))
    seen = text.select("doc_id", F.when(F.trim("words") == "", F.lit(0)).otherwise(_spaces(F.col("words")) - 1).cast("long").alias("n_words"), starts.alias("starts"), F.array_sort(base).alias("base"), F.when(gate, surviving(detections(F.col("words")))).otherwise(none).alias("found"))
    return seen.select(
        "doc_id", "n_words", F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union("base", F.transform("found", lambda x: x["label"])))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
