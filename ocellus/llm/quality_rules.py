"""Quality rules with risk-controlled thresholds.

Base rules are fixed.  Further rules reject a document if one of its ratios is
over a cutoff.  The cutoffs of a stratum (language) come from its labelled
good documents: of a fixed sequence of levels, from loose to strict, the
strictest up to which exact binomial tests show that all rules together
reject at most ``RISK`` of the stratum's good documents.  As each level
rejects what looser ones do, the sequence needs no correction of its own; the
strata share the chance of an error (Bonferroni).  A stratum with too few
labelled documents for any such proof has no cutoffs.  All of it is DataFrame
expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import let, written

SPACE = r"[\x20\x09-\x0D]+"
#: Share of a stratum's good documents that the rules may reject, and the chance that any stratum breaks its bound.
RISK = 0.03
CONFIDENCE_GAP = 0.05
#: The rules' cutoffs at level 1.
RULES = {"symbols": 0.5, "exclamations": 0.5, "capitals": 1.0, "repeated_words": 1.0, "repeated_lines": 1.0}
#: The levels, from the strictest on.
GRID = [round(0.02 * 1.25**i, 4) for i in range(24)]
#: Strata up to which their cutoffs are broadcast; more are joined by a shuffle of ids and numbers.
BROADCAST_STRATA = 10_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def _without(text: Column, characters: str) -> Column:
    """How many of the characters, written as in a class of a regular expression, a text has.

    ``translate`` would make a Java string of each character of the text.
    """
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{characters}]", ""))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash.  Windows with their places are
    sorted, so equal ones are neighbours; the places found are sorted, and each
    adds the words up to the next one, three at most.
    """
    hashes = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(F.lit(0)))


def measures(text: Column) -> Column:
    """What the rules see of a text, as a struct; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(F.regexp_replace(text, SPACE, ""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
    return F.struct(
        of_words["n"].cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), _without(text, "#*$%&|<>").cast("long").alias("n_symbols"), of_lines["again"].cast("long").alias("n_dup_lines"), of_words["again"].cast("long").alias("n_repeat_words"),
        of_lines["n"].cast("long").alias("n_lines"), _without(text, "!").cast("long").alias("n_exclamations"), _without(text, _UPPER).cast("long").alias("n_capitals"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and measures of each document."""
    m = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), measures(F.col("text").cast("string")).alias("m"))
    return m.select("doc_id", "stratum", "m.*")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def level(of: Callable[[str], Column]) -> Column:
    """The largest of a document's ratios, each in units of its rule's cutoff: a level below it rejects the document."""
    per = lambda a, b: of(a) / F.greatest(of(b), F.lit(1))
    ratios = {
        "symbols": per("n_symbols", "n_words"), "exclamations": per("n_exclamations", "n_words"), "capitals": per("n_capitals", "word_chars"),
        "repeated_words": per("n_repeat_words", "n_words"), "repeated_lines": per("n_dup_lines", "n_lines"),
    }
    return F.greatest(*[ratios[name] / cutoff for name, cutoff in RULES.items()])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for n draws of chance p, exactly; 1 where k reaches the mean.

    Terms and their sum are kept as logarithms, each term from the one before.
    """
    odds = math.log(p / (1 - p))
    first = n * math.log(1 - p)
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(s["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, step, lambda s: s["sum"])))


def cutoffs(measures_: DataFrame, labels: DataFrame, risk: float = RISK, gap: float = CONFIDENCE_GAP) -> DataFrame:
    """stratum and the level of its cutoffs, from labelled documents; no row for a stratum without.

    A doc_id with several labels counts as good only if all say so.  Only good
    documents that pass the base rules count: the bound is on their rejection.
    """
    good = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    rows = measures_.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("doc_id", "stratum", level(F.col).alias("level")).join(good, "doc_id")
    # How many levels of the grid a document is over: a histogram has all that the tests need.
    over = F.aggregate(F.array(*[F.lit(g) for g in GRID]), F.lit(0), lambda a, g: a + (F.col("level") > g).cast("int"))
    counts = rows.groupBy("stratum", over.alias("over")).agg(F.count("*").alias("c"))
    # One row for each stratum, so few files: Hadoop starts processes for every file, and each counts as a copy of its JVM until it runs.
    hist = written(counts.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("over", "c")).alias("h")))
    strata = max(1, hist.count())
    tests = hist.select("stratum", "n", "h", F.posexplode(F.array(*[F.lit(g) for g in GRID])).alias("g", "cutoff"))
    rejected = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.when(x["over"] > F.col("g"), x["c"]).otherwise(F.lit(0).cast("long")))
    # A stricter level rejects no fewer, so the strictest proven one ends the sequence of proven ones.
    proven = tests.select("stratum", "cutoff", "n", rejected.alias("k")).where(binomial_tail(F.col("n"), F.col("k"), risk) <= gap / strata)
    return proven.groupBy("stratum").agg(F.min("cutoff").alias("_ocellus_cut"))


def with_cutoffs(df: DataFrame, cuts: DataFrame, stratum: Column) -> DataFrame:
    """``df`` with the cutoffs of each row's stratum."""
    cuts = cuts.withColumnRenamed("stratum", "_ocellus_stratum")
    small = cuts.count() <= BROADCAST_STRATA
    return df.join(F.broadcast(cuts) if small else cuts, stratum == F.col("_ocellus_stratum"), "left").drop("_ocellus_stratum")


def kept(of: Callable[[str], Column]) -> Column:
    """Whether a document passes the base rules and its stratum's cutoffs."""
    over = F.coalesce(level(of) > F.col("_ocellus_cut"), F.lit(False))
    return ~base_failed(of("n_words"), of("n_repeat_words")) & ~over


def judge(measures_: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per document: words, the base counts, base_failed and kept.

    A null or empty text has no words and fails the base rules.  Each row
    gives one row; null doc_ids stay; a null language is a stratum of its own,
    together with the empty one.
    """
    rows = with_cutoffs(measures_, cuts, F.col("stratum"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), kept(F.col).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns.

    Documents are measured once and written with their measures, from which
    both the cutoffs and the verdicts come.  Null and empty texts go, as they
    fail the base rules; repeated rows are judged alike; an empty table stays
    empty; without labels the base rules alone decide.
    """
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    seen = written(docs.select("*", stratum.alias("_ocellus_lang"), measures(F.col("text").cast("string")).alias("_ocellus_m")))
    cuts = cutoffs(seen.select(F.col("doc_id").cast("long"), F.col("_ocellus_lang").alias("stratum"), "_ocellus_m.*"), labels)
    rows = with_cutoffs(seen, cuts, F.col("_ocellus_lang"))
    return rows.where(kept(lambda c: F.col(f"_ocellus_m.{c}"))).select(*docs.columns)
