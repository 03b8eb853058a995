"""Exact near-duplicate components: n-gram Jaccard similarity by parity sketches.

A document's 5-word shingles are hashed to 64 bits and XORed into the blocks
of a sketch.  A shingle that one of two documents lacks changes one block, so
the number of differing blocks never exceeds the symmetric difference ``d`` of
the sets.  A similarity of at least 3/4 means ``d <= (|A| + |B|) / 7``, and so
the documents share one of their first ``|A| / 3 + 1`` blocks in any common
order (pigeonhole).  These blocks are the join keys.  Sketches have a block
count for each size band, and a document whose partners may fall into the next
band has keys there too.

Blocks hold whole 64-bit words, not single bits, and there are many more than
shingles: in a dense sketch of one-bit blocks, blocks that no shingle or by
chance the same number of shingles touched agree for one pair in ten.

What keeps hot groups linear:

* documents with equal sets are one node, named by a hash of the set;
* blocks that many documents hold come last in the common order, rarest first,
  so a passage in thousands of documents is no key while a document has enough
  others, and what stands before it is known to differ;
* a large group of a key is compared with its leaders only;
* members that do not end up in the component of most of the group differ from
  that component's centre ``X`` by more than links allow.  Two members that
  link, one of them such, must agree in part of what sets them apart from
  ``X`` (:func:`differences`), so they are joined on these differences, rarest
  first, instead of being compared with all of the group.

Candidates whose bit sketches (each shingle flips one bit) differ in more bits
than the sets may differ are dropped; the rest are verified on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.llm import _arrow
from ocellus.llm._arrow import drop_written, map_batches, slices

#: This module moves many tables in turn, so no shuffle's files may stay behind.
written = partial(_arrow.written, tidy=True)

WIDTH = 5
#: A size band reaches from one power of this to the next.
BAND = 16
#: Documents with a block, as far as a task counts it, from which it comes last in the order.
HOT = 40
#: Blocks that a task gathers before it counts them, and sets that it remembers so as to name equal ones once.
HELD, SEEN = 4_000_000, 100_000
#: Hot blocks sent to the workers; with more, the bound above is doubled until they fit.  The result is the same.
MAX_HOT = 1_000_000
#: Largest group of a key that is compared as a whole, and most members of a larger one that are compared with all of it.
GROUP, FEW = 24, 64
#: Ids up to which a set of documents is looked up by broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Whole sets are moved in passes: in each, pairs with about this share of the shingles of all documents.
PASS_SHARE = 1 / 4
#: Shingles that a pass may move in any case; small tables need one pass.
PASS_LEAST = 2_000_000

SETS = "doc_id long, text_hash long, n long, sig long, bits array<long>, hot_key long, hot_n long"
KEYS = "key long, sig long, n long"
#: A key's row has the set's size class, the differences that the keys before it prove, and the set's size, in one number.
CLASS_AT, PLACE_AT = 50, 25
PART = (1 << PLACE_AT) - 1
#: Blocks of a sketch for each shingle of the largest set of its band, as a power of two; and of all, at most.
SPREAD, MOST_BLOCKS = 12, 32
FOUND = "key long, a long, b long"
#: A difference: a hash of it and the centre, its place and those behind it, the set and its size, component and kind.
APART = "key long, place int, rest int, sig long, n int, root long, minor boolean"

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _scramble(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_of(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of the whole sequence if it has fewer words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        total = total * _MIX[0] + h[j : len(h) - width + 1 + j] * _MIX[j]
    total = np.sort(_scramble(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """The set's bit sketch: each shingle flips one bit.  A power of two of bits, one for each shingle or more.

    Folding a sketch's halves by XOR gives that of half the bits.
    """
    bits = max(256, 1 << (len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def signature(shingles: np.ndarray) -> int:
    """A name for a set: documents with equal sets are one node."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _block_of(shingles: np.ndarray, band: int) -> np.ndarray:
    blocks = np.uint64(min(1 << MOST_BLOCKS, BAND ** (band + 1) << SPREAD))
    return (shingles >> np.uint64(32)) * blocks >> np.uint64(32)


def _key_of(words: np.ndarray, block: np.ndarray, band: int) -> np.ndarray:
    salt = np.full(1, band + 1, np.uint64) * _MIX[1]
    return _scramble(_scramble(words + salt) + block * _MIX[2]).view(np.int64)


def sketch_keys(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each block of the set's sketch that holds a shingle, in the order of the blocks; and how many it holds.

    Blocks are ranges of the hash, so those of a sorted set are runs.
    """
    block = _block_of(shingles, band)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return _key_of(np.bitwise_xor.reduceat(shingles, first), block[first], band), np.diff(np.append(first, len(shingles)))


def bands(n: int) -> list[int]:
    """The bands in which a set of ``n`` shingles has keys: its own, and the next if a partner may lie there."""
    own = 0
    while BAND ** (own + 1) <= n:
        own += 1
    return [own, own + 1] if 4 * n >= 3 * BAND ** (own + 1) else [own]


def packed(size: int, place: np.ndarray) -> np.ndarray:
    """A row's number; in a key's group it puts the row with the least differences of a size class first."""
    return int(np.log(max(size, 1)) / np.log(1.15)) << CLASS_AT | place << PLACE_AT | size


@dataclass
class HotKeys:
    """Keys that many documents hold, sorted, with each one's rank by frequency."""

    keys: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> HotKeys:
        ranks = np.empty(len(keys), np.int64)
        ranks[np.lexsort((keys, counts))] = np.arange(len(keys))
        by = np.argsort(keys)
        return cls(keys[by], ranks[by])

    def order(self, keys: np.ndarray) -> np.ndarray:
        """Places that put the keys into the common order: by number, then the hot ones from the rarest on."""
        plain = np.argsort(keys)
        if not len(self.keys):
            return plain
        at = np.minimum(np.searchsorted(self.keys, keys[plain]), len(self.keys) - 1)
        hot = self.keys[at] == keys[plain]
        behind = np.flatnonzero(hot)
        return np.concatenate([plain[~hot], plain[behind[np.argsort(self.ranks[at[behind]])]]])


def leading_keys(shingles: np.ndarray, hot: HotKeys) -> tuple[np.ndarray, np.ndarray]:
    """The join keys: in each band the first |A| / 3 + 1 keys; and their rows' numbers.

    If a key is the first that two sets share, each block before it differs.
    One that holds a single shingle is a difference of its own, as far as the
    other set's block there is none with several; so ``2 - shingles`` of each
    block before it may be counted as differences on either side.
    """
    need = len(shingles) // 3 + 1
    out, rows = [], []
    for band in bands(len(shingles)):
        keys, held = sketch_keys(shingles, band)
        by = hot.order(keys)[:need]
        proven = np.concatenate([[0], np.cumsum(2 - held[by])[:-1]])
        out.append(keys[by])
        rows.append(packed(len(shingles), np.maximum(proven, 0)))
    return np.concatenate(out), np.concatenate(rows)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("text_hash"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def repeated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys that occur twice or more, with counts.  Empties ``parts``: a worker holds the keys once, and twice for a moment."""
    keys = np.concatenate(parts)
    parts.clear()
    keys.sort()
    again = keys[1:] == keys[:-1]
    first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
    last = np.flatnonzero(again & ~np.concatenate([again[1:], [False]]))
    return keys[first], last - first + 2


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, set size and set name of each document; and blocks that a task meets twice or more in ``HELD`` blocks, with counts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc_id=None, text_hash=None, n=None, sig=None, bits=None, hot_key=None, hot_n=None) -> pa.RecordBatch:
            columns = {"doc_id": doc_id, "text_hash": text_hash, "n": n, "sig": sig, "bits": bits, "hot_key": hot_key, "hot_n": hot_n}
            size = len(n if n is not None else hot_key)
            kind = lambda c: pa.list_(pa.int64()) if c == "bits" else pa.int64()
            return pa.RecordBatch.from_arrays([pa.nulls(size, kind(c)) if v is None else pa.array(v, kind(c)) for c, v in columns.items()], names=list(columns))

        seen: set[int] = set()
        keys: list[np.ndarray] = []
        held = 0

        def often() -> pa.RecordBatch:
            key, count = repeated(keys)
            return rows(hot_key=key, hot_n=count)

        for batch in batches:
            for first, texts in slices(batch, "text"):
                n, sig, bits = [], [], []
                for text in texts:
                    own = set_of(text)
                    n.append(len(own))
                    bits.append(parity_bits(own) if len(own) else None)
                    sig.append(signature(own) if len(own) else None)
                    if len(own) and sig[-1] not in seen:
                        seen.add(sig[-1])
                        keys += [sketch_keys(own, band)[0] for band in bands(len(own))]
                        held += len(own)
                yield rows(batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), n, sig, bits)
                if held > HELD:
                    yield often()
                    seen, keys, held = set(), [], 0
        if keys:
            yield often()

    return map_batches(_texts(docs), describe, SETS)


def hot_keys(described_: DataFrame, least: int = HOT, most: int = MAX_HOT) -> HotKeys:
    """The keys of blocks that many documents hold; they only change the order of keys."""
    counts = described_.where("hot_key is not null").groupBy("hot_key").agg(F.sum("hot_n").alias("n"))
    counts = written(counts.where(F.col("n") >= least))
    while counts.where(F.col("n") >= least).count() > most:
        least *= 2
    found = counts.where(F.col("n") >= least).select("hot_key", "n").toArrow()
    drop_written(counts)
    return HotKeys.of(found.column(0).to_numpy(), found.column(1).to_numpy())


def keyed(docs: DataFrame, hot: HotKeys) -> DataFrame:
    """A row (key, set name, size and differences) for each join key; a task names equal sets once as long as it remembers them."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen = set()
            for _, texts in slices(batch, "text"):
                keys, sigs, ns = [], [], []
                for text in texts:
                    own = set_of(text)
                    if not len(own) or (sig := signature(own)) in seen:
                        continue
                    seen.add(sig)
                    k, row = leading_keys(own, sent.value)
                    keys.append(k)
                    sigs.append(np.full(len(k), sig))
                    ns.append(row)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, sigs, ns)], names=["key", "sig", "n"])

    return map_batches(_texts(docs), emit, KEYS)


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether two rows' set sizes allow a similarity of 3/4."""
    n, m = n & PART, m & PART
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def _first(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets that are similar may have this key as the first they share."""
    return 7 * ((n >> PLACE_AT & PART) + (m >> PLACE_AT & PART)) <= (n & PART) + (m & PART)


class Grouper:
    """Turns rows sorted by (key, n, sig) into candidate pairs, a batch at a time.

    Groups of up to ``GROUP`` rows give all pairs.  Rows of larger ones are
    paired with the leader of their size class, leaders with the leader
    before; such groups are also handed on as rows (key, sig, n).  Only an
    unfinished group of up to ``GROUP`` rows, or the leader of an unfinished
    larger one, is kept between batches.
    """

    def __init__(self) -> None:
        self.rest = [np.zeros(0, np.int64)] * 3
        self.large: tuple[int, int, int] | None = None  # key, sig and n of the leader

    def feed(self, key: np.ndarray, sig: np.ndarray, n: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (two columns) and rows of large groups (three columns)."""
        key, sig, n = (np.concatenate([a, b]) for a, b in zip(self.rest, (key, sig, n), strict=True))
        self.rest = [x[:0] for x in (key, sig, n)]
        none = np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)
        if not len(key):
            return none
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
        key, sig, n = key[new], sig[new], n[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        goes_on = self.large is not None and self.large[0] == key[0]
        if not last and sizes[-1] <= GROUP and not (goes_on and len(starts) == 1):
            cut = starts[-1]
            self.rest = [x[cut:] for x in (key, sig, n)]
            key, sig, n, starts, sizes = key[:cut], sig[:cut], n[:cut], starts[:-1], sizes[:-1]
            if not len(key):
                return none
        large = sizes > GROUP
        large[0] |= goes_on
        of = np.repeat(large, sizes)
        pairs = []
        small = np.flatnonzero(~of & np.repeat(sizes > 1, sizes))
        if len(small):
            k, s, m = key[small], sig[small], n[small]
            for step in range(1, GROUP):
                same = np.flatnonzero(k[step:] == k[:-step])
                if not len(same):
                    break
                ok = same[_alike(m[same], m[same + step]) & _first(m[same], m[same + step])]
                pairs.append(np.stack([s[ok], s[ok + step]], axis=1))
        rows = np.stack([key[of], sig[of], n[of]], axis=1)
        if of.any():
            k, s, m = rows.T
            if goes_on:
                lead = self.large
                k, s, m = (np.concatenate([[v], x]) for v, x in zip(lead, (k, s, m), strict=True))
            group = m >> CLASS_AT
            head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (group[1:] != group[:-1])]))
            leader = np.repeat(head, np.diff(np.append(head, len(k))))
            a, b = np.arange(len(k)), leader
            before = head[1:][k[head[1:]] == k[head[:-1]]]
            a, b = np.concatenate([a, before]), np.concatenate([b, leader[before - 1]])
            ok = (a != b) & _alike(m[a], m[b])
            pairs.append(np.stack([s[a[ok]], s[b[ok]]], axis=1))
            self.large = (int(k[-1]), int(s[leader[-1]]), int(m[leader[-1]]))
        if not large[-1]:
            self.large = None
        found = np.concatenate(pairs) if pairs else none[0]
        found = np.sort(found[found[:, 0] != found[:, 1]], axis=1)
        return np.unique(found, axis=0) if len(found) else found, rows


def grouped(keys: DataFrame) -> DataFrame:
    """Candidate pairs (null, a, b) and the rows (key, sig, n) of large groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Grouper()

        def out(pairs: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["key", "a", "b"])

        for batch in batches:
            yield from out(*state.feed(*(batch.column(i).to_numpy() for i in range(3))))
        empty = np.zeros(0, np.int64)
        yield from out(*state.feed(empty, empty, empty, last=True))

    return map_batches(keys.repartition("key").sortWithinPartitions("key", "n", "sig"), run, FOUND)


def _small(ids: DataFrame) -> DataFrame:
    """A table of ids and numbers, to be broadcast where it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _folded(bits: Column, words: Column) -> Column:
    """A bit sketch of twice as many words, or as many, as one of ``words``."""
    halves = F.transform(F.slice(bits, F.lit(1), words), lambda x, i: x.bitwiseXOR(F.get(bits, i + words)))
    return F.when(F.size(bits) > words, halves).otherwise(bits)


def _first_ids(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, text_hash) of one text of each wanted set."""
    return sets.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text_hash").alias("text_hash"))


def promising(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose bit sketches allow a similarity of 3/4, with sizes; and, for the sets in all pairs, sig and text_hash among others.

    The sketches' Hamming distance is at most the symmetric difference, which
    is at most a seventh of the sets' sizes together.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    own = written(sets.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    left, right = (own.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a")
    words = F.least(F.size("sa"), F.size("sb"))
    flipped = F.zip_with(_folded(F.col("sa"), words), _folded(F.col("sb"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    distance = F.aggregate(flipped, F.lit(0), lambda t, x: t + x)
    near = written(both.where(7 * distance <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb").distinct())
    return near, own


def _sets(docs: DataFrame, names: DataFrame) -> DataFrame:
    """sig and hashes of the named sets, from the texts (sig, text_hash)."""
    names = written(names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for first, texts in slices(batch, "text"):
                held, sigs = [], []
                for text, sig in zip(texts, batch.column(0).slice(first, len(texts)).to_pylist(), strict=True):
                    if sig not in seen and signature(own := set_of(text)) == sig:
                        seen.add(sig)
                        held.append(own.view(np.int64))
                        sigs.append(sig)
                if held:
                    offsets = pa.array(np.cumsum([0] + [len(o) for o in held]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))], names=["sig", "hashes"])

    found = map_batches(_texts(docs).join(_small(names), "text_hash").select("sig", "text"), hashes, "sig long, hashes array<long>")
    # Copies of a text in several batches name a set several times.
    out = written(found.dropDuplicates(["sig"]))
    drop_written(names)
    return out


def _shingles(sets: DataFrame) -> int:
    """Shingles of all documents, copies counted too."""
    return sets.agg(F.sum("n")).first()[0] or 0


def _passes(moved: int, ids: int, shingles: int) -> int:
    """In how many passes whole sets are moved, so that their disk keeps to a share of the documents and their ids can be broadcast."""
    return max(1, -int(-moved // max(PASS_LEAST, shingles * PASS_SHARE)), -(-ids // BROADCAST_IDS))


def _pass_of(column: str, passes: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("pass"), column), F.lit(passes))


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of 3/4 or more; a pair may be repeated.

    Pairs carry whole sets, which in a table of near copies take many times
    its size; so they are verified in passes, each of which leaves its links
    only.
    """
    near, ids = promising(pairs, sets)
    count, moved = near.agg(F.count("*"), F.sum(F.col("na") + F.col("nb"))).first()
    passes = _passes(moved or 0, 2 * count, _shingles(sets))
    out = []
    for number in range(passes):
        some = near.where(_pass_of("a", passes) == number).select("a", "b")
        whole = _sets(docs, ids.join(some.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "sig", "left_semi").select("sig", "text_hash"))
        left, right = (whole.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        both = some.join(right, "b").join(left, "a")
        shared = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).cast("long").alias("i"), (F.size("ha") + F.size("hb")).cast("long").alias("t"))
        out.append(written(shared.where(100 * F.col("i") >= 75 * (F.col("t") - F.col("i"))).select("a", "b")))
        drop_written(whole)
    for done in (near, ids):
        drop_written(done)
    return reduce(DataFrame.unionByName, out)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge; the root is the component's smallest node.

    Rounds of large star and small star by joins and minima; the edges of each
    round are written to the shared folder.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = mark(now)
    while state[0]:
        # Large star: larger neighbours of a node go to the smallest node around it.
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = written(small)
        drop_written(large)
        drop_written(now)
        now, before, state = after, state, mark(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def differences(own: np.ndarray, centre: np.ndarray, minor: bool, hot: HotKeys) -> tuple[np.ndarray, int]:
    """What sets a set apart from a centre ``X``, in an order common to all sets, as far as linked sets must share of it.

    With ``D`` for the symmetric difference to ``X``, sets A and B differ by
    ``|D_A| + |D_B| - 2 |D_A & D_B|``, at most ``(|A| + |B|) / 7`` if they
    link.  A minor set A does not link with X: ``|D_A| > (|A| + |X|) / 7``.
    As ``|B|`` is at most ``|X| + |D_B|``, it shares more than ``3/7 |D_B|``
    with B; and, as ``|D_B|`` is at least the difference of the sizes, at
    least ``|D_A| / 2 - (|A| + |X|) / 14``.  So one shared element, the first
    in any common order, lies so far from the end.  Shingles that X lacks come
    first, the hot ones of them last; then those that only X has.
    """
    more, fewer = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
    # The keys of blocks that hold one shingle alone; the rest may stay in any order.
    band = bands(len(centre))[0]
    more = more[hot.order(_key_of(more, _block_of(more, band), band))]
    apart = np.concatenate([more, fewer])
    shared = 3 * len(apart) // 7 + 1
    if minor:
        shared = min(shared, max(1, -((len(own) + len(centre) - 7 * len(apart)) // 14)))
    # All before the first shared element differs, which is at most (|A| + |B|) / 7, and so |A| / 3.
    return apart[: max(0, min(len(apart) - shared, len(own) // 3) + 1)].view(np.int64), len(apart)


def across(spark: SparkSession, docs: DataFrame, large: DataFrame, comps: DataFrame, links: DataFrame, sets: DataFrame, hot: HotKeys, tried: DataFrame) -> DataFrame:
    """Pairs of a large group that lie in different components and may link, as far as not tried yet.

    Each group has the component of most of its rows; the set with most links
    in that component is the group's centre.  Rows of groups with the same
    centre are one row.  Pairs of these of which one is in another component
    are joined where they share one of their differences to the centre; in a
    group with at most ``FEW`` rows in other components, where they fit.  Both
    ways find all pairs that link.
    """
    rooted = comps.withColumnRenamed("node", "sig")
    size, place = F.col("b").bitwiseAND(PART), F.shiftright("b", PLACE_AT).bitwiseAND(PART)
    # Two rows can link by the key as the first they share only if their sizes leave as much as the differences before it take.
    rows = large.select("key", F.col("a").alias("sig"), size.alias("n"), F.shiftright("b", CLASS_AT).alias("c"), (size - 7 * place).alias("left")).join(rooted, "sig", "left")
    rows = written(rows.withColumn("root", F.coalesce("root", "sig")))
    counts = rows.groupBy("key", "root", "c").agg(F.count("*").alias("rows"), F.max("left").alias("left"))
    main = counts.groupBy("key", "root").agg(F.sum("rows").alias("rows")).groupBy("key").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.count("*").alias("roots"))
    # The best row of another component around each size class; a similarity of 3/4 spans three classes at most.
    near = counts.select("key", "root", "left", F.explode(F.sequence(F.col("c") - 3, F.col("c") + 3)).alias("c"))
    top = near.groupBy("key", "c").agg(F.max(F.struct("left", "root")).alias("top"))
    second = near.join(top, ["key", "c"]).where("root <> top.root").groupBy("key", "c").agg(F.first("top").alias("top"), F.max("left").alias("second"))
    partner = F.when(F.col("root") == F.col("top.root"), F.col("second")).otherwise(F.col("top.left"))
    rows = rows.join(second, ["key", "c"]).where(F.col("left") + partner >= 0).select("key", "sig", "n", "root", "left")
    rows = rows.join(main.where("roots > 1").select("key", "main"), "key").withColumn("minor", F.col("root") != F.col("main"))
    rows = written(rows)
    minors = written(rows.where("minor").groupBy("key").agg(F.count("*").alias("minors")))
    # A group of few such members is compared with them as it is, which is linear in its size.
    some = rows.join(minors.where(F.col("minors") <= FEW).select("key"), "key")
    few = some.where("minor").select("key", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "root", "left")])
    alike = 4 * F.least("n", "n_a") >= 3 * F.greatest("n", "n_a")
    met = few.join(some, "key").where((F.col("root") != F.col("root_a")) & alike & (F.col("left") + F.col("left_a") >= 0))
    direct = met.select(F.least("sig", "sig_a").alias("a"), F.greatest("sig", "sig_a").alias("b"))
    rows = rows.join(minors.where(F.col("minors") > FEW).select("key"), "key")
    of_key = written(rows.select("key", "main").distinct())
    main = of_key.select("main").distinct()
    degrees = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
    of_main = rooted.join(main.withColumnRenamed("main", "root"), "root", "left_semi").join(degrees, "sig", "left")
    centres = of_main.groupBy("root").agg(F.max_by("sig", F.struct(F.coalesce("links", F.lit(0)), "sig")).alias("x"))
    of_key = of_key.join(centres.withColumnRenamed("root", "main"), "main", "left").select("key", F.coalesce("x", "main").alias("x"))
    members = written(rows.join(of_key, "key").select("x", "sig", "n", "root", "minor").distinct())
    sent = spark.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, sig, n, root, minor = (batch.column(i)[row].as_py() for i in (0, 2, 4, 5, 6))
                centre, own = (batch.column(i)[row].values.to_numpy().view(np.uint64) for i in (1, 3))
                elements, size = differences(own, centre, minor, sent.value)
                k = len(elements)
                if k:
                    place = np.arange(k, dtype=np.int32)
                    same = lambda v, kind: np.full(k, v, kind)  # noqa: E731, B023
                    # Equal keys of different elements only add pairs to verify.
                    key = _scramble(elements.view(np.uint64) + _scramble(np.full(1, x).view(np.uint64))).view(np.int64)
                    columns = [key, place, np.int32(size) - place, same(sig, np.int64), same(n, np.int32), same(root, np.int64), same(minor, bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in APART.split(", ")])

    count, moved = members.agg(F.count("*"), F.sum(2 * F.col("n"))).first()
    passes = _passes(moved or 0, 2 * count, _shingles(sets))
    parts = []
    for number in range(passes):
        some = members.where(_pass_of("sig", passes) == number)
        wanted = some.select(F.explode(F.array("x", "sig")).alias("sig")).distinct()
        whole = _sets(docs, _first_ids(sets, wanted))
        both = some.join(whole, "sig").join(whole.select(F.col("sig").alias("x"), F.col("hashes").alias("centre")), "x").select("x", "centre", "sig", "hashes", "n", "root", "minor")
        parts.append(written(map_batches(both, emit, APART)))
        drop_written(whole)
    apart = reduce(DataFrame.unionByName, parts)
    minor = apart.where("minor").select("key", *[F.col(c).alias(f"{c}_a") for c in ("place", "rest", "sig", "n", "root")])
    size = F.col("n") + F.col("n_a")
    fits = (F.col("root") != F.col("root_a")) & alike & (7 * (F.col("place") + F.col("place_a") + F.abs(F.col("rest") - F.col("rest_a"))) <= size)
    met = minor.join(apart, "key").where(fits)
    pairs = met.select(F.least("sig", "sig_a").alias("a"), F.greatest("sig", "sig_a").alias("b")).unionByName(direct).distinct()
    out = written(pairs.join(tried, ["a", "b"], "left_anti"))
    for done in (minors, members, *parts):
        drop_written(done)
    return out


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, sig) of each row, and (node, root) of the sets that link."""
    spark = docs.sparkSession
    seen = written(described(docs))
    sets = seen.where("hot_key is null").select("doc_id", "text_hash", "n", "sig", "bits")
    hot = hot_keys(seen)
    found = written(grouped(keyed(docs, hot)))
    pairs = written(found.where("key is null").select("a", "b").distinct())
    links = verified(docs, pairs, sets)
    comps = components(spark, links)
    more = across(spark, docs, found.where("key is not null"), comps, links, sets, hot, pairs)
    if more.limit(1).count():
        links = links.unionByName(verified(docs, more, sets))
        comps = components(spark, links)
    for done in (found, pairs, more):
        drop_written(done)
    return sets.select("doc_id", "text_hash", "n", "sig"), comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Two documents link when their sets of 5-word shingles have a Jaccard
    similarity of 3/4 or more; a component is named by its smallest doc_id.
    Null, empty and blank texts have an empty set and are linked with nothing.
    Rows with a null doc_id have a null component; texts that link through
    them are still one component.  Repeated rows give a row each.  An empty
    table has no rows.
    """
    rows, comps = _components(docs)
    named = rows.select("doc_id", "n", "sig").join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "n", F.coalesce("root", "sig").alias("root"))
    first = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    out = named.join(first, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    It is a row with the smallest doc_id (null ids last) and, of rows with
    that doc_id, one text; which of several rows alike in both is kept is not
    defined, as long as one is.  Rows without words all stay: they link with
    nothing.  An empty table stays empty.
    """
    rows, comps = _components(docs)
    named = rows.where("sig is not null").join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "text_hash", F.coalesce("root", "sig").alias("root"))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = named.groupBy("root").agg(F.min(name).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    judged = written(named.join(chosen, "root").groupBy("doc_id", "text_hash").agg(F.first(name == F.col("best")).alias("best"), F.count("*").alias("rows")))
    judged = judged.select(F.col("doc_id").alias("_ocellus_id"), F.col("text_hash").alias("_ocellus_text"), "best", "rows")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_ocellus_id")) & (_text_hash() == F.col("_ocellus_text"))
    dropped, again = judged.where("not best"), judged.where("best and rows > 1")
    kept = docs.join(_small(dropped), own, "left_anti")
    if again.limit(1).count():
        # Repeated rows of the row that stays: all but one of them go.
        again = _small(again)
        single = kept.join(again, own, "left_anti")
        order = Window.partitionBy("_ocellus_id", "_ocellus_text").orderBy(F.lit(0))
        repeated = kept.join(again, own).withColumn("_ocellus_n", F.row_number().over(order)).where("_ocellus_n = 1")
        kept = single.unionByName(repeated.select(*docs.columns))
    return kept.select(*docs.columns)
