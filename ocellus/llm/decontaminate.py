"""Benchmark decontamination by suffix arrays of the training texts.

A task gathers documents to shards, builds each shard's suffix array over
word numbers, and searches every suffix of every benchmark item in it by
binary search.  The ranges found give the longest verbatim match of each
suffix and all its locations; nothing is shuffled.

Words outside the benchmark get number 0, which matches nothing and so ends a
match.  Only training suffixes with enough numbered words to hold the
shortest window enter a suffix array: no other can hold a match.

The benchmark reaches the workers in blocks of at most ``BLOCK_CHARS``
characters; each block is one pass over the documents, so a benchmark of any
size works with bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ocellus.llm._arrow import map_batches

BLOCK_CHARS = 8_000_000
SHARD_WORDS = 1 << 19
WINDOW = 10

#: A-Z become a-z; digits, letters and all bytes of other characters stay; the rest are spaces.
_TRANSLATE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

SPAN = "struct<start:long,end:long>"
MATCH = "struct<length:long,at:long,item_id:string,item_at:long>"
SCANNED = f"row long, doc_id long, n_words long, spans array<{SPAN}>, items array<string>, longest {MATCH}"
MATCHES = "doc_id long, item_id string, item_at long, doc_at long, length long"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; a null text has none."""
    return (text or "").encode().translate(_TRANSLATE).split()


@dataclass
class TestSuffixes:
    """All suffixes of a block of benchmark items, as word numbers."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    windows: np.ndarray  # words of the window at each suffix; 0: none begins there
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        ids: list[int] = []
        starts, lengths, windows, item, names = [], [], [], [], []
        for name, text in items:
            own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            n = len(own)
            starts.append(np.arange(n) + len(ids))
            lengths.append(n - np.arange(n))
            windows.append(np.where(np.arange(n) + window <= n, window, 0) if n >= window else np.where(np.arange(n) == 0, n, 0))
            item.append(np.full(n, len(names)))
            names.append("null" if name is None else str(name))
            ids += own
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(vocabulary, np.array(ids, np.int64), join(starts), join(lengths), join(windows), join(item), names)


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int, largest: int) -> np.ndarray:
    """``at`` ordered by the up to ``depth`` words from there on; 0 ends a suffix.

    As many words as fit are packed into one sort key; only suffixes that
    still tie with others are sorted by their next words.
    """
    bits = max(1, int(largest).bit_length())
    each = max(1, 62 // bits)
    ids = np.concatenate([ids, np.zeros(each + 1, ids.dtype)])
    order = at.astype(np.int64)
    slots, group, done = np.arange(len(order)), np.zeros(len(order), np.int64), 0
    while len(slots) and done < depth:
        place = order[slots]
        key, alive = np.zeros(len(place), np.int64), np.ones(len(place), bool)
        for j in range(each):
            word = np.where(alive, ids[np.minimum(place + done + j, len(ids) - 1)], 0)
            alive = word > 0
            key = (key << bits) | word
        by = np.lexsort((key, group)) if done else np.argsort(key, kind="stable")
        order[slots] = place[by]
        key = key[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new) - 1
        tied = (np.bincount(group)[group] > 1) & (key & ((1 << bits) - 1) > 0)
        slots, group, done = slots[tied], group[tied], done + each
    return order


def _bound(ids: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """In each range of suffixes alike in ``depth`` words, the first whose next word is not less (``right``: is greater)."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        value = ids[order[mid] + depth]
        less = value <= word[open_] if right else value < word[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


def search(ids: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per test suffix: words matched, the range of the longest match, the range of its window."""
    n = len(test.starts)
    lo, hi, depth = np.zeros(n, np.int64), np.full(n, len(order)), np.zeros(n, np.int64)
    window_lo, window_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active, t = np.arange(n), 0
    while len(active) and len(order):
        word = test.ids[test.starts[active] + t]
        a = _bound(ids, order, lo[active], hi[active], t, word, right=False)
        b = _bound(ids, order, a, hi[active], t, word, right=True)
        found = b > a
        active = active[found]
        lo[active], hi[active], t = a[found], b[found], t + 1
        depth[active] = t
        full = active[test.windows[active] == t]
        window_lo[full], window_hi[full] = lo[full], hi[full]
        active = active[test.lengths[active] > t]
    return depth, lo, hi, window_lo, window_hi


class Shard:
    """Word numbers of some documents, each followed by a 0."""

    def __init__(self, test: TestSuffixes):
        self.test, self.parts, self.n_words = test, [], []
        self.size = 0

    def add(self, text: str | None) -> None:
        get = self.test.vocabulary.get
        own = [get(w, 0) for w in words_of(text)]
        self.n_words.append(len(own))
        self.parts.append(np.array([*own, 0], np.int64))
        self.size += len(own) + 1

    def scan(self) -> None:
        """Sets what was found: hit words, and each occurrence of windows and of longest matches."""
        test = self.test
        self.ids = ids = np.concatenate(self.parts)
        self.begin = np.cumsum([0] + [len(p) for p in self.parts])
        ends = np.flatnonzero(ids == 0)
        at = np.flatnonzero(ids)
        least = int(test.windows[test.windows > 0].min()) if (test.windows > 0).any() else 1
        at = at[ends[np.searchsorted(ends, at)] - at >= least]
        order = suffix_array(ids, at, int(test.lengths.max()) if len(test.lengths) else 0, len(test.vocabulary))
        self.order = order
        self.depth, self.lo, self.hi, window_lo, window_hi = search(ids, order, test)
        # Ranges of windows of one length are equal or apart: each is read once, whatever the number of items that hold it.
        found = np.flatnonzero(window_hi > window_lo)
        ranges, of = np.unique(np.stack([window_lo[found], window_hi[found], test.windows[found]], axis=1), axis=0, return_inverse=True)
        cover = np.zeros(len(ids) + 1, np.int64)
        docs: list[np.ndarray] = []
        for a, b, words in ranges.tolist():
            place = order[a:b]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + words, -1)
            docs.append(np.unique(self.doc_of(place)))
        self.hit = np.cumsum(cover)[:-1] > 0
        # Pairs of documents and items: each item of a range with each document in it.
        pairs = np.unique(np.stack([of.reshape(-1), test.item[found]], axis=1), axis=0)
        self.pair_doc = np.concatenate([docs[r] for r in pairs[:, 0].tolist()] or [np.zeros(0, np.int64)])
        self.pair_item = np.repeat(pairs[:, 1], [len(docs[r]) for r in pairs[:, 0].tolist()])
        self.least = least

    def longest(self) -> list[tuple[int, int, int, int]]:
        """(document, words, place, test suffix) of each document's longest match; of equal ones the first.

        Ranges of longest matches lie in one another or apart, so a sweep gives
        each place the deepest range around it.
        """
        long = np.flatnonzero((self.depth >= self.least) & (self.hi > self.lo))
        by = long[np.lexsort((long, self.depth[long], -self.hi[long], self.lo[long]))]
        best = np.full(len(self.order), -1)
        open_: list[tuple[int, int]] = []  # end and suffix of the ranges around the sweep's place
        at = 0
        for suffix, lo, hi in zip(by.tolist(), self.lo[by].tolist(), self.hi[by].tolist(), strict=True):
            while open_ and open_[-1][0] <= lo:
                end, inner = open_.pop()
                best[at:end], at = inner, max(at, end)
            if open_:
                best[at:lo] = open_[-1][1]
            at = max(at, lo)
            if not (open_ and open_[-1][0] == hi and self.depth[open_[-1][1]] >= self.depth[suffix] and self.lo[open_[-1][1]] == lo):
                open_.append((hi, suffix))
        while open_:
            end, inner = open_.pop()
            best[at:end], at = inner, max(at, end)
        held = np.flatnonzero(best >= 0)
        place, suffix = self.order[held], best[held]
        doc, words = self.doc_of(place), self.depth[suffix]
        by = np.lexsort((place, -words, doc))
        _, head = np.unique(doc[by], return_index=True)
        return [(int(doc[i]), int(words[i]), int(place[i]), int(suffix[i])) for i in by[head].tolist()]

    def locations(self, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Test suffixes and places of all longest matches, about ``most`` at a time, without those that the word before extends."""
        test, ids = self.test, self.ids
        long = np.flatnonzero((self.depth >= self.least) & (self.hi > self.lo))
        first = test.starts - (test.starts > 0)
        inner = np.concatenate([[False], test.item[1:] == test.item[:-1]]) if len(test.item) else np.zeros(0, bool)
        for suffix in long.tolist():
            for a in range(int(self.lo[suffix]), int(self.hi[suffix]), most):
                place = self.order[a : min(a + most, int(self.hi[suffix]))]
                before = np.where(place > 0, ids[np.maximum(place - 1, 0)], 0)
                place = place[~(inner[suffix] & (before > 0) & (before == test.ids[first[suffix]]))]
                if len(place):
                    yield np.full(len(place), suffix), place

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def item_at(self, suffix: np.ndarray) -> np.ndarray:
        """Word of its item at which a test suffix begins."""
        item = self.test.item
        return suffix - np.searchsorted(item, item[suffix], side="left")


def _blocks(benchmark: DataFrame, window: int, chars: int) -> Iterator[TestSuffixes]:
    """The benchmark, at most ``chars`` characters of whole items at a time."""
    items: list[tuple[object, str | None]] = []
    size = 0
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= chars:
            yield TestSuffixes.of(items, window)
            items, size = [], 0
    yield TestSuffixes.of(items, window)


def _shards(batches: Iterator[pa.RecordBatch], text: int, test: TestSuffixes, shard_words: int) -> Iterator[tuple[Shard, list[pa.RecordBatch]]]:
    """Scanned shards with the batches whose rows they hold."""
    shard, rows = Shard(test), []
    for batch in batches:
        first = 0
        for row, value in enumerate(batch.column(text)):
            shard.add(value.as_py())
            if shard.size >= shard_words:
                shard.scan()
                yield shard, [*rows, batch.slice(first, row + 1 - first)]
                shard, rows, first = Shard(test), [], row + 1
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if rows:
        shard.scan()
        yield shard, rows


def _scanned(docs: DataFrame, test: TestSuffixes, shard_words: int) -> DataFrame:
    """Per document of one pass: hit spans of words, items with occurring windows, the longest match."""
    sent = docs.sparkSession.sparkContext.broadcast(test)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches, 2, sent.value, shard_words):
            test = shard.test
            n = len(shard.n_words)
            edge = np.diff(np.concatenate([[0], shard.hit.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            spans: list[list] = [[] for _ in range(n)]
            for d, s, e in zip(shard.doc_of(a).tolist(), a.tolist(), b.tolist(), strict=True):
                spans[d].append({"start": s - int(shard.begin[d]), "end": e - int(shard.begin[d])})
            items: list[set] = [set() for _ in range(n)]
            for d, k in zip(shard.pair_doc.tolist(), shard.pair_item.tolist(), strict=True):
                items[d].add(test.names[k])
            longest: list[dict | None] = [None] * n
            for d, words, at, s in shard.longest():
                longest[d] = {"length": words, "at": at - int(shard.begin[d]), "item_id": test.names[test.item[s]], "item_at": int(shard.item_at(np.array([s]))[0])}
            whole = pa.Table.from_batches(rows)
            columns = [whole.column(0), whole.column(1), pa.array(shard.n_words, pa.int64()), spans, [sorted(x) for x in items], longest]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.struct([("length", pa.int64()), ("at", pa.int64()), ("item_id", pa.string()), ("item_at", pa.int64())])]
            table = pa.table([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "n_words", "spans", "items", "longest"])
            yield from table.combine_chunks().to_batches()

    return map_batches(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, SCANNED)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: words, words hit, items hit, the longest verbatim match and where it lies.

    A window is ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window.  Null and empty texts have no words.
    A null ``item_id`` is listed as ``null``; equal item_ids count once.  Each
    row of ``docs`` gives one row, repeated rows and null doc_ids too.
    """
    passes = [_scanned(docs, test, shard_words) for test in _blocks(benchmark, window, block_chars)]
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        every = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max_by("longest", F.struct("longest.length", -F.col("longest.at"))).alias("longest"),
        )
        # Spans of the passes may overlap: each counts from where those before it end.
        found = every.withColumn("spans", F.expr("""aggregate(spans, named_struct('to', 0L, 'out', cast(array() as array<struct<start:bigint,end:bigint>>)),
            (s, x) -> if(x.end > s.to, named_struct('to', x.end, 'out', concat(s.out, array(named_struct('start', greatest(s.to, x.start), 'end', x.end)))), s), s -> s.out)"""))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("longest.length", F.lit(0)).cast("long").alias("longest_match"), F.col("longest.at").alias("longest_at"), F.col("longest.item_id").alias("longest_item"), F.col("longest.item_at").alias("longest_item_at"), "spans",
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each longest verbatim match of a benchmark suffix and each of its locations.

    Matches shorter than the shortest window are left out, and so are those
    that the word before would extend.
    """
    out: DataFrame | None = None
    for test in _blocks(benchmark, window, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(test)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard, rows in _shards(batches, 1, sent.value, shard_words):
                ids = pa.Table.from_batches(rows).column(0).combine_chunks()
                for suffix, place in shard.locations():
                    doc = shard.doc_of(place)
                    item = pa.array([shard.test.names[i] for i in shard.test.item[suffix].tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), item, pa.array(shard.item_at(suffix)), pa.array(place - shard.begin[doc]), pa.array(shard.depth[suffix])], names=["doc_id", "item_id", "item_at", "doc_at", "length"])

        found = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, MATCHES)
        out = found if out is None else out.unionByName(found)
    assert out is not None
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs; all columns stay.

    Null and empty texts stay, as do null doc_ids and repeated rows without a
    window; an empty benchmark removes nothing; an empty table stays empty.
    """
    schema: StructType = docs.schema
    text = schema.fieldNames().index("text")
    for test in _blocks(benchmark, window, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(test)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard, rows in _shards(batches, text, sent.value, shard_words):
                clean = np.ones(len(shard.n_words), bool)
                clean[shard.pair_doc] = False
                first = 0
                for batch in rows:
                    yield batch.filter(pa.array(clean[first : first + batch.num_rows]))
                    first += batch.num_rows

        docs = map_batches(docs, keep, schema)
    return docs
