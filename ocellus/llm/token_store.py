"""Token ids in grammar-compressed files with random access.

Documents are written in ascending ``doc_id`` order as shards of about a
million ids.  Each shard is compressed by Re-Pair in rounds: in each the most
frequent pairs of neighbouring symbols become nonterminals together, as one
pair at a time needs thousands of passes.  ``ROUNDS`` rounds share the symbol
space; more follow until it is used up or no pair is frequent.  A shard stores its rules with the
length that each nonterminal expands to, so a stretch of ids can be decoded
without expanding what stands before it.

Layout of a shard (little-endian): the magic ``OCRP``; version, first
nonterminal, rules, symbols, documents as u4; ids as u8; the rules' two
symbols as u4 pairs; the rules' expansion lengths as u4; the symbols as u2
(u4 when the symbol space is over 65,536); the documents' ids counts as u4.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm._arrow import map_batches, shared_folder, slices
from ocellus.llm.tokens import RUN_CHARS, encoder, vocabulary_of

MAGIC = b"OCRP"
HEAD = struct.Struct("<4s5IQ")
SHARD_IDS = 1 << 20
ROUNDS = 8
SHARDS = "part int, seq int, before long, n_docs long, n_tokens long, doc_ids array<long>, payload binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frequent_pairs(keys: np.ndarray, most: int, least: int) -> np.ndarray:
    """The up to ``most`` most frequent keys that occur ``least`` times or more, in ascending order; of equally frequent ones the smallest."""
    ordered = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= least)
    if len(often) > most:
        # Which of equal counts argpartition takes depends on the CPU.
        n = counts[often]
        last = np.partition(n, len(n) - most)[len(n) - most]
        chosen = n > last
        chosen[np.flatnonzero(n == last)[: most - np.count_nonzero(chosen)]] = True
        often = often[chosen]
    return ordered[starts[often]]


def compress(ids: np.ndarray, vocabulary: int, rounds: int = ROUNDS, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs) and expansion lengths of the rules.

    Nonterminals are numbered from ``vocabulary``.  Below 65,536 ids the
    symbol space ends there and pairs are sorted as 32-bit keys.
    """
    small = vocabulary < 1 << 16
    space = 1 << 16 if small else vocabulary + (1 << 16)
    key_type, bits = (np.uint32, 16) if small else (np.uint64, 32)
    symbols = ids.astype(key_type)
    rules: list[np.ndarray] = []
    next_id = vocabulary
    while len(symbols) > 1 and next_id < space:
        each = max(1, (space - next_id) // max(1, rounds - len(rules)))
        keys = (symbols[:-1] << key_type(bits)) | symbols[1:]
        chosen = frequent_pairs(keys, each, least)
        # A slot of the table holds one pair; pairs that collide wait for the next round.
        slot = lambda k: ((k * key_type(0x9E3779B1)) & key_type(0xFFFFFFFF)) >> key_type(13)
        _, first = np.unique(slot(chosen), return_index=True)
        chosen = chosen[np.sort(first)]
        if not len(chosen):
            break
        table = np.zeros(1 << 19, np.uint32)
        table[slot(chosen)] = np.arange(1, len(chosen) + 1)
        which = table[slot(keys)]
        at = np.flatnonzero(which)
        at = at[chosen[which[at] - 1] == keys[at]]
        if not len(at):
            break
        # Of overlapping places every second one of a run is taken, from its left.
        new_run = np.concatenate([[True], np.diff(at) > 1])
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        symbols[at] = (which[at] - 1 + next_id).astype(key_type)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules.append(np.stack([chosen >> key_type(bits), chosen & key_type((1 << bits) - 1)], axis=1).astype(np.uint32))
        next_id += len(chosen)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return symbols.astype("<u2" if small else "<u4"), pairs, expansion_lengths(pairs, vocabulary, [len(r) for r in rules])


def expansion_lengths(pairs: np.ndarray, vocabulary: int, rounds: list[int]) -> np.ndarray:
    """Ids that each rule stands for; a rule refers to rules of earlier rounds only."""
    lengths = np.zeros(len(pairs), np.uint32)
    done = 0
    for n in rounds:
        for side in (0, 1):
            s = pairs[done : done + n, side].astype(np.int64)
            lengths[done : done + n] += np.where(s < vocabulary, 1, lengths[np.maximum(s - vocabulary, 0)]).astype(np.uint32)
        done += n
    return lengths


def unfold(symbols: np.ndarray, pairs: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids that symbols stand for: nonterminals are replaced by their pairs until none is left."""
    symbols = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(symbols >= vocabulary)):
        n = np.ones(len(symbols), np.int64)
        n[at] = 2
        place = np.cumsum(n) - n
        out = np.repeat(symbols, n)
        rule = symbols[at] - vocabulary
        out[place[at]], out[place[at] + 1] = pairs[rule, 0], pairs[rule, 1]
        symbols = out
    return symbols


def expand(symbols: np.ndarray, pairs: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """The same, with each rule unfolded once and its ids copied to each of its places."""
    if not len(pairs) or len(symbols) < len(pairs):
        return unfold(symbols, pairs, vocabulary)
    unfolded = unfold(np.arange(vocabulary, vocabulary + len(pairs)), pairs, vocabulary)
    # One table: a terminal's ids begin at itself, a rule's behind all terminals.
    table = np.concatenate([np.arange(vocabulary, dtype=np.uint32), unfolded])
    sizes = np.concatenate([np.ones(vocabulary, np.int32), lengths.astype(np.int32)])
    begins = np.concatenate([np.arange(vocabulary), vocabulary + np.cumsum(lengths, dtype=np.int64) - lengths])
    n = sizes[symbols]
    ends = np.cumsum(n, dtype=np.int64)
    return table[np.repeat(begins[symbols] - ends + n, n) + np.arange(int(ends[-1]))]


def to_bytes(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """A shard's file; all ids must be below ``vocabulary``."""
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is not below {vocabulary}")
    symbols, pairs, lengths = compress(ids, vocabulary)
    head = HEAD.pack(MAGIC, 1, vocabulary, len(pairs), len(symbols), len(counts), len(ids))
    return b"".join([head, pairs.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.tobytes(), counts.astype("<u4").tobytes()])


class Shard:
    """A shard's file, opened for decoding."""

    def __init__(self, data: bytes):
        magic, version, self.vocabulary, rules, symbols, docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = HEAD.size
        self.pairs = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2)
        self.lengths = np.frombuffer(data, "<u4", rules, at := at + 8 * rules)
        kind = np.dtype("<u2" if self.vocabulary < 1 << 16 else "<u4")
        self.symbols = np.frombuffer(data, kind, symbols, at := at + 4 * rules)
        self.counts = np.frombuffer(data, "<u4", docs, at + kind.itemsize * symbols)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.pairs, self.lengths, self.vocabulary)

    def stretch(self, start: int, length: int) -> np.ndarray:
        """The ids ``start`` to ``start + length``, expanding only the symbols that hold them."""
        s = self.symbols.astype(np.int64)
        n = np.ones(len(s), np.int64)
        rule = s >= self.vocabulary
        n[rule] = self.lengths[s[rule] - self.vocabulary]
        ends = np.cumsum(n)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, min(start + length, self.n_ids), side="left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return unfold(self.symbols[a:b], self.pairs, self.vocabulary)[skip : skip + length]

    def document(self, row: int) -> np.ndarray:
        return self.stretch(int(self.counts[:row].sum()), int(self.counts[row]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents, in ascending ``doc_id`` order, as shards below ``path``.

    Texts are dealt by ranges of ``doc_id`` and sorted, then encoded and
    compressed where they lie; each task's shards are rows of a Parquet file
    written by Spark, so a lost task is simply run again.  A null text has its
    end id only; null doc_ids come first; rows with equal doc_ids follow each
    other in the order of their texts.  An empty table has no shards.  The
    files' symbol space begins behind the tokenizer's ids and the end id.
    """

    vocabulary = max(vocabulary_of(tokenizer), end_id + 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq = before = size = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        counts: list[int] = []

        def flush() -> pa.RecordBatch:
            blob = to_bytes(np.concatenate(ids), np.array(counts), vocabulary)
            row = {"part": part, "seq": seq, "before": before, "n_docs": len(names), "n_tokens": size, "doc_ids": names, "payload": blob}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for first, texts in slices(batch, "text", RUN_CHARS):
                found, n = tok.encode(texts)
                found = np.insert(found, np.cumsum(n), np.uint32(end_id))
                ends = np.cumsum(n + 1)
                own = batch.column(0)[first : first + len(texts)].to_pylist()
                row = at = 0
                while row < len(texts):
                    # The documents up to the one that fills the shard.
                    last = min(len(texts), int(np.searchsorted(ends, at + shard_ids - size)) + 1)
                    ids.append(found[at : ends[last - 1]])
                    counts += (n[row:last] + 1).tolist()
                    names += own[row:last]
                    size += len(ids[-1])
                    row, at = last, int(ends[last - 1])
                    if size >= shard_ids:
                        yield flush()
                        seq, before, size = seq + 1, before + size, 0
                        ids, names, counts = [], [], []
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(rows, shards, SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below ``path``: its place among all ids, its count and the ids' crc32.

    Only the parts' totals (a row for each partition written) come to the
    driver, to turn places within a part into places among all ids.
    """
    table = spark.read.schema(SHARDS).parquet(path)
    total, offsets = 0, {}
    for r in sorted(table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        offsets[r.part], total = total, total + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "payload")}
                shard = Shard(one["payload"])
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.counts.astype(np.int64))
                starts = ends - shard.counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = offsets[one["part"]] + one["before"]
                yield pa.RecordBatch.from_arrays([pa.array(one["doc_ids"], pa.int64()), pa.array(starts + base), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(table.select("part", "before", "doc_ids", "payload"), decode, DECODED)


def store_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the ids to the shared folder and reads them back."""
    path = shared_folder(docs.sparkSession)
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
