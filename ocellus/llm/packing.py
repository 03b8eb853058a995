"""Packing of documents into training sequences.

First-fit decreasing with a tournament tree of bin capacities, run
independently in randomised groups of pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import map_batches, slices, written
from ocellus.llm.tokens import RUN_CHARS, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces of a group on average; a group is packed by one task.
GROUP_PIECES = 16_384


class TournamentTree:
    """Free space of bins; finds the first bin with room for a size in O(log bins).

    Each inner node holds the larger free space of its two children, so the
    winner path to the leftmost sufficient leaf is found from the root.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room: the bin and the offset in it."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        leaf, offset = node - self.leaves, self.capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return leaf, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths[order] >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(max(1, len(lengths) - full), capacity)
    for i in order[full:].tolist():
        b, offsets[i] = tree.place(int(lengths[i]))
        bins[i] = full + b
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece of each document, cut at multiples of ``capacity`` from its start.

    A null or empty text has its end id only; a null ``doc_id`` stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        for batch in batches:
            for first, texts in slices(batch, "text", RUN_CHARS):
                ids, counts = tok.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                begins = np.cumsum(counts) - counts
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(texts)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = begins[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                doc = batch.column(0).slice(first, len(texts)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])], names=[c.split()[0] for c in PIECES.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Each piece with its sequence and its offset there.

    Pieces are written once, counted, and dealt to groups by a hash of
    (doc_id, start, crc32), so a group is a random sample of the corpus
    whatever the order of the files, and its size does not depend on any
    document's length or any id's frequency.  Each group is packed by
    first-fit decreasing; sequences of different groups never mix.  Repeated
    rows are packed once each; an empty table has no sequences.
    """
    found = written(pieces(docs, tokenizer, end_id, capacity))
    groups = max(1, math.ceil(found.count() / group_pieces))

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        columns = [*(rows[c.split()[0]] for c in PIECES.split(", ")), pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)]
        return pa.table(columns, names=[c.split()[0] for c in PACKED.split(", ")])

    # A repeated row has the same hash: its copies go round the groups by a number of their own.
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return found.withColumn("_ocellus_group", spread).groupBy("_ocellus_group").applyInArrow(packed, PACKED)
