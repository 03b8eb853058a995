"""Quality classifier: random-indexing word vectors and a two-layer network.

Words are letter runs as they stand, numbers and runs of other characters.
Every word has a sparse random index vector, found from its hash; its context
vector is the sum of the index vectors of the words within two places of it,
over all documents.  Vectors are kept in ``ROWS`` hashed rows, so memory stays
bounded for a vocabulary of any size; words that share a row share a vector,
which the more frequent one dominates.  A document is the mean of its words'
vectors, weighted against frequent words.  The network is trained with numpy
on at most ``SAMPLE`` labelled documents, and a temperature fitted on a part
of them held back makes its probabilities calibrated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import hash_sample, map_batches, slices

ROWS = 1 << 17
DIMENSIONS = 32
NONZERO = 4
REACH = 2
SAMPLE = 6000
THRESHOLD = 0.3
#: Tables of counts for each executor core that Spark adds up: more make smaller tasks, fewer a smaller shuffle.
TABLES_PER_CORE = 4
#: Words whose vectors are summed at once.
RUN_WORDS = 1 << 16
#: What stands between letter runs.
_BETWEEN = r"(\pN+|[^\s\pL\pN]+)"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the texts' words in order, and the count of each text."""
    spaced = pc.replace_substring_regex(pa.array(texts, pa.string()), _BETWEEN, r" \1 ")
    words = pc.utf8_split_whitespace(spaced)
    coded = pc.list_flatten(words).dictionary_encode()
    # White space at the ends of a text makes empty words.
    rows = np.array([zlib.crc32(w.encode()) % ROWS if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
    rows = rows[coded.indices.to_numpy()]
    held = np.concatenate([[0], np.cumsum(rows >= 0)])[words.offsets.to_numpy()]
    return rows[rows >= 0], np.diff(held)


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's sparse random vector: the places that are not 0 and the signs there."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (ROWS, NONZERO)), rng.choice(np.array([-1, 1], np.int64), (ROWS, NONZERO))


@dataclass
class WordVectors:
    """A unit vector and a weight for each row."""

    vectors: np.ndarray
    weights: np.ndarray

    def pool(self, texts: list[str]) -> np.ndarray:
        """Weighted mean of each text's word vectors; zeros for a text without words."""
        rows, counts = words_of(texts)
        out, total = np.zeros((len(texts), self.vectors.shape[1])), np.zeros(len(texts))
        of = np.repeat(np.arange(len(texts)), counts)
        for first in range(0, len(rows), RUN_WORDS):
            r, text = rows[first : first + RUN_WORDS], of[first : first + RUN_WORDS]
            begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            w = self.weights[r].astype(np.float64)
            out[text[begins]] += np.add.reduceat(self.vectors[r].astype(np.float64) * w[:, None], begins)
            total[text[begins]] += np.add.reduceat(w, begins)
        return out / np.maximum(total, 1e-12)[:, None]


def word_vectors(docs: DataFrame) -> WordVectors:
    """Context vectors over all documents.

    Each task sums the index vectors that stand near each row in a fixed table
    and returns one record for each row met; Spark adds them up.  There are
    ``TABLES_PER_CORE`` tasks a core at most, so the tables' shuffle does not
    grow with the corpus.  The driver gets at most ``ROWS`` records.
    """
    names = ["row", "n", *[f"d{i}" for i in range(DIMENSIONS)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        context, n = np.zeros(ROWS * DIMENSIONS, np.int64), np.zeros(ROWS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                rows, counts = words_of(texts)
                of = np.repeat(np.arange(len(texts)), counts)
                n += np.bincount(rows, minlength=ROWS)
                for step in range(1, REACH + 1):
                    near = of[step:] == of[:-step]
                    a, b = rows[:-step][near], rows[step:][near]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            np.add.at(context, x * DIMENSIONS + places[y, k], signs[y, k])
        met = np.flatnonzero(n)
        for first in range(0, len(met), 8192):
            some = met[first : first + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], *np.ascontiguousarray(context.reshape(ROWS, DIMENSIONS)[some].T))], names=names)

    tasks = TABLES_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    parts = map_batches(docs.select(F.col("text").cast("string")).coalesce(tasks), count, ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    at = found.column(0).to_numpy()
    vectors, n = np.zeros((ROWS, DIMENSIONS)), np.zeros(ROWS)
    n[at] = found.column(1).to_numpy()
    for i in range(DIMENSIONS):
        vectors[at, i] = found.column(i + 2).to_numpy()
    # A word without neighbours keeps its own direction.
    places, signs = index_vectors()
    own = np.sqrt(np.maximum(n, 1))
    for k in range(NONZERO):
        np.add.at(vectors, (np.arange(ROWS), places[:, k]), signs[:, k] * own)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    share = n / max(n.sum(), 1)
    return WordVectors(vectors.astype(np.float32), (1e-2 / (1e-2 + share)).astype(np.float32))


@dataclass
class Network:
    """Two layers; its logits are divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the cross entropy; every fifth row is held back for the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    a, b = x[~held], y[~held]
    net = Network(a.mean(0) if len(a) else np.zeros(x.shape[1]), (a.std(0) if len(a) else np.zeros(x.shape[1])) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    if not len(b):
        return net
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (a - net.mean) / net.scale
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(b)), max(1, len(b) // 128)):
            hid = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3][0], -40, 40))) - b[at]) / len(at)
            back = np.outer(d, p[2]) * (1 - hid**2)
            grads = [z[at].T @ back + decay * p[0], back.sum(0), hid.T @ d + decay * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(p[3][0])
    if held.any():
        logits = net.logits(x[held])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda k: _loss(logits / k, y[held])))
    return net


@dataclass
class QualityModel:
    words: WordVectors
    network: Network

    def score(self, texts: list[str]) -> np.ndarray:
        # Rounded, so that a text's score does not depend on the texts scored with it.
        return np.round(self.network.probability(self.words.pool(texts)), 12) if texts else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learnt from: crc32(doc_id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Word vectors of all documents and a network fitted to at most ``sample`` labelled ones.

    The sample has the labelled doc_ids with the smallest hashes, without
    those held out; a doc_id with several labels counts as the lowest.
    """
    words = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(words)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hash_sample(known, ["doc_id"], sample, known.count())

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "text"):
                v = sent.value.pool(texts).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(v, pa.list_(pa.float64()))], names=["doc_id", "quality", "v"])

    # At most `sample` rows of two numbers: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    got = sorted(map_batches(rows, pooled, "doc_id long, quality int, v array<double>").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    x = np.array([r.v for r in got], np.float64).reshape(len(got), DIMENSIONS)
    return QualityModel(words, train(x, np.array([r.quality for r in got], np.float64)))


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: held_out, score and predicted.

    A null text is empty; an empty text has the score of the zero vector.
    Each row gives one row; null doc_ids stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch, "text"):
                p = sent.value.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scored, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``; all columns stay.

    Null and empty texts have the score of a text without words; repeated rows
    are judged alike; null doc_ids stay; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([sent.value.score(texts) for _, texts in slices(batch, "text")] or [np.zeros(0)])
            yield batch.filter(pa.array(p >= threshold))

    return map_batches(docs, keep, docs.schema)
