"""op3: held-out accuracy, calibration and odd rows."""

import zlib

import numpy as np
import pytest

from ocellus.llm import quality_model as Q

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.fit(docs, labels)


def test_held_out_accuracy(spark, model):
    docs, labels, m = model
    rows = Q.score(docs, m).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    p, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert abs(p.mean() - y.mean()) < 0.08


def test_held_out_labels_do_not_matter(spark, model):
    docs, labels, m = model
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    assert np.allclose(Q.fit(docs, flipped).network.w1, m.network.w1)


def test_odd_rows(spark, model):
    m = model[2]
    rows = [(1, None, "n"), (2, "", "n"), (None, "Some plain words here.", "n"), (3, "   \n\t", "n"), (4, "word " * 200_000, "n"), (4, "word " * 200_000, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = Q.score(frame, m).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert Q.keep_good(frame, m).columns == frame.columns
    assert Q.score(frame.limit(0), m).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    m = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert len(Q.score(docs, m).collect()) == 2


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8))
    y = (rng.random(1500) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = Q.train(x, y)
    held = np.arange(1500) % 5 == 4
    assert Q._loss(net.logits(x[held]) / net.temperature, y[held]) <= Q._loss(net.logits(x[held]), y[held]) + 1e-9
