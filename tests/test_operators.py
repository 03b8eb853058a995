import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.operators import boxes, detections, frames, masks
from ocellus.types import BOX2D, Box2d, Mask, rle


def rows(spark, pairs):
    real = lambda b: None if b is None else tuple(map(float, b))
    return spark.createDataFrame([(i, real(a), real(b)) for i, (a, b) in enumerate(pairs)], f"id int, a {BOX2D.simpleString()}, b {BOX2D.simpleString()}")


PAIRS = [((0, 0, 20, 20), (10, 10, 30, 30)), ((0, 5, 10, 8), (2, 0, 4, 6)), ((0, 0, 10, 10), (10, 10, 20, 20)), ((1, 1, 1, 1), (1, 1, 1, 1)), (None, (0, 0, 1, 1)), ((0, 0, 1, 1), None)]


def test_iou_and_intersection(spark):
    got = rows(spark, PAIRS).select("id", boxes.iou(F.col("a"), F.col("b")).alias("iou"), boxes.intersect(F.col("a"), F.col("b")).alias("i"), boxes.overlaps(F.col("a"), F.col("b")).alias("o"), boxes.area(F.col("a")).alias("area")).orderBy("id").collect()
    assert math.isclose(got[0].iou, 1 / 7) and tuple(got[0].i) == (10, 10, 20, 20)
    assert tuple(got[1].i) == (2, 5, 4, 6) and got[1].o
    assert (got[2].iou, got[2].i, got[2].o) == (0, None, False)
    assert math.isnan(got[3].iou)
    assert [got[i].iou for i in (4, 5)] == [None, None] and got[4].area is None


def test_iou_stays_in_generated_code(spark):
    plan = rows(spark, PAIRS).select(boxes.iou(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_random_boxes_match_the_view(spark):
    r = np.random.default_rng(4)
    made = [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in r.integers(0, 20, (80, 4))]
    pairs = list(zip(made[:40], made[40:], strict=True))
    got = rows(spark, pairs).select("id", boxes.iou(F.col("a"), F.col("b")).alias("iou")).orderBy("id").collect()
    for g, (a, b) in zip(got, pairs, strict=True):
        want = Box2d(*a).iou(Box2d(*b))
        assert (math.isnan(want) and math.isnan(g.iou)) or math.isclose(g.iou, want)


def test_constructors(spark):
    v = spark.createDataFrame([([1.0, 2.0, 2.0, 3.0],), (None,)], "v array<double>")
    got = v.select(boxes.area(boxes.box2d(F.col("v"))).alias("a"), boxes.area(boxes.box2d_from_top_left(F.col("v"))).alias("t")).collect()
    assert [tuple(r) for r in got] == [(1, 6), (None, None)]
    for bad in ([3.0, 0.0, 1.0, 1.0], [-1.0, 0.0, 1.0, 1.0], [1.0]):
        with pytest.raises(Exception, match="not a box"):
            spark.createDataFrame([(bad,)], "v array<double>").select(boxes.box2d(F.col("v")).alias("b")).collect()
    with pytest.raises(Exception, match="not a box"):
        spark.createDataFrame([([0.0, 0.0, 2.0, 2.0],)], "v array<double>").select(boxes.box2d_from_center(F.col("v")).alias("b")).collect()


def test_scaling_errors(spark):
    with pytest.raises(Exception, match="positive"):
        rows(spark, PAIRS[:1]).select(boxes.scale(F.col("a"), 0.0)).collect()


def test_rle(spark):
    r = np.random.default_rng(0)
    arrays = [[0, 0, 0, 1, 1, 0, 0], [1, 1, 0, 0], [1], [0], [], None] + [r.integers(0, 2, int(n)).tolist() for n in r.integers(1, 60, 20)]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id int, bits array<int>")
    got = frame.select("id", masks.rle_encode(F.col("bits")).alias("e")).withColumn("d", masks.rle_decode(F.col("e"))).orderBy("id").collect()
    for g, a in zip(got, arrays, strict=True):
        assert (g.e, g.d) == ((None, None) if a is None else (rle.encode(a), a))


def test_masks(spark):
    poly = [[1.0, 1.0, 5.0, 1.0, 5.0, 5.0, 1.0, 5.0]]
    frame = spark.createDataFrame([(poly, [2, 3, 1])], "p array<array<double>>, c array<int>")
    made = frame.select(masks.mask_from_polygon(F.col("p"), F.lit(10), F.lit(8)).alias("p"), masks.mask_from_rle(F.col("c"), F.lit(2), F.lit(3)).alias("r"), masks.mask_from_coco_rle(F.col("c"), F.lit(2), F.lit(3)).alias("k"))
    got = made.select(masks.rasterize(F.col("p")).alias("poly"), masks.rasterize(F.col("r")).alias("runs"), masks.to_mask(F.col("k")).alias("columns"), masks.mask_iou(F.col("r"), F.col("k")).alias("iou")).first()
    assert got.poly == Mask.from_polygon(poly, 10, 8).to_mask().reshape(-1).tolist()
    a, b = Mask.from_rle([2, 3, 1], 2, 3), Mask.from_coco_rle([2, 3, 1], 2, 3)
    assert got.runs == a.to_mask().reshape(-1).tolist() and got.columns == b.to_mask().reshape(-1).tolist()
    assert math.isclose(got.iou, a.iou(b))


def test_sampled_frames(spark):
    seg = lambda a, b: frames.segment(F.lit(a), F.lit(b))
    one = spark.range(1)
    get = lambda s, n, rate, most: one.select(frames.sampled_frames(s, F.lit(n), rate, most)).first()[0]
    assert get(seg(0, 20), 300, 2, 10) == list(range(0, 20, 2))
    assert get(seg(0, 20), 300, 2, 100) == list(range(0, 40, 2))
    assert get(seg(5, -1), 12, 3, -1) == [5, 8, 11] and get(seg(20, -1), 12, 3, -1) == [] and get(seg(5, 5), 12, 1, 7) == []
    with pytest.raises(Exception, match="not a segment"):
        one.select(seg(5, 0)).collect()


def test_probe(spark):
    good = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":640,"height":360,"nb_frames":"300","duration":"10.01","bit_rate":"415543","avg_frame_rate":"30000/1001"}],"format":{"size":"736613"}}'
    bad = ['{"streams":[{"codec_type":"audio"}]}', '{"streams":[{"codec_type":"video","avg_frame_rate":"0/0"}]}', "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [good, *bad]], "p string").select(frames.metadata_of_probe(F.col("p"))).collect()]
    assert tuple(got[0])[:8] == (640, 360, 300, pytest.approx(10.01), 415543, 30, "h264", 736613) and got[0]["_errors"] is None
    assert "stream" in got[1]["_errors"].message and "denominator" in got[2]["_errors"].message and got[3]["_errors"] is not None and got[4] is None


def test_detections(spark):
    box = lambda *v: dict(zip(boxes.NAMES, map(float, v), strict=True))
    found = [{"box": box(0, 0, 10, 10), "score": 0.9, "label_id": 1, "label": None}, {"box": box(1, 1, 10, 10), "score": 0.8, "label_id": 1, "label": None}, {"box": box(1, 1, 10, 10), "score": 0.3, "label_id": 2, "label": None}]
    frame = spark.createDataFrame([(1, found), (2, []), (3, None)], f"id int, d {detections.DETECTIONS}")
    got = {r.id: r for r in frame.select("id", detections.keep_scores(F.col("d")).alias("k"), detections.non_maximum_suppression(F.col("d")).alias("n")).collect()}
    assert len(got[1].k) == 2 and [d.score for d in got[1].n] == [pytest.approx(0.9), pytest.approx(0.3)] and got[2].n == [] and got[3].n is None
    c = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>").select(detections.classify(F.col("x"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("c")).first().c
    assert (c.label_id, c.label) == (1, "b") and math.isclose(c.score, math.exp(3) / (2 * math.exp(3) + math.e), rel_tol=1e-5)


def test_class_scores():
    logits = np.log(np.array([[0.1, 0.7, 0.2], [0.1, 0.6, 0.3], [0.8, 0.1, 0.1], [0.3, 0.2, 0.5]]))
    at = np.array([[0, 0, 10, 10], [0, 0, 10, 9], [50, 50, 60, 60], [30, 30, 40, 40]], float)
    got = detections.class_scores(at, logits, threshold=0.25, candidates=5, most_common=0.5, detections=10, classes=1, least=0.3)
    assert [g["label_ids"] for g in got] == [[1], [2], [1]] and got[0]["scores"][0] == pytest.approx(0.7)


def test_suppression_of_many_groups_is_that_of_each(spark):
    """Arrays of all sizes, with ties, empty boxes, null labels and null scores, against the plain loop."""
    r = np.random.default_rng(3)
    data, want = [], {}
    for i in range(120):
        n = int(r.integers(0, 12)) if i else 400
        low, side = r.integers(0, 12, (n, 2)), r.integers(0, 9, (n, 2))
        at, score, label = np.hstack([low, low + side]).astype(float), r.integers(0, 4, n) / 4, r.integers(0, 3, n)
        data.append((i, [(tuple(map(float, b)), None if s == 0 else float(s), None if c == 2 else int(c), str(k)) for k, (b, s, c) in enumerate(zip(at, score, label, strict=True))]))
        want[i] = [str(k) for k in detections.suppressed(at, np.where(score == 0, np.nan, score), label, 0.3)]
    frame = spark.createDataFrame([*data, (-1, None)], f"id int, d {detections.DETECTIONS}")
    for most in (None, 3):
        got = {x.id: x.n and [d.label for d in x.n] for x in frame.select("id", detections.non_maximum_suppression(F.col("d"), 0.3, most).alias("n")).collect()}
        assert got.pop(-1) is None and {i: x or [] for i, x in got.items()} == {i: x[:most] for i, x in want.items()}


def test_a_probe_is_parsed_once(spark):
    """In one plan for all fields; the query deals a small file's rows out."""
    from ocellus.plans import queries as plans

    m = spark.createDataFrame([("{}",)], "p string").select(frames.metadata_of_probe(F.col("p")).alias("m")).select("m.width", "m.frame_rate", "m._errors.message")
    assert m._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert plans.f14_video_metadata(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
