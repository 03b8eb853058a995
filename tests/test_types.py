import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ocellus.types import Box2d, Box3d, Image, Mask, NDArray, Point, Segment, YouTubeVideo, png, rle
from ocellus.types.video import sample
from ocellus.types.views import plain, to_tensor


def test_box_arithmetic():
    b = Box2d(1, 2, 3, 4)
    assert b / 2 == Box2d(0.5, 1, 1.5, 2) and b * 2 == Box2d(2, 4, 6, 8)
    assert b / (2, 4) == Box2d(0.5, 0.5, 1.5, 1) and b * (10, 7.5) == Box2d(10, 15, 30, 30)
    assert (b.width, b.height, b.area, len(b), list(b)) == (2, 2, 4, 4, [1, 2, 3, 4])
    assert Box2d.from_center(1.5, 2.5, 1, 1) == Box2d(1, 2, 2, 3) and Box2d.from_top_left(1, 2, 3, 4) == Box2d(1, 2, 4, 6)
    for bad in [(-1, 0, 1, 1), (2, 0, 1, 1), (0, 3, 1, 2)]:
        with pytest.raises(ValueError):
            Box2d(*bad)
    with pytest.raises(ValueError):
        Box2d.from_center(0, 0, 2, 2)
    with pytest.raises(ValueError):
        b / 0


def test_box_overlap():
    a, b, big = Box2d(0, 0, 20, 20), Box2d(10, 10, 30, 30), Box2d(0, 0, 100, 100)
    assert (a & b).area == 100 and b & big == b
    assert not Box2d(0, 0, 10, 10).overlaps(Box2d(10, 10, 20, 20)) and not Box2d(5, 10, 15, 20).overlaps(Box2d(5, 0, 15, 10))
    # Overlapping in one axis from either side, and not square.
    assert Box2d(0, 5, 10, 8) & Box2d(2, 0, 4, 6) == Box2d(2, 5, 4, 6)
    assert np.allclose(a.iou([b, Box2d(15, 15, 35, 35)]), [1 / 7, 25 / 775]) and a.iou([]).size == 0
    m = Box2d.ious([Box2d(0, 0, 10, 10), a], [Box2d(5, 5, 10, 10), Box2d(10, 10, 20, 20)])
    assert np.allclose(m, [[0.25, 0], [0.0625, 0.25]])
    assert Box2d.ious([], [a]) is None and np.isnan(Box2d(1, 1, 1, 1).iou(Box2d(1, 1, 1, 1)))
    with pytest.raises(ValueError):
        a.iou(7)


def test_rle_fixtures():
    assert rle.encode([0, 0, 0, 1, 1, 0, 0]) == [3, 2, 2]
    assert rle.encode([[0, 0, 0, 1, 1], [1, 0, 0, 1, 0]]) == [3, 3, 2, 1, 1]
    assert rle.encode([1, 1, 0, 0]) == [0, 2, 2] and rle.encode([]) == []
    assert not rle.decode([10000], (100, 100)).any() and rle.decode([0, 10000], (100, 100)).all()
    with pytest.raises(ValueError):
        rle.decode([3], (2, 2))


@given(st.lists(st.lists(st.booleans(), min_size=3, max_size=3), min_size=1, max_size=8))
def test_rle_round_trip(rows):
    m = np.array(rows)
    assert np.array_equal(rle.decode(rle.encode(m), m.shape), m)
    assert np.array_equal(rle.decode(rle.encode(m.T), m.shape, "F"), m)


def test_masks():
    square = Mask.from_polygon([[1, 1, 5, 1, 5, 5, 1, 5]], 10, 8)
    assert square.to_mask().sum() == 16 and square.iou(square) == 1
    m = Mask.from_mask(square.to_mask())
    assert np.array_equal(m.to_mask(), square.to_mask()) and m.to_dict()["height"] == 10
    coco = Mask.from_coco_rle(rle.encode(square.to_mask().T), 10, 8)
    assert np.array_equal(coco.to_mask(), square.to_mask())
    assert Mask.from_rle([4], 2, 2).iou(Mask.from_rle([4], 2, 2)) == 0
    with pytest.raises(ValueError):
        Mask(1, 2, 2)


def test_segments_and_sampling():
    assert Segment(0, 10) and Segment(15, -1)
    for bad in [(-1, 2), (5, 0)]:
        with pytest.raises(ValueError):
            Segment(*bad)
    assert list(sample(range(30), 3, 5, 3)) == [3, 8, 13] and list(sample(range(5), 0, 2)) == [0, 2, 4] and list(sample(range(5), most=0)) == []
    assert YouTubeVideo.pick([(360, "a"), (1080, "b")]) == "a" and YouTubeVideo.pick([(360, "a"), (1080, "b")], "best") == "b"


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (4, 4, 4), (3, 2, 2)])
def test_png_and_images(shape, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert np.array_equal(png.decode(png.encode(pixels)), pixels)
    stored = Image.from_array(pixels, f"{tmp_path}/x.png")
    assert np.array_equal(stored.to_numpy(), pixels) and stored.to_embedded().is_embedded
    (cut,) = stored.crop(Box2d(0, 1, 2, 3))
    assert np.array_equal(cut.to_numpy(), pixels[1:3, 0:2])
    assert (stored * 2).to_numpy().shape[:2] == (2 * shape[0], 2 * shape[1])


def test_png_filters():
    """Every filter type, against a plain decoder's definition."""
    import struct
    import zlib

    pixels = np.random.default_rng(1).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    raw, before = b"", np.zeros((6, 3), int)
    for kind, row in enumerate(pixels.astype(int)):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        p = left + before - corner
        pa, pb, pc = abs(p - left), abs(p - before), abs(p - corner)
        guess = [0, left, before, (left + before) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, before, corner))][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    data = png.MAGIC + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(raw)) + png._chunk(b"IEND", b"")
    assert np.array_equal(png.decode(data), pixels)


def test_equality_and_plain():
    assert Image(uri="/a/b.png") == Image(uri="file:///a/b.png") and Image(data=b"1") != Image(data=b"2")
    with pytest.raises(ValueError):
        Image()
    a = np.arange(6, dtype=np.int64).reshape(2, 3)
    assert np.array_equal(NDArray.of(a).to_numpy(), a)
    b = Box3d(Point(1, 2, 3), 1, 2, 3, 0.5)
    assert plain({"x": [b, a]})["x"][0]["center"]["z"] == 3
    assert to_tensor({"b": Box2d(0, 0, 1, 1), "n": [1, 2]})["b"].tolist() == [0, 0, 1, 1]


def test_crops_are_dealt_over_tasks(spark):
    """A small file of rows that Python works on is more than one task."""
    from ocellus.plans import files

    assert files.f12_crop(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
