import json
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.conf import get_option, option_context, set_option
from ocellus.errors import ColumnNotFoundError
from ocellus.functions import io, register_functions
from ocellus.sources import Dataset, coco, loaders, messages, read_dataset, write_dataset, write_pandas
from ocellus.sources import resolver as R
from ocellus.sources import uri as U
from ocellus.sources.dataset import save_as_table, sharded
from ocellus.types import BOX2D, IMAGE, MASK, NDARRAY, Box2d, Image, Mask, NDArray


def test_dataset_round_trip(spark, tmp_path):
    path = f"{tmp_path}/d"
    rows = [(1, [(Box2d(0, 0, 1, 2).to_dict(),)], NDArray.of(np.eye(2)).to_dict()), (2, None, NDArray.of(np.ones(3, np.int8)).to_dict())]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("boxes", T.ArrayType(T.StructType([T.StructField("b", BOX2D)]))), T.StructField("n", NDARRAY)])
    write_dataset(spark.createDataFrame(rows, schema), path, metadata1=1, flag=True)
    data = Dataset(path)
    assert data.metadata == {"options": {"metadata1": "1", "flag": "true"}} and len(data) == 2
    got = sorted(data, key=lambda r: r["id"])
    assert got[0]["boxes"] == [{"b": Box2d(0, 0, 1, 2)}] and np.array_equal(got[0]["n"], np.eye(2)) and got[1]["boxes"] is None
    assert read_dataset(spark, path, ["id"]).columns == ["id"]
    for f in (lambda: read_dataset(spark, path, ["x"]), lambda: Dataset(path, ["x"])):
        with pytest.raises(ColumnNotFoundError):
            f()
    assert data.to_pandas(1).shape == (1, 3) and data.to_pandas().shape == (2, 3)


def test_offset_and_shards(spark, tmp_path):
    path = f"{tmp_path}/d"
    write_dataset(spark.range(5000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartitionByRange(3, "id").sortWithinPartitions("id"), path, block_size=16 * 1024)
    every = [r["id"] for r in Dataset(path)]
    for offset in (0, 10, 1700, 4999, 5000, 9000):
        assert [r["id"] for r in Dataset(path, offset=offset)] == every[offset:]
    parts = [[r["id"] for r in Dataset(path, offset=10, rank=k, world_size=3)] for k in range(3)]
    assert sorted(sum(parts, [])) == sorted(every[10:]) and all(parts)
    assert sorted(r.id for r in sharded(spark, path, 1, 3, 10).collect()) == sorted(parts[1])
    narrow = sharded(spark, path, 1, 3, 10, columns=["id"])
    assert narrow.columns == ["id"] and sorted(r.id for r in narrow.collect()) == sorted(parts[1])
    with pytest.raises(Exception, match="nothing"):
        sharded(spark, path, 0, 1, columns=["nothing"])
    with pytest.raises(ValueError):
        Dataset(path, offset=-1)


def test_partitions_tables_and_modes(spark, tmp_path):
    path = f"{tmp_path}/p"
    frame = pd.DataFrame({"id": [1, 2], "image": [Image(uri="/a.png"), Image(data=b"x")], "mask": [Mask.from_rle([1, 2, 3], 2, 3), None], "split": ["train", "val"]})
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("image", IMAGE), T.StructField("mask", MASK), T.StructField("split", T.StringType())])
    write_pandas(spark, frame, path, schema, partition_by=["split"])
    with pytest.raises(Exception, match="exists"):
        write_pandas(spark, frame, path, schema, partition_by=["split"])
    write_pandas(spark, frame[:1], path, schema, partition_by=["split"], mode="delete_matching")
    assert sorted((r.id, r.split) for r in read_dataset(spark, path).collect()) == [(1, "train"), (2, "val")]
    write_pandas(spark, frame[:1], path, schema, partition_by=["split"], mode="overwrite_or_ignore")
    assert read_dataset(spark, path).count() == 3
    with pytest.raises(ValueError):
        write_pandas(spark, frame, path, schema, mode="x")
    save_as_table(spark.range(3), "ocellus_saved")
    assert spark.table("ocellus_saved").count() == 3


def test_resolvers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Dataset(f"{tmp_path}/none")
    (tmp_path / "empty").mkdir()
    assert list(Dataset(f"{tmp_path}/empty")) == []
    pd.DataFrame({"a": [1]}).to_parquet(f"{tmp_path}/empty/x.parquet")
    with pytest.raises(ValueError):
        Dataset(f"{tmp_path}/empty")

    class Other(R.FolderResolver):
        def resolve(self, uri):
            return super().resolve(str(tmp_path / "real"))

        def schema(self, uri):
            return super().schema(str(tmp_path / "real"))

    write_dataset(spark.range(4), f"{tmp_path}/real")
    R.register("other", Other())
    try:
        with pytest.raises(KeyError):
            R.register("other", Other())
        assert len(list(Dataset("other://x"))) == 4
    finally:
        R.unregister("other")


def test_uris(spark, tmp_path):
    assert U.normalize("s3a://b/c") == "s3://b/c" and U.normalize("/x") == "file:///x" and U.same_uri("/x", "file:///x")
    a = f"{tmp_path}/a.txt"
    U.write_bytes(a, b"hi")
    assert U.copy(a, f"{tmp_path}/to/") == f"file://{tmp_path}/to/a.txt" and U.read_bytes(f"{tmp_path}/to/a.txt") == b"hi"
    assert U.exists(a) and not U.exists(a + "x")
    register_functions(spark)
    got = spark.createDataFrame([(a,), (None,)], "s string").select(F.expr(f"copy(s, '{tmp_path}/f/')").alias("c")).collect()
    assert [r.c for r in got] == [f"file://{tmp_path}/f/a.txt", None]


def test_image_functions(spark, tmp_path):
    register_functions(spark)
    pixels = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    frame = spark.createDataFrame([(NDArray.of(pixels).to_dict(),)], T.StructType([T.StructField("n", NDARRAY)]))
    got = frame.select(F.expr(f"numpy_to_image(n, '{tmp_path}/i.png', 'PNG')").alias("i"), io.numpy_to_image("n", F.lit(None), F.lit(None)).alias("e"))
    got = got.select("*", F.expr("crop(e, array(named_struct('xmin', 1D, 'ymin', 0D, 'xmax', 3D, 'ymax', 2D)))").alias("c"), F.expr(f"image_copy(e, '{tmp_path}/j.png')").alias("j")).first()
    assert np.array_equal(Image(uri=got.i.uri).to_numpy(), pixels) and np.array_equal(Image(data=bytes(got.c[0].data)).to_numpy(), pixels[0:2, 1:3])
    assert np.array_equal(Image(uri=got.j.uri).to_numpy(), pixels)
    meta = spark.createDataFrame([("/no/such.mp4",)], "u string").select(io.video_metadata(F.col("u")).alias("m")).first().m
    assert meta["_errors"].message.startswith("ffprobe error")


def test_sql_functions(spark):
    register_functions(spark)
    one = spark.sql("SELECT area(box2d(array(1D, 2D, 3D, 4D))) a, iou(box2d(array(0D,0D,20D,20D)), box2d(array(10D,10D,30D,30D))) i, area(NULL) n, image(NULL) m, to_image('x').uri u, size(rle_decode(array(2, 3))) r").first()
    assert one.a == 4 and abs(one.i - 1 / 7) < 1e-12 and one.n is None and one.m is None and one.u == "x" and one.r == 5
    for bad in ("area(123)", "area('x')"):
        with pytest.raises(Exception, match="MISMATCH|CAST"):
            spark.sql(f"SELECT {bad}").collect()


def test_coco(spark, tmp_path):
    data = {
        "images": [{"id": 1, "width": 100, "height": 50, "file_name": "a.jpg", "date_captured": "x"}, {"id": 2, "width": 10, "height": 10, "file_name": "b.jpg", "date_captured": "x"}],
        "annotations": [
            {"id": 7, "image_id": 1, "category_id": 3, "area": 9.0, "iscrowd": 0, "bbox": [10, 10, 20, 20], "segmentation": [[1, 1, 5, 5, 10, 10]]},
            {"id": 6, "image_id": 1, "category_id": 3, "area": 4.0, "iscrowd": 1, "bbox": [0, 0, 100, 50], "segmentation": {"counts": [0, 10], "size": [50, 100]}},
        ],
        "categories": [{"id": 3, "name": "cat", "supercategory": "animal"}],
    }
    for split in ("train", "val"):
        U.write_bytes(f"{tmp_path}/annotations/instances_{split}2017.json", json.dumps(data).encode())
    ins = coco.read_instances(spark, f"{tmp_path}/annotations/instances_train2017.json")
    ann = {r.ann_id: r for r in coco.annotations(ins).collect()}
    assert ann[7].label == "cat" and ann[7].segmentation.type == 1 and ann[6].segmentation.rle == [0, 10] and tuple(ann[7].bbox) == (10, 10, 30, 30)
    got = coco.convert(spark, str(tmp_path), limit=5).collect()
    assert {r.split for r in got} == {"train", "val"} and [round(a.bbox.xmax, 3) for a in got[0].annotations] == [1.0, 0.3] and got[0].image.uri.endswith("2017/a.jpg")
    assert coco.sample(ins, 1).count() == 2


def test_messages(spark):
    class Stamp:
        __slots__, _slot_types = ["secs", "nsecs"], []

        def __init__(self, s, n):
            self.secs, self.nsecs = s, n

    class Header:
        __slots__, _slot_types = ["seq", "stamp", "frame_id"], ["uint32", "time", "string"]

        def __init__(self):
            self.seq, self.stamp, self.frame_id = 3, Stamp(10, 5000), "f"

    class Scan:
        __slots__, _slot_types = ["header", "data", "ranges", "took", "many"], ["std/Header", "uint8[]", "float32[4]", "duration", "std/Header[]"]

        def __init__(self):
            self.header, self.data, self.ranges, self.took, self.many = Header(), [1, 2, 3], [1.0, 2.0], Stamp(1, 500), [Header()]

    schema = messages.schema_of(Scan, lambda name: Header)
    assert schema["data"].dataType == T.BinaryType() and schema["header"].dataType["stamp"].dataType == T.TimestampType() and schema["took"].dataType == T.LongType()
    d = messages.to_dict(Scan())
    assert d["data"] == b"\x01\x02\x03" and d["took"] == 1_000_000_500 and messages.to_json_dict(Scan())["took"] == pytest.approx(1.0000005)
    assert spark.createDataFrame([d], schema).first().header.seq == 3


def test_loaders(spark, tmp_path):
    with option_context(cache_uri=f"{tmp_path}/cache"):
        got = list(loaders.tensors(spark.createDataFrame([(1, NDArray.of(np.eye(2)).to_dict())], T.StructType([T.StructField("id", T.LongType()), T.StructField("n", NDARRAY)]))))
    assert got[0]["id"] == 1 and np.array_equal(got[0]["n"], np.eye(2))
    frame = loaders.FrameDataset(pd.Series([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]))
    assert [b.shape for b in frame.batches(2)] == [(2, 2), (1, 2)]
    with pytest.raises(ImportError):
        loaders.torch_dataset(str(tmp_path))
    with pytest.raises(ImportError):
        loaders.tf_dataset(str(tmp_path), None)


def test_options():
    with pytest.raises(KeyError):
        set_option("nope", 1)
    with option_context(viz__color="blue"):
        assert get_option("viz.color") == "blue"
    assert get_option("viz.color") == "red"


def test_drawing():
    from ocellus.viz import Draw, Style, with_label

    image = Image.from_array(np.zeros((10, 12, 3), np.uint8))
    svg = (Draw(image) | Box2d(1, 1, 5, 5) @ Style(color="blue") | [with_label(Box2d(0, 0, 2, 2), "a<b")] | Mask.from_rle([100, 20], 10, 12) | "note").to_svg()
    assert 'width="12"' in svg and "blue" in svg and "a&lt;b" in svg and svg.count("<image") == 2 and SimpleNamespace


def test_small_row_groups_share_a_partition(spark, tmp_path):
    """A file's small groups are one partition; bundles have every group once, in order, whatever their size."""
    path = f"{tmp_path}/d"
    write_dataset(spark.range(20000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(2), path, block_size=16 * 1024)
    for offset in (0, 777):
        data = Dataset(path, offset=offset, rank=1, world_size=3)
        groups = list(data.groups())
        assert len(groups) > 8
        for least in (1, 100_000, 2**40):
            bundles = list(data.bundles(least))
            assert [(uri, g, skip) for uri, every in bundles for g, skip in every] == groups
        assert len(bundles) == len({uri for uri, _, _ in groups}) and len(list(data.bundles(1))) == len(groups)
        scan = sharded(spark, path, 1, 3, offset)
        assert scan.rdd.getNumPartitions() == len(bundles) and sorted(r.id for r in scan.collect()) == sorted(r["id"] for r in data)
