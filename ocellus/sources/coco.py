"""Converter for COCO annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.operators import boxes, masks

_SEGMENT = "struct<counts:array<int>,size:array<int>>"
INSTANCES = (
    "images array<struct<id:int,date_captured:string,width:int,height:int,file_name:string>>,"
    "annotations array<struct<id:bigint,image_id:int,category_id:int,area:double,iscrowd:int,bbox:array<double>,segmentation:string>>,"
    "categories array<struct<id:int,name:string,supercategory:string>>"
)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """The one row of an instances file; segmentations stay JSON, as they have two forms."""
    return spark.read.schema(INSTANCES).option("multiLine", True).json(path)


def categories(instances: DataFrame) -> DataFrame:
    return instances.select(F.inline("categories")).select(F.col("id").alias("label_id"), F.col("name").alias("label"), "supercategory")


def images(instances: DataFrame, folder: str) -> DataFrame:
    rows = instances.select(F.inline("images"))
    image = F.struct(F.lit(None).cast("binary").alias("data"), F.concat_ws("/", F.lit(folder.rstrip("/")), "file_name").alias("uri"))
    return rows.withColumn("image", image)


def segmentation(text: Column, height: Column, width: Column) -> Column:
    """A mask of a segmentation's JSON: column-major run lengths, or polygons."""
    runs = F.from_json(text, _SEGMENT)
    polygons = F.from_json(text, "array<array<float>>")
    return F.when(text.startswith("{"), masks.mask_from_coco_rle(runs["counts"], height, width)).when(text.startswith("["), masks.mask_from_polygon(polygons, height, width))


def annotations(instances: DataFrame) -> DataFrame:
    """image_id, area, label_id, ann_id, bbox, segmentation, supercategory and label of each annotation."""
    sizes = instances.select(F.inline("images")).select(F.col("id").alias("image_id"), "height", "width")
    rows = instances.select(F.inline("annotations"))
    whole = rows.join(sizes, "image_id").join(categories(instances), rows.category_id == F.col("label_id"))
    return whole.select("image_id", "area", "label_id", F.col("id").alias("ann_id"), boxes.box2d_from_top_left(F.col("bbox")).alias("bbox"), segmentation(F.col("segmentation"), F.col("height"), F.col("width")).alias("segmentation"), "supercategory", "label")


def rescaled(box: Column, width: Column, height: Column) -> Column:
    """A pixel box as shares of the image."""
    return boxes.shrink(box, width, height)


def by_image(image_rows: DataFrame, annotation_rows: DataFrame) -> DataFrame:
    """Images with the array of their annotations, boxes rescaled, ordered by annotation."""
    joined = annotation_rows.join(image_rows.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    one = F.struct("ann_id", "label_id", "label", F.col("area").cast("float").alias("area"), rescaled(F.col("bbox"), F.col("width").cast("double"), F.col("height").cast("double")).alias("bbox"))
    grouped = joined.groupBy("image_id").agg(F.sort_array(F.collect_list(one)).alias("annotations"))
    return grouped.join(image_rows.select(F.col("id").alias("image_id"), "image"), "image_id").select(F.col("image_id").cast("long"), F.transform("annotations", lambda a: a.dropFields("ann_id")).alias("annotations"), "image")


def convert(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val"), year: str = "2017", limit: int | None = None) -> DataFrame:
    """A COCO folder (annotations/instances_<split><year>.json, <split><year>/) as one dataset.

    With a limit, the images of each split with the smallest ids.
    """
    out: DataFrame | None = None
    for split in splits:
        instances = read_instances(spark, f"{root}/annotations/instances_{split}{year}.json")
        rows = by_image(images(instances, f"{root}/{split}{year}"), annotations(instances)).withColumn("split", F.lit(split))
        if limit is not None:
            rows = rows.orderBy("image_id").limit(limit)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no splits")
    return out


def sample(instances: DataFrame, each: int = 10) -> DataFrame:
    """Annotations of up to ``each`` images with crowd (run-length) and with polygon segmentations."""
    rows = instances.select(F.inline("annotations"))
    first = rows.groupBy("iscrowd", "image_id").agg(F.count("*").alias("n"))
    chosen = first.withColumn("r", F.row_number().over(Window.partitionBy("iscrowd").orderBy("image_id"))).where(F.col("r") <= each)
    return rows.join(chosen.select("iscrowd", "image_id"), ["iscrowd", "image_id"], "left_semi")
