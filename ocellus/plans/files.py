"""Queries over images, masks, files and model specs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import register_functions
from ocellus.operators import masks
from ocellus.plans.queries import _folder, _part_engine, dealt, query, table
from ocellus.sources import dataset
from ocellus.sources.uri import write_bytes


@query("SELECT p_partkey, CAST(8 AS BIGINT) AS width, CAST(6 AS BIGINT) AS height, CAST(p_size % 5 + 1 AS BIGINT) AS crop_width, CAST(p_size % 4 + 1 AS BIGINT) AS crop_height FROM part")
def f12_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numpy_to_image and crop by their SQL names; sides are read from the encoded images."""
    register_functions(spark)
    pixels = F.unhex(F.repeat(F.lpad(F.hex(F.col("p_size")), 2, "0"), 48))
    array = F.struct(F.lit("uint8").alias("dtype"), F.array(F.lit(6), F.lit(8)).alias("shape"), pixels.alias("data"))
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    made = part.select("p_partkey", "p_size", F.expr("box2d(array(0D, 0D, double(p_size % 5 + 1), double(p_size % 4 + 1)))").alias("b"), array.alias("a"))
    made = made.select("p_partkey", "b", F.expr("numpy_to_image(a, CAST(NULL AS STRING), 'PNG')").alias("i"))
    made = made.select("p_partkey", "i", F.expr("get(crop(i, array(b)), 0)").alias("c"))

    def side(image: str, at: int):
        return F.conv(F.hex(F.substring(F.col(image)["data"], at, 4)), 16, 10).cast("long")

    return made.select("p_partkey", side("i", 17).alias("width"), side("i", 21).alias("height"), side("c", 17).alias("crop_width"), side("c", 21).alias("crop_height"))


@query("SELECT n_nationkey, n_name FROM nation")
def f10_image_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded images stored by image_copy, copied by copy, and read back as files."""
    register_functions(spark)
    folder = _folder(spark, sf_dir, "f10")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("bytes_to_image(CAST(n_name AS BINARY))").alias("i"))
    stored = n.select("n_nationkey", F.expr(f"image_copy(i, concat('{folder}/stored/', n_nationkey, '.bin'))").alias("s"))
    stored.select(F.expr(f"copy(s.uri, concat('{folder}/copied/', n_nationkey, '.bin'))")).write.format("noop").mode("overwrite").save()
    files = spark.read.format("binaryFile").load(f"{folder}/copied")
    return files.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("content").cast("string").alias("n_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s10_pandas_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas DataFrame written as a dataset."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _folder(spark, sf_dir, "s10")
    dataset.write_pandas(spark, n.toPandas(), path, n.schema, mode="delete_matching")
    return dataset.read_dataset(spark, path)


@query("SELECT p_partkey, (p_size % 5) * (p_partkey % 4) AS pixels FROM part")
def t8_polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of filled rectangles."""
    x, y = F.col("p_size") % 5 + 1, F.col("p_partkey") % 4 + 1
    corners = F.array(*[c.cast("float") for c in (F.lit(1), F.lit(1), x, F.lit(1), x, y, F.lit(1), y)])
    m = table(spark, sf_dir, "part").select("p_partkey", masks.mask_from_polygon(F.array(corners), F.lit(8), F.lit(8)).alias("m"))
    filled = m.select("p_partkey", masks.rasterize(F.col("m")).alias("bits"))
    return filled.select("p_partkey", F.aggregate("bits", F.lit(0).cast("long"), lambda n, b: n + b).alias("pixels"))


@query("SELECT p_partkey, round(2 * CAST(p_size AS DOUBLE) + 1, 1) AS score FROM part")
def p10_yaml_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model by a YAML spec, with its parameters in a file beside it."""
    folder = _folder(spark, sf_dir, "p10")
    write_bytes(f"{folder}/m.json", b'{"coef": [2], "intercept": 1}')
    write_bytes(f"{folder}/m.yml", b'version: "1.0"\nname: twice\nschema: double\nmodel: {uri: m.json, flavor: numpy, type: linear_regression}\n')
    engine = _part_engine(spark, sf_dir)
    engine.sql(f"CREATE MODEL twice USING '{folder}/m.yml'")
    return engine.sql("SELECT p_partkey, round(double(ML_PREDICT(twice, p_size)), 1) AS score FROM part")
