"""One query for each operator, over the TPC-H-like tables, and the same in SQL for comparison.

Boxes are made from lineitem: (100 * discount, 100 * tax) is the lower corner
and the quantity is both sides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.functions import register_functions
from ocellus.functions.io import image, image_of_bytes
from ocellus.operators import boxes, detections, frames, masks
from ocellus.sources import coco, dataset
from ocellus.sql.engine import Engine
from ocellus.workers import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query with its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has: a small file is one task, however much is computed for its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _corner(c: Callable[[str], Column]) -> list[Column]:
    return [c("l_discount") * 100, c("l_tax") * 100, c("l_discount") * 100 + c("l_quantity"), c("l_tax") * 100 + c("l_quantity")]


def lineitem_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber and a box."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct(*[c.alias(n) for c, n in zip(_corner(F.col), boxes.NAMES, strict=True)]).alias("box"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes a and b of consecutive lines of an order."""
    b = lineitem_boxes(spark, sf_dir)
    nxt = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("box").alias("b"))
    return b.select("l_orderkey", "l_linenumber", F.col("box").alias("a")).join(nxt, ["l_orderkey", "l_linenumber"])


_BOXES = "SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 100 AS x0, l_tax * 100 AS y0, l_discount * 100 + l_quantity AS x1, l_tax * 100 + l_quantity AS y1 FROM lineitem"
_PAIRS = f"WITH t AS ({_BOXES}), p AS (SELECT a.l_orderkey, a.l_linenumber, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1)"
_IOU = "greatest(least({0}x1, {1}x1) - greatest({0}x0, {1}x0), 0.0) * greatest(least({0}y1, {1}y1) - greatest({0}y0, {1}y0), 0.0)"


def _sql_iou(a: str, b: str) -> str:
    common = _IOU.format(a, b)
    return f"{common} / (({a}y1 - {a}y0) * ({a}x1 - {a}x0) + ({b}y1 - {b}y0) * ({b}x1 - {b}x0) - {common})"


@query(f"{_PAIRS}, i AS (SELECT *, round({_sql_iou('a', 'b')}, 6) AS iou FROM p) SELECT l_linenumber, count(*) AS pairs, sum(CASE WHEN iou > 0.5 THEN 1 ELSE 0 END)::BIGINT AS over_half, round(avg(iou), 6) AS mean_iou FROM i GROUP BY l_linenumber")
def box_iou_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IOU of consecutive boxes of an order, summed up by line: the flagship query."""
    pairs = neighbours(spark, sf_dir).select("l_linenumber", F.round(boxes.iou(F.col("a"), F.col("b")), 6).alias("iou"))
    return pairs.groupBy("l_linenumber").agg(F.count("*").alias("pairs"), F.sum((F.col("iou") > 0.5).cast("long")).alias("over_half"), F.round(F.avg("iou"), 6).alias("mean_iou"))


@query(f"SELECT l_orderkey, l_linenumber, round((y1 - y0) * (x1 - x0), 6) AS area FROM ({_BOXES})")
def f1_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area(box) by its SQL function."""
    register_functions(spark)
    return lineitem_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.expr("area(box)"), 6).alias("area"))


@query(f"{_PAIRS} SELECT l_orderkey, l_linenumber, round({_sql_iou('a', 'b')}, 6) AS iou FROM p")
def f2_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iou(a, b) by its SQL function."""
    register_functions(spark)
    return neighbours(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.expr("iou(a, b)"), 6).alias("iou"))


@query(f"SELECT l_orderkey, l_linenumber, round(x0, 6) AS xmin, round(y1, 6) AS ymax FROM ({_BOXES}) WHERE x0 < 5")
def f3_to_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of boxes are reachable in SELECT and WHERE."""
    lineitem_boxes(spark, sf_dir).createOrReplaceTempView("boxes_f3")
    return spark.sql("SELECT l_orderkey, l_linenumber, round(box.xmin, 6) AS xmin, round(box.ymax, 6) AS ymax FROM boxes_f3 WHERE box.xmin < 5")


@query("SELECT page_id, url AS uri, true AS no_data FROM pages")
def f4_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image(uri) by its SQL function."""
    register_functions(spark)
    made = table(spark, sf_dir, "pages").select("page_id", F.expr("image(url)").alias("i"))
    return made.select("page_id", F.col("i.uri").alias("uri"), F.col("i.data").isNull().alias("no_data"))


@query(f"SELECT l_orderkey, l_linenumber, round((y1 - y0) * (x1 - x0), 4) AS area, round(x1, 6) AS xmax FROM ({_BOXES})")
def f5_box2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box2d(array) by its SQL function."""
    register_functions(spark)
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*_corner(F.col)).alias("v")).withColumn("b", F.expr("box2d(v)"))
    return made.select("l_orderkey", "l_linenumber", F.round(boxes.area(F.col("b")), 4).alias("area"), F.round("b.xmax", 6).alias("xmax"))


@query("SELECT l_orderkey, l_linenumber, round(100 + l_discount * 100 - l_quantity / 2, 6) AS xmin, round(100 + l_tax * 100 + l_quantity / 2, 6) AS ymax FROM lineitem")
def f6_box2d_from_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box2d_from_center(array) by its SQL function."""
    register_functions(spark)
    v = F.array(100 + F.col("l_discount") * 100, 100 + F.col("l_tax") * 100, F.col("l_quantity"), F.col("l_quantity"))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).withColumn("b", F.expr("box2d_from_center(v)"))
    return made.select("l_orderkey", "l_linenumber", F.round("b.xmin", 6).alias("xmin"), F.round("b.ymax", 6).alias("ymax"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100 + l_quantity, 6) AS xmax, round(l_tax * 100 + 2 * l_quantity, 6) AS ymax FROM lineitem")
def f7_box2d_from_top_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box2d_from_top_left(array) as a Column."""
    v = F.array(F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity"), 2 * F.col("l_quantity"))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", boxes.box2d_from_top_left(v).alias("b"))
    return made.select("l_orderkey", "l_linenumber", F.round("b.xmax", 6).alias("xmax"), F.round("b.ymax", 6).alias("ymax"))


@query("SELECT page_id, length(html) AS n, md5(html) AS digest, url AS uri FROM pages")
def f9_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to_image of bytes and of a URI."""
    made = table(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("long").alias("n"), image_of_bytes(F.col("html").cast("binary")).alias("e"), image(F.col("url")).alias("u"))
    return made.select("page_id", "n", F.md5("e.data").alias("digest"), F.col("u.uri").alias("uri"))


@query("SELECT user_id, count(*) AS n, min(ts)::DATE AS first_day FROM events GROUP BY user_id")
def f13_frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a user's stream."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").cast("date").alias("first_day"))


@query("""SELECT c_custkey, list_transform(range(0, CASE WHEN (c_custkey % 30) < 60 THEN least(CASE WHEN (c_custkey % 5) * 12 > (c_custkey % 7) THEN least((c_custkey % 5) * 12 - (c_custkey % 7), 10) ELSE 10 END,
    CAST(ceil((60 - (c_custkey % 7)) / 3.0) AS BIGINT)) ELSE 0 END), lambda i: CAST((c_custkey % 7) + i * 3 AS INTEGER)) AS frames FROM customer WHERE (c_custkey % 5) * 12 > (c_custkey % 7)""")
def f13_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers of segments: every third, at most ten."""
    c = table(spark, sf_dir, "customer").where("(c_custkey % 5) * 12 > (c_custkey % 7)")
    seg = frames.segment((F.col("c_custkey") % 7).cast("int"), ((F.col("c_custkey") % 5) * 12).cast("int"))
    return c.select("c_custkey", frames.sampled_frames(seg, F.lit(60), 3, 10).alias("frames"))


@query("SELECT p_partkey, p_size AS width, CAST(round(p_retailprice) AS INTEGER) AS frame_rate, CASE WHEN p_partkey % 10 = 0 THEN 'no video stream' END AS message FROM part".replace("p_size AS width", "CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS width").replace("CAST(round(p_retailprice) AS INTEGER)", "CASE WHEN p_partkey % 10 <> 0 THEN CAST(round(CAST(p_size AS DOUBLE) * 1000 / 1001) AS INTEGER) END"))
def f14_video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata parsed from a prober's JSON; files without video are error rows."""
    stream = F.struct(
        F.when(F.col("p_partkey") % 10 == 0, F.lit("audio")).otherwise(F.lit("video")).alias("codec_type"), F.lit("h264").alias("codec_name"), F.col("p_size").alias("width"), F.col("p_size").alias("height"),
        F.lit("300").alias("nb_frames"), F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001")).alias("avg_frame_rate"),
    )
    probe = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(F.lit("736613").alias("size")).alias("format")))
    m = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", frames.metadata_of_probe(probe).alias("m"))
    return m.select("p_partkey", "m.width", "m.frame_rate", F.col("m._errors.message").alias("message"))


@query("""WITH f AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM events), d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame)) > 50 AS cut FROM f),
    s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS scene FROM d), g AS (SELECT user_id, CAST(scene AS INTEGER) AS scene, min(frame) AS start_frame, max(frame) AS last_frame FROM s GROUP BY user_id, scene)
    SELECT user_id, scene, CAST(start_frame AS INTEGER) AS start_frame, CAST(coalesce(lead(start_frame) OVER (PARTITION BY user_id ORDER BY scene), last_frame) AS INTEGER) AS end_frame FROM g""")
def f16_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of each user's stream of values."""
    e = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    e = e.withColumn("pos", F.col("frame") / 30)
    return frames.scenes(e, "user_id", "frame", "value", "pos", 50.0).select("user_id", "scene", "start_frame", "end_frame")


@query(f"{_PAIRS} SELECT l_orderkey, l_linenumber, round(greatest(ax0, bx0), 6) AS xmin, round(least(ay1, by1), 6) AS ymax FROM p WHERE greatest(ax0, bx0) < least(ax1, bx1) AND greatest(ay0, by0) < least(ay1, by1)")
def t1_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common boxes of overlapping pairs."""
    p = neighbours(spark, sf_dir).where(boxes.overlaps(F.col("a"), F.col("b"))).withColumn("i", boxes.intersect(F.col("a"), F.col("b")))
    return p.select("l_orderkey", "l_linenumber", F.round("i.xmin", 6).alias("xmin"), F.round("i.ymax", 6).alias("ymax"))


@query(f"SELECT l_orderkey, l_linenumber, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height FROM ({_BOXES})")
def t2_width_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of boxes."""
    return lineitem_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(boxes.width(F.col("box")), 6).alias("width"), F.round(boxes.height(F.col("box")), 6).alias("height"))


@query(f"SELECT l_orderkey, l_linenumber, round(x1 * 2, 6) AS xmax, round(y1 * 0.5, 6) AS ymax, round(x0 / 4, 6) AS xmin FROM ({_BOXES})")
def t3_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes multiplied and divided by factors."""
    b = lineitem_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", boxes.scale(F.col("box"), 2.0, 0.5).alias("m"), boxes.shrink(F.col("box"), 4.0, 8.0).alias("d"))
    return b.select("l_orderkey", "l_linenumber", F.round("m.xmax", 6).alias("xmax"), F.round("m.ymax", 6).alias("ymax"), F.round("d.xmin", 6).alias("xmin"))


_ORDER_LISTS = f"WITH t AS ({_BOXES})"


@query(f"{_ORDER_LISTS} SELECT a.l_orderkey, round(max({_sql_iou('a.', 'b.')}), 6) AS best, count(*) AS n FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 GROUP BY a.l_orderkey")
def t4_iou_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best IOU of an order's first box with the array of its boxes."""
    o = lineitem_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "box"))).alias("r"))
    o = o.select("l_orderkey", "r", F.transform("r", lambda x: x["box"]).alias("all")).withColumn("one", F.transform(F.filter("r", lambda x: x["l_linenumber"] == 1), lambda x: x["box"]))
    first = o.where(F.size("one") > 0).select("l_orderkey", F.flatten(F.transform("one", lambda a: boxes.iou_list(a, F.col("all")))).alias("i"))
    return first.select("l_orderkey", F.round(F.array_max("i"), 6).alias("best"), F.size("i").cast("long").alias("n"))


@query(f"{_ORDER_LISTS} SELECT a.l_orderkey, round(sum(round({_sql_iou('a.', 'b.')}, 6)), 6) AS total, count(*) AS n FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey")
def t5_iou_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and size of each order's IOU matrix."""
    o = lineitem_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("box").alias("b"))
    m = o.select("l_orderkey", F.flatten(boxes.iou_matrix(F.col("b"), F.col("b"))).alias("m"))
    return m.select("l_orderkey", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + F.round(x, 6)), 6).alias("total"), F.size("m").cast("long").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, round(x0, 6) + round(y0, 6) + round(x1, 6) + round(y1, 6) AS total FROM ({_BOXES})".replace("round(x0, 6) + round(y0, 6) + round(x1, 6) + round(y1, 6)", "round(x0 + y0 + x1 + y1, 5)"))
def t6_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as arrays."""
    a = lineitem_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", boxes.to_array(F.col("box")).alias("a"))
    return a.select("l_orderkey", "l_linenumber", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("SELECT p_partkey, round(p_size * 2.0 * p_retailprice, 4) AS volume, p_size::DOUBLE AS x FROM part")
def t7_box3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and 3-D boxes."""
    size = F.col("p_size")
    b = table(spark, sf_dir, "part").select("p_partkey", boxes.box3d(boxes.point(size, size, size), size, F.lit(2.0), F.col("p_retailprice"), F.lit(0.0)).alias("b"))
    return b.select("p_partkey", F.round(F.col("b.length") * F.col("b.width") * F.col("b.height"), 4).alias("volume"), F.col("b.center.x").alias("x"))


def event_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and the 0/1 array of its events in order: whether the value is over 50."""
    e = table(spark, sf_dir, "events")
    one = F.struct("event_id", (F.col("value") > 50).cast("int").alias("bit"))
    return e.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("e")).select("user_id", F.transform("e", lambda x: x["bit"]).alias("bits"))


_BITS = "SELECT user_id, event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS bit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events"
_RUNS = f"WITH b AS ({_BITS}), c AS (SELECT *, CASE WHEN bit <> coalesce(lag(bit) OVER (PARTITION BY user_id ORDER BY i), bit) THEN 1 ELSE 0 END AS new FROM b), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c), g AS (SELECT user_id, run, bit, count(*) AS n FROM r GROUP BY user_id, run, bit)"


@query(f"{_RUNS}, z AS (SELECT user_id, -1 AS run, 0 AS n FROM g WHERE run = 0 AND bit = 1 UNION ALL SELECT user_id, run, n FROM g) SELECT user_id, list(CAST(n AS INTEGER) ORDER BY run) AS rle FROM z GROUP BY user_id")
def t11_rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of each user's bits."""
    return event_bits(spark, sf_dir).select("user_id", masks.rle_encode(F.col("bits")).alias("rle"))


@query(f"{_RUNS} SELECT user_id, CAST(run AS INTEGER) AS run, bit, n AS length FROM g")
def t11_runs_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs from tall data by windows."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 50).cast("int").alias("bit"))
    runs = masks.runs_of(e, ["user_id"], "event_id", "bit")
    first = Window.partitionBy("user_id")
    return runs.withColumn("run", (F.col("run") - F.min("run").over(first)).cast("int")).select("user_id", "run", "bit", "length")


@query(f"WITH b AS ({_BITS}) SELECT user_id, list(bit ORDER BY i) AS bits FROM b GROUP BY user_id")
def t12_rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again."""
    return event_bits(spark, sf_dir).select("user_id", masks.rle_decode(masks.rle_encode(F.col("bits"))).alias("bits"))


@query("SELECT p_partkey, list_transform(range(0, 12), lambda i: CASE WHEN ((i % 4) * 3 + i // 4) < p_size % 12 THEN 0 ELSE 1 END) AS bits FROM part")
def t9_mask_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column-major mask of 3 x 4 pixels in row-major order."""
    m = masks.mask_from_coco_rle(F.array((F.col("p_size") % 12).cast("int"), (12 - F.col("p_size") % 12).cast("int")), F.lit(3), F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", masks.to_mask(F.col("m")).alias("bits"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 10 + p_partkey % 10 = 0 THEN 0.0 ELSE least(p_size % 10, p_partkey % 10) / greatest(p_size % 10, p_partkey % 10)::DOUBLE END, 6) AS iou FROM part")
def t10_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IOU of two masks of 10 pixels."""
    one = lambda n: masks.mask_from_rle(F.array(F.lit(0), n.cast("int"), (10 - n).cast("int")), F.lit(2), F.lit(5))
    m = table(spark, sf_dir, "part").select("p_partkey", one(F.col("p_size") % 10).alias("a"), one(F.col("p_partkey") % 10).alias("b"))
    return m.select("p_partkey", F.round(masks.mask_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("SELECT l_orderkey, min(l_linenumber) AS start_fno, max(l_linenumber) AS end_fno FROM lineitem GROUP BY l_orderkey")
def t16_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked segments."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("s"), F.max("l_linenumber").alias("e"))
    return o.select("l_orderkey", frames.segment(F.col("s"), F.col("e")).alias("g")).select("l_orderkey", "g.start_fno", "g.end_fno")


def _part_engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return engine


def _parameters(**values) -> str:
    return json.dumps(values).replace("'", "\\'")


@query("SELECT p_partkey, round((CAST(p_size AS DOUBLE) + 2 * p_retailprice + 3)::FLOAT::DOUBLE, 1) AS score FROM part WHERE p_size > 10")
def p1_ml_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML_PREDICT of a linear model over two columns in SELECT."""
    engine = _part_engine(spark, sf_dir)
    engine.sql(f"CREATE MODEL lin FLAVOR numpy MODEL_TYPE linear_regression OPTIONS (parameters='{_parameters(coef=[1, 2], intercept=3)}')")
    return engine.sql("SELECT p_partkey, round(double(ML_PREDICT(lin, array(double(p_size), p_retailprice))), 1) AS score FROM part WHERE p_size > 10")


@query("SELECT count(*) AS n, min(p_size) AS smallest FROM part WHERE p_size - 25 > 0")
def p1_ml_predict_in_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML_PREDICT of a logistic model in WHERE."""
    engine = _part_engine(spark, sf_dir)
    engine.sql(f"CREATE MODEL big FLAVOR numpy MODEL_TYPE logistic_regression OPTIONS (parameters='{_parameters(coef=[[1]], intercept=-25)}')")
    return engine.sql("SELECT count(*) AS n, min(p_size) AS smallest FROM part WHERE ml_predict(big, p_size) = 1")


@query("SELECT p_partkey, p_size + 2 AS plus2 FROM part")
def p15_sql_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that is a Spark expression; its bare call is named after it."""
    engine = _part_engine(spark, sf_dir)
    engine.sql("CREATE MODEL plus2 USING 'sql:{0} + 2'")
    return engine.sql("SELECT p_partkey, ML_PREDICT(plus2, p_size) FROM part")


@query("SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE))::FLOAT::DOUBLE, 3) AS first, round((CAST(embedding[3] AS DOUBLE) - 1)::FLOAT::DOUBLE, 3) AS second FROM embeddings")
def p23_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection of embeddings on two components."""
    engine = _part_engine(spark, sf_dir)
    a, b, mean = ([0.0] * 64 for _ in range(3))
    a[0] = a[1] = b[2] = mean[2] = 1.0
    engine.sql(f"CREATE MODEL pca FLAVOR numpy MODEL_TYPE pca OPTIONS (parameters='{_parameters(mean=mean, components=[a, b])}')")
    return engine.sql("SELECT vec_id, round(double(p[0]), 3) AS first, round(double(p[1]), 3) AS second FROM (SELECT vec_id, ML_PREDICT(pca, embedding) AS p FROM embeddings)")


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN 1.0 ELSE 2.0 END AS value FROM part")
def p23_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of two equal stumps."""
    engine = _part_engine(spark, sf_dir)
    tree = {"feature": [0, -1, -1], "threshold": [25, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [0, 1, 2]}
    engine.sql(f"CREATE MODEL forest FLAVOR numpy MODEL_TYPE random_forest_regression OPTIONS (parameters='{_parameters(trees=[tree, tree])}')")
    return engine.sql("SELECT p_partkey, double(ML_PREDICT(forest, p_size)) AS value FROM part")


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT vec_id, max(v) AS top FROM x GROUP BY vec_id),
    s AS (SELECT vec_id, sum(exp(CAST(v AS DOUBLE) - CAST(top AS DOUBLE))) AS total FROM x JOIN m USING (vec_id) GROUP BY vec_id) SELECT vec_id, CAST(min(i) AS INTEGER) AS label_id, round(1 / any_value(total), 4) AS score FROM x JOIN m USING (vec_id) JOIN s USING (vec_id) WHERE v = top GROUP BY vec_id""")
def p24_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax and the best class of all logits."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    c = e.select("vec_id", detections.classify(F.col("logits")).alias("c"))
    return c.select("vec_id", "c.label_id", F.round(F.col("c.score").cast("double"), 4).alias("score"))


def _order_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order as detections, by line and corners (lines repeat)."""
    one = F.struct("l_linenumber", "box", (F.col("l_partkey") % 100 / 100).cast("float").alias("score"), (F.col("l_linenumber") % 2).cast("int").alias("label_id"))
    lines = lineitem_boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("d"))
    return lines.select("l_orderkey", F.transform("d", lambda x: F.struct(x["box"].alias("box"), x["score"].alias("score"), x["label_id"].alias("label_id"), F.lit(None).cast("string").alias("label"))).alias("d"))


@query("SELECT l_orderkey, count(CASE WHEN (l_partkey % 100 / 100)::FLOAT >= 0.5 THEN 1 END) AS n FROM lineitem GROUP BY l_orderkey")
def p25_detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a score of 0.5 or more."""
    return _order_detections(spark, sf_dir).select("l_orderkey", F.size(detections.keep_scores(F.col("d"))).cast("long").alias("n"))


_SUPPRESSED = f"""WITH RECURSIVE t AS (SELECT *, l_linenumber % 2 AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey % 100 / 100)::FLOAT DESC, l_linenumber, x0, y0, x1, y1) AS r FROM ({_BOXES})),
    c AS (SELECT a.l_orderkey, a.r, coalesce(list(b.r) FILTER (b.r IS NOT NULL), []) AS over FROM t a LEFT JOIN t b ON a.l_orderkey = b.l_orderkey AND a.label = b.label AND b.r < a.r AND {_sql_iou('a.', 'b.')} > 0.5 GROUP BY a.l_orderkey, a.r),
    s AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS kept FROM t
        UNION ALL SELECT s.l_orderkey, c.r, CASE WHEN list_has_any(s.kept, c.over) THEN s.kept ELSE list_append(s.kept, c.r) END FROM s JOIN c ON s.l_orderkey = c.l_orderkey AND c.r = s.r + 1)
    SELECT l_orderkey, CAST(max(len(kept)) AS BIGINT) AS n FROM s GROUP BY l_orderkey"""


@query(_SUPPRESSED)
def p26_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-maximum suppression of each order's boxes."""
    d = _order_detections(spark, sf_dir).select("l_orderkey", detections.non_maximum_suppression(F.col("d"), 0.5).alias("k"))
    return d.select("l_orderkey", F.size("k").cast("long").alias("n"))


@query("WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM x) SELECT vec_id, list(CAST(i AS INTEGER) ORDER BY k) AS ids FROM r WHERE k <= 3 GROUP BY vec_id")
def p26_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of all scores."""
    top = detections.top_scores(F.col("embedding"), 3, -1e9)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(top, lambda x: x["label_id"]).alias("ids"))


@query("SELECT 'm1' AS name, '' AS flavor, 'sql:upper' AS uri, '{\"batch\": \"10\", \"flag\": \"true\"}' AS options UNION ALL SELECT 'm2', 'numpy', NULL, ''")
def m6_show_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE twice, DROP once, SHOW."""
    engine = Engine(spark)
    engine.sql("CREATE MODEL m1 OPTIONS (batch=10, flag=True) USING 'sql:upper'")
    engine.sql("CREATE MODEL m2 FLAVOR numpy MODEL_TYPE norm")
    engine.sql("CREATE OR REPLACE MODEL m3 FLAVOR numpy MODEL_TYPE norm;")
    engine.sql("DROP MODEL m3")
    return engine.sql("SHOW MODELS")


@query("SELECT 'm1' AS name, 'numpy' AS flavor, NULL::VARCHAR AS uri, '' AS options")
def m5_describe_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.sql("CREATE MODEL IF NOT EXISTS m1 FLAVOR numpy MODEL_TYPE norm")
    return engine.sql("-- one row\nDESCRIBE MODEL m1")


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder for a written dataset: in the shared folder if there is one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/ocellus-datasets"
    return f"{base.rstrip('/')}/{name}_{sf_dir.rstrip('/').rpartition('/')[2]}"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s1_dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a sidecar and read with a projection."""
    path = _folder(spark, sf_dir, "s1")
    dataset.write_dataset(table(spark, sf_dir, "orders"), path, kind="orders")
    return dataset.read_dataset(spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT 'orders' AS kind, '7' AS number, count(*) AS n FROM orders")
def s4_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar's options and the count from footers."""
    path = _folder(spark, sf_dir, "s4")
    dataset.write_dataset(table(spark, sf_dir, "orders"), path, kind="orders", number=7)
    data = dataset.Dataset(path)
    o = data.metadata["options"]
    return spark.createDataFrame([(o["kind"], o["number"], data.count())], "kind string, number string, n long")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def s7_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by partition; the filter prunes partitions."""
    path = _folder(spark, sf_dir, "s7")
    dataset.write_dataset(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"])
    return dataset.read_dataset(spark, path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) - 1000 AS n FROM orders")
def s13_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind an offset, by row groups."""
    path = _folder(spark, sf_dir, "s13")
    dataset.write_dataset(table(spark, sf_dir, "orders").orderBy("o_orderkey"), path, block_size=64 * 1024)
    return dataset.sharded(spark, path, 0, 1, offset=1000, columns=["o_orderkey"]).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def s14_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards together are the dataset."""
    path = _folder(spark, sf_dir, "s14")
    dataset.write_dataset(table(spark, sf_dir, "orders"), path, block_size=64 * 1024)
    shards = [dataset.sharded(spark, path, r, 3, columns=["o_orderkey", "o_custkey"]) for r in range(3)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


@query("""WITH a AS (SELECT o_orderkey, l_linenumber, p_type AS label, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
    SELECT o_orderkey AS image_id, count(*) AS n, round(max(l_quantity / 640), 8) AS widest FROM a GROUP BY o_orderkey""")
def s23_annotations_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of orders (as images), labelled, grouped and rescaled."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(640).alias("width"), F.lit(480).alias("height"), image(F.col("o_orderpriority")).alias("image"))
    lines = lineitem_boxes(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ann = lines.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ann_id"), F.col("p_size").alias("label_id"), F.col("p_type").alias("label"), boxes.area(F.col("box")).alias("area"), F.col("box").alias("bbox"))
    grouped = coco.by_image(images, ann)
    return grouped.select("image_id", F.size("annotations").cast("long").alias("n"), F.round(F.array_max(F.transform("annotations", lambda a: boxes.width(a["bbox"]))), 8).alias("widest"))


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10")
def r_join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner join, aggregation and HAVING."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b")).where("customers > 10")
    return c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", F.round("b", 2).alias("balance"))


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def r_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXCEPT ALL."""
    return table(spark, sf_dir, "orders").select("o_custkey").exceptAll(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")))


@query("SELECT c_custkey FROM customer INTERSECT ALL SELECT o_custkey FROM orders")
def r_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERSECT ALL."""
    return table(spark, sf_dir, "customer").select("c_custkey").intersectAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM lineitem WHERE l_quantity > 25) GROUP BY label")
def r_explode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each label: detections exploded and counted."""
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.array(F.struct(F.when(F.col("l_partkey") % 2 == 0, "even").otherwise("odd").alias("label"))).alias("d"))
    return d.select(F.inline("d")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def r_collect_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a group as an array."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def r_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered aggregation over the largest table."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def r_top_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest orders of each customer."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 2").select("o_custkey", "o_orderkey")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour, as a stream writes them."""
    from ocellus.streaming import read_stream, write_complete

    # The stream runs to its end into a folder; what it holds is the result.
    source = read_stream(importable(spark), f"{sf_dir}/events*.parquet")
    span = F.window("ts", "1 hour")
    agg = source.groupBy("user_id", span.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    folder = f"{_folder(spark, sf_dir, 'r_stream_windows')}_{uuid.uuid4().hex}"
    write_complete(agg, f"{folder}/result", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/result").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", F.round("t", 4).alias("total"))


def queries() -> dict[str, Query]:
    from ocellus.plans import files, relational  # noqa: F401  they register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
