"""Relational queries that the library leaves to Spark, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.operators import joins
from ocellus.plans.queries import _parameters, _part_engine, query, table


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
def r_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their large orders, if any."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT coalesce(o_custkey, user_id) AS id, orders, events FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY ALL) FULL JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY ALL) ON o_custkey = user_id")
def r_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two tables, of ids in either; both are reduced before the join."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("events"))
    return o.join(e, "id", "full")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def r_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def r_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT l_orderkey, l_linenumber, e.event_id FROM lineitem ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) e
    ON l_suppkey = e.user_id AND l_shipdate + INTERVAL 8766 DAY + l_linenumber * INTERVAL 1 HOUR >= e.ts""")
def r_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the latest event before a time."""
    at = F.expr("l_shipdate + INTERVAL '8766' DAY + l_linenumber * INTERVAL '1' HOUR")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"), at.alias("ts"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return joins.asof(lines, events, "user_id", "ts", ["event_id"]).select("l_orderkey", "l_linenumber", "event_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def r_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groupings of two columns."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (CAST(year(o_orderdate) AS INTEGER), o_orderstatus)")
def r_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals by year and status."""
    return table(spark, sf_dir, "orders").rollup(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def r_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen groupings in one pass."""
    return table(spark, sf_dir, "part").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def r_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses as columns; naming them saves a pass."""
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.na.fill(0, ["F", "O", "P"])


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def r_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts of two columns."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def r_approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sketch's distinct count is within a tenth of the exact one."""
    # A sketch is the same of distinct values; in one aggregation with an exact count Spark holds a sketch for each value.
    values = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    c = values.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("e"))
    return c.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e")).alias("near"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def r_top_with_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sorted table: a top-k report."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def r_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "events").select("user_id")).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def r_except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXCEPT."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT user_id AS id FROM events INTERSECT SELECT o_custkey FROM orders")
def r_intersect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERSECT."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT p_partkey, upper(p_name) AS name, split_part(p_name, ' ', 1) AS first, length(p_name) AS size, replace(p_brand, 'Brand#', '') AS brand, p_type LIKE 'ECO%' AS economy, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part")
def r_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.length("p_name").cast("long").alias("size"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"), F.col("p_type").startswith("ECO").alias("economy"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, dayofyear(o_orderdate) AS d FROM orders")
def r_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.datediff(d.cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.dayofyear(d).cast("long").alias("d"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def r_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text, summed."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT vec_id, map([label, 1000], [vec_id, 0])[label] AS own FROM embeddings")
def r_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value looked up in a map."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.create_map("label", "vec_id", F.lit(1000), F.lit(0).cast("long"))[F.col("label")].alias("own"))


@query("""SELECT o_orderkey, rank() OVER w AS r, CAST(ntile(3) OVER w AS BIGINT) AS third, lag(o_orderkey) OVER w AS before FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def r_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, tiles and the row before, over one shuffle."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.ntile(3).over(w).cast("long").alias("third"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) + 2 * p_retailprice AS score FROM part ORDER BY score DESC, p_partkey LIMIT 10")
def p1_predict_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY a prediction, with a LIMIT."""
    engine = _part_engine(spark, sf_dir)
    engine.sql(f"CREATE MODEL rank_by FLAVOR numpy MODEL_TYPE linear_regression OPTIONS (parameters='{_parameters(coef=[1, 2], intercept=0)}')")
    return engine.sql("SELECT p_partkey, p_size + 2 * p_retailprice AS score FROM part ORDER BY ML_PREDICT(rank_by, array(double(p_size), p_retailprice)) DESC, p_partkey LIMIT 10")
