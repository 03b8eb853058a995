import json

import pandas as pd
import pytest
from pyspark.errors import ParseException
from pyspark.sql import types as T

from ocellus.errors import ModelExistsError, ModelNameError, ModelNotFoundError, ModelResolveError, SchemaError, SpecError
from ocellus.sources.uri import write_bytes
from ocellus.sql import Engine
from ocellus.sql.catalog import FileCatalog, Model
from ocellus.sql.ddl import CreateModel, DescribeModel, DropModel, ShowModels, parse_statement
from ocellus.sql.models import Classification, Detection, ModelType, apply_spec, register_model_type
from ocellus.sql.schema import parse_schema, schema_text
from ocellus.sql.spec import ModelSpec, merged, spec_of
from ocellus.types import BOX2D


def test_schema_language():
    assert parse_schema("STRUCT<foo:int,bar:string>") == T.StructType([T.StructField("foo", T.IntegerType()), T.StructField("bar", T.StringType())])
    nested = parse_schema("struct<id:int, scores: ARRAY<bigint>, b: box2d>")
    assert nested["scores"].dataType == T.ArrayType(T.LongType()) and nested["b"].dataType == BOX2D
    assert parse_schema("ARRAY<STRING>") == parse_schema("array<str>") and parse_schema("map<string,int>") == T.MapType(T.StringType(), T.IntegerType())
    assert parse_schema(schema_text(nested)) == nested
    for bad, why in [("STRUCT<0id:int>", "can not start with a digit"), ("STRUCT<id:8float>", "can not start with a digit"), ("", "Invalid schema"), ("foo,bar", "Can not recognize type"), ("array<int", "Invalid schema"), ("int int", "left over")]:
        with pytest.raises(SchemaError, match=why):
            parse_schema(bad)


def test_statements():
    got = parse_statement("create or replace model M1 flavor numpy model_type a.b OPTIONS (x.foo.bar=1.23, foo='bar', num=-1.23, batch=10, flag=True) RETURNS STRUCT<foo:int, bar:ARRAY<STRING>> USING 'abc' -- end\n;")
    assert got == CreateModel("M1", True, False, "numpy", "a.b", {"x.foo.bar": "1.23", "foo": "bar", "num": "-1.23", "batch": "10", "flag": "true"}, "STRUCT<foo:int, bar:ARRAY<string>>", "abc")
    assert parse_statement("CREATE MODEL IF NOT EXISTS m /* x */ USING \"test://m\"") == CreateModel("m", if_not_exists=True, uri="test://m")
    assert parse_statement("desc model m") == parse_statement("DESCRIBE MODEL `m`;") == DescribeModel("m") and parse_statement("SHOW MODELS") == ShowModels() and parse_statement("drop model m") == DropModel("m")
    assert parse_statement("SELECT 1") is None and parse_statement("CREATE TABLE model (a int)") is None and parse_statement("") is None
    for bad in ("CREATE OR REPLACE MODEL IF NOT EXISTS m", "DROP MODEL", "CREATE MODEL", "CREATE MODEL m OPTIONS (a)", "CREATE MODEL m OPTIONS (a=b)", "CREATE MODEL m USING x", "CREATE MODEL m USING 'a' FLAVOR x", "SHOW MODELS x", "CREATE MODEL m RETURNS foo<"):
        with pytest.raises(ParseException):
            parse_statement(bad)


LINEAR = json.dumps({"coef": [1, 2], "intercept": 3})


@pytest.fixture
def engine(spark):
    spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None)], "id int, x double").createOrReplaceTempView("t")
    return Engine(spark)


def test_catalog_statements(engine):
    engine.sql("CREATE MODEL created USING 'sql:{0} + 1'")
    with pytest.raises(ModelExistsError):
        engine.sql("CREATE MODEL created USING 'sql:{0} + 2'")
    engine.sql("CREATE MODEL IF NOT EXISTS created USING 'sql:{0} + 2'")
    assert engine.sql("DESC MODEL created").first().uri == "sql:{0} + 1"
    engine.sql("CREATE OR REPLACE MODEL created USING 'sql:{0} + 2'")
    assert [tuple(r) for r in engine.sql("SHOW MODELS").collect()] == [("created", "", "sql:{0} + 2", "")]
    engine.sql("DROP MODEL created")
    assert engine.sql("SHOW MODELS").count() == 0
    for text in ("DROP MODEL created", "DESCRIBE MODEL created"):
        with pytest.raises(ModelNotFoundError):
            engine.sql(text)
    with pytest.raises(ModelNameError):
        engine.sql("CREATE MODEL `a.b` USING 'sql:{0}'")
    with pytest.raises(ModelResolveError):
        engine.sql("CREATE MODEL m USING 'nope:/x'")
    assert engine.sql("SELECT 1 AS a").first().a == 1


def test_predict_in_queries(engine, tmp_path):
    write_bytes(f"{tmp_path}/m.json", LINEAR.encode())
    engine.sql(f"CREATE MODEL lin FLAVOR numpy MODEL_TYPE linear_regression USING 'file://{tmp_path}/m.json'")
    got = engine.sql("SELECT id, ML_PREDICT(lin, array(double(id), id + 1D)) FROM t ORDER BY ml_predict(lin, array(double(id), id + 1D)) DESC")
    assert got.columns == ["id", "lin"] and got.schema["lin"].dataType == T.FloatType() and [r.lin for r in got.collect()] == [11, 8, 5]
    assert engine.sql("SELECT count(*) AS n FROM t WHERE ML_PREDICT(lin, array(double(id), id + 1D)) > 7").first().n == 2
    assert [r.y for r in engine.sql("SELECT ML_PREDICT(lin, double(id), x) AS y FROM t ORDER BY id").collect()] == [5, 8, None]
    assert engine.sql("SELECT 'ML_PREDICT(a, b)' AS s").first().s == "ML_PREDICT(a, b)"
    for bad, error in (("SELECT ML_PREDICT(lin) FROM t", ValueError), ("SELECT ML_PREDICT(nope, id) FROM t", ModelNotFoundError)):
        with pytest.raises(error):
            engine.sql(bad)
    plan = engine.sql("SELECT ML_PREDICT(lin, array(double(id), x)) FROM t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_yaml_spec_and_literal_uri(engine, tmp_path):
    write_bytes(f"{tmp_path}/m.json", LINEAR.encode())
    write_bytes(f"{tmp_path}/labels.json", b'["a", "b"]')
    write_bytes(f"{tmp_path}/m.yml", b'version: "1.0"\nname: m\nschema: double\nmodel: {uri: m.json, flavor: numpy, type: linear_regression}\nlabels: {uri: labels.json}\noptions: {a: 1}')
    engine.sql(f"CREATE MODEL y OPTIONS (b=2) USING '{tmp_path}/m.yml'")
    assert json.loads(engine.sql("DESC MODEL y").first().options) == {"a": "1", "b": "2"}
    assert engine.sql(f"SELECT ML_PREDICT('{tmp_path}/m.yml', array(1D, 1D)) AS p").first().p == 6.0
    assert engine.sql("SELECT ML_PREDICT(y, array(1D, 1D)) AS p").schema["p"].dataType == T.DoubleType()


def test_specs():
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": None}, "d": None}) == {"a": {"b": 3, "c": 2}}
    for bad in ({}, {"version": "1.0"}, {"version": "1.0", "model": {}}, {"version": "2.0", "model": {"uri": "x"}}, {"version": "1.0", "model": {"uri": "x", "flavor": ""}}, {"version": "1.0", "model": {"flavor": "numpy"}}):
        with pytest.raises(SpecError):
            spec_of("m", bad)
    assert spec_of("m", {"version": "1.0", "model": {"uri": "w.bin"}}, "file:///a/b/m.yml").uri == "file:///a/b/w.bin"
    with pytest.raises(SpecError):
        spec_of("m", {"version": "1.0", "model": {"uri": "x"}, "labels": {"func": "no.such.thing"}})


def test_detection_and_classification(engine):
    raw = pd.DataFrame({"boxes": [[[0, 0, 1, 1], [0, 0, 2, 2]]], "scores": [[0.9, 0.4]], "labels": [[1, 0]]})
    got = list(apply_spec(ModelSpec("d", flavor="numpy", model_type="detection", labels=("x", "y")), iter([[raw]])))
    assert got[0][0] == [{"box": {"xmin": 0.0, "ymin": 0.0, "xmax": 1.0, "ymax": 1.0}, "score": 0.9, "label_id": 1, "label": "y"}]
    assert list(apply_spec(ModelSpec("d", flavor="numpy", model_type="detection", options={"min_score": "1.0"}), iter([[raw]])))[0][0] == []
    assert isinstance(Detection(), ModelType) and Classification().schema().startswith("struct")
    engine.sql("CREATE MODEL det FLAVOR numpy MODEL_TYPE detection OPTIONS (min_score=0.3)")
    rows = engine.sql("SELECT explode(ML_PREDICT(det, named_struct('boxes', array(array(0,0,1,1)), 'scores', array(0.5), 'labels', array(3)))) AS d")
    assert rows.first().d.label_id == 3
    engine.sql("CREATE MODEL c FLAVOR numpy MODEL_TYPE classification")
    assert engine.sql("SELECT ML_PREDICT(c, array(1D, 5D)).label_id AS k, size(array(ML_PREDICT(c, array(1D, 5D)))) AS n").first()[:] == (1, 1)


class Loads(ModelType):
    """Fails unless it is released after each load."""

    open = 0

    def load(self, spec):
        super().load(spec)
        Loads.open += 1

    def release(self):
        Loads.open -= 1

    def schema(self):
        return "int"

    def predict(self, batch):
        return [len(batch)] * len(batch)


def test_batches_release_and_plugins():
    register_model_type("numpy", "loads", Loads)
    out = list(apply_spec(ModelSpec("m", model_type="loads", options={"batch_size": "2"}), iter([[pd.Series([1, 2, None, 4])]])))
    assert out == [[2, 2, None, 1]] and Loads.open == 0
    assert list(apply_spec(ModelSpec("m", model_type="ocellus.sql.models.Norm"), iter([[pd.Series([3.0])]]))) == [[3.0]]
    with pytest.raises(SpecError):
        list(apply_spec(ModelSpec("m", model_type="nope"), iter([])))


def test_pca_and_forest():
    p = json.dumps({"mean": [1, 0], "components": [[1, 0], [0, 2]]})
    assert list(apply_spec(ModelSpec("m", model_type="pca", options={"parameters": p}), iter([[pd.Series([[3, 2]])]]))) == [[[2.0, 4.0]]]
    tree = {"feature": [0, -1, -1], "threshold": [1, 0, 0], "left": [1, 0, 0], "right": [2, 0, 0], "value": [[0, 0], [1, 0], [0, 1]]}
    f = json.dumps({"trees": [tree], "classes": [7, 9]})
    assert list(apply_spec(ModelSpec("m", model_type="random_forest_classification", options={"parameters": f}), iter([[pd.Series([0.5, 2.0])]]))) == [[7, 9]]


def test_shared_catalog(spark, tmp_path):
    uri = f"{tmp_path}/models.json"
    Engine(spark, FileCatalog(uri)).sql("CREATE MODEL m USING 'sql:{0} * 2'")
    other = Engine(spark, FileCatalog(uri))
    assert other.sql("SELECT ML_PREDICT(m, 4) AS p").first().p == 8 and other.catalog.get("m") == Model("m", "sql:{0} * 2")


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from ocellus import streaming as S

    src = f"{tmp_path}/in"
    spark.range(100).select(F.col("id").cast("double").alias("x"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), F.lit("k").alias("k")).write.parquet(src)
    engine = Engine(spark)
    engine.sql(f"CREATE MODEL lin FLAVOR numpy MODEL_TYPE linear_regression OPTIONS (parameters='{json.dumps({'coef': [2]})}')")
    S.write_stream(S.predicted(S.read_stream(spark, src, 1), engine, "lin", "x"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("lin")).first()[0] == 9900
    hourly = S.windowed(S.read_stream(spark, src), "ts", "1 hour", ["k"], "0 seconds", F.count("*").alias("n"))
    S.write_stream(hourly, f"{tmp_path}/h", f"{tmp_path}/c2").awaitTermination()
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/h").collect()] == [60]
    assert S.sessions(S.read_stream(spark, src), "ts", "5 minutes", ["k"], "1 minute", F.count("*")).isStreaming


def test_windows_of_a_stream_stay_off_the_driver(spark):
    """The result lies in files, not in the driver's memory table, each run has its own, and the session's state store is as before."""
    from ocellus.plans import queries as plans
    from ocellus.streaming import STATE_STORE

    before = spark.conf.get(STATE_STORE, None)
    one, two = (plans.r_stream_windows(spark, "/root/testdata/sf0.001") for _ in range(2))
    assert one.inputFiles() and two.inputFiles() and not set(one.inputFiles()) & set(two.inputFiles())
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and spark.conf.get(STATE_STORE, None) == before
