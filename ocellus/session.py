"""A session that is ready for this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ocellus.functions import register_functions
from ocellus.workers import importable


def init_session(conf: dict[str, str] | None = None, app_name: str = "ocellus", cores: int | str = "*", master: str | None = None) -> SparkSession:
    """A session with this library's SQL functions.

    A running session is kept if it has all settings of ``conf``, else stopped
    and started anew with them.  Without a ``master`` and outside of a
    submitted application it runs on ``cores`` local cores.
    """
    wanted = {k: str(v) for k, v in (conf or {}).items()}
    active = SparkSession.getActiveSession()
    if active is not None:
        held = {k: active.conf.get(k, None) or active.sparkContext.getConf().get(k) for k in wanted}
        if held != wanted:
            active.stop()
    builder = SparkSession.builder.appName(app_name).config(map={"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | wanted)
    if master or "spark.master" not in wanted:
        builder = builder.master(master or f"local[{cores}]")
    spark = importable(builder.getOrCreate())
    register_functions(spark)
    return spark
