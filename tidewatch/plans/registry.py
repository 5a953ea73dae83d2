"""Every registered query and its SQL, by key. Queries run over whole tables; doubles are rounded to six places on
both sides, because sums may be added in another order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def query(sql: str | None = None, doubles: str = ""):
    """Registers a function under its name, with the SQL of the same result; doubles are the columns SQL rounds."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return rounded(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            body = sql.strip()
            parts = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[f.__name__] = f"SELECT * REPLACE ({parts}) FROM ({body})" if parts else body
        return f

    return add


from tidewatch.plans import composed_queries, count_queries, dataset_queries, emission_queries, event_queries, rate_queries, record_queries, score_queries, signal_queries, stream_queries, study_queries, tracking_queries, window_queries  # noqa: E402, F401
