"""Session settings the library relies on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: UTC for epoch bounds; ANSI stays on, so every cast of data is a try_cast.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "rulesieve", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_rows(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver as a table that is part of the plan.

    A list given to ``createDataFrame`` is dealt over all cores, and each of them
    starts Python to read its part, empty ones too.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = fields.names
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=to_arrow_schema(fields)), fields)
