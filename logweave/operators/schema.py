"""The entry schema and how a DataFrame gets into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, MapType, StringType, StructField, StructType, TimestampType

_KINDS = {"seq": LongType(), "ts": TimestampType(), "metadata": MapType(StringType(), StringType()), "ts_inferred": BooleanType()}
_NAMES = ("seq", "ts", "level", "message", "metadata", "source", "request_id", "user_id", "session_id", "trace_id", "job_id", "ts_inferred", "format", "raw")
ENTRY = StructType([StructField(n, _KINDS.get(n, StringType())) for n in _NAMES])


def as_entries(df: DataFrame) -> DataFrame:
    """Add what is missing of the entry schema, cast the rest, and add ``ms`` (epoch milliseconds, floored)."""
    defaults = {"level": F.lit("info"), "ts_inferred": F.lit(False), "metadata": F.create_map().cast("map<string,string>"), "raw": F.col("message") if "message" in df.columns else F.lit(None)}
    columns = []
    for field in ENTRY.fields:
        value = F.col(field.name) if field.name in df.columns else defaults.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns).withColumn("ms", F.unix_millis("ts"))
