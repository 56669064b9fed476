"""Makes the engine's functions visible to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text


def register(spark: SparkSession) -> None:
    """nfc, lcs_length as Arrow UDFs; the rest as SQL functions that Catalyst expands."""
    from ..operators.scores import lcs_length

    spark.udf.register("nfc", text.nfc)
    spark.udf.register("lcs_length", lcs_length)
    ws, other = text.WS.replace("\\", "\\\\"), text.NOT_WS.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION words(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(t, '{ws}+'), w -> w <> '')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION word_count(t STRING) RETURNS INT RETURN regexp_count(t, '{other}+')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION script_ratio(t STRING, chars STRING) RETURNS DOUBLE RETURN coalesce(try_divide(regexp_count(t, chars), length(regexp_replace(t, '{ws}', ''))), 0.0D)")
