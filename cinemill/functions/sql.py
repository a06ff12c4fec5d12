"""Some of the scalar functions by name, for SQL text. They are SQL functions, so the optimiser inlines them as it does Columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "media_resolution_tier(width BIGINT, height BIGINT) RETURNS STRING": "CASE WHEN width IS NULL OR height IS NULL THEN NULL WHEN least(width, height) >= 2160 THEN '4K+' WHEN least(width, height) >= 1080 THEN '1080p' WHEN least(width, height) >= 720 THEN '720p' WHEN least(width, height) >= 480 THEN 'SD' ELSE 'sub-SD' END",
    "media_layout_name(channels BIGINT) RETURNS STRING": "CASE channels WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE channels || 'ch' END",
    "media_extension(path STRING) RETURNS STRING": r"lower(nullif(regexp_extract(path, '\\.([^./]+)$', 1), ''))",
    "media_round4(x DOUBLE) RETURNS DOUBLE": "sign(x) * floor(abs(x) * 10000 + 0.5D) / 10000",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
