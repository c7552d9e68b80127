"""The library's functions for SQL users, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from colloquy.functions import udfs

#: name: parameters, type, body.
FUNCTIONS = {
    "token_estimate": ("text string", "bigint", r"cast(ceil((length(regexp_replace(text, r'[^\x00-\x7F]', '')) * 7 + (octet_length(text) - length(regexp_replace(text, r'[^\x00-\x7F]', ''))) * 8) / 20) as bigint)"),
    "content_budget": ("context bigint, overhead bigint", "bigint", "greatest(256, context - least(4096, context div 4) - overhead - 64)"),
    "clock": ("seconds double", "string", "case when seconds is null then '[--:--]' else format_string('[%02d:%02d]', cast(floor(seconds / 60) as bigint), cast(floor(seconds) as bigint) % 60) end"),
    "letters": ("text string", "bigint", r"cast(length(regexp_replace(text, r'[^\p{L}]', '')) as bigint)"),
    "ascii_lower": ("text string", "string", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql``; the fingerprint, which SQL can't express, is an Arrow function."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udf.register("fnv1a", F.pandas_udf(udfs.fnv1a.__wrapped__, "string"))
