"""SQL functions for the scalar operators, as SQL user-defined functions: no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..resources import values as V


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """name(arguments) RETURNS type RETURN expression, by name."""
    redact = "t"
    for label, pattern in V.STRUCTURED_PATTERNS:
        redact = f"regexp_replace({redact}, {_lit(pattern)}, '[{label}]')"
    return {
        "ts_squeeze": r"(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\s+', ' '))",
        "ts_clean_text": "(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), "
        r"'http\\S+|www\\S+', ''), '\\S+@\\S+', ''), '[^a-z0-9\\s]', ' '), '\\s+', ' '))",
        "ts_word_count": r"(t STRING) RETURNS INT RETURN CASE WHEN length(trim(t)) > 0 THEN size(split(trim(t), '\\s+')) ELSE 0 END",
        "ts_preview": "(t STRING) RETURNS STRING RETURN concat(left(t, 50), '...')",
        "ts_regex_redact": f"(t STRING) RETURNS STRING RETURN {redact}",
        "ts_mask_all": "(t STRING, c STRING) RETURNS STRING RETURN repeat(c, length(t))",
        "ts_mask_first": "(t STRING, c STRING, n INT) RETURNS STRING RETURN concat(repeat(c, least(length(t), n)), substring(t, least(length(t), n) + 1))",
        "ts_mask_last": "(t STRING, c STRING, n INT) RETURNS STRING RETURN concat(left(t, greatest(length(t) - n, 0)), repeat(c, least(length(t), n)))",
        "ts_hash": "(t STRING, salt STRING) RETURNS STRING RETURN sha2(concat(t, coalesce(salt, '')), 256)",
        "ts_polarity_label": f"(c DOUBLE) RETURNS STRING RETURN CASE WHEN c >= {V.POLARITY_CUT}D THEN 'positive' WHEN c <= -{V.POLARITY_CUT}D THEN 'negative' ELSE 'neutral' END",
        "ts_star_bucket": "(s STRING) RETURNS STRING RETURN CASE WHEN lower(s) IN ('1 star', '2 stars') THEN 'negative' WHEN lower(s) IN ('4 stars', '5 stars') THEN 'positive' ELSE 'neutral' END",
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the functions for this session and returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
