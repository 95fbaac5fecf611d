"""SQL names for the text functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import LEAKAGE_PATTERN, SECTION_HEADER


def _text(pattern: str) -> str:
    return "r\"" + pattern.replace('"', '\\"') + "\""


def register_functions(spark: SparkSession) -> None:
    """Make ``find_leakage(text)`` and the table function ``split_sections(text)`` known to SQL.

    Both are SQL bodies, so queries that use them stay in generated code.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION find_leakage(x STRING) RETURNS ARRAY<STRING> RETURN "
        f"array_sort(array_distinct(transform(regexp_extract_all(coalesce(x, ''), {_text(LEAKAGE_PATTERN)}, 0), "
        "h -> lower(h))))")
    header = _text(SECTION_HEADER)
    ids = f"regexp_extract_all(x, {header}, 1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION split_sections(x STRING) "
        "RETURNS TABLE(pos INT, section_id STRING, body STRING) RETURN "
        f"SELECT p, z.`0`, z.`1` FROM (SELECT posexplode(arrays_zip({ids}, "
        f"slice(split(x, {header}, -1), 2, size({ids})))) AS (p, z))")
