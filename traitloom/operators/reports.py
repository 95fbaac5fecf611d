"""Grouped texts: put sections together, take reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import extract_report
from ..sources.scans import split_sections
from .ordered import row_numbers


def assemble_text(df: DataFrame, key: list[str], order: list[str], text: str, sep: str = "\n") -> DataFrame:
    """``(key.., text)``: the texts of a key in order, joined by *sep*.

    The result is one cell for each key, so a key's text must fit into a cell;
    what has no such bound goes through :func:`ordered_texts` and is joined by
    the sink (``write_sections``), where no task gathers a key.
    """
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(pieces, lambda p: p["_text"]), sep).alias("text"))


def ordered_texts(df: DataFrame, key: list[str], order: list[str], text: str) -> DataFrame:
    """``(key.., pos, text)``: the texts of a key numbered in order, one row each."""
    numbered = row_numbers(df.select(*key, *order, text), key, order, "pos")
    return numbered.select(*key, (F.col("pos") - 1).alias("pos"), F.col(text).alias("text"))


def extract_reports(df: DataFrame, text: str, doc: list[str]) -> DataFrame:
    """The report of every section of each text; ``is_empty`` where there is none."""
    sections = split_sections(df, text, doc)
    reports = sections.withColumn("report", extract_report(F.col("body"))).drop("body")
    return reports.withColumn("is_empty", F.col("report") == "")
