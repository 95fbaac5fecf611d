"""Writers; every one replaces or appends whole files, so a retry changes nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import NOT_FOUND_TEXT
from ..functions.text import SECTION_SEPARATOR


def write_records(documents: DataFrame, path: str) -> None:
    """Merged records as rows ``(line_id.., body)``, replacing an earlier merge."""
    documents.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_gaps(report: DataFrame, path: str) -> None:
    """Gap reports, one JSON object per line; the overwrite removes filled ones."""
    report.write.mode("overwrite").json(path)


def append_partials(answers: DataFrame, path: str) -> None:
    """Add answers to the partial store; readers keep the newest per key."""
    answers.write.mode("append").parquet(path)


def write_requests(requests: DataFrame, path: str, fields: list[str]) -> None:
    """One request per line as JSON; text outside ASCII stays as it is."""
    requests.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)


def write_table(wide: DataFrame, path: str, provenance: list[dict] | None = None, key: str = "line_id") -> None:
    """The wide table as CSV and as Parquet.

    Parquet keeps the ordered levels in the column metadata, and the provenance
    in that of the key column.
    """
    stored = wide
    if provenance is not None:
        block = provenance[0] if len(provenance) == 1 else {"mixed": True, "values": provenance}
        stored = wide.withMetadata(key, {"provenance": json.dumps(block, ensure_ascii=False)})
    stored.write.mode("overwrite").parquet(f"{path}/parquet")
    wide.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def complete_sections(lines: DataFrame, answers: DataFrame, key: str = "section_id") -> DataFrame:
    """Every requested line with its ``text``; one without an answer says so."""
    return lines.join(answers.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit(NOT_FOUND_TEXT)))


def write_sections(sections: DataFrame, path: str, order: list[str]) -> None:
    """``### <id>`` blocks in the order of the line list, set apart by ``---``.

    The sort spreads the blocks over ranges; the files in name order are the text.
    """
    block = F.concat(F.lit("### "), F.col("section_id"), F.lit("\n\n"), F.col("text"))
    sections.orderBy(*order).select(block.alias("value")).write.mode("overwrite").option(
        "lineSep", SECTION_SEPARATOR).text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a grouped text, one row each."""
    return spark.read.option("lineSep", SECTION_SEPARATOR).text(path)


def export_files(named: DataFrame, root: str) -> int:
    """Write one file per row ``(name, content)`` below *root*; returns the count.

    For tools that expect a file per record.  Tasks write side by side, each
    file under a temporary name first, so a repeated task leaves the same files.
    """
    binary = named.schema["content"].dataType.simpleString() == "binary"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import uuid

        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                target = posixpath.join(base, name)
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                waiting = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with store.open_output_stream(waiting) as out:
                    out.write(bytes(content) if binary else content.encode("utf-8"))
                store.move(waiting, target)
            yield pd.DataFrame({"n": [len(batch)]})
    return named.select("name", "content").mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0] or 0
