"""Removal of word windows that occur more than once, behind a count-min sketch.

1. Every task counts the anchors of its texts in a count-min sketch: each falls
   on one cell in each of ``DEPTH`` rows, and cells only ever count too much.
   Partial sketches travel as lists of cells and are merged cell by cell.
2. An anchor all of whose cells counted twice is estimated repeated.  A window
   cannot occur more often than its anchor, so no repeated window is lost.
3. Only windows around such anchors are grouped, exactly, by their words.

The merged sketch has one bit for each cell, ``DEPTH * MAX_CELLS / 8`` bytes at
most (16 MB), which bounds the broadcast; a fuller sketch rules out less and
stays right.  Its width follows the amount of text up to that bound.

Words are cut at ASCII white space and otherwise unchanged.  Null and empty
texts have no words.  Rows that agree in id and text are one document, stated
more than once: each gets its result.  A missing id is an id of its own for
each text.  Other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch
from . import anchors
from .common import groups, steps, texts
from .shingles import mix, word_hashes

WINDOW, PIECE = 35, 16
DEPTH = 2
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 26
#: Cells of a sketch row that travel and merge together.
SHARD = 1 << 20


def tokens(many: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in many]
    every = word_hashes([w for words in split for w in words])
    return np.split(every, np.cumsum([len(w) for w in split])[:-1]) if split else []


SHAPE = anchors.Shape(WINDOW, PIECE, tokens)


def cells(h: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell of each hash in every row of the sketch."""
    for row in range(DEPTH):
        yield (mix(h + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) & np.uint64(width - 1)).astype(np.int64)


def width_for(n_bytes: int) -> int:
    """Cells in a row: about three for each anchor expected, a power of two within the bounds."""
    expected = n_bytes / 6.5 * 2 / (WINDOW - PIECE + 1)
    return int(min(MAX_CELLS, max(MIN_CELLS, 1 << int(3 * expected).bit_length())))


def sketch(rows: DataFrame, width: int) -> list[np.ndarray]:
    """For each row of the sketch, one bit a cell: whether it counted twice or more."""
    shard = min(SHARD, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", anchors.PIECE * 4):
            found = [h for _, _, h, _, _ in anchors.anchors(SHAPE, tokens(texts(batch, "text")))]
            for row, cell in enumerate(cells(np.concatenate(found), width) if found else ()):
                at, n = np.unique(cell, return_counts=True)
                part = at // shard
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                stops = np.append(cuts[1:], len(at))
                # an odd number stands for a cell that counted more than once here
                packed = ((at % shard) * 2 + (n > 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cuts), row), pa.int32()), pa.array(part[cuts], pa.int32()),
                    pa.array([packed[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())], ["row", "part", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["row", "part"]):
            once, twice = np.zeros(shard, bool), np.zeros(shard, bool)
            for packed in table.column("cells"):
                cell = np.frombuffer(packed.as_buffer(), np.uint32)
                at = cell >> 1
                twice[at] |= once[at] | (cell & 1).astype(bool)
                once[at] = True
            yield pa.RecordBatch.from_arrays([
                table.column("row").slice(0, 1).combine_chunks(), table.column("part").slice(0, 1).combine_chunks(),
                pa.array([np.packbits(twice).tobytes()], pa.binary())], ["row", "part", "bits"])

    partial = rows.mapInArrow(count, "row int, part int, cells binary")
    merged = partial.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(merge, "row int, part int, bits binary")
    out = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)]
    for r in merged.collect():  # DEPTH * width / 8 bytes
        start = r.part * (shard // 8)
        out[r.row][start:start + shard // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def compare(columns: dict[str, np.ndarray], packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur twice or more among the contexts of one anchor."""
    n, span = len(packed), 2 * WINDOW - PIECE
    reach = WINDOW - PIECE
    size = np.array([len(p) // 8 for p in packed])
    left, group = columns["left"], np.cumsum(anchors._changes(columns["h"]))
    grid = np.zeros((n, span), np.uint64)
    # all contexts in one grid, the anchor in the same place
    flat = np.frombuffer(b"".join(packed), np.uint64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    grid[np.repeat(np.arange(n), size), inside + np.repeat(reach - left, size)] = flat
    rows, offsets = [], []
    for offset in range(reach + 1):
        has = np.flatnonzero((left >= offset) & (size - left >= WINDOW - offset))
        if not len(has):
            continue
        value = np.zeros(len(has), np.uint64)
        for j in range(reach - offset, reach - offset + WINDOW):
            value = (value ^ grid[has, j]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        order = np.lexsort((value, group[has]))
        at = has[order]
        new = anchors._changes(value[order], group[at])
        number = np.cumsum(new) - 1
        repeated = np.bincount(number, columns["n"][at])[number] > 1
        rows.append(at[repeated])
        offsets.append(np.full(int(repeated.sum()), offset))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(offsets)


def marked(docs: DataFrame, text: str = "text", hot: int = anchors.HOT) -> DataFrame:
    """``doc, tie, spans`` of words inside repeated windows (spans may overlap)."""
    spark = docs.sparkSession
    rows = anchors.keyed(docs, text)
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = width_for(n_bytes)
    bits = spark.sparkContext.broadcast(sketch(rows, width))

    def repeated(h: np.ndarray) -> np.ndarray:
        keep = np.ones(len(h), bool)
        for row, cell in zip(bits.value, cells(h, width)):
            keep &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return keep

    path = scratch(spark, "windows-instances")
    anchors.sorted_out(anchors.instances(rows, SHAPE, repeated), SHAPE, True).write.parquet(path)
    found = spark.read.parquet(path)
    settled = found.where("h is null").select("doc", "tie", F.col("pos").alias("start"), F.col("right").alias("stop"))
    rest = anchors.resolved(found, rows, SHAPE, np.ndarray.tobytes, lambda b: np.frombuffer(b, np.uint64), compare, True, hot)
    return anchors.joined_spans(settled.unionAll(rest))


def without_repeats(docs: DataFrame, text: str = "text", hot: int = anchors.HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: ``kept`` holds the words left, joined by blanks."""
    joined = anchors.keyed(docs, text, "doc_id").join(marked(docs, text, hot), ["doc", "tie"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            total, removed, kept = [], [], []
            for t, spans in zip(texts(batch, "text"), batch.column("spans")):
                words = t.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
                total.append(len(words))
                if spans.is_valid:
                    start, stop = anchors.union_runs(*(np.array(spans.values.field(k)) for k in ("start", "stop")))
                    removed.append(int((stop - start).sum()))
                    edges = [0, *np.column_stack([start, stop]).ravel().tolist(), len(words)]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return joined.mapInArrow(run, schema)

