"""Helpers that several operators share: words, batches, safe column names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A word, in Java's regular expressions and in the query contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that one step inside a task handles together.
STEP_CHARS = 1_000_000


def free_name(df: DataFrame, wanted: str) -> str:
    """*wanted*, or a longer name that no column of *df* has (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def through_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: list[T.StructField]) -> DataFrame:
    """All columns of *df* and the *added* ones, as *run* gives them batch by batch.

    Columns whose names are no plain words are known by others on the way.
    """
    plain = [c if re.fullmatch(r"\w+", c) else free_name(df, f"_column_{i}") for i, c in enumerate(df.columns)]
    fields = [T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields)]
    return df.toDF(*plain).mapInArrow(run, T.StructType([*fields, *added])).toDF(*df.columns, *(f.name for f in added))


def steps(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded text, so that memory follows one slice.

    A text longer than the limit is a slice of its own.
    """
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if len(lengths) > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # what this task no longer needs goes back before the next one


def texts(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        cuts = [0]
        if batch.num_rows > 1:
            change = None
            for c in columns:
                differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                change = differs if change is None else pc.or_(change, differs)
            cuts += [i + 1 for i in pc.indices_nonzero(change).to_pylist()]
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
            key = tuple(c[start].as_py() for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def finite(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    sound = F.forall(vector, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(sound, F.lit(False))


def whole(vector: str, scale: float) -> Column:
    """``floor(scale * x)`` of each component as a long, held at a long's ends."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def narrowest(df: DataFrame, codes: str) -> DataFrame:
    """The same rows with *codes* (longs) in the smallest type that holds them all; reads the rows once."""
    ends = df.select(F.min(F.array_min(codes)).alias("lo"), F.max(F.array_max(codes)).alias("hi")).first()
    for name, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
        if ends.lo is None or (ends.lo >= -(1 << bits) and ends.hi < 1 << bits):
            return df.withColumn(codes, F.col(codes).cast(f"array<{name}>"))
    return df
