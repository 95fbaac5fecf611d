"""Near copies among vectors by int8 tile products with rigorous error bounds.

Vectors are compared when their labels are equal and not null.  Equal vectors
of a label become one class first.  The classes of a label are dealt to parts
of bounded size, and every pair of parts is a tile:

* each unit vector u is rounded to s * q with int8 q, and the length of what
  rounding lost, e = |u - s q|, is kept with it;
* |u.v - s_u s_v q_u.q_v| <= e_u + e_v + e_u e_v holds for every pair, so
  integer products rule out all pairs whose upper bound is below the limit;
* the rest is computed anew from the given numbers in double precision.

A tile gives one sum of link counts for each class and only as many links as
connect what it connects, never all its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do rows without label or id; vectors of different lengths
don't link.  Rows that share an id count as vectors of their own.  Repeated
rows link with each other.  Other columns do no harm, and an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch
from .common import groups
from .components import components

#: Classes that one side of a tile holds on average.
PART = 1024
#: Slack for rounding in the bounds and products themselves.
SLACK = 1e-6
#: Pairs computed in full precision at a time.
PAIRS = 200_000


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and rounding losses of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - scale[:, None] * codes, axis=1)


def possible(left: tuple, right: tuple, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose upper bound reaches the limit."""
    (qa, sa, ea), (qb, sb, eb) = left, right
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums stay exact integers
    product = qa.astype(kind) @ qb.astype(kind).T
    bound = product * sa[:, None] * sb[None, :] + ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :]
    return np.nonzero(bound >= limit - SLACK)


def tile(vectors: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Link counts of all rows, and links enough to connect them; left and right are equal or disjoint."""
    length = np.linalg.norm(vectors, axis=1)
    codes = quantised(vectors / length[:, None])
    counts = np.zeros(len(vectors), np.int64)
    links: list[tuple[int, int]] = []
    root = list(range(len(vectors)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    i, j = possible(*(tuple(c[side] for c in codes) for side in (left, right)), limit)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    for start in range(0, len(i), PAIRS):
        a, b = i[start:start + PAIRS], j[start:start + PAIRS]
        near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (length[a] * length[b]) >= limit
        a, b = a[near], b[near]
        np.add.at(counts, a, weight[b])
        np.add.at(counts, b, weight[a])
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((x, y))
    return counts, links


def near_copies(rows: DataFrame, limit: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding, label``."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    path = scratch(spark, "vector-classes")
    rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).write.parquet(path)
    classes = spark.read.parquet(path)

    kinds = classes.withColumn("dim", F.size("embedding"))
    parts = kinds.groupBy("label", "dim").agg(F.ceil(F.count("*") / PART).alias("parts"))
    tiles = kinds.join(parts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("embedding"), F.col("parts")))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    keys = ["label", "dim", "lo", "hi"]
    tiles = tiles.select("label", "dim", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "n", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            table = table.combine_chunks()
            node, weight, part = (np.array(table.column(c)) for c in ("node", "n", "part"))
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            vectors = np.array(table.column("embedding").combine_chunks().flatten(), np.float64).reshape(len(node), -1)
            left = np.flatnonzero(part == lo)
            counts, links = tile(vectors, weight, left, left if lo == hi else np.flatnonzero(part == hi), limit)
            some = np.flatnonzero(counts)
            a, b = (node[[x[k] for x in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([node[some], a]), pa.int64()),
                pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
                pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]), pa.int64())], ["a", "b", "n"])

    found = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")
    path = scratch(spark, "vector-links")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    placed = classes.join(counts, "node", "left").join(components(found.where("b is not null").select("a", "b")), "node", "left").select(
        "label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where(fit).join(placed, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
