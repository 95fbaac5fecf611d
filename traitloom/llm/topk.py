"""Exact top-k search by inner product, with score histograms that close in on the kth value.

Components become whole numbers, ``floor(64 * x)``; a score is the inner product
of two such vectors, an exact integer.  Queries and candidates are dealt to
blocks of bounded size, and every block of queries meets every block of
candidates in a tile, one matrix product.  Scores are never stored:

1. A query starts with the interval that the lengths of the vectors allow.  Each
   round scores all tiles and counts, for every query, how many scores fall into
   each of ``BINS`` equal bins of its interval.  The counts of all tiles are
   added up, and the bin that holds the kth largest score is the next interval.
   A tile leaves out what lies below its own kth score, since the kth score of
   all is no lower; so it gives some k bins for each query at most.
2. Once a bin is one value wide, or few scores lie in it or above it, its lower
   end is the query's limit.  Any 64-bit range takes six rounds at most.
3. A last pass gives the candidates that reach the limit, of each tile no more
   than the k that come first by score, then by smaller id.  Ranking those
   settles ties, so reruns agree.

Vectors that are null, empty, or hold null or non-finite components, and rows
without id, take no part; vectors of different lengths don't meet.  Rows equal
in id and vector are one class with a number of copies: each copy of a query
gets its own answer, in which the other copies are candidates.  Codes and scores
beyond a long are held at its ends.  Other columns do no harm, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch
from .common import finite, groups, narrowest, whole

#: Bins of a histogram.
BINS = 4096
#: Numbers that a block of queries and one of candidates hold on average.
QUERY_CELLS, CANDIDATE_CELLS = 1 << 16, 1 << 18
#: Scores that a step inside a tile holds.
STEP_SCORES = 1 << 19
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of *a* with all rows of *b*, in a type that holds them."""
    size = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    most = size(a) * size(b) * a.shape[1]
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64  # sums stay exact integers
        return a.astype(kind) @ b.astype(kind).T
    if most <= MOST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


class Tile:
    """The rows of one tile: a block of queries and a block of candidates."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        is_query = np.array(table.column("is_query"))
        codes = np.array(table.column("codes").combine_chunks().flatten()).reshape(len(is_query), -1)
        pick = lambda name, side: np.array(table.column(name))[side]
        self.uid, self.lo, self.width = (pick(c, is_query).astype(np.int64) for c in ("uid", "lo", "width"))
        self.query_id, self.copies, self.queries = pick("vec_id", is_query), pick("n", is_query), codes[is_query]
        self.vec_id, self.n, self.candidates = pick("vec_id", ~is_query), pick("n", ~is_query), codes[~is_query]

    def reached(self, k: int, open_only: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Query, candidate, score and copies wherever a score reaches both the limit and the k best of the tile.

        Ties with the kth are all there; a query is no candidate of its own.
        """
        count = max(1, STEP_SCORES // max(1, len(self.vec_id)))
        rows = np.flatnonzero(self.width > 0) if open_only else np.arange(len(self.uid))
        for start in range(0, len(rows) if len(self.vec_id) else 0, count):
            some = rows[start:start + count]
            scores = products(self.queries[some], self.candidates)
            limit = self.lo[some].astype(scores.dtype)
            if scores.shape[1] > k + 1:  # one more, as the query itself may be among them
                limit = np.maximum(limit, np.partition(scores, -k - 1, axis=1)[:, -k - 1])
            i, j = np.nonzero(scores >= limit[:, None])
            score, i = scores[i, j].astype(np.int64), some[i]
            copies = self.n[j].copy()
            own = np.flatnonzero(self.query_id[i] == self.vec_id[j])
            copies[own] -= (self.queries[i[own]] == self.candidates[j[own]]).all(axis=1)
            there = (copies > 0) & (score >= self.lo[i])
            yield i[there], j[there], score[there], copies[there]

    def histogram(self, k: int) -> pa.RecordBatch:
        """``uid, bin, n``: how many scores of each open query fall into which bins, as far as they may hold the kth."""
        out = [(np.zeros(0, np.int64),) * 3]
        for i, _, score, copies in self.reached(k, True):
            # the difference of two longs may need 64 bits without sign
            bins = (score.view(np.uint64) - self.lo[i].view(np.uint64)) // self.width[i].astype(np.uint64)
            inside = bins < BINS
            keys, at = np.unique(i[inside] * BINS + bins[inside].astype(np.int64), return_inverse=True)
            counted = np.zeros(len(keys), np.int64)
            np.add.at(counted, at, copies[inside])
            out.append((self.uid[keys // BINS], keys % BINS, counted))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["uid", "bin", "n"])

    def best(self, k: int) -> Iterator[pa.RecordBatch]:
        """The candidates that reach a query's limit, of each query the first k."""
        for i, j, score, copies in self.reached(k, False):
            order = np.lexsort((self.vec_id[j], ~score, i))
            i, j, score, copies = i[order], j[order], score[order], np.minimum(copies[order], k)
            before = np.cumsum(copies) - copies
            first = before - before[np.searchsorted(i, i)] < k  # counted from where the rows of a query begin
            columns = [x[first] for x in (self.uid[i], self.query_id[i], self.copies[i], self.vec_id[j], copies, score)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["uid", "query_id", "copies", "vec_id", "n", "score"])


def top_k(rows: DataFrame, is_query: Column | None = None, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query among ``vec_id, embedding``.

    *is_query* says which ids are queries, by default those divisible by 20.
    """
    spark = rows.sparkSession
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"topk-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = fit.where(F.col("vec_id").isNotNull() & finite("embedding") & (F.size("embedding") > 0))
    classes = kept(narrowest(fit.select("vec_id", whole("embedding", scale).alias("codes")), "codes").groupBy("vec_id", "codes").agg(
        F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("uid"), "*", F.size("codes").alias("dim"), is_query.alias("is_query")), "classes")

    length = F.sqrt(F.aggregate("codes", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ceil_ = lambda n, cells: F.ceil(n / F.greatest(F.lit(1), F.lit(cells) / F.col("dim")))
    shape = classes.groupBy("dim").agg(F.count_if("is_query").alias("q"), F.count("*").alias("c"), F.max(length).alias("longest")).where("q > 0").select(
        "dim", ceil_(F.col("q"), QUERY_CELLS).alias("q_blocks"), ceil_(F.col("c"), CANDIDATE_CELLS).alias("c_blocks"), "longest")
    block = lambda n: F.pmod(F.xxhash64("vec_id", "codes"), F.col(n))
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    placed = classes.join(shape, "dim")
    none = F.lit(0).cast("long")
    candidates = placed.select(
        F.lit(False).alias("is_query"), none.alias("uid"), "vec_id", "n", "codes", "dim", each("q_blocks").alias("q_block"), block("c_blocks").alias("c_block"),
        none.alias("lo"), none.alias("width"))
    queries = placed.where("is_query")

    def tiles(state: DataFrame) -> DataFrame:
        own = queries.join(state, "uid").select(
            F.lit(True).alias("is_query"), "uid", "vec_id", "n", "codes", "dim", block("q_blocks").alias("q_block"), each("c_blocks").alias("c_block"), "lo", "width")
        keys = ["dim", "q_block", "c_block"]
        return candidates.unionByName(own).repartition(*keys).sortWithinPartitions(*keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["dim", "q_block", "c_block"]):
            yield Tile(table).histogram(k)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["dim", "q_block", "c_block"]):
            yield from Tile(table).best(k)

    # no score is larger than the product of the lengths
    most = F.least(F.floor(length * F.col("longest") * (1 + 1e-9)).cast("double") + 2, F.lit(float(1 << 63)))
    state = kept(queries.select(
        "uid", (-most).cast("long").alias("lo"), (F.ceil(2 * most / BINS * (1 + 1e-9)) + 1).cast("long").alias("width"), F.lit(k).cast("long").alias("need")), "state")
    while not state.where("width > 0").isEmpty():
        counts = tiles(state).mapInArrow(counted, "uid long, bin long, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("above", F.sum("n").over(Window.partitionBy("uid").orderBy(F.desc("bin"))))
        hit = upto.join(state.select("uid", "need"), "uid").where("above >= need").groupBy("uid").agg(F.max_by(F.struct("bin", "n", "above"), "bin").alias("hit"))
        # the way from one end of a long to the other is no long
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        at = (wide("lo") + wide("hit.bin") * wide("width")).cast("long")
        done = (F.col("width") <= 1) | (F.lit(k) - F.col("need") + F.col("hit.above") <= 2 * k)
        state = kept(state.join(hit, "uid", "left").select(
            "uid", F.when(F.col("hit").isNull(), F.col("lo")).otherwise(at).alias("lo"),
            # queries with fewer than k candidates take them all
            F.when(F.col("hit").isNull() | done, 0).otherwise(F.ceil(F.col("width") / BINS)).cast("long").alias("width"),
            F.coalesce(F.col("need") - F.col("hit.above") + F.col("hit.n"), "need").alias("need")), "state")

    found = tiles(state).mapInArrow(selected, "uid long, query_id long, copies long, vec_id long, n long, score long")
    found = found.select("uid", "query_id", "copies", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("_copy"))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, copies)")).alias("_copy")).drop("_copy")
