"""Near copies of texts by HyperMinHash registers.

A text's set holds its distinct shingles of five words, or one shingle of all
its words if there are fewer.  One hash of each shingle gives a bucket (7 bits)
and a value; a bucket's register keeps the smallest value as leading zeros and
ten mantissa bits.  Empty buckets borrow the register of a bucket drawn by a
fixed sequence, so small sets keep the collision rate of their similarity.

1. Texts with equal sets become one class, represented by its smallest id.
2. Bands of four registers put classes into buckets; every member is compared
   with the bucket's smallest one, first by the collision-corrected estimate,
   then by the full sets.  Links give components.
3. A bucket whose members are still in several components is open: all pairs of
   different components are compared in tiles of bounded size, each pair in the
   first band that it shares.  Only pairs that pass go on to the full sets.

So no list of all pairs is made.  A link with similarity of at least 0.85 is
missed by all 32 bands with a probability of 6e-11 (0.8: 5e-8), and by the
estimate's margin with about 5e-8; for sets of fewer than ``FEW`` shingles the
margin is eight standard deviations.

Null and empty texts have no shingles and link with nothing.  A row without id
links with nothing and stays.  Repeated rows get equal results; rows that share
an id and differ in text count as texts of their own; an empty table gives an empty result; other columns do
no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import scratch
from .common import groups, steps, texts
from .components import components
from .shingles import shingle_sets

REGISTERS = 128
ROWS = 4
MANTISSA = 10
#: Chance that registers of different smallest values agree.
COLLISION = 0.17 * 2.0 ** -MANTISSA
#: How far the estimate of sets that fill most registers may fall short: five standard deviations at 0.85.
MARGIN = 0.17
#: Shingles below which sets fill few registers, and standard deviations that their estimate may fall short.
FEW, DEVIATIONS = 32, 8
#: Members of a bucket, and bytes of their shortened sets, that one side of a tile holds on average.
TILE = 640
TILE_BYTES = 32 << 20
#: Characters of text that a task hashes at a time.
STEP = 400_000
_EMPTY = 0xFFFF


def _probes() -> np.ndarray:
    """For each register the order in which it asks others, all of them once."""
    rng = np.random.default_rng(97)
    return np.array([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


PROBES = _probes()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers of sorted shingle sets, one row each."""
    out = np.full((len(sets), REGISTERS), _EMPTY, np.uint16)
    shift = np.uint64(64 - (REGISTERS.bit_length() - 1))
    rows, buckets, values = [], [], []
    for i, s in enumerate(sets):
        if len(s):
            b = s >> shift
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            rows.append(np.full(len(first), i))
            buckets.append(b[first])
            values.append(s[first])
    if not rows:
        return out
    row, bucket, value = np.concatenate(rows), np.concatenate(buckets).astype(np.int64), np.concatenate(values)
    value = (value & ((np.uint64(1) << shift) - np.uint64(1))) | np.uint64(1)
    zeros = int(shift) - np.frexp(value.astype(np.float64))[1].astype(np.int64)  # leading zeros
    zeros = np.maximum(zeros, 0)
    top = (value << zeros.astype(np.uint64)) >> np.uint64(int(shift) - 1 - MANTISSA)
    out[row, bucket] = (np.minimum(zeros, 62) << MANTISSA | (top & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)).astype(np.uint16)
    own = out.copy()
    some = np.array([len(s) > 0 for s in sets])
    for t in range(REGISTERS):
        open_ = np.flatnonzero(some & (out == _EMPTY).any(axis=1))
        if not len(open_):
            break
        asked = own[np.ix_(open_, PROBES[:, t])]
        part = out[open_]
        out[open_] = np.where(part == _EMPTY, asked, part)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, corrected for chance."""
    return ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION)


def slack(n: np.ndarray) -> np.ndarray:
    """How far the estimate may fall short of the similarity (0.8 or more) of sets with *n* shingles.

    Small sets fill few registers, which the others borrow, so fewer count; the
    estimate of sets of some 12 shingles or less drops nothing.
    """
    return np.where(n < FEW, DEVIATIONS * np.sqrt(0.16 / (REGISTERS * -np.expm1(-np.maximum(n, 1) / REGISTERS))), MARGIN)


def _jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common, len(both) - common


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, registers`` of every row; digest is null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text, STEP):
            sets = list(shingle_sets(texts(batch, text)))
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, regs)], pa.binary())],
                ["doc_id", "n_shingles", "digest", "registers"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _sets(rows: DataFrame) -> DataFrame:
    """``node, registers, shingles`` of rows ``node, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            sets = list(shingle_sets(texts(batch, "text")))
            regs = [r.tobytes() for r in registers(sets)]
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.array(regs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "registers", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, registers binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose estimate and then full sets reach *percent*."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("shingles").alias(f"s{x}"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")]
            sizes = np.minimum(*(np.array(pc.binary_length(batch.column(c))) // 8 for c in ("sa", "sb")))
            keep = []
            for i in np.flatnonzero(estimate(*regs) >= percent / 100 - slack(sizes)):
                a, b = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), np.uint64) for c in ("sa", "sb"))
                common, union = _jaccard(a, b)
                if 100 * common >= percent * union:
                    keep.append(int(i))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(run, "a long, b long")


def _tile_pairs(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Pairs of one tile that pass on shortened sets, as few as connect what they connect."""
    node = np.array(table.column("node"))
    band, lo, hi = (table.column(c)[0].as_py() for c in ("band", "lo", "hi"))
    part, comp = np.array(table.column("part")), np.array(table.column("component"))
    regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(node), REGISTERS)
    bands = np.ascontiguousarray(regs).view(np.uint64)
    sets = [np.frombuffer(x, np.uint32) for x in table.column("short").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    short_by = slack(sizes)
    found: list[tuple[float, int, int]] = []
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    for i in left:
        others = right[(right > i) if lo == hi else np.ones(len(right), bool)]
        others = others[comp[others] != comp[i]]
        if band and len(others):
            others = others[~(bands[others, :band] == bands[i, :band]).any(axis=1)]
        # sets whose sizes are too far apart can't be similar enough; shortened ones may be a little smaller
        fewer, more = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[101 * (fewer + 1) >= percent * more]
        if len(others):
            near = estimate(regs[others], regs[i])
            good = near >= percent / 100 - np.maximum(short_by[others], short_by[i])
            found += [(float(e), int(i), int(j)) for e, j in zip(near[good], others[good])]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for _, i, j in sorted(found, reverse=True):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x == y:
            continue
        common, union = _jaccard(sets[i], sets[j])
        # shortened hashes may collide: a little below the limit is passed on, well above it is certain
        if 200 * common >= (2 * percent - 1) * union:
            out.append((int(node[i]), int(node[j])))
            if 200 * common >= (2 * percent + 1) * union:
                root[x] = y
    return out


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs in buckets that still hold several components."""
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.unique((np.frombuffer(s, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for s in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("registers"), pa.array(short, pa.binary())], ["node", "registers", "short"])

    parts = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n_shingles") * 4 / TILE_BYTES))
    sizes = members.groupBy("key").agg(parts.alias("parts"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").drop("c0", "c1")
    tiles = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")))
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    tiles = tiles.select("key", "band", "node", "component", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    short = sets.mapInArrow(shorten, "node long, registers binary, short binary")
    rows = tiles.join(short, "node").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["key", "lo", "hi"]):
            pairs = _tile_pairs(table, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*pairs)], ["a", "b"])

    return rows.select("key", "lo", "hi", "band", "node", "component", "part", "registers", "short").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents link where ``100 * intersection >= percent * union`` of their sets.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"minhash-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    signed = kept(signatures(docs, text), "signatures")
    known = signed.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"))
    # one row for each class: the row of its smallest id
    first = known.join(classes.withColumnsRenamed({"digest": "_digest"}), (F.col("digest") == F.col("_digest")) & (F.col("doc_id") == F.col("node")))
    first = first.groupBy("node", "digest").agg(F.min("registers").alias("registers"), F.min("n_shingles").alias("n_shingles"))
    n_bands = REGISTERS // ROWS
    bands = first.select("node", "n_shingles", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.xxhash64(b, F.substr("registers", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    members = kept(bands.join(buckets, "key").select("key", "band", "node", "n_shingles", "least"), "members")

    source = docs.select(F.col("doc_id").alias("node"), F.col(text).alias("text"))
    sets = kept(_sets(source.join(members.select("node").distinct(), "node")), "sets")
    stars = members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    links = kept(_confirmed(stars, sets, percent), "links")
    placed = members.join(components(links), "node", "left").select("key", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    more = _confirmed(_open_pairs(placed, sets, percent), sets, percent)
    found = classes.join(components(links.unionAll(more)), "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    out = signed.join(found, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
