"""Ordered passes (running totals, previous row, exact ranks) that bear hot keys.

A plain window puts every row of one key into one task.  Here the rows are first
cut into ranges by key *and* order, so a key with a third of the data covers
many ranges.  Windows then run inside one range, and only the last state of each
range is carried to the next.  The carried state is one row per range at most.
Nothing is written on the way, but for the few counts that exact ranks come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import blocks_of, bounded, settle, small_rows, sql_literal

BLOCK = "_block"


#: Rows that the split points of a range come from, about.
SAMPLED = 64


def split_points(df: DataFrame, columns: list[str], n: int) -> list[Row]:
    """At most *n* - 1 rows that cut the rows, ordered by *columns*, into ranges of about equal size.

    They come from a sample by hash, so every run over the same rows gives the
    same ones.  Its size follows *n*, not the rows: some ``SAMPLED`` a range
    reach the driver.
    """
    count, wanted = df.count(), n * SAMPLED
    # the upper 63 bits of a hash are spread evenly
    below = min((1 << 63) - 1, (wanted << 63) // max(1, count))
    some = df.select(*columns).where(F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(below)) if count > wanted else df.select(*columns)
    rows = some.distinct().orderBy(*columns).collect()
    return [rows[len(rows) * i // n] for i in range(1, n)] if len(rows) >= n else rows[1:]


def in_blocks(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of the range they fall in."""
    columns = list(dict.fromkeys([*key, *order]))
    return between_points(df, columns, split_points(df, columns, blocks_of(df.sparkSession)))


def between_points(df: DataFrame, columns: list[str], points: list[Row]) -> DataFrame:
    """Rows with the number of the range between *points* that they fall in.

    Ranges are cut at fixed points, which stand in the plan as literals, so each
    use of the result finds a row in the same range without any copy of the
    rows.  A row searches its range among the points by halving.
    """
    if not points:
        return df.withColumn(BLOCK, F.lit(0))
    kind = ",".join(f"c{i}:{df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    literal = lambda row: F.struct(*[sql_literal(v).alias(f"c{i}") for i, v in enumerate(row)])
    # in order as they come; a sort here would run again for each row and step
    cuts = F.array(*map(literal, points)).cast(f"array<struct<{kind}>>")
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        there = at + step
        return F.when((there <= len(points)) & (F.get(cuts, there - 1) <= own), there).otherwise(at)

    return df.withColumn(BLOCK, F.aggregate(steps, F.lit(0), halve))


def scan(
    df: DataFrame,
    key: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sums, running minima and previous values per key.

    *order* must name columns that, with the key, make rows distinct.  Each
    output covers the rows up to and with the current one; *previous* gives the
    value of the row before, NULL for the first row of a key.
    """
    sums, mins, previous = sums or {}, mins or {}, previous or {}
    rows = df
    for name, c in {**sums, **mins}.items():
        rows = rows.withColumn(f"_in_{name}", c)
    columns = list(dict.fromkeys([*key, *order]))
    points = split_points(df, columns, blocks_of(df.sparkSession))
    rows = between_points(rows, columns, points)

    upto = Window.partitionBy(*key, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*key, BLOCK).orderBy(*order)
    local = rows.select(
        "*",
        *[F.sum(f"_in_{n}").over(upto).alias(f"_l_{n}") for n in sums],
        *[F.min(f"_in_{n}").over(upto).alias(f"_l_{n}") for n in mins],
        *[F.lag(c).over(step).alias(f"_l_{n}") for n, c in previous.items()],
        F.row_number().over(step).alias("_at"),
    )

    last = F.struct(*[F.col(c) for c in order])
    # A key in several ranges is that of a point between them: one row per range at most.
    cut = df.sparkSession.createDataFrame(
        list(dict.fromkeys(tuple(p[c] for c in key) for p in points)), df.select(*[F.col(k).alias(f"_cut_{i}") for i, k in enumerate(key)]).schema)
    crossing = rows.join(F.broadcast(cut), [rows[k].eqNullSafe(cut[f"_cut_{i}"]) for i, k in enumerate(key)], "left_semi")
    per_block = crossing.groupBy(*key, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_in_{n}").alias(f"_b_{n}") for n in sums],
        *[F.min(f"_in_{n}").alias(f"_b_{n}") for n in mins],
        *[F.max_by(F.col(c), last).alias(f"_b_{n}") for n, c in previous.items()],
    )
    earlier = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy(*key).orderBy(BLOCK)
    carried = per_block.select(
        *key, BLOCK,
        F.row_number().over(by_block).alias("_nth"),
        *[F.sum(f"_b_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_b_{n}").over(earlier).alias(f"_c_{n}") for n in mins],
        *[F.lag(f"_b_{n}").over(by_block).alias(f"_c_{n}") for n in previous],
    ).where("_nth > 1").drop("_nth")
    # Only the first key of a range can go on from an earlier one, so this side
    # has at most one row per range.
    joined = local.join(
        F.broadcast(carried),
        [local[k].eqNullSafe(carried[k]) for k in key] + [local[BLOCK] == carried[BLOCK]],
        "left",
    )
    out = [local[c] for c in df.columns]
    for n in sums:
        out.append(
            (F.coalesce(local[f"_l_{n}"], F.lit(0)) + F.coalesce(carried[f"_c_{n}"], F.lit(0))).alias(n)
        )
    for n in mins:
        out.append(F.least(local[f"_l_{n}"], carried[f"_c_{n}"]).alias(n))
    for n in previous:
        out.append(F.when(local["_at"] == 1, carried[f"_c_{n}"]).otherwise(local[f"_l_{n}"]).alias(n))
    return joined.select(*out)


def row_numbers(df: DataFrame, key: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Exact 1-based position of each row within its key."""
    return scan(df, key, order, sums={name: F.lit(1).cast("long")})


#: Relative error of the sketch that encloses a rank, as one over this number.
ACCURACY = 10_000
#: Types whose values a sketch of doubles keeps as they are.
_EXACT = ("double", "float", "int", "smallint", "tinyint")


def _around_ranks(rows: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame | None:
    """Rows counted by value near the ranks *qs* and by stretch elsewhere, or None.

    A sketch gives each rank two values that enclose it, so only about four in
    ``ACCURACY`` rows keep their value.  All between two enclosures count as one
    entry, ``_out``, placed after the last bound below.  Groups so small that a
    bound could be off by one rank keep all values.  Only for few groups, and
    types that the sketch keeps exactly.
    """
    if rows.schema[value].dataType.simpleString() not in _EXACT:
        return None
    margin = 2 / ACCURACY
    ends = [min(1.0, max(0.0, q + d)) for q in sorted(set(qs)) for d in (-margin, margin)]
    bounds = rows.groupBy(*group).agg(
        (F.count(F.lit(1)) <= 2 * ACCURACY).alias("_all_in"), F.min(value).alias("_least"),
        F.percentile_approx(value, [float(e) for e in ends], ACCURACY).alias("_ends"))
    few = small_rows(bounds)
    if not few:
        return None
    bounds = rows.sparkSession.createDataFrame(few, bounds.schema)
    v = F.col(value)
    near = F.col("_all_in")
    for i in range(0, len(ends), 2):
        near = near | v.between(F.col("_ends")[i], F.col("_ends")[i + 1])
    below = F.coalesce(F.array_max(F.filter("_ends", lambda e: e <= v)), F.col("_least"))
    found = rows.select(*group, value).join(F.broadcast(bounds), [rows[g].eqNullSafe(bounds[g]) for g in group])
    return settle(found.select(*[rows[g] for g in group], F.when(near, v).otherwise(below).alias("_v"), (~near).alias("_out"))
                  .groupBy(*group, "_v", "_out").agg(F.count(F.lit(1)).alias("_c")))


def quantiles(
    df: DataFrame, value: str, qs: list[float], by: list[str], interpolate: bool
) -> DataFrame:
    """Exact quantiles per group as ``(by.., n, q, value)``.

    Nearest rank takes position ``round_half_even((n - 1) * q)``; with
    *interpolate* the two neighbours are mixed.  With few groups, two passes over
    the rows leave only what lies near the ranks (``_around_ranks``); otherwise
    rows are counted per distinct value, so repeats never leave their map task.
    What is ranked is spread over ranges, so no group is gathered anywhere.
    """
    group = by or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    counts = _around_ranks(rows, group, value, qs)
    if counts is None:
        counts = rows.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.lit(False).alias("_out"))
    ranked = scan(counts, group, ["_v", "_out"], sums={"_upto": F.col("_c")})
    # The last running count of a group is its size; few groups are broadcast,
    # many are joined by a shuffle that Spark splits where a group is hot.
    totals = bounded(ranked.groupBy(*group).agg(F.max("_upto").alias("n")))
    position = (F.col("n") - 1) * F.col("q")
    wanted = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    if interpolate:
        wanted = wanted.withColumn("_lo", F.floor(position)).withColumn("_hi", F.ceil(position))
    else:
        nearest = F.bround(position, 0).cast("long")
        wanted = wanted.withColumn("_lo", nearest).withColumn("_hi", nearest)
    first = F.col("_upto") - F.col("_c")
    covers_lo = (F.col("_lo") >= first) & (F.col("_lo") < F.col("_upto"))
    covers_hi = (F.col("_hi") >= first) & (F.col("_hi") < F.col("_upto"))
    hits = ranked.join(wanted, group).where(covers_lo | covers_hi)
    # Not a filter, which would move below the join and meet all rows.
    held = F.when(F.col("_out"), F.raise_error(F.lit("a rank lies outside its bounds")).cast(df.schema[value].dataType)).otherwise(F.col("_v"))
    out = hits.groupBy(*group, "n", "q").agg(
        F.max(F.when(covers_lo, held)).alias("_a"),
        F.max(F.when(covers_hi, held)).alias("_b"),
    )
    share = position - F.floor(position)
    mixed = F.col("_a") + (F.col("_b") - F.col("_a")) * share if interpolate else F.col("_a")
    return out.select(*by, "n", "q", mixed.alias("value"))
