"""Request planning: subjects with shards, resume, order, size, packing, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import REQUEST_FILE_GUARD
from ..functions.values import custom_id
from ..session import blocks_of, bounded, scratch, small_rows, sql_literal
from .ordered import BLOCK, in_blocks, scan


def each_with(lines: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every row of *lines* with every row of a dimension.

    A dimension of proven size becomes an array in the plan that each line
    unfolds in place: no join and no shuffle.  A larger one is copied to each of
    a fixed number of line slices and joined on the slice number.
    """
    rows = small_rows(dimension)
    if rows is not None:
        if not rows:
            return lines.limit(0).join(dimension.limit(0), F.lit(True))
        items = F.array(*[sql_literal(r) for r in rows])
        unfolded = lines.withColumn("_d", F.explode(items))
        return unfolded.select(
            *lines.columns,
            *[F.col(f"_d.{f.name}").cast(f.dataType).alias(f.name) for f in dimension.schema],
        )
    n = blocks_of(lines.sparkSession) * 4
    sliced = lines.withColumn("_slice", F.pmod(F.xxhash64(*lines.columns), F.lit(n)))
    copies = dimension.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return sliced.join(copies, "_slice").drop("_slice")


def plan_requests(lines: DataFrame, shards: DataFrame) -> DataFrame:
    """One request per line and shard with its ``custom_id``."""
    planned = each_with(lines, shards)
    return planned.withColumn("custom_id", custom_id(F.col("line_id"), F.col("shard_id")))


def plant_major(requests: DataFrame, key: str = "line_id", order: str = "shard_ord") -> DataFrame:
    """All requests of a line side by side and in shard order, lines spread out."""
    return requests.repartition(key).sortWithinPartitions(key, order)


def first_plants(df: DataFrame, n: int, key: str = "line_id") -> DataFrame:
    """All rows of the first *n* lines in sorted order."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def manifest_order(df: DataFrame, shards: DataFrame, line: str = "line_id") -> DataFrame:
    """Rows by line and manifest position; shards the manifest lacks come last."""
    known = shards.select("shard_id", F.col("shard_ord").alias("_pos"))
    ranked = df.join(bounded(known), "shard_id", "left")
    return ranked.orderBy(line, F.col("_pos").asc_nulls_last(), "shard_id").drop("_pos")


def pending(requests: DataFrame, partials: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Requests with no usable partial yet."""
    key = key or ["custom_id"]
    return requests.join(partials.select(*key).distinct(), key, "left_anti")


def split_uploads(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """Images with the id of an earlier upload, and whether there is one."""
    known = manifest.groupBy("path").agg(F.max("file_id").alias("file_id"))
    return images.join(known, "path", "left").withColumn("is_cached", F.col("file_id").isNotNull())


def payload_estimate(
    images: DataFrame, shards: int, limit: int = REQUEST_FILE_GUARD, by: str | None = None, line: str = "line_id"
) -> DataFrame:
    """Request bytes if every shard request of a line embeds all its images as base64.

    One row for the whole run, whose requests share one file; with *by*, one row
    for each group.
    """
    lines = images.groupBy(*dict.fromkeys([*([by] if by else []), line])).agg(F.sum("length").cast("long").alias("bytes"))
    lines = lines.withColumn("estimate", (F.floor(F.col("bytes") * 4 / 3) * shards).cast("long"))
    total = lines.groupBy(*([by] if by else [])).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("estimate"), F.lit(0)).alias("estimate"))
    return total.withColumn("over_limit", F.col("estimate") > limit)


def largest(df: DataFrame, by: list[str], size: str, pick: str) -> DataFrame:
    """Per group the largest item; the smaller name wins a tie."""
    top = df.groupBy(*by, pick).agg(F.sum(size).alias(size))
    if not by:
        return top.orderBy(F.col(size).desc(), F.col(pick)).limit(1)
    best = F.min_by(F.struct(pick, size), F.struct(-F.col(size), F.col(pick)))
    return top.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


# -- packing ------------------------------------------------------------------


def _bin_starts(cost: np.ndarray, forced: np.ndarray, budget: float) -> np.ndarray:
    """For each item, where the next bin begins if a bin begins at this item."""
    total = np.concatenate(([0.0], np.cumsum(cost)))
    n = len(cost)
    full = np.searchsorted(total, total[:-1] + budget, side="right") - 1
    full = np.maximum(full, np.arange(n) + 1)
    stops = np.append(np.flatnonzero(forced), n)
    nearest = stops[np.searchsorted(stops, np.arange(n) + 1)]
    return np.minimum(full, nearest)


def _entry(cost: np.ndarray, forced: np.ndarray, budget: float, carry: float | None) -> int:
    """First item that begins a new bin when *carry* is already in the open one."""
    if carry is None:
        return 0
    total = np.cumsum(cost)
    over = np.flatnonzero((carry + total > budget) | forced)
    return int(over[0]) if len(over) else len(cost)


def _summaries(budget: float, order: list[str]) -> Callable:
    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        cost = pdf["_cost"].to_numpy(float)
        forced = pdf["_forced"].to_numpy(bool)
        nxt = _bin_starts(cost, forced, budget)
        n = len(cost)
        total = np.cumsum(cost)
        bins, carry = np.ones(n, dtype=np.int64), np.empty(n)
        for i in range(n - 1, -1, -1):
            j = int(nxt[i])
            if j < n:
                bins[i], carry[i] = bins[j] + 1, carry[j]
            else:
                carry[i] = total[-1] - (total[i - 1] if i else 0.0)
        # Only an item reachable while the open bin still has room can be first.
        reach = int(np.searchsorted(total, budget, side="right")) + 1
        stops = np.flatnonzero(forced)
        if len(stops):
            reach = min(reach, int(stops[0]) + 1)
        reach = min(reach, n)
        return pd.DataFrame({
            "_key": [pdf["_key"].iloc[0]], BLOCK: [int(pdf[BLOCK].iloc[0])],
            "upto": [total[:reach].tolist()], "forced": [bool(forced[reach - 1])],
            "bins": [bins[:reach].tolist()], "carry": [carry[:reach].tolist()],
            "total": [float(total[-1])],
        })
    return one_block


#: How a stretch of ranges turns what is open before it into what is open after it.  Item e begins
#: a new bin if it is the first with ``open + upto[e] > budget``, or the last one and *forced*; then
#: ``bins[e]`` begin and ``carry[e]`` stays open.  If none does, ``total`` is added to what is open.
STRETCH = "upto array<double>, forced boolean, bins array<bigint>, carry array<double>, total double"


def _passed(stretch: dict, budget: float, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is open after a stretch, and how many bins begin in it, for each amount open before it."""
    upto, bins, carry = (np.asarray(stretch[c]) for c in ("upto", "bins", "carry"))
    at = np.searchsorted(upto, budget - opened, side="right")
    if stretch["forced"]:
        at = np.minimum(at, len(upto) - 1)
    none = at == len(upto)
    at = np.minimum(at, len(upto) - 1)
    return np.where(none, opened + stretch["total"], carry[at]), np.where(none, 0, bins[at])


def _joined(first: dict, then: dict, budget: float) -> dict:
    """Two stretches in a row as one; no longer than what fits one bin from the beginning on."""
    carry, more = _passed(then, budget, np.asarray(first["carry"]))
    upto, bins, forced = np.asarray(first["upto"]), np.asarray(first["bins"]) + more, first["forced"]
    if not forced:
        upto = np.concatenate([upto, first["total"] + np.asarray(then["upto"])])
        bins, carry = np.concatenate([bins, then["bins"]]), np.concatenate([carry, then["carry"]])
        reach = int(np.searchsorted(upto, budget, side="right")) + 1
        forced = then["forced"] and reach >= len(upto)
        upto, bins, carry = upto[:reach], bins[:reach], carry[:reach]
    return {"upto": upto.tolist(), "forced": bool(forced), "bins": bins.astype(int).tolist(), "carry": carry.tolist(), "total": first["total"] + then["total"]}


def _composed(budget: float, fields: list[str]) -> Callable:
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                first = {c: r[f"before_{c}"] for c in fields}
                if pd.isna(r["before_bins_used"]):
                    rows.append({"_key": r["_key"], "nth": r["nth"], "open_cost": None, "bins_used": None, **_joined(first, r, budget)})
                else:  # all that comes before is known
                    carry, more = _passed(r, budget, np.array([r["before_open_cost"]]))
                    rows.append({
                        "_key": r["_key"], "nth": r["nth"], "open_cost": float(carry[0]), "bins_used": int(r["before_bins_used"] + more[0]),
                        "upto": [], "forced": False, "bins": [], "carry": [], "total": 0.0})
            yield pd.DataFrame(rows, columns=["_key", "nth", "open_cost", "bins_used", *fields])
    return pairs


def _states(answers: DataFrame, budget: float) -> DataFrame:
    """``_key, block, open_cost, used``: what is open, and how many bins began, before each range of a key.

    Stretches of 1, 2, 4, ... ranges are joined pair by pair, so a key with many
    ranges takes as many rounds as its number of ranges has bits, and a task
    holds two stretches at a time.  The state after the first range needs
    nothing from before; all that is joined to a known state is known.
    """
    spark = answers.sparkSession
    fields = ["upto", "forced", "bins", "carry", "total"]
    kind = answers.schema["_key"].dataType.simpleString()

    def kept(df: DataFrame) -> DataFrame:
        path = scratch(spark, "packing")
        df.write.parquet(path)
        return spark.read.parquet(path)

    answers = kept(answers)
    places = answers.select("_key", BLOCK).withColumn("nth", F.row_number().over(Window.partitionBy("_key").orderBy(BLOCK)))
    places = places.withColumn("ranges", F.max("nth").over(Window.partitionBy("_key")))
    start = answers.join(places.where("ranges > 1").withColumnRenamed("_key", "_k"), F.col("_k").eqNullSafe(F.col("_key")) & (answers[BLOCK] == places[BLOCK])).select(
        "_key", "nth", F.when(F.col("nth") == 1, F.col("carry")[0]).alias("open_cost"),
        F.when(F.col("nth") == 1, F.col("bins")[0]).alias("bins_used"), *fields)
    state, step = kept(start), 1
    while not state.where("bins_used is null").isEmpty():
        earlier = state.select(
            F.col("_key").alias("_k"), (F.col("nth") + step).alias("_n"), *[F.col(c).alias(f"before_{c}") for c in ("open_cost", "bins_used", *fields)])
        met = state.where("bins_used is null").join(earlier, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("nth")))
        moved = met.drop("_k", "_n").mapInPandas(_composed(budget, fields), f"_key {kind}, nth int, open_cost double, bins_used bigint, {STRETCH}")
        state, step = kept(state.where("bins_used is not null").unionByName(moved)), step * 2
    after = state.select(F.col("_key").alias("_k"), (F.col("nth") + 1).alias("_n"), "open_cost", F.col("bins_used").alias("used"))
    return places.join(after, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_n") == F.col("nth")), "left").select(
        "_key", BLOCK, "open_cost", F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def _assign(budget: float, order: list[str]) -> Callable:
    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        cost = pdf["_cost"].to_numpy(float)
        forced = pdf["_forced"].to_numpy(bool)
        used = int(pdf["used"].iloc[0])
        open_cost = pdf["open_cost"].iloc[0]
        carry = None if pd.isna(open_cost) else float(open_cost)
        nxt = _bin_starts(cost, forced, budget)
        bins = np.full(len(cost), used, dtype=np.int64)
        at = _entry(cost, forced, budget, carry)
        while at < len(cost):
            used += 1
            end = int(nxt[at])
            bins[at:end] = used
            at = end
        return pdf.drop(columns=["_cost", "_forced", "used", "open_cost", BLOCK]).assign(bin=bins)
    return one_block


def pack_items(df: DataFrame, key: str, order: list[str], cost: str, forced: str, budget: float) -> DataFrame:
    """Fill bins in order per key; a bin closes when the next item would not fit.

    ``forced`` items always begin a bin.  Filling is a chain over the items of
    a key, yet no key is gathered: each range of items answers, for every item
    that can begin a bin in it, how many bins follow and what stays open at its
    end.  Answers of neighbouring ranges are composed in a logarithmic number of
    rounds, then all ranges fill their bins side by side.  Sums of whole costs
    are exact up to 2**53.
    """
    rows = in_blocks(
        df.withColumn("_key", F.col(key)).withColumn("_cost", F.col(cost).cast("double"))
        .withColumn("_forced", F.coalesce(F.col(forced), F.lit(False))),
        ["_key"], order,
    )
    kind = rows.schema["_key"].dataType.simpleString()
    answers = rows.select("_key", BLOCK, "_cost", "_forced", *[c for c in order]).groupBy("_key", BLOCK).applyInPandas(
        _summaries(budget, order),
        f"_key {kind}, {BLOCK} int, {STRETCH}")
    state = _states(answers, budget)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = rows.join(
        state.withColumnsRenamed({"_key": "_k", BLOCK: "_b"}), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_b") == F.col(BLOCK))).drop("_key", "_k", "_b").groupBy(key, BLOCK).applyInPandas(
        _assign(budget, order), f"{fields}, bin bigint"
    )
    return placed


def pack_by_budget(
    df: DataFrame, key: str, group: str, group_order: str, order: str, cost: str, budget: float
) -> DataFrame:
    """Pack ordered groups of items into bins of at most *budget* per key.

    A group stays whole while it fits a bin.  One that is larger than the budget
    closes the open bin, is split by its own items and shares no bin with others.
    """
    sums = df.groupBy(key, group).agg(
        F.sum(cost).alias("_group_cost"), F.min(group_order).alias("_group_ord"))
    whole = sums.where(F.col("_group_cost") <= budget)
    big = sums.where(F.col("_group_cost") > budget)
    big_items = df.join(big, [key, group]).select(
        key, group, F.col("_group_ord"), F.col(order).alias("_item"),
        F.col(cost).cast("double").alias("_c"), F.lit(True).alias("_big"))
    whole_items = whole.select(
        key, group, F.col("_group_ord"), F.lit(None).cast(df.schema[order].dataType).alias("_item"),
        F.col("_group_cost").cast("double").alias("_c"), F.lit(False).alias("_big"))
    items = whole_items.unionByName(big_items)
    # A bin must begin where a large group begins, and right after it ends.
    items = items.withColumn("_tag", F.when(F.col("_big"), F.col("_group_ord").cast("string")))
    marked = scan(items, [key], ["_group_ord", "_item"],
                  sums={"_at": F.lit(1).cast("long")}, previous={"_before": "_tag"})
    forced = ~F.col("_tag").eqNullSafe(F.col("_before")) & (F.col("_at") > 1)
    # narrow rows, one for each group that stays whole; several passes read them
    path = scratch(df.sparkSession, "packing-items")
    marked.select(key, group, "_group_ord", "_item", "_c", "_big", forced.alias("_force")).write.parquet(path)
    packed = pack_items(
        df.sparkSession.read.parquet(path),
        key, ["_group_ord", "_item"], "_c", "_force", budget,
    )
    bins = packed.select(key, group, "_item", "_big", "bin")
    small = df.join(bins.where(~F.col("_big")).select(key, group, "bin"), [key, group])
    large = df.join(
        bins.where(F.col("_big")).select(key, group, F.col("_item").alias(order), "bin"), [key, group, order])
    return small.unionByName(large)


# -- scoring ------------------------------------------------------------------

SCORE_SCHEMA = (
    "custom_id string, line_id string, shard_id string, shard_ord int, status string, "
    "detail string, text string, input_tokens bigint, output_tokens bigint"
)


def apply_scorer(requests: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run a user's batch scorer over planned requests, all shards of a line in order.

    ``score`` takes a frame of requests and returns ``custom_id, status, detail,
    text, input_tokens, output_tokens``.  A batch that raises becomes rows with
    status ``api error``, so one bad call never ends the job, and as those rows
    carry no answer the next resume asks for them again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = score(batch)
            except Exception as e:  # noqa: BLE001 - reported as data
                out = pd.DataFrame({
                    "custom_id": batch["custom_id"], "status": "api error",
                    "detail": f"{type(e).__name__}: {e}", "text": None,
                    "input_tokens": 0, "output_tokens": 0,
                })
            ids = batch[["custom_id", "line_id", "shard_id", "shard_ord"]]
            yield ids.merge(out, on="custom_id", how="left")
    ordered = plant_major(requests).select("custom_id", "line_id", "shard_id", "shard_ord")
    return ordered.mapInPandas(run, SCORE_SCHEMA)
