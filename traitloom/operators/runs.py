"""Operations reports over requests, progress rows and metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    BATCH_DISCOUNT, FAILURE_RUN_LENGTH, STATUS_CACHED, STATUS_OK, WARM_HIT_WARN_PCT,
)
from ..session import bounded, settle
from .ordered import quantiles, row_numbers, scan


def token_totals(resp: DataFrame, by: list[str]) -> DataFrame:
    """Token sums of the calls made; a missing count is zero."""
    return resp.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
          for c in ("input_tokens", "output_tokens", "cached_tokens")])


def is_failed(status: Column) -> Column:
    return ~status.isin(STATUS_OK, STATUS_CACHED)


def status_counts(prog: DataFrame, by: list[str]) -> DataFrame:
    """Rows per status with subtotals (NULL = all), and how many of them failed."""
    return prog.rollup(*by, "status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_failed(F.col("status"))).alias("failed"))


def mark_cold(prog: DataFrame, line: str = "line_id", order: tuple[str, ...] = ("ts", "i")) -> DataFrame:
    """``call_class``: the first call really sent for a line is cold, later ones warm.

    Cached rows were not sent and get no class.  The first call per line is a
    partial minimum; joining it back lets Spark split a line that is very hot.
    """
    sent = F.col("status") != STATUS_CACHED
    first = prog.where(sent).groupBy(line).agg(F.min(F.struct(*order)).alias("_first"))
    marked = prog.join(first, line, "left")
    is_first = F.struct(*order) == F.col("_first")
    return marked.withColumn(
        "call_class", F.when(sent & is_first, "cold").when(sent, "warm")).drop("_first")


def hit_pct(cached: Column, prompt: Column) -> Column:
    """Cached share of the prompt in percent; NULL when unknown or empty."""
    return F.when(prompt > 0, F.lit(100.0) * cached / prompt)


def cache_hit(marked: DataFrame, by: list[str], warn_below: float = WARM_HIT_WARN_PCT) -> DataFrame:
    """Mean cache-hit rate of cold and of warm calls; ``warn`` when warm ones are low."""
    pct = hit_pct(F.col("cached_tokens"), F.col("prompt_tokens"))
    cold, warm = F.col("call_class") == "cold", F.col("call_class") == "warm"
    out = marked.groupBy(*by).agg(
        F.count_if(cold & pct.isNotNull()).alias("cold_calls"),
        F.avg(F.when(cold, pct)).alias("cold_hit_pct"),
        F.count_if(warm & pct.isNotNull()).alias("warm_calls"),
        F.avg(F.when(warm, pct)).alias("warm_hit_pct"))
    return out.withColumn("warn", F.coalesce(F.col("warm_hit_pct") < warn_below, F.lit(False)))


def nearest_rank(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles, ``(by.., n, q, value)``; the rank rounds half to even."""
    return quantiles(df, value, qs, by or [], interpolate=False)


def failure_runs(
    prog: DataFrame, run: list[str], line: str = "line_id", order: tuple[str, ...] = ("ts", "i"), min_len: int = FAILURE_RUN_LENGTH
) -> DataFrame:
    """Runs of at least *min_len* lines in a row without a usable result.

    A line counts once, where its last call finished; one ok or cached call is
    enough for it, and ends a run.  The running number of such lines names each
    run, and a run is then just a counted group.
    """
    lines = prog.groupBy(*run, line).agg(
        F.max(F.struct(*order)).alias("_last"), F.bool_and(is_failed(F.col("status"))).alias("_failed"))
    lines = lines.select(*run, line, "_failed", *[F.col(f"_last.{c}").alias(c) for c in order])
    reset = F.when(F.col("_failed"), F.lit(0)).otherwise(F.lit(1)).cast("long")
    marked = scan(lines, run, [*order, line], sums={"run_id": reset})
    runs = marked.where("_failed").groupBy(*run, "run_id").agg(
        F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"))
    return runs.where(F.col("length") >= min_len).select(*run, "length", "first_ts", "last_ts")


def counter_delta(samp: DataFrame, counter: str, by: list[str], order: str = "ts") -> DataFrame:
    """Change of a cumulative counter since the sample before; a drop is a restart.

    A restart counts as no change; the first sample of a key has none.
    """
    moved = scan(samp, by, [order], previous={"before": counter})
    delta = F.col(counter) - F.col("before")
    return moved.withColumns({
        "delta": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0))), "restart": F.coalesce(delta < 0, F.lit(False)),
        "raised": F.coalesce(delta > 0, F.lit(False))}).drop("before")


def low_water(samp: DataFrame, gauge: str, limit: float, by: list[str], ts: str = "ts") -> DataFrame:
    """Lowest value and when it came, exact p1 and median, samples below *limit*."""
    low = samp.where(F.col(gauge).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.min(gauge).alias("low"),
        F.min(F.struct(gauge, ts)).alias("_low"),
        F.count_if(F.col(gauge) < limit).alias("below"))
    marks = quantiles(samp, gauge, [0.01, 0.5], by, interpolate=True).groupBy(*by).agg(
        F.max(F.when(F.col("q") == 0.01, F.col("value"))).alias("p1"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"))
    return low.join(marks, by).select(
        *by, "samples", "low", F.col(f"_low.{ts}").alias("low_ts"), "p1", "median", "below",
        (F.col("below") / F.col("samples")).alias("share_below"))


def running_low(samp: DataFrame, gauge: str, by: list[str], order: str = "ts") -> DataFrame:
    """The lowest value seen so far at each sample."""
    return scan(samp, by, [order], mins={"running_low": F.col(gauge)})


def progress_eta(finished: DataFrame, total: int | Column, started: Column, order: tuple[str, ...] = ("ts", "line_id")) -> DataFrame:
    """Rate and time left after each finished line, over the whole run.

    The running count is one ordered pass over all rows, range by range.
    """
    counted = row_numbers(finished.withColumn("_run", F.lit(0)), ["_run"], list(order), "done").drop("_run")
    elapsed = F.greatest(
        (F.unix_micros(order[0]) - F.unix_micros(started)) / F.lit(1e6), F.lit(1e-9))
    left = (total if isinstance(total, Column) else F.lit(total)) - F.col("done")
    return counted.withColumn("elapsed_s", elapsed).withColumn(
        "rate", F.col("done") / F.col("elapsed_s")).withColumn("eta_s", left / F.col("rate"))


def cost(tokens: DataFrame, prices: DataFrame, scale_to: float | None = None, lines: str | None = None) -> DataFrame:
    """Price of the tokens per group, direct and with the batch discount.

    With *scale_to*, also the price for that many lines at the group's mean.
    """
    usd = (F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")) / 1e6
    priced = tokens.join(bounded(prices), "model").withColumn("usd", usd).withColumn(
        "usd_batch", F.col("usd") * BATCH_DISCOUNT).drop("usd_in", "usd_out")
    if scale_to is not None:
        priced = priced.withColumn("usd_scaled", F.col("usd") / F.col(lines) * scale_to)
    return priced


def project_run(marked: DataFrame, shards: int, requests: int, seconds: str = "wall_seconds") -> DataFrame:
    """Hours for *requests* calls: all cold, all warm, and one cold call per line.

    Based on the exact median time of cold and of warm calls.
    """
    sent = marked.where(F.col("call_class").isNotNull())
    medians = quantiles(sent, seconds, [0.5], ["call_class"], interpolate=True)
    two = medians.agg(
        F.max(F.when(F.col("call_class") == "cold", F.col("value"))).alias("cold_s"),
        F.max(F.when(F.col("call_class") == "warm", F.col("value"))).alias("warm_s"))
    plants = requests / shards
    per_plant = F.col("cold_s") + (shards - 1) * F.col("warm_s")
    return two.select(
        "cold_s", "warm_s",
        (F.col("cold_s") * requests / 3600).alias("all_cold_h"),
        (F.col("warm_s") * requests / 3600).alias("all_warm_h"),
        (per_plant * plants / 3600).alias("mixed_h"))


def first_seen_order(df: DataFrame, key: list[str], name: str, pos: str) -> DataFrame:
    """Distinct names per key, numbered by where each first appears.

    Names are reduced to their first position before they are numbered, so the
    numbering runs over the names of a key only.
    """
    first = settle(df.groupBy(*key, name).agg(F.min(pos).alias("first_pos")))  # read several times
    return row_numbers(first, key, ["first_pos", name], "ord")
