"""Ordered passes with a hot key, against plain single-machine results."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitloom.operators import planning, runs
from traitloom.operators.ordered import quantiles, row_numbers, scan
from traitloom.operators.reports import assemble_text, ordered_texts


def hot(n=3000, seed=1):
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 0.5 else f"k{rng.randrange(200)}" for _ in range(n)]
    return pd.DataFrame({"k": keys, "at": rng.sample(range(10 * n), n), "v": [rng.randrange(-5, 20) for _ in range(n)]})


def test_scan(spark):
    pdf = hot()
    got = scan(spark.createDataFrame(pdf), ["k"], ["at"], {"total": F.col("v")}, {"low": F.col("v")}, {"before": "v"}).toPandas()
    want = pdf.sort_values(["k", "at"]).copy()
    want["total"], want["low"], want["before"] = (
        want.groupby("k").v.cumsum(), want.groupby("k").v.cummin(), want.groupby("k").v.shift())
    got = got.sort_values(["k", "at"])
    for c in ("total", "low"):
        assert got[c].tolist() == want[c].tolist()
    assert got.before.astype(float).fillna(-99).tolist() == want.before.fillna(-99).tolist()


def test_a_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(20)], "k string, at int")
    got = row_numbers(df, ["k"], ["at"]).collect()
    assert all(r.rn == r.at + 1 for r in got) and len(got) == 40


@pytest.mark.parametrize("by", [["k"], []])
def test_quantiles(spark, by):
    pdf = hot(seed=2)
    df = spark.createDataFrame(pdf)
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    exact = {(*[r[b] for b in by], r.q): r.value for r in quantiles(df, "v", qs, by, interpolate=True).collect()}
    ranked = {(*[r[b] for b in by], r.q): r.value for r in runs.nearest_rank(df, "v", qs, by).collect()}
    for key, part in (pdf.groupby("k") if by else [((), pdf)]):
        values = sorted(part.v)
        key = (key,) if by else ()
        for q in qs:
            assert exact[(*key, q)] == pytest.approx(np.quantile(values, q))
            assert ranked[(*key, q)] == values[int(round((len(values) - 1) * q))]


@pytest.mark.parametrize("kind", ["double", "int", "bigint", "decimal(12,3)"])
def test_quantiles_of_groups_larger_than_their_sketch(spark, kind, monkeypatch):
    monkeypatch.setattr("traitloom.operators.ordered.ACCURACY", 200)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(-4000, 4000, 9000), np.full(6000, 17), rng.integers(0, 3, 3000)])
    pdf = pd.DataFrame({"k": ["hot"] * 15000 + ["k"] * 2999 + [None], "v": rng.permutation(values)})
    df = spark.createDataFrame(pdf, "k string, v bigint").repartition(6).select("k", F.col("v").cast(kind).alias("v"))
    qs = [0.0, 0.01, 0.5, 0.501, 0.93, 1.0]
    for interpolate in (True, False):
        found = quantiles(df, "v", qs, [], interpolate).collect()
        want = np.quantile(pdf.v, qs, method="linear" if interpolate else "nearest")
        assert [float(r.value) for r in sorted(found, key=lambda r: r.q)] == pytest.approx(want.tolist())
        by_key = {(r.k, r.q): float(r.value) for r in quantiles(df.where("k is not null"), "v", qs, ["k"], interpolate).collect()}
        for k, part in pdf.dropna().groupby("k"):
            assert [by_key[k, q] for q in qs] == pytest.approx(np.quantile(part.v, qs, method="linear" if interpolate else "nearest").tolist())


def test_failure_runs_span_ranges(spark):
    rows = [("hot", i, i, "api error" if 100 <= i < 900 else "ok") for i in range(1000)] + [("x", 1, 1, "api error"), ("x", 2, 2, "api error")]
    df = spark.createDataFrame(rows, "run string, line_id int, i int, status string").withColumn("ts", F.timestamp_seconds("i"))
    assert [(r.run, r.length) for r in runs.failure_runs(df, ["run"]).collect()] == [("hot", 800)]


def test_failure_runs_count_lines(spark):
    # calls of a line need not stand together; one usable call, a cached one too, is enough for it
    calls = [("a", "api error"), ("b", "api error"), ("a", "api error"), ("c", "api error"), ("d", "api error"),
             ("e", "api error"), ("e", "skip (cached)"), ("f", "api error"), ("g", "ok"), ("f", "api error"), ("g", "api error"), ("h", "api error")]
    df = spark.createDataFrame([("r", line, i, s) for i, (line, s) in enumerate(calls)], "run string, line_id string, i int, status string")
    got = runs.failure_runs(df.withColumn("ts", F.timestamp_seconds("i")), ["run"]).collect()
    assert [(r.length, r.first_ts.second, r.last_ts.second) for r in got] == [(4, 1, 4)]


def test_counter_and_low_water(spark):
    rows = [("h", i, float(v), v) for i, v in enumerate([1, 3, 3, 0, 2])]
    df = spark.createDataFrame(rows, "host string, i int, gauge double, c int").withColumn("ts", F.timestamp_seconds("i"))
    got = runs.counter_delta(df, "c", ["host"]).orderBy("ts").collect()
    assert [(r.delta, r.restart, r.raised) for r in got] == [
        (None, False, False), (2, False, True), (0, False, False), (0, True, False), (2, False, True)]
    low = runs.low_water(df, "gauge", 2.0, ["host"]).first()
    assert (low.samples, low.low, low.median, low.below) == (5, 0.0, 2.0, 2)


def pack(groups, budget):
    """The packing rule, one key, in plain Python: [(group, [costs])] -> {(group, i): bin}."""
    bins, now, filled, used = {}, 0, 0, False
    for name, costs in groups:
        total = sum(costs)
        if total > budget:
            now, filled, used = now + used, 0, False
            inside, any_item = 0, False
            for i, c in enumerate(costs):
                if any_item and inside + c > budget:
                    now, inside = now + 1, 0
                bins[(name, i)] = now
                inside, any_item = inside + c, True
            now += 1
            continue
        if used and filled + total > budget:
            now, filled = now + 1, 0
        for i in range(len(costs)):
            bins[(name, i)] = now
        filled, used = filled + total, True
    return {k: v + 1 for k, v in bins.items()}


@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, seed):
    rng = random.Random(seed)
    keys = {"hot": 300, "a": 1, "b": 7, "c": 40}
    rows, want = [], {}
    for key, n in keys.items():
        groups = [(g, [rng.choice([1, 2, 3, 5, 8, 30]) for _ in range(rng.randrange(1, 5))]) for g in range(n)]
        if key == "b":
            groups = [(0, [60, 10]), (1, [20, 20]), (2, [40]), (3, [41]), (4, [1]), (5, [39]), (6, [50])]
        want.update({(key, *k): v for k, v in pack(groups, 40).items()})
        rows += [(key, g, i, c) for g, costs in groups for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "key string, grp int, item int, cost int").withColumn("ord", F.col("grp") * 10 + F.col("item"))
    got = planning.pack_by_budget(df, "key", "grp", "ord", "ord", "cost", 40).collect()
    assert {(r.key, r.grp, r.item): r.bin for r in got} == want


def test_packing_of_one_key_over_many_ranges(spark):
    # a budget that holds few items, one that holds more than a range, and one that holds all
    rng = random.Random(9)
    costs = [rng.choice([0, 1, 2, 3, 5, 8, 30]) for _ in range(4000)]
    df = spark.createDataFrame([(None, i, c, rng.random() < 0.002) for i, c in enumerate(costs)], "key string, at int, cost int, force boolean")
    forced = {r["at"] for r in df.where("force").collect()}
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        for budget in (31, 3000, 10**6):
            got = {r["at"]: r.bin for r in planning.pack_items(df, "key", ["at"], "cost", "force", budget).collect()}
            bins, filled, want = 1, 0, {}
            for i, c in enumerate(costs):
                if i and (i in forced or filled + c > budget):
                    bins, filled = bins + 1, 0
                filled, want[i] = filled + c, bins
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_texts_of_a_key_keep_one_order(spark):
    df = spark.createDataFrame([("k", i, f"t{i:03d}") for i in range(100)] + [("s", 1, "x")], "k string, i int, t string").repartition(5)
    whole = {r.k: r.text for r in assemble_text(df, ["k"], ["i"], "t", "\n").collect()}
    assert whole == {"k": "\n".join(f"t{i:03d}" for i in range(100)), "s": "x"}
    rows = ordered_texts(df, ["k"], ["i"], "t").collect()
    assert sorted((r.k, r.pos, r.text) for r in rows) == [("k", i, f"t{i:03d}") for i in range(100)] + [("s", 0, "x")]


def test_large_dimension_goes_through_slices(spark, monkeypatch):
    monkeypatch.setattr(planning, "small_rows", lambda df: None)
    lines = spark.createDataFrame([(f"l{i}",) for i in range(50)], "line_id string")
    shards = spark.createDataFrame([(i, f"s{i}") for i in range(7)], "shard_ord int, shard_id string")
    got = planning.plan_requests(lines, shards)
    assert got.count() == 350 and got.select("custom_id").distinct().count() == 350


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_points_are_not_sorted_for_each_row(spark):
    df = scan(spark.createDataFrame(hot()), ["k"], ["at"], {"total": F.col("v")})
    assert "array_sort" not in plan_of(df)


def test_only_keys_cut_by_a_point_are_carried(spark):
    rows = spark.createDataFrame([(None if i < 900 else i, i) for i in range(2000)], "k bigint, at int")
    df = row_numbers(rows, ["k"], ["at"])
    assert "LeftSemi" in plan_of(df)
    got = {r["at"]: r.rn for r in df.collect()}
    assert got == {i: i + 1 if i < 900 else 1 for i in range(2000)}


def test_first_positions_are_reduced_once(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "a", 5), (2, "c", 1)], "k int, n string, at int")
    df = runs.first_seen_order(rows, ["k"], "n", "at")
    assert "min(at" not in plan_of(df)
    assert sorted(tuple(r)[:2] + (r.ord,) for r in df.select("k", "n", "ord").collect()) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
