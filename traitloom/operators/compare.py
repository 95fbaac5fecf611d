"""Compare runs: agreement, noise, shifts, drift, accuracy.

Runs are compared inside one grouped row per cell (a line and a trait), which
holds the value of each *declared* run.  No self join is made and no pair rows
are shuffled: each pair of runs is two counters of an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..constants import NOMINAL, ORDINAL, QUANTITATIVE, SENTINEL
from ..functions import stats
from ..session import sql_literal

CELL = ["line_id", "group_name", "trait_name"]
#: Pairs counted by one aggregate; more pairs become more aggregates.
PAIRS_PER_PASS = 200
#: Size of a distinct sketch: 4 KB, relative standard error 1.6%.
SKETCH_LG_K = 12


def run_cells(records: DataFrame, runs: list[int], value: Column, extra: list[str] | None = None) -> DataFrame:
    """One row per cell with ``vals``: a map from run to value.

    A cell has one value per run, so the map is bounded by the declared runs.
    A value that is JSON null counts as present and equal to another null.
    """
    extra = extra or []
    held = records.where(F.col("run_no").isin(*runs)).select(
        *CELL, *extra, F.struct(F.col("run_no").alias("run"), value.alias("value")).alias("_v"))
    return held.groupBy(*CELL, *extra).agg(F.map_from_entries(F.collect_set("_v")).alias("vals"))


def line_cells(
    merged: DataFrame, rows: list[Row], runs: list[int], value: Callable[[Column, Column], Column], scale: str | None = None
) -> DataFrame:
    """:func:`run_cells` of merged lines, with ``scale_type``.

    *value* gives the value from scale and raw text; with *scale*, only traits of
    it count.  A run of a line is one row with a value for each trait; the runs
    of a line, bounded by the declared ones, meet by its id and unfold into cells
    in place, so no cell is moved and what follows by line needs no shuffle.
    """
    wanted = [(i, r) for i, r in enumerate(rows) if scale is None or r.scale_type == scale]
    values = [F.get("cells", F.lit(i))["value"] for i, _ in wanted]
    held = F.array(*[
        F.when(v.isNotNull(), F.struct(value(F.lit(r.scale_type), F.try_variant_get(v, "$", "string")).alias("value")))
        for v, (_, r) in zip(values, wanted)])
    run_rows = merged.where(F.col("run_no").isin(*runs)).select("line_id", F.struct(F.col("run_no").alias("run"), held.alias("held")).alias("_r"))
    per_line = run_rows.repartition("line_id").groupBy("line_id").agg(F.collect_list("_r").alias("_runs"))

    def vals(no: int) -> Column:
        has = F.filter("_runs", lambda r: F.get(r["held"], F.lit(no)).isNotNull())
        return F.map_from_entries(F.transform(has, lambda r: F.struct(
            r["run"].alias("run"), F.get(r["held"], F.lit(no))["value"].alias("value"))))
    cells = F.array(*[
        F.struct(*[sql_literal(r[c]).alias(c) for c in ("group_name", "trait_name", "scale_type")], vals(no).alias("vals"))
        for no, (_, r) in enumerate(wanted)])
    return per_line.select("line_id", F.explode(cells).alias("_c")).select("line_id", "_c.*").where(F.size("vals") > 0)


def _has(run: int) -> Column:
    return F.map_contains_key("vals", F.lit(run))


def _value(run: int) -> Column:
    return F.try_element_at("vals", F.lit(run))


def _differs(a: int, b: int) -> Column:
    return _has(a) & _has(b) & ~_value(a).eqNullSafe(_value(b))


def agreement(cells: DataFrame, runs: list[int], by: list[str] | None = None) -> DataFrame:
    """Cells compared and cells agreeing for each pair of runs ``run_a < run_b``.

    Equality is exact; the sentinel is an ordinary value.
    """
    by = by or []
    pairs = list(combinations(sorted(runs), 2))
    parts = []
    for at in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[at:at + PAIRS_PER_PASS]
        counted = cells.groupBy(*by).agg(*[
            c for a, b in chunk for c in (
                F.count_if(_has(a) & _has(b)).alias(f"n_{a}_{b}"),
                F.count_if(_has(a) & _has(b) & _value(a).eqNullSafe(_value(b))).alias(f"s_{a}_{b}"),
            )])
        rows = F.array(*[
            F.struct(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"),
                     F.col(f"n_{a}_{b}").alias("compared"), F.col(f"s_{a}_{b}").alias("agreeing"))
            for a, b in chunk])
        parts.append(counted.select(*by, F.explode(rows).alias("_p")).select(*by, "_p.*"))
    return reduce(DataFrame.unionByName, parts)


def run_pairs(cells: DataFrame, runs: list[int]) -> DataFrame:
    """Pairwise comparison per trait: cells both runs answered, and equal answers."""
    return agreement(cells, runs, ["group_name", "trait_name"]).where("compared > 0")


def agreement_by_scale(cells: DataFrame, runs: list[int]) -> DataFrame:
    """Agreement of categorical and of measured traits, and of all together."""
    kind = F.when(F.col("scale_type").isin(NOMINAL, ORDINAL), "categorical").otherwise("quantitative")
    split = agreement(cells.withColumn("subset", kind), runs, ["subset"])
    sets = split.groupingSets(
        [["subset", "run_a", "run_b"], ["run_a", "run_b"]], "subset", "run_a", "run_b"
    ).agg(F.sum("compared").alias("compared"), F.sum("agreeing").alias("agreeing"))
    return sets.select(F.coalesce("subset", F.lit("all")).alias("subset"), "run_a", "run_b", "compared", "agreeing")


def noise_excess(cells: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    """Per line: disagreements within each config, across them, and the excess.

    Only lines that every run of both configs answered; ``excess`` is the mean
    over all cross pairs minus the mean of the two within-config figures.
    """
    def total(pairs) -> Column:
        return reduce(lambda x, y: x + y, [F.count_if(_differs(*p)) for p in pairs]) / float(len(pairs))

    per_line = cells.groupBy("line_id").agg(
        total(list(combinations(a, 2))).alias("noise_a"),
        total(list(combinations(b, 2))).alias("noise_b"),
        total(list(product(a, b))).alias("cross_mean"),
        reduce(lambda x, y: x & y, [F.bool_or(_has(r)) for r in [*a, *b]]).alias("_complete"),
    ).where("_complete").drop("_complete")
    return per_line.withColumn("excess", F.col("cross_mean") - (F.col("noise_a") + F.col("noise_b")) / 2)


def paired_stats(df: DataFrame, col: str, against: str | None = None, other: str | None = None) -> DataFrame:
    """n, mean, sd, se, t, df and the count above zero; Pearson r of two columns."""
    n = F.count(col)
    sd = F.stddev_samp(col)
    r = F.corr(against, other) if against else F.lit(None).cast("double")
    base = df.agg(
        n.alias("n"), F.avg(col).alias("mean"), sd.alias("sd"),
        F.count_if(F.col(col) > 0).alias("positive"), r.alias("r"))
    se = F.col("sd") / F.sqrt("n")
    return base.select(
        "n", "mean", "sd", se.alias("se"), F.when(se > 0, F.col("mean") / se).alias("t"),
        (F.col("n") - 1).alias("df"), "positive", "r")


def with_p_value(paired: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add the two-sided p and the confidence interval to the one-row statistics."""
    p, q = stats.t_test_columns(confidence)
    half = q(F.col("df")) * F.col("se")
    return paired.withColumns({
        "p": p(F.col("t"), F.col("df")), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def shifted_cells(cells: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    """Cells where every run of *b* differs from every run of *a*, per trait."""
    null = F.lit("\u0000")

    def held(runs) -> Column:
        present = F.filter(F.array(*[F.lit(r) for r in runs]), lambda r: F.map_contains_key("vals", r))
        return F.transform(present, lambda r: F.coalesce(F.try_element_at("vals", r), null))
    one, two = held(a), held(b)
    both = (F.size(one) > 0) & (F.size(two) > 0)
    return cells.where(both).groupBy("group_name", "trait_name").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~F.arrays_overlap(one, two)).alias("shifted"))


def drift(cells: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    """Mean absolute difference of measured traits, within *a* and across configs.

    *cells* hold numbers; a pair counts where both runs measured something.
    """
    def gap(pairs) -> tuple[Column, Column]:
        gaps = [F.abs(_value(x) - _value(y)) for x, y in pairs]
        total = reduce(lambda x, y: x + y, [F.sum(F.coalesce(g, F.lit(0.0))) for g in gaps])
        count = reduce(lambda x, y: x + y, [F.count(g) for g in gaps])
        return total, count
    wt, wn = gap(list(combinations(a, 2)))
    ct, cn = gap(list(product(a, b)))
    return cells.groupBy("group_name", "trait_name").agg(
        wt.alias("wt"), wn.alias("within_pairs"), ct.alias("ct"), cn.alias("cross_pairs")
    ).select(
        "group_name", "trait_name",
        F.when(F.col("within_pairs") > 0, F.col("wt") / F.col("within_pairs")).alias("mean_within"),
        F.when(F.col("cross_pairs") > 0, F.col("ct") / F.col("cross_pairs")).alias("mean_cross"),
        "within_pairs", "cross_pairs")


def accuracy(results: DataFrame, annotations: DataFrame, key: list[str]) -> DataFrame:
    """Share of results equal to the annotated value, per trait."""
    truth = annotations.select(*key, F.col("value").alias("_truth"))
    return results.join(truth, key).groupBy("trait_name").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("value") == F.col("_truth")).alias("correct"),
    ).withColumn("accuracy", F.col("correct") / F.col("compared"))


def length_profile(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Mean, median, least and most characters.

    The exact median counts distinct lengths, which the longest text bounds.
    """
    n = F.length(text)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"), F.avg(n).alias("mean_chars"), F.percentile(n, 0.5).alias("median_chars"),
        F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def completeness(records: DataFrame, by: list[str]) -> DataFrame:
    """Cells answered and how many of them say the trait cannot be judged."""
    na = F.count_if(F.col("raw") == SENTINEL)
    n = F.count(F.lit(1))
    return records.groupBy(*by).agg(
        n.alias("cells"), na.alias("not_assessable"), (na / n).alias("sentinel_rate"))


def _shown(records: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows that show a value, and the columns that name it."""
    value = F.when(F.col("scale_type") != QUANTITATIVE, F.col("raw")).otherwise("(measured)")
    usable = records.where(F.col("raw").isNotNull() & (F.col("raw") != SENTINEL))
    return usable, [F.col("group_name"), F.col("trait_name"), value.alias("value")]


def shown_lines(merged: DataFrame, rows: list[Row], by: str = "run_no") -> DataFrame:
    """The rows that :func:`support` and :func:`support_sketches` count, from merged lines.

    A run of a line is moved once, as one list of texts, and lies by its line:
    counting lines needs no other shuffle of rows, and what is counted in several
    ways is merged once.
    """
    texts = [F.try_variant_get(F.get("cells", F.lit(i))["value"], "$", "string") for i in range(len(rows))]
    packed = merged.select("line_id", F.array(F.col(by).cast("string"), *texts).alias("_texts")).repartition("line_id")
    each = F.array(*[
        F.struct(*[sql_literal(r[c]).alias(c) for c in ("group_name", "trait_name", "scale_type")], F.get("_texts", F.lit(i + 1)).alias("raw"))
        for i, r in enumerate(rows)])
    run = F.get("_texts", F.lit(0)).cast(merged.schema[by].dataType)
    return packed.select("line_id", run.alias(by), F.explode(each).alias("_c")).select("line_id", by, "_c.*").where(F.col("raw").isNotNull())


def support(records: DataFrame, approx: bool = False) -> DataFrame:
    """Number of lines that show each value of each categorical trait, and each trait.

    With *approx* the number is estimated by sketches (``merged_support``).
    """
    if approx:
        return merged_support(support_sketches(records)).drop("error")
    usable, place = _shown(records)
    return usable.groupBy(*place).agg(F.countDistinct("line_id").alias("support"))


def support_sketches(records: DataFrame, by: list[str] | None = None, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """The lines that show each value as a sketch of at most ``2 ** lg_k`` bytes, for each group of *by*.

    Sketches of a run are kept and merged with those of later runs, so a growing
    set of runs is never counted anew; lines in several runs count once.
    """
    usable, place = _shown(records)
    return usable.groupBy(*(by or []), *place).agg(
        F.hll_sketch_agg("line_id", lg_k).alias("lines"), F.lit(lg_k).alias("lg_k"))


def merged_support(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``support`` estimated from sketches of any runs, with its relative standard ``error``.

    Sketches of different sizes merge to the smallest, which sets the error.
    """
    return sketches.groupBy(*(by or []), "group_name", "trait_name", "value").agg(
        F.hll_sketch_estimate(F.hll_union_agg("lines", True)).alias("support"),
        (1.04 / F.sqrt(F.pow(F.lit(2.0), F.min("lg_k")))).alias("error"))
