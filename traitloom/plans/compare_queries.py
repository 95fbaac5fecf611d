"""Run comparison, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import parse_value
from ..operators import compare as cp
from . import inputs as src
from .registry import over, query

_PAIR = """+ pair AS (
  SELECT a.line_id, a.group_name, a.trait_name, a.scale_type, a.run_no AS run_a, b.run_no AS run_b, a.v IS NOT DISTINCT FROM b.v AS same
  FROM (SELECT *, CASE WHEN scale_type = 'quantitative' AND raw <> 'not_assessable' THEN CAST(num AS VARCHAR) ELSE raw END AS v FROM merged) a
  JOIN (SELECT *, CASE WHEN scale_type = 'quantitative' AND raw <> 'not_assessable' THEN CAST(num AS VARCHAR) ELSE raw END AS v FROM merged) b
  ON a.line_id = b.line_id AND a.group_name = b.group_name AND a.trait_name = b.trait_name AND a.run_no < b.run_no)
"""
_N = "CAST(count(*) AS BIGINT) AS compared, CAST(count(*) FILTER (same) AS BIGINT) AS agreeing"


def _cells(spark: SparkSession, sf: str, runs: list[int] = src.RUNS, numbers: bool = False) -> DataFrame:
    """Cells with the merged value: numbers as numbers, the sentinel as it stands."""
    merged, _, rows = src.merged(spark, sf)
    if numbers:
        return cp.line_cells(merged, rows, runs, parse_value, "quantitative")
    return cp.line_cells(merged, rows, runs, lambda scale, raw: F.when(
        (scale == "quantitative") & (raw != "not_assessable"), parse_value(scale, raw).cast("string")).otherwise(raw))


@query("agreement", over("merged", _PAIR + f"SELECT run_a, run_b, {_N} FROM pair GROUP BY 1, 2"))
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return cp.agreement(_cells(spark, sf), src.RUNS)


@query("run_pairs", over("merged", _PAIR + f"SELECT group_name, trait_name, run_a, run_b, {_N} FROM pair GROUP BY 1, 2, 3, 4"))
def run_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cp.run_pairs(_cells(spark, sf), src.RUNS)


@query("agreement_by_scale", over("merged", _PAIR + f"""
SELECT CASE WHEN scale_type = 'quantitative' THEN scale_type ELSE 'categorical' END AS subset, run_a, run_b, {_N} FROM pair GROUP BY 1, 2, 3
UNION ALL SELECT 'all', run_a, run_b, {_N} FROM pair GROUP BY 2, 3"""))
def agreement_by_scale(spark: SparkSession, sf: str) -> DataFrame:
    return cp.agreement_by_scale(_cells(spark, sf), src.RUNS)


_EXCESS = _PAIR + """, full_lines AS (SELECT line_id FROM merged WHERE run_no <= 4 GROUP BY 1 HAVING count(DISTINCT run_no) = 4),
d AS (SELECT f.line_id, coalesce(count(*) FILTER (run_a = 1 AND run_b = 2 AND NOT same), 0) AS na,
    coalesce(count(*) FILTER (run_a = 3 AND run_b = 4 AND NOT same), 0) AS nb,
    coalesce(count(*) FILTER (run_a <= 2 AND run_b IN (3, 4) AND NOT same), 0) AS nc
  FROM full_lines f LEFT JOIN pair p USING (line_id) GROUP BY 1),
x AS (SELECT line_id, CAST(na AS DOUBLE) AS noise_a, CAST(nb AS DOUBLE) AS noise_b, nc / 4.0::DOUBLE AS cross_mean,
  nc / 4.0::DOUBLE - (na + nb) / 2.0::DOUBLE AS excess FROM d)
"""


@query("noise_excess", over("merged", _EXCESS + "SELECT line_id, noise_a, noise_b, cross_mean, excess FROM x"))
def noise_excess(spark: SparkSession, sf: str) -> DataFrame:
    return cp.noise_excess(_cells(spark, sf, [1, 2, 3, 4]), src.CONFIG_A, src.CONFIG_B)


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    """Excess per line with the number of deliveries the line had."""
    excess = cp.noise_excess(_cells(spark, sf, [1, 2, 3, 4]), src.CONFIG_A, src.CONFIG_B)
    items = src.table(spark, sf, "lineitem").groupBy(src.line_of(F.col("l_orderkey")).alias("line_id")).agg(
        F.count(F.lit(1)).cast("double").alias("images"))
    return cp.paired_stats(excess.join(items, "line_id"), "excess", "cross_mean", "images")


_STATS = _EXCESS + """, i AS (SELECT 's' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS line_id, count(*) AS images FROM lineitem GROUP BY 1),
s AS (SELECT count(*) AS n, avg(excess) AS mean, stddev_samp(excess) AS sd, count(*) FILTER (excess > 0) AS positive,
  corr(cross_mean, images) AS r FROM x JOIN i USING (line_id))
SELECT CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se,
  round(mean / (sd / sqrt(n)), 6) AS t, CAST(n - 1 AS BIGINT) AS df, CAST(positive AS BIGINT) AS positive, round(r, 6) AS r FROM s"""


@query("paired_stats", over("merged", _STATS))
def paired_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).select("n", "df", "positive", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "se", "t", "r")])


# With t = sqrt(df) * tan(u) the density is cos(u) ** (df - 1); its area is summed on a fine grid and read off between points.
_P_VALUE = _EXCESS + """, b AS (SELECT count(*) AS n, avg(excess) AS mean, stddev_samp(excess) / sqrt(count(*)) AS se FROM x),
g AS (SELECT r.i, r.i * pi() / 400000 AS u, pow(cos(r.i * pi() / 400000), n - 2) AS y FROM range(0, 200001) r(i), b),
c AS (SELECT i, u, y, (sum(y) OVER (ORDER BY i) - y / 2 - 0.5) * pi() / 400000 AS area FROM g),
w AS (SELECT *, max(area) OVER () AS whole, lead(u) OVER (ORDER BY i) AS u2, lead(y) OVER (ORDER BY i) AS y2, lead(area) OVER (ORDER BY i) AS area2 FROM c),
a AS (SELECT *, atan(abs(mean / se) / sqrt(n - 1)) AS theta FROM b),
p AS (SELECT 1 - (area + (theta - u) * (y + (y2 - y) * (theta - u) / (u2 - u) / 2)) / whole AS p FROM w, a WHERE u <= theta AND theta < u2),
q AS (SELECT sqrt(n - 1) * tan(u + (u2 - u) * (0.95 * whole - area) / (area2 - area)) AS q FROM w, b WHERE area < 0.95 * whole AND area2 >= 0.95 * whole)
SELECT CAST(n AS BIGINT) AS n, round(mean / se, 6) AS t, round(p, 6) AS p, round(mean - q * se, 5) AS ci_low, round(mean + q * se, 5) AS ci_high FROM b, p, q"""


@query("paired_test", over("merged", _P_VALUE))
def paired_test(spark: SparkSession, sf: str) -> DataFrame:
    """The paired statistics with p value and confidence interval."""
    return cp.with_p_value(_paired(spark, sf)).select(
        "n", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"), F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


@query("shifted_cells", over("merged", """+ v AS (SELECT *, coalesce(CASE WHEN scale_type = 'quantitative' AND raw <> 'not_assessable'
    THEN CAST(num AS VARCHAR) ELSE raw END, chr(1)) AS v FROM merged WHERE run_no <= 4),
c AS (SELECT line_id, group_name, trait_name, list(DISTINCT v) FILTER (run_no <= 2) AS a, list(DISTINCT v) FILTER (run_no > 2) AS b
  FROM v GROUP BY 1, 2, 3)
SELECT group_name, trait_name, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (NOT list_has_any(a, b)) AS BIGINT) AS shifted
FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2"""))
def shifted_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cp.shifted_cells(_cells(spark, sf, [1, 2, 3, 4]), src.CONFIG_A, src.CONFIG_B)


@query("drift", over("merged", """+ q AS (SELECT * FROM merged WHERE scale_type = 'quantitative' AND num IS NOT NULL AND run_no <= 4),
g AS (SELECT a.group_name, a.trait_name, a.run_no AS ra, b.run_no AS rb, abs(a.num - b.num) AS gap FROM q a JOIN q b
  ON a.line_id = b.line_id AND a.group_name = b.group_name AND a.trait_name = b.trait_name AND a.run_no < b.run_no)
SELECT group_name, trait_name, round(avg(gap) FILTER (ra = 1 AND rb = 2), 6) AS mean_within,
  round(avg(gap) FILTER (ra <= 2 AND rb >= 3), 6) AS mean_cross, CAST(count(*) FILTER (ra = 1 AND rb = 2) AS BIGINT) AS within_pairs,
  CAST(count(*) FILTER (ra <= 2 AND rb >= 3) AS BIGINT) AS cross_pairs FROM g GROUP BY 1, 2"""))
def drift(spark: SparkSession, sf: str) -> DataFrame:
    found = cp.drift(_cells(spark, sf, [1, 2, 3, 4], numbers=True), src.CONFIG_A, src.CONFIG_B)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_within", "mean_cross")})


@query("accuracy", """
WITH r AS (SELECT doc_id, 'quality' AS trait_name, CASE WHEN length(text) >= 300 THEN 1 ELSE 0 END AS value FROM documents
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN length(text) < 200 THEN 1 ELSE 0 END FROM documents),
a AS (SELECT doc_id, 'quality' AS trait_name, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT trait_name, CAST(count(*) AS BIGINT) AS compared, CAST(count(*) FILTER (value = truth) AS BIGINT) AS correct,
  round(count(*) FILTER (value = truth) / count(*)::DOUBLE, 6) AS accuracy FROM r JOIN a USING (doc_id, trait_name) GROUP BY 1""")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """A length rule as the result, labels as the annotation."""
    docs, labels = src.table(spark, sf, "documents"), src.table(spark, sf, "labels")

    def long_form(df: DataFrame, quality, toxic) -> DataFrame:
        both = F.array(F.struct(F.lit("quality").alias("t"), quality.alias("v")), F.struct(F.lit("toxic").alias("t"), toxic.alias("v")))
        return df.select("doc_id", F.explode(both).alias("_b")).select("doc_id", F.col("_b.t").alias("trait_name"), F.col("_b.v").alias("value"))
    n = F.length("text")
    results = long_form(docs, F.when(n >= 300, 1).otherwise(0), F.when(n < 200, 1).otherwise(0))
    truth = long_form(labels, F.col("quality"), F.col("toxic"))
    found = cp.accuracy(results, truth, ["doc_id", "trait_name"])
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query("length_profile", """
SELECT source, lang, CAST(count(*) AS BIGINT) AS texts, round(avg(length(text)), 6) AS mean_chars, round(median(length(text)), 6) AS median_chars,
  CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM documents GROUP BY 1, 2""")
def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = cp.length_profile(src.table(spark, sf, "documents"), "text", ["source", "lang"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_chars", "median_chars")})


@query("rationale_length", over("merged", """
SELECT run_no, CAST(count(*) AS BIGINT) AS texts, round(avg(length(rationale)), 6) AS mean_chars, round(median(length(rationale)), 6) AS median_chars,
  CAST(min(length(rationale)) AS BIGINT) AS min_chars, CAST(max(length(rationale)) AS BIGINT) AS max_chars FROM merged GROUP BY 1"""))
def rationale_length(spark: SparkSession, sf: str) -> DataFrame:
    found = cp.length_profile(src.records(spark, sf), "rationale", ["run_no"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean_chars", "median_chars")})


@query("completeness", over("merged", """
SELECT run_no, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (raw = 'not_assessable') AS BIGINT) AS not_assessable,
  round(count(*) FILTER (raw = 'not_assessable') / count(*)::DOUBLE, 6) AS sentinel_rate FROM merged GROUP BY 1"""))
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return cp.completeness(src.records(spark, sf), ["run_no"]).withColumn("sentinel_rate", F.round("sentinel_rate", 6))


@query("support", over("merged", """
SELECT group_name, trait_name, CASE WHEN scale_type = 'quantitative' THEN '(measured)' ELSE raw END AS value,
  CAST(count(DISTINCT line_id) AS BIGINT) AS support FROM merged WHERE raw IS NOT NULL AND raw <> 'not_assessable' GROUP BY 1, 2, 3"""))
def support(spark: SparkSession, sf: str) -> DataFrame:
    return cp.support(src.records(spark, sf))


@query("support_merged", over("merged", """
SELECT group_name, trait_name, CASE WHEN scale_type = 'quantitative' THEN '(measured)' ELSE raw END AS value,
  CAST(count(DISTINCT line_id) AS BIGINT) AS support, true AS within FROM merged WHERE raw IS NOT NULL AND raw <> 'not_assessable' GROUP BY 1, 2, 3"""))
def support_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of each run, merged over all runs: within four standard errors of the exact count."""
    lines, _, rows = src.merged(spark, sf)
    records = cp.shown_lines(lines, rows)
    merged = cp.merged_support(cp.support_sketches(records, ["run_no"])).withColumnRenamed("support", "estimate")
    exact = cp.support(records).join(merged, ["group_name", "trait_name", "value"], "left")
    off = F.abs(F.col("estimate") - F.col("support"))
    return exact.select("group_name", "trait_name", "value", "support",
                        F.coalesce(off <= 4 * F.col("error") * F.col("support"), F.lit(False)).alias("within"))
