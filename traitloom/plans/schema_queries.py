"""Trait schema documents and naming, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import values as vl
from ..operators import planning, runs, schema as sc, table as tb
from . import inputs as src
from .registry import over, query


@query("load_traits", over("tr", """
SELECT doc_id, group_ord, trait_ord, group_name, trait_name, scale_type, unit, CAST(n_values AS INTEGER) AS n_values FROM tr"""))
def load_traits(spark: SparkSession, sf: str) -> DataFrame:
    return sc.read_traits(src.master_docs(spark, sf)).select(
        "doc_id", "group_ord", "trait_ord", "group_name", "trait_name", "scale_type", "unit", "n_values")


@query("document_errors", """
SELECT p_partkey AS doc_id, CASE p_partkey % 50 WHEN 0 THEN 'unknown shape' WHEN 1 THEN 'duplicate group name'
  ELSE 'group without a name' END AS error FROM part WHERE p_partkey % 50 <= 2""")
def document_errors(spark: SparkSession, sf: str) -> DataFrame:
    return sc.document_errors(src.master_docs(spark, sf))


@query("traits_from_manifest", """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN CASE x.g WHEN 'early' THEN 1 WHEN 'whole' THEN 2 ELSE 3 END
    ELSE CASE x.g WHEN 'leaf' THEN 2 ELSE 1 END END AS group_ord, x.trait_ord,
  CASE WHEN x.g <> 'early' THEN x.g WHEN p_partkey % 2 = 0 THEN 'stem' ELSE 'whole' END AS group_name, x.trait_name, x.scale_type, x.unit
FROM part, (VALUES (1, 'early', 'first', 'quantitative', 'cm'), (2, 'whole', 'form', 'nominal', NULL),
  (3, 'leaf', 'hue', 'nominal', NULL), (4, 'early', 'again', 'ordinal', NULL)) x(trait_ord, g, trait_name, scale_type, unit)""")
def traits_from_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return sc.traits_from_manifest(src.manifest_docs(spark, sf))


@query("traits_from_shards", """
SELECT p_partkey AS doc_id, 'leaf' AS group_name, x.t AS trait_name, x.s AS scale_type, x.l AS levels
FROM part, (VALUES ('extra_code', 'ordinal', '1=1,2=2,3=3'), ('extra_name', 'nominal', '')) x(t, s, l) WHERE p_partkey % 8 = 0 AND p_partkey % 50 > 2
UNION ALL
SELECT p_partkey, x.g, CASE WHEN x.t = '?' THEN CASE WHEN p_partkey % 3 = 2 THEN 'Girth Size' ELSE 'length' END ELSE x.t END,
  CASE WHEN x.t IN ('vigor', 'extra_code') THEN 'ordinal' ELSE 'nominal' END,
  CASE WHEN x.t = 'vigor' THEN (SELECT string_agg(n || '=' || n, ',' ORDER BY n) FROM range(CAST(3 + p_size % 6 AS BIGINT)) r(n))
    WHEN x.t = 'extra_code' THEN '1=1,2=2,3=3' ELSE '' END
FROM part, (VALUES ('whole', 'spread', 1), ('whole', 'form', 1), ('leaf', 'hue', 1), ('leaf', 'length', 1), ('leaf', 'extra_code', 8),
  ('leaf', 'extra_name', 8), ('stem', 'vigor', -14), ('stem', '?', 1)) x(g, t, every)
WHERE p_partkey % 50 <= 2 AND CASE WHEN every > 0 THEN p_partkey % every = 0 ELSE p_partkey % -every <> 0 END""")
def traits_from_shards(spark: SparkSession, sf: str) -> DataFrame:
    master = sc.read_traits(src.master_docs(spark, sf))
    found = sc.traits_from_shards(src.shard_docs(spark, sf), master)
    text = F.array_join(F.transform("levels", lambda e: F.concat(e["level"].cast("string"), F.lit("="), e["label"])), ",")
    return found.select("doc_id", "group_name", "trait_name", "scale_type", F.coalesce(text, F.lit("")).alias("levels"))


@query("forbidden_nodes", """
SELECT p_partkey AS doc_id, x.path, x.key FROM part, (VALUES
  (12, '.properties.whole.properties.spread.properties.value.minLength', 'minLength'),
  (13, '.properties.whole.properties.spread.properties.value.anyOf', 'anyOf'),
  (13, '.properties.whole.properties.spread.properties.value.anyOf[0].pattern', 'pattern')) x(every, path, key)
WHERE p_partkey % every = 0
UNION ALL
SELECT p_partkey, x.path, x.key FROM part, (VALUES
  (12, '.properties.whole.properties.spread.properties.value.minLength', 'minLength'),
  (13, '.properties.whole.properties.spread.properties.value.anyOf', 'anyOf'),
  (13, '.properties.whole.properties.spread.properties.value.anyOf[0].pattern', 'pattern')) x(every, path, key)
WHERE p_partkey % every = 0 AND p_partkey % 15 = 0""")
def forbidden_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return sc.forbidden_nodes(src.shard_docs(spark, sf))


@query("schema_problems", over("part_doc", """
SELECT doc_id, 'whole' AS group_name, 'form' AS trait_name, 'key order' AS problem FROM part_doc WHERE p % 9 = 0
UNION ALL SELECT doc_id, 'leaf', 'hue', 'required' FROM part_doc WHERE p % 10 = 0
UNION ALL SELECT doc_id, 'stem', 'vigor', 'additionalProperties' FROM part_doc WHERE p % 11 = 0 AND p % 14 <> 0"""))
def schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    return sc.schema_problems(src.shard_docs(spark, sf))


@query("lint_traits", over("tr", """+ used AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trait_name) AS uses FROM tr)
SELECT doc_id, group_name, trait_name, 'too many categories' AS rule FROM tr WHERE scale_type = 'nominal' AND n_values > 7
UNION ALL SELECT doc_id, group_name, trait_name, 'too many levels' FROM tr WHERE scale_type = 'ordinal' AND n_values > 7
UNION ALL SELECT doc_id, group_name, trait_name, 'levels need a note' FROM tr WHERE scale_type = 'ordinal' AND n_values > 5 AND p % 2 = 1
UNION ALL SELECT doc_id, group_name, trait_name, 'missing definition' FROM tr
  WHERE trait_name = 'form' OR trait_name = 'hue' AND p % 6 = 0 OR trait_name = 'vigor' AND p % 7 = 0
UNION ALL SELECT doc_id, group_name, trait_name, 'not snake case' FROM tr WHERE trait_name = 'Girth Size'
UNION ALL SELECT doc_id, group_name, trait_name, 'name reused' FROM used WHERE uses > 1"""))
def lint_traits(spark: SparkSession, sf: str) -> DataFrame:
    return sc.lint_traits(sc.read_traits(src.master_docs(spark, sf)))


@query("absence_audit", over("doc", """
SELECT doc_id, CAST(3 AS BIGINT) AS categorical, CAST(3 AS BIGINT) AS quantitative,
  CAST((p % 4 = 0)::INT + (p % 5 = 0)::INT AS BIGINT) AS with_absence,
  CAST(3 - (p % 4 = 0)::INT - (p % 5 = 0)::INT AS BIGINT) AS without_absence FROM doc"""))
def absence_audit(spark: SparkSession, sf: str) -> DataFrame:
    return sc.absence_audit(sc.read_traits(src.master_docs(spark, sf)))


_SIDES = """+ a AS (SELECT doc_id, group_name, trait_name, count(*) AS m FROM tr GROUP BY ALL),
b AS (SELECT doc_id, group_name, trait_name, count(*) AS s FROM placed GROUP BY ALL)
"""


@query("coverage", over("tr placed", _SIDES + """
SELECT doc_id, group_name, trait_name, 'duplicate' AS problem FROM b WHERE s > 1
UNION ALL SELECT a.doc_id, a.group_name, a.trait_name, 'missing' FROM a ANTI JOIN b USING (doc_id, group_name, trait_name)
UNION ALL SELECT b.doc_id, b.group_name, b.trait_name, 'extra' FROM b ANTI JOIN a USING (doc_id, group_name, trait_name)"""))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return sc.coverage(sc.read_traits(src.master_docs(spark, sf)), sc.shard_properties(src.shard_docs(spark, sf)))


@query("trait_diff", over("tr placed", """
SELECT *, 'missing' AS side FROM (SELECT doc_id, group_name, trait_name FROM tr EXCEPT SELECT doc_id, group_name, trait_name FROM placed)
UNION ALL
SELECT *, 'extra' FROM (SELECT doc_id, group_name, trait_name FROM placed EXCEPT SELECT doc_id, group_name, trait_name FROM tr)"""))
def trait_diff(spark: SparkSession, sf: str) -> DataFrame:
    return sc.trait_diff(sc.read_traits(src.master_docs(spark, sf)), sc.shard_properties(src.shard_docs(spark, sf)))


_VERSIONS = ["raw", "typed", "edited"]


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """All versions of all constrained schemas; document and shard number make the id."""
    docs = None
    for v in _VERSIONS:
        one = src.shard_docs(spark, sf, v).select(
            F.concat_ws("/", F.col("doc_id").cast("string"), F.col("shard_no").cast("string")).alias("doc_id"),
            F.lit(v).alias("version"), "body")
        docs = one if docs is None else docs.unionByName(one)
    return docs


def _shard_of(name: str = "doc_id") -> list[Column]:
    ids = F.split(name, "/")
    return [ids[0].cast("long").alias("doc_id"), ids[1].cast("int").alias("shard_no")]


@query("schema_diff", """
SELECT p_partkey AS doc_id, 1 AS shard_no, 'properties.whole.form.value' AS place, 'enum members differ' AS problem
FROM part WHERE p_partkey % 16 = 0
UNION ALL SELECT p_partkey, s.n, 'properties.whole.spread.value', 'type differs' FROM part, (VALUES (1), (2)) s(n)
WHERE p_partkey % 17 = 0 AND (s.n = 1 OR p_partkey % 15 = 0)
UNION ALL SELECT p_partkey, 1, 'properties.leaf', 'names or order differ' FROM part WHERE p_partkey % 18 = 0""")
def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of each constrained schema; the typed one must not count as different."""
    found = sc.schema_diff(_versions(spark, sf), _VERSIONS)
    return found.select(*_shard_of(), F.concat(F.lit("properties."), F.array_join("path", ".")).alias("place"), "problem")


@query("enum_equal", over("part_doc", """
SELECT doc_id, 1 AS shard_no, 'whole.form.value' AS place, p % 16 <> 0 AS same, k + 1 AS members FROM part_doc
UNION ALL SELECT doc_id, 1, 'leaf.hue.value', p % 18 <> 0, 4 FROM part_doc
UNION ALL SELECT doc_id, 1, 'leaf.hues.value', false, NULL FROM part_doc WHERE p % 18 = 0
UNION ALL SELECT doc_id, 1, 'leaf.' || x.name || '.value', true, x.n FROM part_doc, (VALUES ('extra_code', 4), ('extra_name', 3)) x(name, n) WHERE p % 8 = 0
UNION ALL SELECT doc_id, 2, 'stem.vigor.value', true, m + 1 FROM part_doc WHERE p % 14 <> 0"""))
def enum_equal(spark: SparkSession, sf: str) -> DataFrame:
    """All enums of both shards, compared as sets over three versions."""
    found = sc.enum_sets(_versions(spark, sf), _VERSIONS)
    return found.select(*_shard_of(), F.array_join("path", ".").alias("place"), "same", "members")


@query("trait_counts", over("tr", """
SELECT doc_id, group_name, CAST(count(*) AS BIGINT) AS traits, CAST(count(*) FILTER (scale_type = 'nominal') AS BIGINT) AS nominal,
  CAST(count(*) FILTER (scale_type = 'ordinal') AS BIGINT) AS ordinal,
  CAST(count(*) FILTER (scale_type = 'quantitative') AS BIGINT) AS quantitative,
  CAST(sum(CASE WHEN scale_type = 'quantitative' THEN 2 ELSE 3 + n_values END) AS BIGINT) AS cost FROM tr GROUP BY 1, 2"""))
def trait_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sc.trait_counts(sc.read_traits(src.master_docs(spark, sf)), ["doc_id", "group_name"])


@query("trait_cost", over("tr", """
SELECT doc_id, group_name, trait_name, CAST(CASE WHEN scale_type = 'quantitative' THEN 2 ELSE 3 + n_values END AS BIGINT) AS cost FROM tr"""))
def trait_cost(spark: SparkSession, sf: str) -> DataFrame:
    return sc.read_traits(src.master_docs(spark, sf)).select(
        "doc_id", "group_name", "trait_name", vl.trait_cost(F.col("scale_type"), F.col("n_values")).alias("cost"))


@query("categories", over("doc", """
SELECT doc_id, 'form' AS trait_name, i AS pos, CASE WHEN i = 1 AND p % 4 = 0 THEN 'absent' ELSE 'c' || i END AS value, NULL AS definition
FROM doc, range(1, 10) r(i) WHERE i <= k
UNION ALL SELECT doc_id, 'hue', i, 'h' || i, CASE WHEN NOT (i = 3 AND p % 6 = 0) THEN 'hue ' || i || ' of ' || p_name END
FROM doc, range(1, 4) r(i)"""))
def categories(spark: SparkSession, sf: str) -> DataFrame:
    nominal = sc.read_traits(src.master_docs(spark, sf)).where(F.col("scale_type") == "nominal")
    each = nominal.select("doc_id", "trait_name", F.posexplode("categories").alias("_p", "_c"))
    return each.select("doc_id", "trait_name", (F.col("_p") + 1).cast("long").alias("pos"), "_c.value", "_c.definition")


@query("allowed_values", over("tr", """
SELECT doc_id, group_name, trait_name, CASE trait_name
  WHEN 'form' THEN (SELECT string_agg(CASE WHEN i = 1 AND p % 4 = 0 THEN 'absent' ELSE 'c' || i END, ',' ORDER BY i) FROM range(1, 10) r(i) WHERE i <= k) || ',not_assessable'
  WHEN 'hue' THEN 'h1,h2,h3,not_assessable'
  WHEN 'vigor' THEN (SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(0, 9) r(i) WHERE i < m) || ',not_assessable'
  ELSE '(text)' END AS allowed FROM tr"""))
def allowed_values(spark: SparkSession, sf: str) -> DataFrame:
    listed = sc.allowed_values(sc.read_traits(src.master_docs(spark, sf)))
    return listed.select("doc_id", "group_name", "trait_name", F.coalesce(F.array_join("allowed", ","), F.lit("(text)")).alias("allowed"))


@query("sanitize_unit", over("tr", """
SELECT doc_id, group_name, trait_name, CASE WHEN unit = 'm²' THEN 'm2' WHEN unit = ' mm / Day ' THEN 'mm_day' WHEN unit = '%' OR unit IS NULL THEN ''
  ELSE unit END AS token FROM tr"""))
def sanitize_unit(spark: SparkSession, sf: str) -> DataFrame:
    return sc.read_traits(src.master_docs(spark, sf)).select(
        "doc_id", "group_name", "trait_name", vl.sanitize_unit(F.col("unit")).alias("token"))


_TOKEN = "CASE WHEN unit = 'm²' THEN '_m2' WHEN unit = ' mm / Day ' THEN '_mm_day' WHEN unit = '%' OR unit IS NULL THEN '' ELSE '_' || unit END"


@query("column_name", over("tr", f"""
SELECT doc_id, group_name, trait_name, trait_name || {_TOKEN} AS name FROM tr"""))
def column_name(spark: SparkSession, sf: str) -> DataFrame:
    return sc.read_traits(src.master_docs(spark, sf)).select(
        "doc_id", "group_name", "trait_name", vl.column_name(F.col("trait_name"), F.col("scale_type"), F.col("unit")).alias("name"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Trait paths of each schema; some have a part between group and trait."""
    middle = F.when(F.col("doc_id") % 4 == 1, F.array(F.col("group_name"), F.lit("tip"), F.col("trait_name"))).otherwise(
        F.array("group_name", "trait_name"))
    return sc.read_traits(src.master_docs(spark, sf)).select("doc_id", middle.alias("path"), "scale_type", "unit")


_NAMED = f"""+ base AS (SELECT doc_id, p, group_name, trait_name, trait_name || {_TOKEN} AS base,
  group_name || CASE WHEN p % 4 = 1 THEN '.tip' ELSE '' END || '.' || trait_name AS path FROM tr),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, base) AS members FROM base)
"""


@query("resolve_names", over("tr", _NAMED + """
SELECT doc_id, path, CASE WHEN members = 1 THEN base WHEN p % 4 = 1 THEN group_name || '_tip_' || base ELSE group_name || '_' || base END AS name,
  'ok' AS problem FROM n"""))
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    named = tb.resolve_names(_paths(spark, sf), "prefix_collided", table=["doc_id"])
    return named.select("doc_id", F.array_join("path", ".").alias("path"), "name", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("resolve_names_error", over("tr", _NAMED + """
SELECT doc_id, path, CASE WHEN path = 'whole.spread' THEN 'model' ELSE base END AS name,
  CASE WHEN path = 'whole.spread' THEN 'reserved' WHEN members > 1 THEN 'collision' ELSE 'ok' END AS problem FROM n"""))
def resolve_names_error(spark: SparkSession, sf: str) -> DataFrame:
    """Mode ``error`` with a rename onto a reserved column."""
    named = tb.resolve_names(_paths(spark, sf), "error", {"whole.spread": "model"}, table=["doc_id"])
    return named.select("doc_id", F.array_join("path", ".").alias("path"), "name", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("resolve_names_all", over("tr", _NAMED + """
SELECT doc_id, path, group_name || CASE WHEN p % 4 = 1 THEN '_tip_' ELSE '_' END || base AS name, 'ok' AS problem FROM n"""))
def resolve_names_all(spark: SparkSession, sf: str) -> DataFrame:
    named = tb.resolve_names(_paths(spark, sf), "prefix_all", table=["doc_id"])
    return named.select("doc_id", F.array_join("path", ".").alias("path"), "name", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query("extract_defs", """
SELECT p_partkey AS doc_id, x.c AS category, CASE x.c WHEN 'erect' THEN 'stands (e.g. ' || p_name || ')' WHEN 'semi_erect' THEN 'leans ' || p_size || '.5 deg'
  ELSE 'lies flat' END AS definition FROM part, (VALUES ('erect'), ('semi_erect'), ('prostrate')) x(c)
WHERE x.c <> 'prostrate' OR p_partkey % 3 = 0""")
def extract_defs(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions written into a free note; one category ends in the name of another."""
    p = src.table(spark, sf, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, " Note. prostrate = lies flat.").otherwise(" Nothing else.")
    note = F.concat(F.lit("semi_erect = leans "), F.col("p_size").cast("string"), F.lit(".5 deg; erect = stands (e.g. "),
                    F.col("p_name"), F.lit("). Seen often."), tail)
    notes = p.select(F.col("p_partkey").alias("doc_id"), note.alias("note"),
                     F.array(F.lit("erect"), F.lit("semi_erect"), F.lit("prostrate"), F.lit("lost")).alias("categories"))
    return sc.extract_defs(notes).select("doc_id", "category", "definition")


@query("first_seen_order", """
SELECT doc_id, grp, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(pos), grp) AS BIGINT) AS ord
FROM (SELECT l_orderkey AS doc_id, l_returnflag || l_linestatus AS grp, l_linenumber AS pos FROM lineitem) GROUP BY 1, 2""")
def first_seen_order(spark: SparkSession, sf: str) -> DataFrame:
    items = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("grp"), F.col("l_linenumber").alias("pos"))
    return runs.first_seen_order(items, ["doc_id"], "grp", "pos").select("doc_id", "grp", "ord")


@query("pack_by_budget", """
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
walk AS (
  SELECT source, doc_id, rn, n_chars AS filled, 1 AS bin FROM d WHERE rn = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.rn, CASE WHEN w.filled + d.n_chars > 50000 THEN d.n_chars ELSE w.filled + d.n_chars END,
    CASE WHEN w.filled + d.n_chars > 50000 THEN w.bin + 1 ELSE w.bin END
  FROM walk w JOIN d ON d.source = w.source AND d.rn = w.rn + 1)
SELECT source, doc_id, CAST(bin AS BIGINT) AS bin FROM walk""")
def pack_by_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.table(spark, sf, "documents").select("source", "doc_id", "n_chars", F.col("doc_id").alias("grp"))
    packed = planning.pack_by_budget(docs, "source", "grp", "doc_id", "doc_id", "n_chars", 50000)
    return packed.select("source", "doc_id", "bin")
