"""Flatten records, type their leaves, and build the wide table."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NOMINAL, ORDINAL, QUANTITATIVE, RESERVED_COLUMNS
from ..functions.values import (
    column_name, conversion_problem, convert_number, convert_text, deepest, is_reserved, json_kind,
)
from ..session import bounded, opened, settle

LEVELS = "array<struct<level:int,label:string,definition:string>>"
#: Trait columns that one grouping makes; a wider table is made of several.
COLUMN_BLOCK = 2_000


class ColumnNameError(ValueError):
    """Column names clash, hit a reserved name, or stay duplicated."""


def flatten_leaves(records: DataFrame, keys: list[str], body: str = "obj", max_depth: int | None = None) -> DataFrame:
    """``(keys.., path, value)`` of every object that holds a ``value`` key.

    Other objects are opened, their keys join the path; scalars and lists are
    ignored.  Each level is one unfolding in place, without a shuffle.  The number
    of levels comes from the records, by one pass over them; where the caller
    knows it, *max_depth* saves that pass, and a record that goes deeper fails
    the query instead of losing leaves.
    """
    if max_depth is None:
        max_depth = deepest(records, F.to_json(body))

    def is_leaf(node: Column) -> Column:
        # read as a struct: a path to a key that an object lacks costs an exception inside Spark
        return F.try_variant_get(node, "$", "struct<value:variant>")["value"].isNotNull()

    found = opened(records, body, "_key", "_node", keys).where(~is_reserved(F.col("_key")))
    found = found.select(*keys, F.array("_key").alias("path"), "_node", is_leaf(F.col("_node")).alias("_leaf"))
    for _ in range(max_depth - 1):
        # A leaf is not opened and passes through this level as its one row.
        inner = found.withColumn("_in", F.when(~F.col("_leaf"), F.col("_node")))
        below = opened(inner, "_in", "_key", "_child", [*keys, "path", "_node", "_leaf"], outer=True)
        below = below.where(F.col("_leaf") | F.col("_key").isNotNull())
        node = F.when(F.col("_leaf"), F.col("_node")).otherwise(F.col("_child"))
        path = F.when(F.col("_leaf"), F.col("path")).otherwise(F.concat("path", F.array("_key")))
        found = below.select(*keys, path.alias("path"), node.alias("_node"), "_leaf").select(
            *keys, "path", "_node", (F.col("_leaf") | is_leaf(F.col("_node"))).alias("_leaf"))
    # an empty object has no leaves to lose
    deeper = ~F.col("_leaf") & (json_kind(F.col("_node")) == "object") & (F.to_json("_node") != "{}")
    guarded = F.when(deeper, F.raise_error(F.lit(
        f"record nested deeper than {max_depth} levels; raise max_depth")).cast("boolean")).otherwise(F.col("_leaf"))
    return found.where(guarded).where("_leaf").select(
        *keys, "path", F.try_variant_get("_node", "$.value", "variant").alias("value"))


def _label_map(levels: Column) -> Column:
    """Labels by level number; of levels that repeat a number the last counts."""
    numbers = F.transform(levels, lambda e: e["level"])
    last = F.filter(
        levels, lambda e, i: i == F.size(levels) - F.array_position(F.reverse(numbers), e["level"]).cast("int"))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["level"].cast("double"), e["label"])))


def type_leaves(leaves: DataFrame, traits: DataFrame) -> DataFrame:
    """Leaves with the type of their trait, found by first and last path element.

    A leaf no schema declares becomes plain text (``declared`` is false).  The
    outcome of the typing is ``num`` or ``text``, and ``problem`` where a value
    could not be used.
    """
    named = leaves.withColumn("group_name", F.col("path")[0]).withColumn(
        "trait_name", F.element_at("path", -1))
    info = traits.select(
        "group_name", "trait_name", "group_ord", "trait_ord", "scale_type", "unit", "levels",
        _label_map(F.col("levels")).alias("_labels"), F.lit(True).alias("declared"))
    found = named.join(bounded(info), ["group_name", "trait_name"], "left").withColumns({
        "declared": F.coalesce("declared", F.lit(False)),
        "scale_type": F.coalesce("scale_type", F.lit(NOMINAL)),
        "raw": F.try_variant_get("value", "$", "string"),
        "kind": json_kind(F.col("value")),
    })
    scale, raw, kind, labels = (F.col(c) for c in ("scale_type", "raw", "kind", "_labels"))
    typed = found.withColumns({
        "num": convert_number(scale, raw, kind), "text": convert_text(scale, raw, kind, labels)})
    problem = conversion_problem(scale, raw, labels, F.col("num"), F.col("text"))
    return typed.withColumn("problem", problem).drop("_labels")


def decode_ordinal(leaves: DataFrame, traits: DataFrame) -> DataFrame:
    """Ordinal leaves with their label; an unknown code has none."""
    return type_leaves(leaves, traits).where(F.col("scale_type") == ORDINAL).withColumn("label", F.col("text"))


def conversion_warnings(typed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell that held something unusable."""
    return typed.where(F.col("problem").isNotNull()).select(
        *keys, F.col("trait_name").alias("trait"), "raw", F.col("problem").alias("kind"))


def unknown_traits(typed: DataFrame) -> DataFrame:
    """Traits that occur in results but in no schema."""
    return typed.where(~F.col("declared")).groupBy("group_name", "trait_name").agg(
        F.count(F.lit(1)).alias("cells"))


# -- column names ---------------------------------------------------------------


def resolve_names(
    paths: DataFrame,
    mode: str = "error",
    rename: dict[str, str] | None = None,
    reserved: tuple[str, ...] = RESERVED_COLUMNS,
    table: list[str] | None = None,
) -> DataFrame:
    """Column name of each path, for one table or many at once.

    *paths* has ``path, scale_type, unit`` and the *table* columns.  A renamed
    path takes its new name as it is.  Where base names clash, ``error`` marks
    them, ``prefix_all`` uses full paths, and ``prefix_collided`` adds the least
    number of path parts that tells all members of the clash apart (the full
    path if none does).  ``problem`` names what is left: ``collision``,
    ``reserved`` or ``duplicate``.
    """
    if mode not in ("error", "prefix_collided", "prefix_all"):
        raise ValueError(f"unknown mode {mode!r}")
    table = table or []
    paths = settle(paths.select(*table, "path", "scale_type", "unit"))  # met several times below
    dotted = F.array_join("path", ".")
    rename_to = F.lit(None).cast("string")
    for name, new in (rename or {}).items():
        rename_to = F.when(dotted == name, F.lit(new)).otherwise(rename_to)
    base = column_name(F.element_at("path", -1), F.col("scale_type"), F.col("unit"))
    rows = paths.withColumns({"base": base, "renamed": rename_to})

    def prefixed(depth: Column) -> Column:
        used = F.least(depth, F.size("path"))
        head = F.slice("path", F.size("path") - used + 1, used - 1)
        return F.when(
            used > 1, F.concat(F.array_join(head, "_"), F.lit("_"), F.col("base"))
        ).otherwise(F.col("base"))

    free = rows.where(F.col("renamed").isNull())
    clash = free.groupBy(*table, "base").agg(
        F.count(F.lit(1)).alias("members"), F.max(F.size("path")).alias("deepest")).where("members > 1")
    if mode == "prefix_collided":
        tried = free.join(clash, [*table, "base"]).withColumn(
            "depth", F.explode(F.sequence(F.lit(2), F.greatest(F.col("deepest"), F.lit(2)))))
        apart = tried.groupBy(*table, "base", "members", "deepest", "depth").agg(
            F.countDistinct(prefixed(F.col("depth"))).alias("names"))
        depth = apart.groupBy(*table, "base").agg(F.coalesce(
            F.min(F.when(F.col("names") == F.col("members"), F.col("depth"))), F.max("depth")).alias("depth"))
        named = rows.join(depth, [*table, "base"], "left")
        name = F.when(F.col("depth").isNotNull(), prefixed(F.col("depth"))).otherwise(F.col("base"))
        clashing = F.lit(False)
    else:
        named = rows.join(clash.withColumn("_hit", F.lit(True)), [*table, "base"], "left")
        name = prefixed(F.size("path")) if mode == "prefix_all" else F.col("base")
        clashing = (F.coalesce("_hit", F.lit(False)) if mode == "error" else F.lit(False)) & F.col("renamed").isNull()
    named = named.withColumn("clashing", clashing).withColumn("name", F.coalesce("renamed", name))
    again = named.groupBy(*table, "name").agg(F.count(F.lit(1)).alias("uses"))
    problem = (
        F.when(F.col("clashing"), "collision")
        .when(F.col("name").isin(*reserved), "reserved")
        .when(F.col("uses") > 1, "duplicate")
    )
    return named.join(again, [*table, "name"]).select(*table, "path", "name", problem.alias("problem"))


def checked_names(resolved: DataFrame) -> DataFrame:
    """The names, or :class:`ColumnNameError` listing some that cannot be used."""
    bad = resolved.where(F.col("problem").isNotNull()).limit(20).collect()
    if bad:
        raise ColumnNameError("; ".join(f"{'.'.join(r.path)}: {r.problem} on {r.name!r}" for r in bad))
    return resolved


def table_columns(typed: DataFrame, mode: str = "error", rename: dict[str, str] | None = None) -> list[dict]:
    """Name, path, type and levels of each trait column, in table order.

    Traits of the master come in its order, then those that only shards declare,
    then undeclared ones, by name.
    """
    seen = typed.groupBy("path", "group_name", "trait_name", "scale_type", "unit", "declared").agg(
        F.min("group_ord").alias("group_ord"), F.min("trait_ord").alias("trait_ord"),
        F.first("levels", ignorenulls=True).alias("levels"))
    rows = seen.collect()  # a table's columns are part of its plan
    spark = typed.sparkSession
    listed = spark.createDataFrame(
        [(list(r.path), r.scale_type, r.unit) for r in rows], "path array<string>, scale_type string, unit string")
    names = {tuple(r.path): r.name for r in checked_names(resolve_names(listed, mode, rename)).collect()}
    # traits that only shards declare have no order and come after those of the master
    rows.sort(key=lambda r: (not r.declared, r.group_ord is None, r.group_ord or 0, r.trait_ord or 0, r.group_name, r.trait_name, r.path))
    return [
        {"name": names[tuple(r.path)], "path": list(r.path), "scale_type": r.scale_type,
         "levels": [e.label for e in sorted(r.levels, key=lambda e: e.level)] if r.levels else None}
        for r in rows
    ]


def wide_table(
    typed: DataFrame, columns: list[dict], keys: list[str], lines: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """One row per line, one typed column per trait: a single grouped pass.

    Where several answers of a line hold one trait, the last in *order* counts,
    as in the merged record, even if it has no usable value.
    Lines given in *lines* get a row even if nothing is known about them.
    Ordinal columns carry their ordered labels as column metadata.
    """
    order = order or []
    typed = typed.select(*keys, "path", "num", "text", *order)
    if lines is not None:
        typed = typed.unionByName(lines.select(*keys), allowMissingColumns=True)
    at = F.array_join("path", "\u001f")
    cells = []
    for c in columns:
        field = "num" if c["scale_type"] == QUANTITATIVE else "text"
        here = at == "\u001f".join(c["path"])
        hit = F.max_by(F.col(field), F.when(here, F.struct(*order))) if order else F.max(F.when(here, F.col(field)))
        cells.append(hit.alias(c["name"]))
    blocks = [cells[i:i + COLUMN_BLOCK] for i in range(0, len(cells), COLUMN_BLOCK)] or [[]]
    wide = typed.groupBy(*keys).agg(*blocks[0]) if blocks[0] else typed.select(*keys).distinct()
    for block in blocks[1:]:
        more = typed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*block)
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        wide = wide.join(more, same).drop(*[f"_{k}" for k in keys])
    return with_levels(wide, columns)


def with_levels(wide: DataFrame, columns: list[dict]) -> DataFrame:
    """Ordered labels of ordinal columns as column metadata."""
    for c in columns:
        if c["scale_type"] == ORDINAL and c["levels"]:
            wide = wide.withMetadata(c["name"], {"ordered": True, "levels": c["levels"]})
    return wide


def line_leaves(answers: DataFrame, shards: int, traits: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """One row per line of :func:`merge.line_answers`, with ``leaves``: path, place in the merge, and the typed value.

    The leaves of a line are unfolded, typed and gathered where the line lies.
    """
    ranks = [F.col(f"_r{i}") for i in range(shards)]
    given = [F.col(f"_o{i}").isNotNull() for i in range(shards)]
    each = [F.struct(
        reduce(add, [F.when(given[j] & (ranks[j] < r), 1).otherwise(0) for j in range(shards)]).alias("no"), F.col(f"_o{i}").alias("obj"))
        for i, r in enumerate(ranks)]
    # a line without a single leaf is kept by one of its own, of no answer
    own = F.struct(F.lit(-1).alias("no"), F.try_parse_json(F.lit('{"line":{"value":null}}')).alias("obj"))
    kept = ["_place", *keys, "_no"]
    found = answers.select("_place", *keys, F.explode(F.array(*each, own)).alias("_e")).where("_e.obj IS NOT NULL").select(
        "_place", *keys, F.col("_e.no").alias("_no"), F.col("_e.obj").alias("obj"))
    typed = type_leaves(flatten_leaves(found, kept, max_depth=max_depth), traits)
    leaf = F.when(F.col("_no") >= 0, F.struct("path", F.col("_no").alias("no"), "num", "text"))
    return typed.groupBy("_place", *keys).agg(F.collect_list(leaf).alias("leaves")).select(*keys, "leaves")


def line_columns(lines: DataFrame, traits: DataFrame, mode: str = "error", rename: dict[str, str] | None = None) -> list[dict]:
    """:func:`table_columns` of lines with their leaves."""
    paths = lines.select(F.explode("leaves.path").alias("path")).distinct()
    return table_columns(type_leaves(paths.withColumn("value", F.lit(None).cast("variant")), traits), mode, rename)


def wide_lines(lines: DataFrame, columns: list[dict], keys: list[str]) -> DataFrame:
    """:func:`wide_table` of lines with their leaves: each row becomes one in place."""
    cells = []
    for c in columns:
        field = "num" if c["scale_type"] == QUANTITATIVE else "text"
        path = F.array(*map(F.lit, c["path"]))
        here = F.filter("leaves", lambda e: e["path"] == path)
        cells.append(F.array_max(F.transform(here, lambda e: F.struct(e["no"], e[field].alias("value"))))["value"].alias(c["name"]))
    return with_levels(lines.select(*keys, *cells), columns)
