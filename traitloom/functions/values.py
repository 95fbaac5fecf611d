"""Value typing, column naming and id functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    CUSTOM_ID_SEPARATOR, MEDIA_TYPES, NOMINAL, ORDINAL, QUANTITATIVE, SENTINEL,
    SIZE_LIMIT_MARKERS, TRANSIENT_STATUS,
)
from .text import strip

# Possessive groups over atoms that loop: a plain group with alternatives of
# length recurses once for each repeat, which a long value turns into a lost JVM.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER_PATTERN = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def number(text: Column) -> Column:
    """Text to DOUBLE by one fixed grammar; anything else is NULL.

    The grammar is checked before the cast because a plain cast also takes type
    suffixes (``1d``) and refuses digit groups (``1_000``).
    """
    s = strip(text)
    low = F.lower(s)
    infinity = F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(s.rlike(NUMBER_PATTERN), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
        .when(low.rlike(r"^[+-]?inf(inity)?$"), infinity)
        .when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def parse_value(scale: Column, raw: Column) -> Column:
    """Merge-time number of a quantitative answer; other scales give NULL.

    Empty text, the sentinel in any case and text that is no number are NULL.
    """
    return F.when(scale == QUANTITATIVE, number(raw))  # the grammar refuses the two others


def level_label(labels: Column, code: Column, kind: Column) -> Column:
    """Label of an ordinal code in a map by number; only numbers and booleans are codes."""
    as_number = (
        F.when(kind == "boolean", F.when(code == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(is_number(kind), code.try_cast("double"))
    )
    return F.try_element_at(labels, as_number)


def is_missing(raw: Column) -> Column:
    """NULL or exactly the sentinel: an empty cell of the wide table."""
    return raw.isNull() | (raw == SENTINEL)


def convert_number(scale: Column, raw: Column, kind: Column) -> Column:
    """Table-time number of a quantitative leaf."""
    as_number = F.when(
        kind == "boolean", F.when(raw == "true", F.lit(1.0)).otherwise(F.lit(0.0))
    ).otherwise(number(raw))
    return F.when((scale == QUANTITATIVE) & ~is_missing(raw), as_number)


def convert_text(scale: Column, raw: Column, kind: Column, labels: Column) -> Column:
    """Table-time text of a nominal or ordinal leaf; an ordinal becomes its label.

    An ordinal trait without *labels* keeps its code.
    """
    label = F.when(labels.isNull(), raw).otherwise(level_label(labels, raw, kind))
    return F.when(is_missing(raw) | (scale == QUANTITATIVE), F.lit(None).cast("string")).when(
        scale == ORDINAL, label
    ).when(kind == "boolean", F.initcap(raw)).otherwise(raw)


def conversion_problem(scale: Column, raw: Column, labels: Column, num: Column, text: Column) -> Column:
    """Why a cell that holds something became empty, or NULL."""
    return F.when(is_missing(raw), F.lit(None).cast("string")).when(
        (scale == QUANTITATIVE) & num.isNull(), "non-numeric value"
    ).when((scale == ORDINAL) & labels.isNotNull() & text.isNull(), "unknown ordinal code")


def sanitize_unit(unit: Column) -> Column:
    """Unit as a column-name token: lower case, superscripts 2 and 3 as digits."""
    s = F.translate(F.lower(strip(F.coalesce(unit, F.lit("")))), "²³", "23")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def column_name(trait: Column, scale: Column, unit: Column) -> Column:
    """Trait name, with the unit token when it is a measured trait with one."""
    token = sanitize_unit(unit)
    return F.when((scale == QUANTITATIVE) & (token != ""), F.concat_ws("_", trait, token)).otherwise(trait)


def custom_id(line: Column, shard: Column) -> Column:
    return F.concat(line, F.lit(CUSTOM_ID_SEPARATOR), shard)


def split_custom_id(cid: Column) -> Column:
    """``(line_id, shard_id)`` split at the last separator; no separator: all shard."""
    shard = F.substring_index(cid, CUSTOM_ID_SEPARATOR, -1)
    line_chars = F.length(cid) - F.length(shard) - len(CUSTOM_ID_SEPARATOR)
    return F.struct(
        F.substring(cid, F.lit(1), F.greatest(line_chars, F.lit(0))).alias("line_id"), shard.alias("shard_id"))


def is_reserved(key: Column) -> Column:
    """Top-level keys that are metadata, not groups."""
    return key.startswith("_")


def is_transient(status: Column, kind: Column, extra: tuple[int, ...] = ()) -> Column:
    """Worth a retry: a transient HTTP status or a failed connection."""
    by_status = F.coalesce(status.isin(*TRANSIENT_STATUS, *extra), F.lit(False))
    return by_status | F.coalesce(kind.isin("connection", "timeout"), F.lit(False))


def is_size_limit(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    hit = F.lit(False)
    for marker in SIZE_LIMIT_MARKERS:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def error_text(kind: Column, message: Column, whole: Column | None = None) -> Column:
    """``type: message`` of a failed request, with fallbacks for missing parts."""
    rest = F.coalesce(message, whole) if whole is not None else F.coalesce(message, F.lit("None"))
    return F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(": "), rest)


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, kind in MEDIA_TYPES.items():
        out = F.when(suffix == ext, F.lit(kind)).otherwise(out)
    return out


def base64_content(content: Column) -> Column:
    return F.base64(content)


def categories(values: Column) -> Column:
    """Nominal values as ``(value, definition)``, from bare strings or objects."""
    items = F.try_variant_get(values, "$", "array<variant>")
    return F.transform(
        items,
        lambda e: F.struct(
            F.coalesce(
                F.try_variant_get(e, "$.value", "string"), F.try_variant_get(e, "$", "string")
            ).alias("value"),
            F.try_variant_get(e, "$.definition", "string").alias("definition"),
        ),
    )


def trait_cost(scale: Column, n_values: Column) -> Column:
    """2 for the answer object, plus one per allowed value and one for the sentinel."""
    listed = scale.isin(NOMINAL, ORDINAL)
    return (F.lit(2) + F.when(listed, F.coalesce(n_values, F.lit(0)) + 1).otherwise(0)).cast("long")


def enum_equal(a: Column, b: Column) -> Column:
    """Same members whatever the order or repeats."""
    same = F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    return F.coalesce(same, a.isNull() & b.isNull())


def json_kind(v: Column) -> Column:
    """Type name of a VARIANT: string, boolean, void (JSON null), object, array or a number type."""
    return F.lower(F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1))


def json_brackets(text: Column) -> Column:
    """The braces of a JSON text, objects and lists alike; strings don't count."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    return F.translate(F.regexp_replace(bare, r"[^{}\[\]]+", ""), "[]", "{}")


def bracket_depth(brackets: Column) -> Column:
    """How deep the braces are nested."""
    def step(state: Column, sign: Column) -> Column:
        now = state["now"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.coalesce(F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"]), F.lit(0))


def json_depth(text: Column) -> Column:
    """How deep objects and lists of a JSON text are nested; 0 for a bare value."""
    return bracket_depth(json_brackets(text))


def deepest(df: DataFrame, text: Column) -> int:
    """How many levels the deepest JSON text of a column has, 1 at least.

    Texts of one shape have the same braces, which are followed once for each shape.
    """
    shapes = df.select(json_brackets(text).alias("_b")).distinct()
    return max(1, shapes.agg(F.max(bracket_depth(F.col("_b")))).first()[0] or 1)


def is_number(kind: Column) -> Column:
    return ~kind.isin("string", "boolean", "void", "object", "array")
