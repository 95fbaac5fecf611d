"""Trait schema documents: load, check, lint, compare, count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    ABSENCE_CATEGORIES, ABSENCE_PATTERN, FORBIDDEN_KEYS, MAX_NOMINAL_CATEGORIES, MAX_ORDINAL_LEVELS, NOMINAL,
    ORDINAL, ORDINAL_LEVELS_WITHOUT_NOTE, QUANTITATIVE, SENTINEL, SNAKE_CASE_PATTERN,
)
from ..functions.nodes import differences, plain_nodes
from ..functions.text import strip
from ..functions.values import bracket_depth, categories, deepest, json_brackets, json_kind, trait_cost
from ..session import bounded, once, settle
from .table import LEVELS

TRAIT = (
    "array<struct<trait_name:string,scale_type:string,unit:string,values:string,"
    "description:string,design_note:string,support:bigint>>"
)
GROUPS = "array<struct<group:string,group_name:string,name:string,description:string,traits:string>>"


class SchemaDocumentError(ValueError):
    """A schema document of unknown shape, or with missing or repeated group names."""


def _groups(docs: DataFrame, body: str) -> DataFrame:
    """Each document with its ordered groups, whichever of the two shapes it has.

    Groups are read as JSON text, which keeps the order of the keys.  ``error``
    says why a document cannot be used.
    """
    by_name = F.get_json_object(body, "$.trait_groups")
    listed = F.get_json_object(body, "$.groups")
    shape = F.when(by_name.startswith("{"), "object").when(listed.startswith("["), "list")
    from_object = F.transform(
        F.map_entries(F.from_json(by_name, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("group_name"), F.get_json_object(e["value"], "$.traits").alias("traits")))

    def filled(c: Column) -> Column:
        return F.when(c != "", c)
    from_list = F.transform(
        F.from_json(listed, GROUPS),
        lambda g: F.struct(
            F.coalesce(filled(g["group"]), filled(g["group_name"]), filled(g["name"])).alias("group_name"),
            g["traits"].alias("traits")))
    shaped = docs.withColumn("_shape", shape)
    grouped = once(shaped, "_groups", F.when(F.col("_shape") == "object", from_object).when(
        F.col("_shape") == "list", from_list))
    names = F.transform("_groups", lambda g: g["group_name"])
    error = (
        F.when(F.col("_shape").isNull(), "unknown shape")
        .when(F.exists(names, lambda n: n.isNull()), "group without a name")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate group name")
    )
    return grouped.withColumn("error", error)


def document_errors(docs: DataFrame, body: str = "body") -> DataFrame:
    """``(doc_id, error)`` of documents that cannot be read as a schema."""
    return _groups(docs, body).select("doc_id", "error").where(F.col("error").isNotNull())


def read_traits(docs: DataFrame, body: str = "body", strict: bool = False) -> DataFrame:
    """One row per (document, group, trait) in schema order.

    *strict* refuses unreadable documents; else they yield no traits and show up
    in :func:`document_errors`.
    """
    if strict:
        bad = document_errors(docs, body).limit(5).collect()
        if bad:
            raise SchemaDocumentError("; ".join(f"{r.doc_id}: {r.error}" for r in bad))
    groups = _groups(docs, body).where(F.col("error").isNull()).select("doc_id", F.posexplode("_groups").alias("_g", "_group"))
    traits = groups.select(
        "doc_id", (F.col("_g") + 1).alias("group_ord"), F.col("_group.group_name").alias("group_name"),
        F.posexplode(F.from_json("_group.traits", TRAIT)).alias("_t", "_trait"))
    flat = traits.select("doc_id", "group_ord", (F.col("_t") + 1).alias("trait_ord"), "group_name", "_trait.*")
    scale = F.col("scale_type")
    levels = F.from_json("values", LEVELS)
    listed = F.when(scale == NOMINAL, categories(F.try_parse_json("values")))
    return flat.withColumns({
        "levels": F.when((scale == ORDINAL) & (F.size(levels) > 0), levels),
        "categories": listed,
        "n_values": F.when(scale == ORDINAL, F.size(levels)).when(scale == NOMINAL, F.size(listed)),
    }).drop("values")


def traits_from_manifest(docs: DataFrame, body: str = "body") -> DataFrame:
    """Traits of shard manifests, groups numbered by first appearance."""
    entry = "array<struct<group:string,trait:string,scale_type:string,unit:string>>"
    listed = docs.select("doc_id", F.from_json(F.get_json_object(body, "$.all_traits"), entry).alias("_all"))
    names = F.array_distinct(F.transform("_all", lambda t: t["group"]))
    return listed.select("doc_id", names.alias("_names"), F.posexplode("_all").alias("pos", "_t")).select(
        "doc_id", F.array_position("_names", F.col("_t.group")).cast("int").alias("group_ord"),
        (F.col("pos") + 1).alias("trait_ord"), F.col("_t.group").alias("group_name"),
        F.col("_t.trait").alias("trait_name"), F.col("_t.scale_type").alias("scale_type"),
        F.col("_t.unit").alias("unit"))


def shard_properties(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per trait of constrained-output schemas; ``node`` is its JSON text.

    Other columns of *docs*, such as the shard number, stay.
    """
    def opened(text: Column) -> Column:
        return F.from_json(F.get_json_object(text, "$.properties"), "map<string,string>")
    kept = [c for c in docs.columns if c != body]
    groups = docs.select(*kept, F.posexplode(opened(F.col(body))).alias("group_pos", "group_name", "_g"))
    return groups.select(
        *kept, "group_pos", "group_name", F.posexplode(opened(F.col("_g"))).alias("trait_pos", "trait_name", "node"))


def traits_from_shards(shards: DataFrame, master: DataFrame, body: str = "body", order: str = "shard_no") -> DataFrame:
    """Best-effort traits for keys the master lacks; the first shard that has one counts.

    Integer members make a trait ordinal, each code being its own label; any
    other trait counts as nominal.  There is no unit.
    """
    key = ["doc_id", "group_name", "trait_name"]
    place = F.struct(order, "group_pos", "trait_pos")
    first = shard_properties(shards, body).groupBy(*key).agg(
        F.min_by("node", place).alias("node"), F.min(place).alias("place"))
    found = first.join(master.select(*key), key, "left_anti")
    enum = F.try_variant_get(F.try_parse_json("node"), "$.properties.value.enum", "array<variant>")
    whole = F.filter(enum, lambda v: F.schema_of_variant(v) == "BIGINT")
    codes = F.array_sort(F.transform(whole, lambda v: F.try_variant_get(v, "$", "int")))
    typed = found.withColumn("_codes", codes)
    ordinal = F.size("_codes") > 0
    levels = F.transform("_codes", lambda c: F.struct(
        c.alias("level"), c.cast("string").alias("label"), F.lit(None).cast("string").alias("definition")))
    return typed.select(
        *key, "place", F.when(ordinal, ORDINAL).otherwise(NOMINAL).alias("scale_type"),
        F.lit(None).cast("string").alias("unit"), F.when(ordinal, levels).alias("levels"))


# -- checks -----------------------------------------------------------------


def nodes(docs: DataFrame, body: str = "body", max_depth: int | None = None) -> DataFrame:
    """Every keyed node of a JSON document: ``(doc_id, path, key)``.

    Keys join the path with dots, list positions as ``[i]``.  Levels unfold in
    place, as many as the documents have; where the caller gives *max_depth*, a
    deeper document fails the query rather than losing nodes.
    """
    max_depth = max_depth or deepest(docs, F.col(body))

    def children(path: Column, node: Column) -> Column:
        keyed = F.transform(
            F.map_entries(F.try_variant_get(node, "$", "map<string,variant>")),
            lambda e: F.struct(F.concat(path, F.lit("."), e["key"]).alias("path"), e["key"].alias("key"),
                               e["value"].alias("node")))
        placed = F.transform(
            F.try_variant_get(node, "$", "array<variant>"),
            lambda v, i: F.struct(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"),
                                  F.lit(None).cast("string").alias("key"), v.alias("node")))
        return F.coalesce(keyed, placed, F.array().cast(
            "array<struct<path:string,key:string,node:variant>>"))
    start = F.struct(F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(body).alias("node"))
    rows = docs.select("doc_id", F.explode(children(start["path"], start["node"])).alias("_n"))
    for _ in range(max_depth - 1):
        # A node that was opened stays as a row without its content.
        shut = F.array(F.struct("_n.path", "_n.key", F.lit(None).cast("variant").alias("node")))
        rows = rows.select("doc_id", F.explode(F.concat(shut, children(F.col("_n.path"), F.col("_n.node")))).alias("_n"))
    deeper = json_kind(F.col("_n.node")).isin("object", "array") & ~F.to_json("_n.node").isin("{}", "[]")
    guard = F.when(deeper, F.raise_error(F.lit("document nested too deep; raise max_depth")).cast("boolean")).otherwise(True)
    return rows.where(guard).select("doc_id", F.col("_n.path").alias("path"), F.col("_n.key").alias("key"))


def forbidden_nodes(docs: DataFrame, body: str = "body") -> DataFrame:
    """Keys a constrained-output schema must not use, with the place of each."""
    return nodes(docs, body).where(F.col("key").isin(*FORBIDDEN_KEYS))


def schema_problems(docs: DataFrame, body: str = "body") -> DataFrame:
    """Traits whose schema breaks the answer layout, one row per broken rule."""
    node = F.col("node")
    keys = F.coalesce(F.json_object_keys(F.get_json_object(node, "$.properties")), F.array().cast("array<string>"))
    answer = F.array(F.lit("rationale"), F.lit("value"))
    required = F.from_json(F.get_json_object(node, "$.required"), "array<string>")
    closed = F.get_json_object(node, "$.additionalProperties")
    problems = F.array(
        F.when(~F.slice(keys, 1, 2).eqNullSafe(answer), "key order"),
        F.when(~required.eqNullSafe(answer), "required"),
        F.when(~closed.eqNullSafe(F.lit("false")), "additionalProperties"))
    return shard_properties(docs, body).select(
        "doc_id", "group_name", "trait_name", F.explode(F.array_compact(problems)).alias("problem"))


def lint_traits(traits: DataFrame) -> DataFrame:
    """Hygiene rules each trait breaks, ``(doc_id, group_name, trait_name, rule)``."""
    scale = F.col("scale_type")
    n = F.coalesce("n_values", F.lit(0))
    note = F.coalesce("design_note", F.lit(""))

    def undefined(values: Column) -> Column:
        return F.coalesce(F.exists(values, lambda v: F.coalesce(v["definition"], F.lit("")) == ""), F.lit(False))
    rules = F.array(
        F.when((scale == NOMINAL) & (n > MAX_NOMINAL_CATEGORIES), "too many categories"),
        F.when((scale == ORDINAL) & (n > MAX_ORDINAL_LEVELS), "too many levels"),
        F.when((scale == ORDINAL) & (n > ORDINAL_LEVELS_WITHOUT_NOTE) & (strip(note) == ""), "levels need a note"),
        F.when(undefined(F.col("categories")) | undefined(F.col("levels")), "missing definition"),
        F.when(~F.col("trait_name").rlike(SNAKE_CASE_PATTERN), "not snake case"),
        F.when(F.col("uses") > 1, "name reused"))
    uses = traits.groupBy("doc_id", "trait_name").agg(F.count(F.lit(1)).alias("uses"))
    return traits.join(uses, ["doc_id", "trait_name"]).select(
        "doc_id", "group_name", "trait_name", F.explode(F.array_compact(rules)).alias("rule"))


def absence_token(scale: Column, cats: Column, levels: Column) -> Column:
    """The category or first level that stands for absence, or NULL."""
    hit = F.filter(cats, lambda c: F.lower(strip(c["value"])).isin(*ABSENCE_CATEGORIES))
    low = F.get(levels, F.lit(0))
    words = F.concat(F.coalesce(low["label"], F.lit("")), F.lit(" "), F.coalesce(low["definition"], F.lit("")))
    reads = words.rlike("(?iU)" + ABSENCE_PATTERN)
    return F.when(scale == NOMINAL, F.get(hit, F.lit(0))["value"]).when(
        (scale == ORDINAL) & reads,
        F.concat(F.lit("level "), low["level"].cast("string"), F.lit(" ("), low["label"], F.lit(")")))


def absence_audit(traits: DataFrame) -> DataFrame:
    """Per schema: categorical traits with and without a value for absence."""
    token = absence_token(F.col("scale_type"), F.col("categories"), F.col("levels"))
    listed = F.col("scale_type").isin(NOMINAL, ORDINAL)
    return traits.withColumn("_token", token).groupBy("doc_id").agg(
        F.count_if(listed).alias("categorical"),
        F.count_if(F.col("scale_type") == QUANTITATIVE).alias("quantitative"),
        F.count_if(F.col("_token").isNotNull()).alias("with_absence"),
        F.count_if(listed & F.col("_token").isNull()).alias("without_absence"))


def coverage(master: DataFrame, shards: DataFrame) -> DataFrame:
    """Traits not held by exactly one shard: ``duplicate``, ``missing`` or ``extra``."""
    key = ["doc_id", "group_name", "trait_name"]
    declared = master.select(*key, F.lit(1).alias("_m"), F.lit(0).alias("_s"))
    placed = shards.select(*key, F.lit(0).alias("_m"), F.lit(1).alias("_s"))
    sides = declared.unionByName(placed).groupBy(*key).agg(F.sum("_m").alias("m"), F.sum("_s").alias("s"))
    problems = F.array(
        F.when(F.col("s") > 1, "duplicate"),
        F.when((F.col("m") > 0) & (F.col("s") == 0), "missing"),
        F.when((F.col("m") == 0) & (F.col("s") > 0), "extra"))
    return sides.select(*key, F.explode(F.array_compact(problems)).alias("problem"))


def trait_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference both ways: traits only in *a* and only in *b*.

    Both sides meet in one grouping, so none is held whole anywhere.
    """
    key = ["doc_id", "group_name", "trait_name"]
    sides = a.select(*key, F.lit("missing").alias("side")).unionByName(b.select(*key, F.lit("extra").alias("side")))
    return sides.groupBy(*key).agg(F.min("side").alias("side"), F.max("side").alias("_other")).where(
        F.col("side") == F.col("_other")).drop("_other")


def trait_counts(traits: DataFrame, by: list[str]) -> DataFrame:
    """Traits and grammar cost per group of *by*, split by scale."""
    price = trait_cost(F.col("scale_type"), F.col("n_values"))
    return traits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("traits"),
        *[F.count_if(F.col("scale_type") == s).alias(s) for s in (NOMINAL, ORDINAL, QUANTITATIVE)],
        F.sum(price).alias("cost"))


def allowed_values(traits: DataFrame) -> DataFrame:
    """Values each trait may take, as text, the sentinel last; NULL = any text."""
    scale = F.col("scale_type")
    na = F.lit(SENTINEL)
    listed = F.when(scale == NOMINAL, F.array_append(F.transform("categories", lambda c: c["value"]), na)).when(
        scale == ORDINAL, F.array_append(F.transform("levels", lambda e: e["level"].cast("string")), na))
    return traits.withColumn("allowed", listed)


def violations(records: DataFrame, allowed: DataFrame) -> DataFrame:
    """Answers outside the values their trait allows."""
    rules = allowed.where(F.col("allowed").isNotNull()).select("group_name", "trait_name", "allowed")
    checked = records.join(bounded(rules), ["group_name", "trait_name"])
    return checked.where(F.col("raw").isNotNull() & ~F.array_contains("allowed", F.col("raw"))).drop("allowed")


def extract_defs(notes: DataFrame) -> DataFrame:
    """``<category> = text`` clauses of a note, for each category of ``categories``.

    A clause ends at the first semicolon or at a period that ends a sentence, so
    abbreviations and decimals stay in it.
    """
    each = notes.select("*", F.explode("categories").alias("category"))
    pattern = F.concat(F.lit(r"(?dU)\b\Q"), F.col("category"), F.lit(r"\E\b\s*=\s*(.+)"))
    tail = F.call_function("regexp_extract", F.col("note"), pattern, F.lit(1))
    found = F.regexp_like("note", pattern)
    first_end = F.regexp_extract(tail, r"(?sdU)^(.*?)(;|\.(?=\s+[A-Z])|\.\s*$|$)", 1)
    body = F.regexp_replace(strip(first_end), r"\.+$", "")
    return each.where(found).withColumn("definition", strip(body)).drop("categories")


# -- versions ---------------------------------------------------------------

NODE = "struct<path:array<string>,kind:string,payload:array<string>,node:string>"
#: What is read of a schema node, by one pass over its text.
MEMBERS = "enum string, properties string, items string, type string"


def _described(rows: DataFrame) -> DataFrame:
    """What the nodes without a ``kind`` constrain: members, named parts, items or a type.

    ``_properties`` and ``_items`` hold what is below a node, as text.
    """
    new = F.col("_n.kind").isNull()
    read = once(rows, "_f", F.when(new, F.from_json("_n.node", MEMBERS)))
    names = [m.split()[0] for m in MEMBERS.split(", ")]
    # a text that is broken further on still gives the members before that
    broken = F.coalesce(*[F.col(f"_f.{m}") for m in names]).isNull()
    enum, props, items, kept = (
        F.coalesce(F.col(f"_f.{m}"), F.when(new & broken, F.get_json_object("_n.node", f"$.{m}"))) for m in names)
    kind = F.when(enum.startswith("["), "enum").when(props.startswith("{"), "properties").when(
        items.startswith("{"), "items").otherwise("type")
    known = once(read, "_k", F.struct(kind.alias("kind"), enum.alias("enum"), props.alias("properties"), items.alias("items")))
    kind = F.when(new, F.col("_k.kind"))
    members = F.array_sort(F.array_distinct(F.transform(
        F.try_variant_get(F.try_parse_json("_k.enum"), "$", "array<variant>"), lambda v: F.to_json(v))))
    payload = F.when(kind == "enum", members).when(kind == "properties", F.json_object_keys("_k.properties")).when(
        kind == "items", F.array().cast("array<string>")).otherwise(F.array(F.get_json_object("_n.node", "$.type")))
    node = F.struct(
        F.col("_n.path").alias("path"), F.coalesce("_n.kind", "_k.kind").alias("kind"),
        F.when(new, payload).otherwise(F.col("_n.payload")).alias("payload"), F.lit(None).cast("string").alias("node"))
    return known.select(
        "doc_id", "version", node.alias("_n"), F.when(kind == "properties", F.col("_k.properties")).alias("_properties"),
        F.when(kind == "items", F.col("_k.items")).alias("_items"))


#: Documents whose nodes one step inside a task holds.
STEP_DOCS = 1_000
PATHS = "path array<string>, kind string, payload array<string>"


def _kind_of(docs: DataFrame) -> str:
    """The id and version columns of *docs* as a schema text."""
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "version"))


def _doc_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_DOCS):
            yield batch.slice(at, STEP_DOCS)


def _odd_docs(docs: DataFrame, max_depth: int | None) -> DataFrame:
    """The documents that :func:`plain_nodes` leaves to the readers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _doc_steps(batches):
            yield batch.filter(pa.array([plain_nodes(t, max_depth) is None for t in batch.column("body").to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def _plain_docs(docs: DataFrame, max_depth: int | None, kinds: list[str] | None) -> DataFrame:
    """The nodes of all other documents, each text read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _doc_steps(batches):
            row, path, kind, payload = [], [], [], []
            for i, text in enumerate(batch.column("body").to_pylist()):
                for p, k, held in plain_nodes(text, max_depth) or ():
                    if kinds is None or k in kinds:
                        row.append(i)
                        path.append(p)
                        kind.append(k)
                        payload.append(held)
            at = pa.array(row, pa.int32())
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version").take(at), pa.array(path, texts), pa.array(kind, pa.string()), pa.array(payload, texts)],
                ["doc_id", "version", "path", "kind", "payload"])
    return docs.mapInArrow(run, f"{_kind_of(docs)}, {PATHS}")


def constraint_nodes(docs: DataFrame, body: str = "body", max_depth: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Every node of a constrained-output schema with its kind and payload; of *kinds* only, where given.

    Enum members are a sorted set, part names keep their order, and the type of
    an enum node is not looked at.  A plain document is read as a whole; any
    other is opened level by level, as many as those documents have.
    """
    given = docs.select("doc_id", "version", F.col(body).alias("body"))
    max_depth = max_depth or None
    odd = _odd_docs(given, max_depth)
    plain = _plain_docs(given, max_depth, kinds)
    if max_depth is None:
        shapes = odd.select(json_brackets(F.col("body")).alias("_b")).distinct()
        n, deep = shapes.agg(F.count(F.lit(1)), F.max(bracket_depth(F.col("_b")))).first()
        if not n:
            return plain
        max_depth = max(1, deep or 1)
    rest = _opened_nodes(odd, max_depth)
    return plain.unionByName(rest if kinds is None else rest.where(F.col("kind").isin(*kinds)))


def _opened_nodes(docs: DataFrame, max_depth: int) -> DataFrame:
    """The nodes of any documents.

    Each level opens its nodes once and hands the texts of their parts on; a
    described node passes without its text.
    """
    def below(path: Column, node: Column) -> Column:
        return F.struct(path.alias("path"), F.lit(None).cast("string").alias("kind"),
                        F.lit(None).cast("array<string>").alias("payload"), node.alias("node"))
    start = below(F.array().cast("array<string>"), F.col("body"))
    rows = _described(docs.select("doc_id", "version", start.alias("_n")))
    path = F.col("_n.path")
    for _ in range(max_depth):
        props = F.transform(
            F.map_entries(F.from_json("_properties", "map<string,string>")), lambda e: below(F.concat(path, F.array(e["key"])), e["value"]))
        items = F.array(below(F.concat(path, F.array(F.lit("[]"))), F.col("_items")))
        parts = F.when(F.col("_properties").isNotNull(), props).when(F.col("_items").isNotNull(), items)
        step = F.concat(F.array("_n"), F.coalesce(parts, F.array().cast(f"array<{NODE}>")))
        rows = _described(rows.select("doc_id", "version", F.explode(step).alias("_n")))
    more = F.col("_properties").isNotNull() | F.col("_items").isNotNull()
    guard = F.when(more, F.raise_error(F.lit("schema nested too deep; raise max_depth")).cast("boolean")).otherwise(True)
    return rows.where(guard).select(
        "doc_id", "version", F.col("_n.path").alias("path"), F.col("_n.kind").alias("kind"),
        F.col("_n.payload").alias("payload"))


def _compared_docs(docs: DataFrame, versions: int, max_depth: int | None) -> DataFrame:
    """``doc_id, path, problem`` of plain documents; one row without path for an id that has another document.

    The versions of a document lie side by side and pass one by one; what is
    held is one id's distinct payloads.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[set, set, set]] | None = {}
        last, begun = None, False
        out: list[tuple] = []

        def close() -> None:
            if not begun:
                return
            if found is None:
                out.append((last, None, None))
            else:  # rows without an id have never been looked for below one another
                out.extend((last, p, why) for p, why in differences(found, versions, last is not None))

        def given() -> pa.RecordBatch:
            rows = [{"doc_id": i, "path": p, "problem": why} for i, p, why in out]
            out.clear()
            return pa.RecordBatch.from_pylist(rows, shape)

        shape = None
        for batch in _doc_steps(batches):
            if shape is None:
                shape = pa.schema([batch.schema.field("doc_id"), pa.field("path", pa.list_(pa.string())), pa.field("problem", pa.string())])
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "body"))):
                if not begun or doc != last:
                    close()
                    last, begun, found = doc, True, {}
                if found is None:
                    continue
                nodes_ = plain_nodes(text, max_depth)
                if nodes_ is None:
                    found = None
                    continue
                for path, node_kind, payload in nodes_:
                    names, kinds, payloads = found.setdefault(path, (set(), set(), set()))
                    if version is not None:
                        names.add(version)
                    kinds.add(node_kind)
                    payloads.add(payload)
            yield given()
        close()
        if out:
            yield given()
    side_by_side = docs.repartition("doc_id").sortWithinPartitions("doc_id")
    return side_by_side.mapInArrow(run, f"doc_id {kind}, path array<string>, problem string")


def schema_diff(docs: DataFrame, versions: list[str], body: str = "body", max_depth: int | None = None) -> DataFrame:
    """Places where versions of one schema constrain differently.

    All versions of a document meet, plain ones as texts, any others as one
    grouping per place.  Below a place that differs nothing more is reported.
    """
    given = docs.select("doc_id", "version", F.col(body).alias("body"))
    if not isinstance(docs.schema["doc_id"].dataType, (T.StringType, T.IntegralType)):  # ids that may equal without being the same
        return _placed_differences(given, versions, max_depth)
    found = settle(_compared_docs(given, len(versions), max_depth or None))  # few
    bad, odd = found.where(F.col("problem").isNotNull()), found.where(F.col("problem").isNull()).select(F.col("doc_id").alias("_odd"))
    if not odd.limit(1).count():
        return bad
    rest = given.join(odd, F.col("doc_id").eqNullSafe(F.col("_odd")), "left_semi")
    return bad.unionByName(_placed_differences(rest, versions, max_depth))


def _placed_differences(docs: DataFrame, versions: list[str], max_depth: int | None) -> DataFrame:
    placed = constraint_nodes(docs, "body", max_depth).groupBy("doc_id", "path").agg(
        F.collect_set("version").alias("_versions"), F.collect_set("kind").alias("_kinds"),
        F.collect_set(F.coalesce("payload", F.array().cast("array<string>"))).alias("_payloads"))
    problem = (
        F.when(F.size("_versions") < len(versions), "absent in some version")
        .when((F.size("_kinds") > 1) & F.array_contains("_kinds", "enum"), "enum in some version only")
        .when(F.size("_kinds") > 1, "kind differs")
        .when((F.size("_payloads") > 1) & (F.col("_kinds")[0] == "enum"), "enum members differ")
        .when((F.size("_payloads") > 1) & (F.col("_kinds")[0] == "properties"), "names or order differ")
        .when(F.size("_payloads") > 1, "type differs")
    )
    bad = settle(placed.select("doc_id", "path", problem.alias("problem")).where(F.col("problem").isNotNull()))  # few, met three times
    above = bad.select("doc_id", F.col("path").alias("_up"))
    parents = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    below = bad.where(F.size("path") > 0).select("doc_id", "path", F.explode(parents).alias("_up")).join(
        above, ["doc_id", "_up"], "left_semi").select("doc_id", "path").distinct()
    return bad.join(below, ["doc_id", "path"], "left_anti")


def enum_sets(docs: DataFrame, versions: list[str], body: str = "body", max_depth: int | None = None) -> DataFrame:
    """Every enum of a schema over its versions: ``(doc_id, path, same, members)``.

    Members are compared as sets, so order and repeats don't matter.  An enum
    that some version lacks is not the same; ``members`` counts the set of the
    first of *versions* and is NULL where that one has no enum there.  All
    versions meet in one aggregate per place, of which tasks keep the smallest
    and the largest set.
    """
    enums = constraint_nodes(docs, body, max_depth, ["enum"])
    payload = F.coalesce("payload", F.array().cast("array<string>"))
    return enums.groupBy("doc_id", "path").agg(
        ((F.size(F.collect_set("version")) == len(versions)) & F.min(payload).eqNullSafe(F.max(payload))).alias("same"),
        F.max(F.when(F.col("version") == versions[0], F.size(payload))).alias("members"))
