"""Which run a record comes from, and refusing to mix runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window, functions as F

from ..constants import IDENTITY_FIELDS, PROVENANCE_KEY
from ..session import small_rows


class MixedRunsError(ValueError):
    """Records of more than one run where one run was expected."""


class ForeignStoreError(ValueError):
    """A partial store that another run created."""


def record_block(documents: DataFrame, body: str = "body") -> DataFrame:
    """Add ``block``: the provenance object of each document, NULL if it has none."""
    fields = "struct<" + ",".join(f"{f}:string" for f in IDENTITY_FIELDS) + ">"
    text = F.get_json_object(body, f"$.{PROVENANCE_KEY}")
    return documents.withColumn("block", F.when(text.startswith("{"), F.from_json(text, fields)))


def resolve_provenance(records: DataFrame, stamp: DataFrame | None, block: str = "block") -> DataFrame:
    """Add provider, model and schema version of each record.

    A record's own block counts as a whole, even where a field of it is empty;
    only records without one take the run stamp, and NULLs when there is none.
    """
    rows = small_rows(stamp, 1) if stamp is not None else []
    if rows is None:
        raise ValueError("a run has one stamp")
    fallback = rows[0] if rows else Row(**{f: None for f in IDENTITY_FIELDS})
    has = F.col(block).isNotNull()
    return records.withColumns({
        f: F.when(has, F.col(block)[f]).otherwise(F.lit(fallback[f]).cast("string")) for f in IDENTITY_FIELDS
    }).withColumn("from_stamp", ~has)


def run_identities(records: DataFrame, line: str = "line_id", shown: int = 4) -> DataFrame:
    """Records per (provider, model, schema version), with the first few ids.

    The ids come from a ranked top-n, which Spark cuts down inside each task
    before any row is moved.
    """
    fields = list(IDENTITY_FIELDS)
    counts = records.groupBy(*fields).agg(F.count(F.lit(1)).alias("records"))
    ranked = records.select(*fields, line).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*fields).orderBy(line)))
    first = ranked.where(F.col("_rn") <= shown).groupBy(*fields).agg(
        F.array_sort(F.collect_list(line)).alias("first_ids"))
    same = [counts[f].eqNullSafe(first[f]) for f in fields]
    return counts.join(first, same).select(*[counts[f] for f in fields], "records", "first_ids")


def assert_single_run(records: DataFrame, allow_mixed: bool = False, line: str = "line_id") -> DataFrame:
    """The records, or :class:`MixedRunsError` naming the runs found."""
    if not allow_mixed:
        found = run_identities(records, line).limit(5).collect()
        if len(found) > 1:
            raise MixedRunsError("; ".join(
                f"{r.provider}/{r.model}/{r.schema_version}: {r.records} record(s), "
                f"{', '.join(r.first_ids)}" for r in found))
    return records


def assert_store_identity(stamp: dict | None, provider: str, model: str, schema_version: str | None) -> dict:
    """The stamp to keep, or :class:`ForeignStoreError` for another run's store.

    A stamp without a schema version is older and gets this run's; a run that
    does not know its version accepts the store as it is.
    """
    if stamp is None:
        return {"provider": provider, "model": model, "schema_version": schema_version}
    if (stamp.get("provider"), stamp.get("model")) != (provider, model):
        raise ForeignStoreError(f"store of {stamp.get('provider')}/{stamp.get('model')}, run of {provider}/{model}")
    if "schema_version" not in stamp:
        return {**stamp, "schema_version": schema_version}
    if schema_version is not None and stamp["schema_version"] != schema_version:
        raise ForeignStoreError(f"store of schema {stamp['schema_version']}, run of schema {schema_version}")
    return stamp


def provenance_blocks(records: DataFrame, block: str = "block") -> DataFrame:
    """Distinct blocks as key-sorted JSON with their record count; ``mixed`` if several."""
    fields = records.schema[block].dataType.names
    ordered = F.struct(*[F.col(block)[f].alias(f) for f in sorted(fields)])
    text = F.when(F.col(block).isNull(), "{}").otherwise(F.to_json(ordered, {"ignoreNullFields": "false"}))
    blocks = records.groupBy(text.alias("block")).agg(F.count(F.lit(1)).alias("records"))
    several = blocks.select(F.count(F.lit(1)) > 1).scalar()
    return blocks.select("block", "records", several.alias("mixed"))
