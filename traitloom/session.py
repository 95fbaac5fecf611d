"""Session settings, shared scratch space and size checks for small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

#: Largest dimension (traits, shards, prices) turned into plan literals.
MAX_DIMENSION_ROWS = 5_000

_LOCAL_DIRS: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; all are runtime settings.

    Duplicate keys in an answer keep the last one, as JSON readers do; the two
    AQE settings let Spark split hot join keys and merge small partitions.
    Estimates don't know how many rows an unfolding gives, so a side is broadcast
    by its size only where that was measured at run time.
    """
    for key, value in {
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="traitloom-")
    return _LOCAL_DIRS[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write is done, instead of when the driver collects its garbage.

    For steps whose rows are read back from what they wrote, so that two steps
    never hold their files at once.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back, so later steps see fixed values.

    A reliable checkpoint: it survives the loss of executors.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def small_rows(df: DataFrame, limit: int = MAX_DIMENSION_ROWS) -> list[Row] | None:
    """The rows of a control table, or None when there are more than *limit*.

    At most ``limit + 1`` rows ever reach the driver, so the caller can put a
    dimension of proven size into the plan and join a larger one instead.
    """
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def bounded(dimension: DataFrame, limit: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """The dimension, marked for broadcast only if it has at most *limit* rows.

    A larger one is joined by a shuffle, where Spark splits keys that are hot.
    """
    few = dimension.limit(limit + 1).count() <= limit
    return F.broadcast(dimension) if few else dimension


def opened(df: DataFrame, node: str, key: str, value: str, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per entry of a VARIANT object; with *outer*, at least one per input row."""
    tvf = df.sparkSession.tvf
    unfold = tvf.variant_explode_outer if outer else tvf.variant_explode
    rows = df.select(*keep, F.col(node).alias("_opened")).lateralJoin(unfold(F.col("_opened").outer()))
    entries = rows.select(*keep, F.col("key").alias(key), F.col("value").alias(value))
    return entries if outer else entries.where(F.col(key).isNotNull())


def exact(name: str) -> Column:
    """A column by its exact name; dots, blanks and backticks are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is costly to compute and used more than once.

    Filters on a plain column move below its projection and take a copy of the
    expression with them; one unfolded from a single-item list stays put.
    """
    keep = [exact(c) for c in df.columns if c != name]
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def blocks_of(spark: SparkSession) -> int:
    """How many ranges an ordered pass uses."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sql_literal(value) -> Column:
    """A literal column for a Python scalar, list, row or None."""
    if isinstance(value, Row):
        return F.struct(*[sql_literal(v).alias(n) for n, v in value.asDict(False).items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[sql_literal(v) for v in value])
    return F.lit(value)
