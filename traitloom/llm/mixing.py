"""Mixing sources to target weights, in DataFrame functions alone.

The words of each source are packed, document after document, into blocks of
fixed length.  Every output slot takes one block: slot numbers of a source run
through a pseudorandom permutation of the block numbers (a new one for every
pass over the source), and slots meet documents by joining on the block number.
The last slot of a source takes only the words that its target still lacks, so
the words taken equal the rounded target.

How many slots of which source stand in which output shard is a multinomial
draw, closed so that the totals are the targets; these counts make the slots.
A slot's place in its shard comes from a permutation of the shard's places.
``slots`` gives the blocks so laid out; the rows of ``mix`` and
``mixed_documents`` are documents, whose blocks stand in many shards.

Targets: sources in order of their code points, null last, weigh 1, 2, 3,
1, 2, 3, ... and share all words; a target stops at three times its source's
size and the excess is shared by weight among the others.

Null texts and texts without words have size 0, take nothing and stay in the
result.  A null source is a source.  Repeated rows are separate documents.
Nulls in ids are allowed.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import blocks_of, bounded, once, scratch
from .common import WORD, col, free_name

#: Words in a block, slots in an output shard, times a source may be repeated.
BLOCK = 64
SHARD_SLOTS = 8192
REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Documents whose offsets one window numbers together.
RUN_ROWS = 4096
#: Slots that one row unfolds to, draws of a task, and marks by which a draw finds its source.
SLOT_RUN = 16384
DRAWS = 1 << 20
DRAW_MARKS = 1024
ROUNDS = 10
#: A document at its place in its source; repeated rows differ in place.
KEY = ["sid", "start", "doc_id", "source", "tie", "size"]


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def permuted(value: str, n: str, key: list[str], inverse: bool = False) -> Column:
    """The place of *value* under a permutation of 0 .. n-1 drawn by *key*.

    Swap-or-not rounds: each is its own inverse, so the inverse runs them backwards.
    """
    size, drawn = F.col(n), [F.col(k) for k in key]

    def round_(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*drawn, r), size) - x, size)
        swap = F.xxhash64(*drawn, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)

    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), F.col(value), round_)


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: ``source, sid, source_size, target`` from rows of ``source, size``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(by_name).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("cap", REPEATS * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    # sources that reach their cap first come first; the level is what a unit of weight gets from there on
    order = Window.orderBy("fills_at", "sid")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("capped", F.col("fills_at") <= F.col("level"))
    shared = F.min(F.when(~F.col("capped"), F.struct("fills_at", "sid", "level"))).over(every)["level"]
    return per.select(
        "source", "sid", "source_size", "n_docs",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * shared).alias("target"))


def placed(sizes: DataFrame, sources: DataFrame, n_docs: int) -> DataFrame:
    """Every document with ``sid`` and its first word's number ``start`` in its source.

    Numbers are summed inside small runs of a source, then over the runs, so no
    window holds a whole source.
    """
    runs = max(1, -(-n_docs // RUN_ROWS))
    rows = sizes.join(bounded(sources.select(F.col("source").alias("_source"), "sid")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(runs)))
    inside = Window.partitionBy("sid", "run").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.join(bounded(sources.select(F.col("source").alias("_source"), "sid")), F.col("source").eqNullSafe(F.col("_source"))).groupBy(
        "sid", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(runs)).alias("run")).agg(F.sum("size").alias("words"))
    base = base.select("sid", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["sid", "run"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "run")


def _drawn_counts(per: DataFrame, all_slots: int, seed: int) -> DataFrame:
    """``sid, shard, from, to``: which slots of each source stand in which output shard.

    Each of a shard's places draws a source with the chance that the source has
    in the mix, so counts of sources in a shard are a multinomial draw.  A
    source gives its slots to shard after shard as drawn, until it has no more;
    what it has left then goes to the last shard, which closes the totals.
    """
    spark = per.sparkSession
    n_shards, width = -(-all_slots // SHARD_SLOTS), -(-all_slots // DRAW_MARKS)
    ends = per.withColumn("high", F.sum("n_slots").over(Window.orderBy("sid"))).withColumn("low", F.col("high") - F.col("n_slots"))
    # a draw finds its source among those of its mark
    marks = ends.select("sid", "low", "high", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")).alias("mark"))
    draws = spark.range(0, all_slots, 1, max(blocks_of(spark), all_slots // DRAWS)).select(
        F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(all_slots)).alias("u"))
    draws = draws.withColumn("mark", F.expr(f"u div {width}")).join(bounded(marks), "mark").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    counts = draws.groupBy("sid", "shard").agg(F.count("*").alias("drawn"))
    upto = counts.withColumn("to", F.sum("drawn").over(Window.partitionBy("sid").orderBy("shard")))
    upto = upto.join(bounded(per.select("sid", "n_slots")), "sid").select(
        "sid", "shard", F.least(F.col("to") - F.col("drawn"), "n_slots").alias("from"), F.least("to", "n_slots").alias("to"))
    path = scratch(spark, "mix-draws")
    upto.where("from < to").write.parquet(path)
    upto = spark.read.parquet(path)
    given = upto.groupBy("sid").agg(F.max("to").alias("given"))
    left = per.select("sid", "n_slots").join(given, "sid", "left").select(
        "sid", F.lit(n_shards - 1).cast("long").alias("shard"), F.coalesce("given", F.lit(0)).cast("long").alias("from"), F.col("n_slots").alias("to"))
    return upto.unionByName(left.where("from < to"))


def slots(sources: DataFrame, seed: int = 7) -> DataFrame:
    """Every slot of the mix: ``sid, slot, block, take, whole, shard, place``.

    ``take`` words from the start of block ``block`` of source ``sid`` go to
    place ``place`` of output shard ``shard``.  ``whole`` says that the slot
    belongs to a pass that takes every block of the source.
    """
    spark = sources.sparkSession
    per = sources.where("source_size > 0 and target > 0").select(
        "sid", F.col("source_size").alias("words"), F.ceil(F.col("source_size") / BLOCK).alias("n"),
        F.round("target").cast("long").alias("wanted"))
    per = per.withColumn("passes", F.expr("wanted div words")).withColumn("rest", F.expr("wanted % words"))
    per = per.withColumn("last_block", F.col("n") - 1).withColumn("last_words", F.col("words") - F.col("last_block") * BLOCK)
    per = per.withColumn("n_slots", F.col("passes") * F.col("n") + F.when(F.col("rest") > 0, F.least("n", F.expr(f"rest div {BLOCK} + 2"))).otherwise(0))
    per = per.where("n_slots > 0").withColumn("seed", F.xxhash64("sid", F.lit(seed)))
    per = per.withColumn("last_at", permuted("last_block", "n", ["seed", "passes"], inverse=True))
    all_slots = per.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    counts = _drawn_counts(per, max(all_slots, 1), seed)
    in_shard = Window.partitionBy("shard")
    counts = counts.withColumn("count", F.col("to") - F.col("from")).withColumn("shard_slots", F.sum("count").over(in_shard)).withColumn(
        "first_place", F.sum("count").over(in_shard.orderBy("sid", "from")) - F.col("count")).drop("count")
    runs = counts.withColumn("begin", F.explode(F.expr(f"sequence(from, to - 1, {SLOT_RUN}L)")))
    # the number is stated: Spark would put rows as small as these into one task, which then unfolds every slot
    runs = runs.join(bounded(per), "sid").repartition(max(blocks_of(spark), all_slots // DRAWS), "sid", "begin")
    out = runs.withColumn("slot", F.explode(F.expr(f"sequence(begin, least(begin + {SLOT_RUN}, to) - 1)")))
    out = out.withColumn("pass", F.expr("slot div n")).withColumn("in_pass", F.expr("slot % n"))
    out = once(out, "block", permuted("in_pass", "n", ["seed", "pass"]))
    full = F.when(F.col("block") == F.col("last_block"), F.col("last_words")).otherwise(F.lit(BLOCK))
    had = F.col("in_pass") * BLOCK - F.when(F.col("last_at") < F.col("in_pass"), BLOCK - F.col("last_words")).otherwise(0)
    take = F.when(F.col("pass") < F.col("passes"), full).otherwise(F.least(full, F.greatest(F.lit(0), F.col("rest") - had)))
    out = out.withColumn("take", take).where("take > 0").withColumn("at", F.col("first_place") + F.col("slot") - F.col("from")).withColumn("all_seed", F.lit(seed))
    whole = (F.col("pass") < F.col("passes")).alias("whole")
    return out.select("sid", "slot", "block", "take", whole, "shard", permuted("at", "shard_slots", ["all_seed", "shard"]).alias("place"))


def shard_counts(mix: DataFrame) -> DataFrame:
    """How many slots of each output shard each source fills."""
    return mix.groupBy("shard", "sid").agg(F.count("*").alias("n_slots"), F.sum("take").alias("words"))


def _pieces(docs: DataFrame, text: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents cut at block borders with what slots take of each piece, documents without words, and sources.

    A piece has one row for every slot that draws its block, or one without a
    slot.  Words ``begin`` to ``begin + used - 1`` of the document, counted from
    0, are those that the slot takes.
    """
    spark = docs.sparkSession
    path = scratch(spark, "mix-sizes")
    docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("tie")).write.parquet(path)
    sizes = spark.read.parquet(path)
    path = scratch(spark, "mix-sources")
    targets(sizes).write.parquet(path)
    sources = spark.read.parquet(path)
    n_docs = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]

    rows = placed(sizes, sources, n_docs)
    pieces = rows.where("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    drawn = slots(sources, seed).select("sid", "block", "take", "whole")
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    stop = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("take"))
    used = F.when(F.col("take").isNotNull(), F.greatest(F.lit(0), stop - begin)).otherwise(F.lit(0))
    # both sides grow with the input, which the planner cannot see through the unfolding
    met = pieces.hint("merge").join(drawn, ["sid", "block"], "left")
    return met.select(*KEY, "whole", (begin - F.col("start")).alias("begin"), used.cast("long").alias("used")), rows.where("size = 0"), sources


def mix(docs: DataFrame, text: str = "text", seed: int = 7) -> DataFrame:
    """``doc_id, source, tie, size, source_size, target, taken`` for every document.

    ``tie`` is a hash of the text.  Texts are read once; all further work is on
    narrow rows kept in the shared folder.
    """
    pieces, empty, sources = _pieces(docs, text, seed)
    per_source = bounded(sources.select("sid", "source_size", "target"))
    taken = pieces.groupBy(*KEY).agg(F.sum("used").alias("taken"))
    empty = empty.select(*KEY, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).join(per_source, "sid").select("doc_id", "source", "tie", "size", "source_size", "target", "taken")


def cut(words: Column, ranges: Column) -> Column:
    """The *ranges* (``begin, used``) of *words*, each with the blanks before it, joined; no blanks begin it unless they begin the text."""
    one = lambda r: F.array_join(F.slice(words, (r["begin"] + 1).cast("int"), r["used"].cast("int")), "")
    joined = F.array_join(F.transform(ranges, one), "")
    return F.when(ranges[0]["begin"] > 0, F.regexp_replace(joined, r"\A[\x20\x09-\x0D]+", "")).otherwise(joined)


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 7) -> DataFrame:
    """The mix as documents with the columns of *docs*.

    A document comes once for every pass over its source that draws some of its
    words.  A pass that takes all blocks gives it whole; from the last pass it
    has the words of exactly the blocks drawn, in the order of the text.
    Documents of which nothing is drawn, empty ones included, are left out.
    ``n_chars``, if there, follows the text.
    """
    name = lambda x: free_name(docs, x)
    k1, k2, nth, drawn, cuts, words = map(name, ("_k1", "_k2", "_nth", "_drawn", "_cuts", "_words"))
    key = lambda tie: [F.xxhash64(F.lit(n), "doc_id", "source", tie).alias(k) for n, k in ((1, k1), (2, k2))]
    pieces, _, _ = _pieces(docs, text, seed)
    # the ranges of a document are a small part of its text; a document drawn as a whole needs none
    part, last = F.struct("begin", "used"), ~F.col("whole")
    wanted = pieces.where("used > 0").groupBy(*KEY).agg(
        F.sum(F.when(F.col("whole"), F.col("used")).otherwise(0)).alias("in_whole"), F.sum(F.when(last, F.col("used")).otherwise(0)).alias("in_last"),
        F.array_sort(F.collect_list(F.when(last, part))).alias("parts"))
    kind = "array<struct<begin:bigint,used:bigint>>"
    copies = F.transform(F.expr("sequence(1L, in_whole div size)"), lambda _: F.lit(None).cast(kind))
    copies = F.when(F.expr("in_whole >= size"), copies).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
    rest = F.when(F.col("in_last") == F.col("size"), F.array(F.lit(None).cast(kind))).when(
        F.col("in_last") > 0, F.array(F.col("parts").cast(kind))).otherwise(F.expr(f"cast(array() as array<{kind}>)"))
    wanted = wanted.select(*key(F.col("tie")), F.concat(copies, rest).alias(drawn))
    # rows that repeat as a whole share one text, which meets the ranges of each of them;
    # numbering and join use one partitioning, so the texts move once
    rows = docs.select(*map(col, docs.columns), *key(F.xxhash64(text))).repartition(k1, k2)
    number = F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(0)))
    rows = rows.withColumn(nth, number).where(F.col(nth) == 1).drop(nth).join(wanted, [k1, k2])
    rows = rows.withColumn(cuts, F.explode(drawn))
    found = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    partly = F.col(cuts).isNotNull()
    rows = once(rows, words, F.when(partly, found))
    out = rows.withColumn(text, F.when(partly, cut(F.col(words), F.col(cuts))).otherwise(F.col(text)))
    if "n_chars" in docs.columns and text != "n_chars":
        out = out.withColumn("n_chars", F.when(partly, F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(col, docs.columns))
