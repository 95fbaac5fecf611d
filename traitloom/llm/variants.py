"""Spelling variants: words one edit apart, found by blocked Gram matrices.

Words are counted by Spark.  A word's letter counts are a vector; one inserted
or deleted letter moves it by a squared distance of 1, a replaced one by 2, so
words at most one edit apart are at most two apart in squared distance, and in
the same or in adjacent blocks of length.

Blocks of one length would hold ever more words, so the letters are dealt to
``GROUPS`` groups, and a block holds the words with the same number of letters
in every group.  An edit takes away at most one letter of one group and adds at
most one to one, so a block is adjacent to few others.  Two words meet in the
cell named by the block of what they share:

* words of equal blocks meet in the cell of their own block,
* a word meets one with a letter more in the cell of the shorter word's block,
* words with a letter replaced by one of another group meet in the cell of the
  block that both have after losing that letter.

So each word is sent to ``GROUPS + 1`` cells at most, and each pair meets in
exactly one.  A cell with more than ``PART`` words is split into parts of bounded
size, and every pair of parts is a tile.  In a tile one product of the
letter-count matrices gives all squared distances; pairs at most two apart are
then verified letter by letter.

Null and empty texts hold no words; a row without id counts with an empty id in
its checksum.  Rows that repeat count again.  Other columns do no harm, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch

#: Letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups that letters are dealt to, about equally common; letters beyond a to z go by their number.
LETTER_GROUPS = ("evq", "tyz", "apj", "oux", "igk", "nwh", "srf", "lmdcb")
GROUPS = len(LETTER_GROUPS)
#: Words that one side of a tile holds on average.
PART = 1024
#: Letters compared in a step when pairs are verified, and distances in a step before.
STEP_LETTERS, STEP_PAIRS = 1 << 22, 1 << 21
#: An occurrence loses a letter if its checksum is divisible by this.
LOSS = 31


def runs(docs: DataFrame, least: int = 7, text: str = "text") -> DataFrame:
    """``word`` of every occurrence of at least *least* letters, some short of a letter by checksum."""
    # a shorter run can't hold a longer one, so these are whole runs
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    each = each.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    checksum = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    each = each.select("run", checksum.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % LOSS == 0, short).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.char_length("word") >= least)


def blocks(word: Column) -> Column:
    """Number of letters of each group, as text."""
    accented = "".join(map(chr, range(0xC0, 0x100)))
    of = [letters + accented[g::GROUPS] for g, letters in enumerate(LETTER_GROUPS)]
    others = lambda g: "".join(x for i, x in enumerate(of) if i != g)
    return F.array(*(F.char_length(F.translate(word, others(g), "")) for g in range(GROUPS)))


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters (equally many, or one more in *b*) are one edit apart."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def close_pairs(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows at most two apart in squared distance, each once, from products of row blocks.

    Rows without any distance are anagrams, which one edit can't turn into each other.
    """
    squares, ones = (counts * counts).sum(axis=1, keepdims=True), np.ones((len(counts), 1), counts.dtype)
    left, right = np.hstack([-2 * counts, squares, ones]), np.hstack([counts, ones, squares])
    step = max(1, STEP_PAIRS // len(counts))
    for start in range(0, len(counts), step):
        distance = left[start:start + step] @ right[start:].T
        i, j = np.nonzero((distance <= 2) & (distance > 0))
        yield i[i < j] + start, j[i < j] + start


def near_rows(words: list[str], lost: np.ndarray, part: np.ndarray, across: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs one edit apart that some whole tiles are to find; *tiles* are the rows they begin at.

    *lost* is -1 for words whose own block names the cell, else the group that
    lost a letter.  Words that lost a letter of the same group have equal blocks
    and meet in the cell of that block.  In a tile of two parts (*across*) only
    pairs of different *part* are compared.
    """
    codes = [np.frombuffer(w.encode("latin-1"), np.uint8) for w in words]  # no letter lies beyond
    lengths = np.array([len(c) for c in codes])
    together = np.concatenate(codes)
    letters = np.unique(together)
    at = np.repeat(np.arange(len(words)), lengths) * len(letters) + np.searchsorted(letters, together)
    counts = np.bincount(at, minlength=len(words) * len(letters))
    # squared distances of longer words need doubles to be exact
    counts = counts.reshape(len(words), -1).astype(np.float32 if lengths.max() < 1000 else np.float64)
    found = [(np.zeros(0, np.int64),) * 2]
    for start, stop in zip(tiles, [*tiles[1:], len(words)]):
        if stop - start > 1:
            for i, j in close_pairs(counts[start:stop]):
                i, j = i + start, j + start
                keep = (lost[i] != lost[j]) | (lost[i] < 0)
                if across[start]:
                    keep &= part[i] != part[j]
                found.append((i[keep], j[keep]))
    i, j = (np.concatenate(x) for x in zip(*found))
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    # words of one length stand in one matrix
    place, spelled = np.zeros(len(words), np.int64), {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        place[rows], spelled[n] = np.arange(len(rows)), np.stack([codes[r] for r in rows])
    good = np.zeros(len(i), bool)
    both = lengths[i] + lengths[j]  # lengths are at most one apart, so the sum tells them
    for total in np.unique(both):
        some = np.flatnonzero(both == total)
        step = max(1, STEP_LETTERS // int(total))
        for start in range(0, len(some), step):
            rows = some[start:start + step]
            good[rows] = _one_edit(spelled[total // 2][place[i[rows]]], spelled[total - total // 2][place[j[rows]]])
    return i[good], j[good]


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by *keys* in batches that hold whole groups only, with the rows that groups begin at."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            c = batch.column(k)
            change[1:] |= np.array(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        begins = np.flatnonzero(change)
        if begins[-1]:
            yield batch.slice(0, begins[-1]), begins[:-1]
        rest = batch.slice(begins[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` for every two words of ``word, n`` one edit apart, in both directions."""
    own = words.select("word", "n", blocks(F.col("word")).alias("block"))
    less = lambda g: F.transform("block", lambda c, i: F.when(i == g, c - 1).otherwise(c))
    entry = lambda lost, block: F.struct(F.lit(lost).alias("lost"), F.array_join(F.transform(block, lambda c: c.cast("string")), ",").alias("cell"))
    entries = F.array(entry(-1, F.col("block")), *(F.when(F.col("block")[g] > 0, entry(g, less(g))) for g in range(GROUPS)))
    cells = own.select("word", "n", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("word", "n", "e.lost", "e.cell")
    # only cells too large for one tile have a row here
    large = cells.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    placed = cells.join(large, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    keys = ["cell", "lo", "hi"]
    tiles = placed.select("cell", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "lost", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in whole_tiles(batches, keys):
            lost, part, lo, hi = (np.array(batch.column(c)) for c in ("lost", "part", "lo", "hi"))
            i, j = near_rows(batch.column("word").to_pylist(), lost, part, lo != hi, begins)
            both, others = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for at in (both, others) for c in ("word", "n")], ["word", "n", "other", "other_n"])

    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, n long, other string, other_n long")


def spelling_variants(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of *least* letters that occurs *often*.

    The form is the near word of largest n (of equal ones the first in code-point
    order), if it occurs *times* as often; the root is the last word on the way
    from form to form.  A form occurs more often than its word, so the way ends.
    """
    spark = docs.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, f"variants-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    words = kept(runs(docs, least, text).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.n") >= times * F.col("n")
    placed = kept(joined.select(
        "word", F.when(is_form, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.n")).alias("form_n")), "forms")

    # each round doubles the steps that a word has gone; counts grow at every step, so the rounds are few
    state, moved = placed.where("form is not null").select("word", F.col("form").alias("root")), True
    while moved:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = kept(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        state, moved = went.select("word", "root"), not went.where("moved").isEmpty()
    return placed.join(state, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
