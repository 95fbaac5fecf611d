"""Repeated windows of a corpus, found through anchors.

A window is W consecutive tokens (bytes or words).  Among the K-token pieces
inside a window, the one with the smallest hash is the window's anchor; equal
windows have equal anchors at equal places, and neighbouring windows mostly
share theirs, so a text has about 2 anchors for every W - K tokens.  Only anchors
are shuffled:

1. ``instances`` gives every anchor with a hash of its whole context, all tokens
   that windows around it can reach.
2. ``sorted_out`` sees all instances of an anchor in order.  Instances with
   equal contexts have all their windows in common, which settles them as spans.
   An anchor with several contexts sends the first instance of each on.
3. ``contexts`` fetches the tokens around those few, for the caller to compare.

A text is processed whole, in pieces that overlap by what a context can reach.
Rows that agree in id and text are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import small_rows
from .common import steps, texts
from .shingles import mix, powers

#: Window starts that one vectorised piece covers; places fit into 21 bits.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
ROW = "h long, c long, doc long, tie int, pos int, right int, n int"
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Window and piece length in tokens, how texts become tokens, and tokens 64-bit values."""

    window: int
    piece: int
    tokens: Callable[[list[str]], list[np.ndarray]]
    values: Callable[[np.ndarray], np.ndarray] = np.asarray

    @property
    def reach(self) -> int:
        return self.window - self.piece


def keyed(docs: DataFrame, text: str = "text", *more: str) -> DataFrame:
    """``doc, tie, text``: id (missing ones last), a hash of the text, and the text."""
    return docs.select(
        *more, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(F.coalesce(text, F.lit(""))).alias("tie"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))


def anchors(shape: Shape, many: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``text number, place, hash, context hash, tokens to the right`` of all anchors."""
    parts: list[tuple[int, int, int, int, np.ndarray]] = []
    held = 0
    for i, tokens in enumerate(many):
        starts = len(tokens) - shape.window + 1
        for a in range(0, starts, PIECE - 4 * shape.window):
            b = min(a + PIECE - 4 * shape.window, starts)
            lo, hi = max(0, a - shape.reach), min(len(tokens), b + 2 * shape.window)
            if held + hi - lo > PIECE and parts:
                yield _anchors(shape, parts)
                parts, held = [], 0
            parts.append((i, lo, a, b, tokens[lo:hi]))
            held += hi - lo
    if parts:
        yield _anchors(shape, parts)


def _anchors(shape: Shape, parts: list) -> tuple[np.ndarray, ...]:
    w = shape.reach + 1
    values = shape.values(np.concatenate([p[4] for p in parts]))
    n = len(values)
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])
    piece = (sums[shape.piece:] - sums[:-shape.piece]) * down[:n - shape.piece + 1]
    rank = (piece ^ (piece >> np.uint64(32))) * _C1
    least = (rank & ~_PLACE) | np.arange(len(rank), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if w > width:
        least = np.minimum(least[:len(least) - (w - width)], least[w - width:])
    begin = np.concatenate([[0], np.cumsum([len(p[4]) for p in parts])[:-1]])
    wanted = np.zeros(len(least) + 1, np.int32)
    for at, (_, lo, a, b, _) in zip(begin, parts):
        wanted[at + a - lo] += 1
        wanted[min(at + b - lo, len(least))] -= 1
    at = (least[np.cumsum(wanted[:-1]) > 0] & _PLACE).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    part = np.searchsorted(begin, at, "right") - 1
    low = np.array([p[1] for p in parts])[part]
    place = at - begin[part] + low
    # contexts end with their piece's tokens, which reach as far as any context does
    stop = begin[part] + np.array([len(p[4]) for p in parts])[part]
    right = np.minimum(stop - at, shape.window)
    left = np.minimum(place, shape.reach)
    context = mix((sums[at + right] - sums[at - left]) * down[at - left] + left.astype(np.uint64) * _C1 + right.astype(np.uint64) * _C2)
    return np.array([p[0] for p in parts])[part], place, mix(piece[at]), context, right


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _rows(h, c, doc, tie, pos, right, n, spans: bool = False) -> pa.RecordBatch:
    long = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else x, pa.int64())
    none = pa.nulls(len(doc), pa.int64())
    return pa.RecordBatch.from_arrays([
        none if spans else long(h), none if spans else long(c), long(doc), *(pa.array(x, pa.int32()) for x in (tie, pos, right, n))],
        ["h", "c", "doc", "tie", "pos", "right", "n"])


def _spans(shape: Shape, doc, tie, pos, right) -> pa.RecordBatch:
    """Whole contexts as spans: their start in ``pos``, their end in ``right``."""
    return _rows(None, None, doc, tie, np.maximum(pos - shape.reach, 0), pos + right, np.zeros(len(doc), np.int32), spans=True)


def instances(rows: DataFrame, shape: Shape, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Anchors of all texts, one row for each context that a slice of rows holds.

    Other instances of that context in the slice become spans at once (rows
    without ``h``); ``n`` counts them, so no hot context floods the shuffle.
    *passes* may rule out anchors by their hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", PIECE):
            ids, ties = np.array(batch.column("doc")), np.array(batch.column("tie"))
            for text, pos, h, c, right in anchors(shape, shape.tokens(texts(batch, "text"))):
                if passes is not None:
                    keep = passes(h)
                    text, pos, h, c, right = (x[keep] for x in (text, pos, h, c, right))
                doc, tie = ids[text], ties[text]
                order = np.lexsort((pos, tie, doc, c, h))
                doc, tie, pos, h, c, right = (x[order] for x in (doc, tie, pos, h, c, right))
                own = _changes(h, c, doc, tie, pos)
                doc, tie, pos, h, c, right = (x[own] for x in (doc, tie, pos, h, c, right))
                first = _changes(h, c)
                if not len(first):
                    continue
                n = np.diff(np.append(np.flatnonzero(first), len(first)))
                yield _rows(*(x[first] for x in (h, c, doc, tie, pos, right)), n)
                if not first.all():
                    yield _spans(shape, *(x[~first] for x in (doc, tie, pos, right)))

    return rows.select("doc", "tie", "text").mapInArrow(run, ROW)


def sorted_out(rows: DataFrame, shape: Shape, also_first: bool) -> DataFrame:
    """Spans of settled instances, and one row for each context of an anchor with several.

    With *also_first* the first instance of a repeated context is a span too.
    Spans among the rows pass through.  Rows come sorted; only the last context is carried from batch to batch, so
    an anchor of any size passes through in bounded memory.
    """
    sort = ["h", "c", "doc", "tie", "pos"]
    # spans have no anchor and go anywhere
    ordered = rows.repartition(F.coalesce("h", F.xxhash64("doc", "pos"))).sortWithinPartitions(*sort)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None
        several = False  # whether the carried anchor has shown other contexts before

        def settle(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carried, several
            h, c, doc, tie, pos, right, n = columns
            same = np.zeros(len(h), bool)  # a row that came twice
            same[1:] = ~_changes(h, c, doc, tie, pos)[1:]
            h, c, doc, tie, pos, right, n = (x[~same] for x in (h, c, doc, tie, pos, right, n))
            new = _changes(h, c)
            at = np.flatnonzero(new)
            n_class = np.add.reduceat(n.astype(np.int64), at)
            if not new.all():
                yield _spans(shape, *(x[~new] for x in (doc, tie, pos, right)))
            h, c, doc, tie, pos, right = (x[at] for x in (h, c, doc, tie, pos, right))
            new_h = _changes(h)
            group = np.cumsum(new_h) - 1
            many = np.bincount(group)[group] > 1
            if several:
                many |= group == 0
            if not last:
                carried = [x[-1:] for x in (h, c, doc, tie, pos, right)] + [n_class[-1:].clip(max=1 << 30).astype(np.int32)]
                several = bool(many[-1])
                h, c, doc, tie, pos, right, n_class, many = (x[:-1] for x in (h, c, doc, tie, pos, right, n_class, many))
            if also_first and (twice := n_class > 1).any():
                yield _spans(shape, *(x[twice] for x in (doc, tie, pos, right)))
            if many.any():
                yield _rows(*(x[many] for x in (h, c, doc, tie, pos, right)), n_class[many].clip(max=1 << 30).astype(np.int32))

        for batch in batches:
            if batch.column("h").null_count:
                yield batch.filter(batch.column("h").is_null())
                batch = batch.filter(batch.column("h").is_valid())
            if batch.num_rows:
                columns = [np.array(batch.column(i)) for i in range(7)]
                if carried is not None:
                    columns = [np.concatenate([a, b]) for a, b in zip(carried, columns)]
                yield from settle(columns, False)
        if carried is not None:
            yield from settle(carried, True)

    return ordered.mapInArrow(run, ROW)


def contexts(found: DataFrame, rows: DataFrame, shape: Shape, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Adds the packed tokens ``context`` around every row of *found* that has an anchor.

    One text is joined with all its rows, of which it has no more than anchors.
    All columns of *rows* are moved, so another join with the same rows need not
    move them again.
    """
    lists = found.where("h is not null").groupBy("doc", "tie").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "right", "n"))).alias("wanted"))
    joined = rows.join(lists, ["doc", "tie"]).select(*rows.columns, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", PIECE):
            out: dict[str, list] = {k: [] for k in ("h", "doc", "tie", "pos", "n", "left", "context")}
            for i, tokens in enumerate(shape.tokens(texts(batch, "text"))):
                wanted = batch.column("wanted")[i].values
                pos, h, right, n = (np.array(wanted.field(k)) for k in ("pos", "h", "right", "n"))
                left = np.minimum(pos, shape.reach)
                out["context"] += [pack(tokens[p - a:p + b]) for p, a, b in zip(pos.tolist(), left.tolist(), right.tolist())]
                for k, x in (("h", h), ("pos", pos), ("n", n), ("left", left)):
                    out[k].append(x)
                for k in ("doc", "tie"):
                    out[k].append(np.full(len(pos), batch.column(k)[i].as_py(), np.int64))
            if out["context"]:
                joint = {k: np.concatenate(v) for k, v in out.items() if k != "context"}
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(joint[k], pa.int64()) for k in ("h", "doc")), *(pa.array(joint[k], pa.int32()) for k in ("tie", "pos", "n", "left")),
                    pa.array(out["context"], pa.binary())], ["h", "doc", "tie", "pos", "n", "left", "context"])

    return joined.mapInArrow(run, "h long, doc long, tie int, pos int, n int, left int, context binary")


def joined_spans(spans: DataFrame) -> DataFrame:
    """``doc, tie, spans`` with the distinct spans of each document."""
    return spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def union_runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; touching spans make one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


#: Contexts of one anchor that are compared in one task; beyond it, window by window.
HOT = 50_000


def resolved(found: DataFrame, rows: DataFrame, shape: Shape, pack: Callable[[np.ndarray], bytes], unpack: Callable[[bytes], np.ndarray],
             compare: Callable[[dict[str, np.ndarray], list[bytes]], tuple[np.ndarray, np.ndarray]], also_first: bool, hot: int = HOT) -> DataFrame:
    """Spans ``doc, tie, start, stop`` of the contexts in *found* that several share only in part.

    *compare* gets whole anchors at a time and gives row numbers and offsets of
    the windows to mark.  Anchors with more than *hot* contexts go window by
    window through ``sorted_out`` instead, which holds no group.
    """
    many = found.where("h is not null").groupBy("h").count().where(F.col("count") > hot).select("h")
    # one in *hot* rows at most is in this list; where it is short, tasks get its values and none waits for them to be counted again
    few = small_rows(many)
    n_many = few is None or len(few)
    listed = many if few is None else F.broadcast(rows.sparkSession.createDataFrame(few, "h long"))
    usual = found.join(listed, "h", "left_anti") if n_many else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            columns = {k: np.array(table.column(k)) for k in ("h", "doc", "tie", "pos", "n", "left")}
            order = np.lexsort(tuple(columns[k] for k in ("pos", "tie", "doc", "h")))
            once = order[_changes(*(columns[k][order] for k in ("h", "doc", "tie", "pos")))]  # rows that repeat as a whole are one document
            columns = {k: v[once] for k, v in columns.items()}
            row, offset = compare(columns, table.column("context").take(pa.array(once)).to_pylist())
            # runs of neighbouring window starts become one span
            order = np.lexsort((-offset, row))
            row, start = row[order], (columns["pos"][row] - offset)[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(row)) - 1
            return pa.RecordBatch.from_arrays([
                pa.array(columns["doc"][row[at]], pa.int64()), *(pa.array(x, pa.int32()) for x in (columns["tie"][row[at]], start[at], start[end] + shape.window))],
                ["doc", "tie", "start", "stop"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            h = batch.column("h")
            if size < 20_000 or h[0].as_py() == h[-1].as_py():
                continue
            table = pa.Table.from_batches(held)
            keys = np.array(table.column("h"))
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1  # the last anchor may go on
            yield flush(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), len(keys) - cut
        if held:
            yield flush(pa.Table.from_batches(held))

    spans = contexts(usual, rows, shape, pack).repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, tie int, start int, stop int")
    if not n_many:
        return spans

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, tie, pos, n, left = (batch.column(k)[i].as_py() for k in ("doc", "tie", "pos", "n", "left"))
                tokens = shape.values(unpack(batch.column("context")[i].as_py()))
                count = len(tokens) - shape.window + 1
                up, down = powers(len(tokens) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[:len(tokens)], dtype=np.uint64)])
                whole = (sums[shape.window:] - sums[:count]) * down[:count]
                start = np.arange(count) + pos - left
                fill = lambda x, count=count: np.full(count, x)
                yield _rows(mix(whole), mix(whole ^ _C2), fill(doc), fill(tie), start, fill(shape.window), fill(n))

    single = Shape(shape.window, shape.window, shape.tokens, shape.values)
    hot_rows = contexts(found.join(listed, "h", "left_semi"), rows, shape, pack).mapInArrow(windows, ROW)
    settled = sorted_out(hot_rows, single, also_first).where("h is null")
    return spans.unionAll(settled.select("doc", "tie", F.col("pos").alias("start"), F.col("right").alias("stop")))
