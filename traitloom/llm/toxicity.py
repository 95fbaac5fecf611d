"""Toxicity of texts from bags of character n-grams.

Every word is a bag of hashed n-grams (3 to 6 bytes, word edges included).  The
embeddings of its n-grams are averaged and go through a linear softmax of two
classes; both are trained jointly in numpy.  As a label speaks of a whole text
and not of its words, a text scores as its most toxic word does, and training
alternates between picking that word and improving on it.  A misspelling that
was never seen shares most n-grams with the word it stands for.

Training uses at most ``MAX_LABELLED`` labelled rows of each class, a
documented bound; scoring covers every word of every text.

Null and empty texts, and texts of white space alone, score 0.  Without
labelled rows of both classes nothing is known and all texts score 0.  Repeated
rows score alike; other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name, steps, texts, through_arrow

#: Labelled rows of each class that training reads at most.
MAX_LABELLED = 1500
BUCKETS = 1 << 17
DIM = 12
SIZES = (3, 4, 5, 6)
ROUNDS = 40
#: Bytes of text that one vectorised step works on.
CHUNK = 1 << 18
_SPACE = 32


@dataclass
class Model:
    """What scoring needs: one number per n-gram bucket, and the calibration."""

    weight: np.ndarray
    slope: float
    offset: float

    @property
    def known(self) -> bool:
        return len(self.weight) > 0


def held_out(doc_id: Column) -> Column:
    """Rows that no training may see."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def normal(text: str) -> bytes:
    """Lower-case words between single blanks, one blank at both ends."""
    words = text.lower().encode("utf-8", "replace").split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the index of the word and the bucket of every n-gram."""
    blank = data == _SPACE
    before = np.cumsum(blank, dtype=np.int32)
    h = data.astype(np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + data[n - 1:]
        if n not in SIZES:
            continue
        inner = before[n - 2:len(data) - 1] - before[:len(data) - n + 1]  # blanks strictly inside
        at = np.flatnonzero(inner == 0)
        mixed = (h[at] ^ (h[at] >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
        yield before[at] - 1, (mixed >> shift).astype(np.int32)


def word_scores(data: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Average n-gram weight of each word of a normalised buffer."""
    n_words = int((data == _SPACE).sum()) - 1
    total, count = np.zeros(n_words), np.zeros(n_words)
    for word, bucket in grams(data):
        total += np.bincount(word, weight[bucket], n_words)[:n_words]
        count += np.bincount(word, minlength=n_words)[:n_words]
    return total / np.maximum(count, 1)


def pieces(data: bytes) -> Iterator[bytes]:
    """A normalised text in parts of bounded length, cut at blanks."""
    while len(data) > CHUNK:
        cut = data.rfind(b" ", 1, CHUNK)
        cut = cut if cut > 0 else data.find(b" ", CHUNK)
        if cut >= len(data) - 1:
            break
        yield data[:cut + 1]
        data = data[cut:]
    yield data


def highest(many: list[str], weight: np.ndarray) -> np.ndarray:
    """The highest word score of each text; minus infinity without words."""
    best = np.full(len(many), -np.inf)

    def flush(parts: list[bytes], owners: list[int]) -> None:
        if parts:
            scores = word_scores(np.frombuffer(b"".join([parts[0], *(p[1:] for p in parts[1:])]), np.uint8), weight)
            starts = np.cumsum([0, *(p.count(b" ") - 1 for p in parts)])[:-1]
            np.maximum.at(best, owners, np.maximum.reduceat(scores, starts))

    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(many):
        data = normal(text)
        for part in pieces(data) if data else ():
            parts.append(part)
            owners.append(i)
            size += len(part)
            if size >= CHUNK:
                flush(parts, owners)
                parts, owners, size = [], [], 0
    flush(parts, owners)
    return best


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """At most *limit* training rows of each class: ``text`` and ``toxic``.

    Chosen by a hash of the id, so the choice does not depend on the order of
    rows; held-out ids are left out.  Of rows that share an id one counts, that
    of the smallest text.
    """
    key = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .select("doc_id", "toxic", F.xxhash64("doc_id").alias("_order")))
    chosen = [key.where(F.col("toxic") == c).orderBy("_order", "doc_id").limit(limit) for c in (0, 1)]
    ids = chosen[0].unionAll(chosen[1]).drop("_order")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def train(rows: list[tuple[str, int]], seed: int = 11) -> Model:
    """Fits embeddings and softmax on (text, label) rows."""
    nothing = Model(np.zeros(0), 0.0, 0.0)
    bags, labels = [], []
    vocabulary: dict[bytes, int] = {}
    for text, label in rows:
        words = set(normal(text or "").split())
        if words:
            bags.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words)), np.int64, len(words)))
            labels.append(label)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return nothing
    every, bucket_parts, size_parts = list(vocabulary), [], []
    for at in range(0, len(every), 20_000):  # a block of words at a time, so that memory follows the n-grams kept
        part = every[at:at + 20_000]
        found = list(grams(np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8)))
        word = np.concatenate([w for w, _ in found])
        bucket_parts.append(np.concatenate([b for _, b in found])[np.argsort(word, kind="stable")])
        size_parts.append(np.bincount(word, minlength=len(part))[:len(part)])
    bucket, sizes = np.concatenate(bucket_parts), np.concatenate(size_parts)
    del every, bucket_parts, size_parts
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    has = sizes > 0
    flat = np.concatenate(bags)
    doc_start = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    doc_of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.3, DIM).astype(np.float32)
    bias = 0.0
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(DIM, 1e-6), 1e-6

    def scores() -> np.ndarray:
        out = np.zeros(len(vocabulary), np.float32)
        out[has] = np.add.reduceat((table @ soft)[bucket], starts[has]) / sizes[has]
        return out

    def improve(chosen: np.ndarray, target: np.ndarray, share: np.ndarray) -> None:
        """One step on some words with their wanted class and weight."""
        nonlocal table, soft, bias, seen_soft, seen_bias
        keep = has[chosen]
        chosen, target, share = chosen[keep], target[keep], share[keep]
        n = sizes[chosen]
        row = np.repeat(np.arange(len(chosen)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = bucket[np.repeat(starts[chosen], n) + inside]
        middle = np.add.reduceat(table[at], np.cumsum(n) - n, axis=0) / n[:, None]
        p = 1 / (1 + np.exp(-np.clip(middle @ soft + bias, -30, 30)))
        push = (p - target) * share
        per_gram = np.bincount(at, (push / n)[row], BUCKETS).astype(np.float32)  # gradient of a bucket is this times softmax weights
        touched = np.flatnonzero(per_gram)
        g_soft, g_bias = push @ middle, push.sum()
        g_table = per_gram[touched, None] * soft
        seen_table[touched] += (g_table ** 2).mean(1)
        table[touched] -= 0.15 * g_table / np.sqrt(seen_table[touched])[:, None]
        seen_soft += g_soft ** 2
        soft = (soft - 0.1 * g_soft / np.sqrt(seen_soft)).astype(np.float32)
        seen_bias += g_bias ** 2
        bias -= 0.1 * g_bias / np.sqrt(seen_bias)

    # to begin with, every word carries the share of toxic texts among those it stands in
    toxic_in = np.bincount(flat, y[doc_of], len(vocabulary))
    clean_in = np.bincount(flat, 1 - y[doc_of], len(vocabulary))
    share = np.log1p(toxic_in + clean_in)
    target = (toxic_in + 0.5) / (toxic_in + clean_in + 1)
    for _ in range(8):
        for part in np.array_split(rng.permutation(len(vocabulary)), max(1, len(vocabulary) // 20_000)):
            improve(part, target[part], share[part])
    for _ in range(ROUNDS):
        now = scores()[flat]
        ranked = np.lexsort((-now, doc_of))
        place = np.empty(len(flat), np.int64)
        place[ranked] = np.arange(len(flat)) - doc_start[doc_of[ranked]]
        top = place < np.where(y[doc_of] == 1, 1, 4)
        extra = (y[doc_of] == 0) & (rng.random(len(flat)) < 4 / np.maximum(1, np.repeat([len(b) for b in bags], [len(b) for b in bags])))
        pick = np.flatnonzero(top | extra)
        wanted = y[doc_of[pick]].astype(float)
        weight = np.where(wanted == 1, 0.5 / max(1, (wanted == 1).sum()), 0.5 / max(1, (wanted == 0).sum())) * len(pick)
        for part in np.array_split(rng.permutation(len(pick)), max(1, len(pick) // 2_000)):
            improve(flat[pick[part]], wanted[part], weight[part])

    best = np.maximum.reduceat(scores()[flat], doc_start)
    slope, offset = calibrate(best, y)
    return Model((table @ soft).astype(np.float32), slope, offset)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of text scores, both classes weighing the same."""
    middle, spread = float(x.mean()), float(x.std()) or 1.0
    z = (x - middle) / spread
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = np.maximum(weight * p * (1 - p), 1e-12)
        g = np.array([(weight * (p - y) * z).sum() + 1e-4 * a, (weight * (p - y)).sum()])
        h = np.array([[(v * z * z).sum() + 1e-4, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a / spread, b - a * middle / spread


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (double, 0 to 1) for the whole text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a MB, whatever the corpus
    name = free_name(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in steps(batches, text):
            if own.known:
                best = highest(texts(batch, text), own.weight)
                out = np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-np.clip(own.slope * np.where(np.isneginf(best), 0, best) + own.offset, -500, 500))))
            else:
                out = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, name])

    return through_arrow(docs, run, [T.StructField(name, T.DoubleType())])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Trains on the bounded sample of labelled documents."""
    rows = labelled_rows(docs, labels, limit).collect()
    return train([(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))])
