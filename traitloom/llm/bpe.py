"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that stands side by side in no vocabulary token can never be
merged over, so every such place in a word is a certain cut.  The fragments
between cuts are encoded on their own, kept in a bounded cache, and their ids
joined.  Results equal those of the ``tokenizers`` library for vocabularies
with a word-end mark (NFC, white space folded, lower case, byte-level pieces).

Texts stream through tasks in slices; nothing is shuffled.  Null texts count
as empty and give no ids; all other columns pass through unchanged, whatever
their names.  Repeated rows give repeated results, empty tables empty ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import free_name, steps, texts, through_arrow

#: Entries a worker's caches hold before they start anew, and the longest word kept.
CACHE_WORDS = 100_000
CACHE_PIECES = 150_000
CACHE_FRAGMENTS = 30_000
LONGEST_KEPT = 48
#: Fragments beyond this length are merged through a heap instead of rescans.
RESCAN_LIMIT = 24

#: White space of the vocabulary's normaliser, and the end mark.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_END = "</w>"

NEVER = 1 << 62
LETTER = regex.compile(r"[\p{L}\p{N}]").match
_CODECS: dict[tuple[str, int], "Codec"] = {}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Codec:
    """The vocabulary, its merge ranks and its certain cuts."""

    def __init__(self, blob: str) -> None:
        spec = json.loads(blob)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + WORD_END) for c in letters]
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids beyond 16 bits are not supported")
        self.merged: dict[int, int] = {}  # two ids -> rank and new id, packed
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged[vocab[a] << 16 | vocab[b]] = rank + 1 << 16 | vocab[a + b]
        self.joined = bytearray(65536)
        for token in vocab:
            inner = [byte_of[c] for c in token.removesuffix(WORD_END)]
            for a, b in zip(inner, inner[1:]):
                self.joined[a << 8 | b] = 1
        self.strings: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            self.strings[t["id"]] = t["content"]
            self.special[t["content"]] = t["id"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        # signs that this module's newer character table calls letters or digits, but the library's does not
        self.newer = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and LETTER(c))
        newer = "".join(self.newer)
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"(?:(?![{newer}])\p{{{kind}}})")
        self.careful_pieces = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])+")).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.spaces = re.compile(f"[{SPACE}]+").split
        self.words: dict[str, bytes] = {}
        self.kept_pieces: dict[str, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def fragment(self, data: bytes, ends: bool) -> list[int]:
        """Ids of one fragment; *ends* tells that the word ends with it."""
        ids = [self.first[b] for b in data]
        if ends:
            ids[-1] = self.last[data[-1]]
        ids = [i for i in ids if i is not None]
        return self.merge_short(ids) if len(ids) <= RESCAN_LIMIT else self.merge_long(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        get = self.merged.get
        steps = [get(a << 16 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while steps and (best := min(steps)) != NEVER:
            i = steps.index(best)
            new = ids[i] = best & 0xFFFF
            del ids[i + 1], steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] << 16 | new, NEVER)
            if i < len(steps):
                steps[i] = get(new << 16 | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, through a heap over linked places."""
        n, get = len(ids), self.merged.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 16 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            new = ids[i] = m & 0xFFFF
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get(new << 16 | ids[k]):
                    heapq.heappush(heap, (m, i, new, ids[k]))
            if (k := before[i]) >= 0 and (m := get(ids[k] << 16 | new)):
                heapq.heappush(heap, (m, k, ids[k], new))
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece: its fragments between certain cuts, joined."""
        data = piece.encode()
        joined, kept = self.joined, self.fragments
        cuts = [i for i, (a, b) in enumerate(zip(data, data[1:]), 1) if not joined[a << 8 | b]]
        if not cuts:
            return array("I", self.fragment(data, True)).tobytes()
        out: list[int] = []
        start = 0
        for stop in [*cuts, len(data)]:
            key = (data[start:stop], stop == len(data))
            ids = kept.get(key)
            if ids is None:
                ids = self.fragment(*key)
                if stop - start <= LONGEST_KEPT:
                    if len(kept) >= CACHE_FRAGMENTS:
                        kept.clear()
                    kept[key] = ids
            out += ids
            start = stop
        return array("I", out).tobytes()

    def word(self, word: str) -> bytes:
        """Packed ids of a word without white space."""
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        kept, out = self.kept_pieces, []
        if plain.isalpha():
            pieces = (plain,)
        elif self.newer.isdisjoint(plain):
            pieces = self.pieces(plain)
        else:
            pieces = self.careful_pieces(plain)
        for piece in pieces:
            packed = kept.get(piece)
            if packed is None:
                packed = self.piece(piece)
                if len(piece) <= LONGEST_KEPT:
                    if len(kept) >= CACHE_PIECES:
                        kept.clear()
                    kept[piece] = packed
            out.append(packed)
        return out[0] if len(out) == 1 else b"".join(out)

    def plain(self, text: str) -> bytes:
        """Packed ids of a text that holds no special token."""
        # str.split() also cuts at four control characters that are no white space here
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            words = [w for w in self.spaces(text) if w]
        else:
            words = text.split()
        kept = self.words
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                packed = kept.get(w)
                if packed is None:
                    packed = self.word(w)
                    if len(w) <= LONGEST_KEPT:
                        if len(kept) >= CACHE_WORDS:
                            kept.clear()
                        kept[w] = packed
                out.append(packed)
            return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut_special is None or "<|" not in text:
            return self.plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self.plain(part)
            for part in self.cut_special(text))

    def decode(self, packed: bytes) -> str:
        """Token strings joined by a blank, as a vocabulary without decoder does."""
        return " ".join(map(self.strings.__getitem__, array("I", packed)))


def codec(blob: str) -> Codec:
    """One codec per worker and vocabulary."""
    key = hashlib.blake2b(blob.encode(), digest_size=16).digest()  # of the whole vocabulary
    if key not in _CODECS:
        _CODECS[key] = Codec(blob)
    return _CODECS[key]


def _with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def vocabulary(path: str) -> str:
    """The vocabulary file's text, read once on the driver (a few MB at most)."""
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``n_tokens`` (long) and ``ids`` (binary, little-endian unsigned 32 bits).

    With *decoded* also ``decoded``, what the ids decode to, in the same pass and
    by the same workers.  Where the table already has such a column, the added
    name gets underscores.
    """
    blob = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), **({"decoded": T.StringType()} if decoded else {})}
    names = [free_name(docs, n) for n in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value)
        for batch in steps(batches, text):
            packed = [own.encode(t) for t in texts(batch, text)]
            added = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decoded:
                added.append(pa.array([own.decode(p) for p in packed], pa.string()))
            yield _with_columns(batch, dict(zip(names, added)))

    return through_arrow(docs, run, [T.StructField(n, k) for n, k in zip(names, kinds.values())])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (string) from packed ids; null ids decode to an empty text."""
    blob = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    name = free_name(encoded, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value)
        for batch in steps(batches, ids):
            yield _with_columns(batch, {name: pa.array([own.decode(p or b"") for p in batch.column(ids).to_pylist()], pa.string())})

    return through_arrow(encoded, run, [T.StructField(name, T.StringType())])
