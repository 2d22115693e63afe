"""Substring dedup: words under a window of some words that occurs elsewhere too are removed.

Count-min prefilter. Each window has an anchor, the least hash among its shingles of ANCHOR words
(leftmost of equal ones), which depends on the window's words alone; so a window is as frequent as its
anchor at most. Every chunk counts the places of its anchors in a sketch of two rows of cells, as the
cells that it fills once and more than once. The sketches are merged by slices of cells, and a cell's sum
overestimates each anchor that falls in it. Each slice tells each chunk which of the chunk's cells reach
two; the sketch itself stays where it is merged. A second pass takes only windows whose anchor's
estimate is two or more in both rows, and groups them by two independent 64-bit hashes over their words.
What turns out to occur once is sent back to its chunk; every other estimated window is repeated. No
window is lost, whatever the sketch's size; two different windows would be taken for equal only if all
128 bits of their hashes were.

The sketch grows with the corpus: CELLS cells for each expected anchor, in slices of 2**SLICE_BITS cells
and at most 2**MOST_SLICES of them a row, which are wider beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PLACE_BITS, chunked, opened
from .common import record_batch, stored, texts_of, words_of

ANCHOR, CELLS, SLICE_BITS, MOST_SLICES = 8, 4, 22, 15
CELLS_OF = "part int, chunk long, cells binary, more binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of size numbers of h: runs of 1, 2, 4 ... numbers, joined as the bits of size say."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base, joined, at, width = _MULTIPLIERS[which], np.zeros(len(h), np.uint64), 0, 1
    for bit in range(size.bit_length()):
        if bit:
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
            width *= 2
        if size >> bit & 1:
            end = min(len(joined), len(h) - at)
            joined = joined[:end] * np.uint64(pow(base, width, 1 << 64)) + h[at : at + end]
            at += width
    return mixed(joined[:n])


def leftmost_least(v: np.ndarray, size: int) -> np.ndarray:
    """For each run of size numbers of v: the place of its least one, the first of equal ones."""
    at, width = np.arange(len(v)), 1
    join = lambda a, b: np.where(v[b] < v[a], b, a)
    while 2 * width <= size:
        at, width = join(at[:-width], at[width:]), 2 * width
    rest = size - width
    return join(at[: len(at) - rest], at[rest:]) if rest else at


class Windows:
    """The windows of a chunk's documents."""

    def __init__(self, texts: list[str], size: int, exact: bool = True) -> None:
        self.offsets, ids, self.words = words_of(texts)
        self.ids, n = ids, len(ids)
        of = lambda seed: np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))[ids] if n else np.zeros(0, np.uint64)
        first = of(1)
        self.valid = np.zeros(max(0, n - size + 1), bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if b - a >= size:
                self.valid[a : b - size + 1] = True
        k = min(ANCHOR, size)
        shingles = rolling(first, k)
        self.anchor_at = leftmost_least(shingles, size - k + 1) if len(self.valid) else np.zeros(0, np.int64)
        self.shingles = shingles
        self.hashes = (rolling(first, size), rolling(of(2), size, 1)) if exact else None

    def anchors(self) -> np.ndarray:
        """The anchor at each place that has one."""
        return self.shingles[np.unique(self.anchor_at[self.valid])]


def cells(anchors: np.ndarray, log_cells: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - log_cells)
    return mixed(anchors + np.uint64(1)) >> shift, mixed(anchors ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> shift


def cells_by_slice(anchors: np.ndarray, log_cells: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[np.ndarray]]:
    """For each slice that the anchors fall in: its number, their cells in it in order, and how often each; and for both rows, the place of each anchor's cell among them."""
    slices_log = min(MOST_SLICES, max(4, log_cells - SLICE_BITS))
    width, out, at = np.uint64(max(0, log_cells - slices_log)), [], []
    for row, of in enumerate(cells(anchors, log_cells)):
        cell, inverse, n = np.unique(of, return_inverse=True, return_counts=True)
        at.append(inverse)
        part = (cell >> width).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else [0]
        local = (cell & ((np.uint64(1) << width) - np.uint64(1))).astype("<u4")
        out += [((row << slices_log) + int(part[a]), local[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out, at


def sketch(chunks: DataFrame, size: int, log_cells: int) -> DataFrame:
    """chunk, parts and bits: of each slice that the chunk's anchors fall in, a bit for each of their cells, whether its sum over all chunks is two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, docs in opened(batches):
            found, _ = cells_by_slice(Windows(texts_of(docs), size, exact=False).anchors(), log_cells)
            if found:
                part, local, n = zip(*found, strict=True)
                yield record_batch(CELLS_OF, {"part": part, "chunk": [row["chunk"].as_py()] * len(part), "cells": [x.tobytes() for x in local], "more": [np.packbits(x > 1).tobytes() for x in n]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            local, inverse = np.unique(np.concatenate([np.zeros(0, "<u4"), *(c for _, c, _ in held)]), return_inverse=True)
            again = np.bincount(inverse, np.concatenate([np.zeros(0), *(1.0 + m for _, _, m in held)]), len(local)) >= 2
            ends = np.cumsum([len(c) for _, c, _ in held])
            bits = [np.packbits(x).tobytes() for x in np.split(again[inverse], ends[:-1])]
            return record_batch("chunk long, part int, bits binary", {"chunk": [c for c, _, _ in held], "part": [part] * len(held), "bits": bits})

        for batch in batches:
            for p, chunk, local, more in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "cells", "more")), strict=True):
                if p != part and held:
                    yield done()
                    held = []
                part, local = p, np.frombuffer(local, "<u4")
                held.append((chunk, local, np.unpackbits(np.frombuffer(more, np.uint8), count=len(local))))
        if held:
            yield done()

    counted = chunks.select("chunk", "payload").mapInArrow(count, CELLS_OF)
    merged = counted.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "chunk long, part int, bits binary")
    answers = merged.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("s"))  # no more than a chunk has anchors
    return stored(answers.select("chunk", F.col("s.bits").alias("bits")), "sketch")


def repeated_by_sketch(windows: Windows, bits: pa.Scalar, log_cells: int) -> np.ndarray:
    """Whether each window may be repeated; bits: the chunk's, in the order of its slices."""
    at = np.unique(windows.anchor_at[windows.valid])
    if not bits.is_valid or not len(at):
        return np.zeros(len(windows.valid), bool)
    found, inverse = cells_by_slice(windows.shingles[at], log_cells)
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(local)) for x, (_, local, _) in zip(bits.as_py(), found, strict=True)]).astype(bool)
    first = int(inverse[0].max()) + 1
    hit = np.zeros(len(windows.shingles) + 1, bool)
    hit[at] = again[inverse[0]] & again[first + inverse[1]]
    return hit[windows.anchor_at] & windows.valid


def dedup_substrings(docs: DataFrame, *, size: int = 35, max_log_cells: int = 41, min_log_cells: int = 16) -> DataFrame:
    """n_words, n_removed and kept_text (kept words joined by one space) of each row; columns as in RESULT.

    Every word is removed that lies under a window of size words of its text whose word sequence also
    starts anywhere else, in the same text too; words are compared unchanged. Null text: no words, and
    the empty string is kept. Empty table: no rows. Repeated rows remove each other's windows, as any
    copies do. A very long text is a chunk of its own, and its windows are never cut. Extra columns are
    ignored.
    """
    chunks = chunked(docs)
    total = chunks.agg(F.sum("size")).first()[0] or 0
    log_cells = min(max_log_cells, max(min_log_cells, int(CELLS * total / 6 * 2 / (size - ANCHOR + 2) + 1).bit_length())) if size > ANCHOR else min(max_log_cells, max(min_log_cells, int(CELLS * total / 6 + 1).bit_length()))
    chunks = chunks.select("chunk", "payload")
    asked = chunks.join(sketch(chunks, size, log_cells), "chunk", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in opened(batches):
            w = Windows(texts_of(texts), size)
            at = np.flatnonzero(repeated_by_sketch(w, row["bits"], log_cells))
            h1, h2 = (h[at] for h in w.hashes)
            order = np.lexsort((at, h2, h1))
            at, h1, h2 = at[order], h1[order], h2[order]
            head = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(at) else np.zeros(0, np.int64)
            yield record_batch("h1 long, h2 long, place long, n long", {"h1": h1[head].view(np.int64), "h2": h2[head].view(np.int64), "place": row["chunk"].as_py() << PLACE_BITS | at[head], "n": np.diff(np.concatenate([head, [len(at)]]))})

    grouped = asked.mapInArrow(take, "h1 long, h2 long, place long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    single = grouped.where("n = 1").select(F.shiftright("place", PLACE_BITS).alias("chunk"), F.col("place").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at"))
    single = stored(single.groupBy("chunk").agg(F.collect_list("at").alias("at")), "single-windows")  # no more than a chunk has words

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in opened(batches):
            w = Windows(texts_of(texts), size, exact=False)
            again = repeated_by_sketch(w, row["bits"], log_cells)
            if row["at"].is_valid:
                again[row["at"].values.to_numpy()] = False
            edge = np.zeros(len(w.ids) + 1, np.int64)
            edge[: len(again)] += again
            edge[size : size + len(again)] -= again
            keep = np.cumsum(edge)[:-1] == 0
            n, kept = [], []
            for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
                words = [w.words[i] for i in w.ids[a:b][keep[a:b]].tolist()]
                n.append((b - a, b - a - len(words)))
                kept.append(b" ".join(words))
            total, removed = zip(*n, strict=True)
            yield record_batch(RESULT, {"doc_id": texts.column("doc_id"), "n_words": total, "n_removed": removed, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return asked.join(single, "chunk", "left").mapInArrow(remove, RESULT)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
