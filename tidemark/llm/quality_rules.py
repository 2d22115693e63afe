"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with references of its
language by Jensen-Shannon distance. References are sums over all documents that pass the base rules:
a fixed number of counts for each of the fixed languages, whatever the size of the corpus, so they
may travel with the tasks. Where a document names no language with a reference, the nearest reference
counts. A test is left out for texts too short for its histogram (the minimum-length guards).

Null text: no words, so the base rules fail it. Empty table: no rows. Repeated rows are judged alike.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, own_columns, record_batch, slices, stored, texts_of
from .textstats import CLASSES, LANGS, WIDTH, Stats

RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, classes array<int>, common array<int>"
SUMS = "key int, n long"
_CELLS = len(CLASSES) + WIDTH


def base_failed(s: Stats, min_words: int = 50, max_repeat_percent: int = 50) -> bool:
    return s.n_words < min_words or 100 * s.repeat_words > max_repeat_percent * s.n_words


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two histograms of counts; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def near(classes: np.ndarray, common: np.ndarray, lang: str | None, refs: np.ndarray) -> tuple[float, float]:
    """Distances to the reference of the language, or to the nearest reference if it has none."""
    of = [LANGS.index(lang)] if lang in LANGS and refs[LANGS.index(lang)].any() else [k for k in range(len(LANGS)) if refs[k].any()]
    return min(((distance(classes, refs[k, : len(CLASSES)]), distance(common[k], refs[k, len(CLASSES) :])) for k in of), key=sum, default=(0.0, 0.0))


def verdict(bad: bool, n_words: int, classes: np.ndarray, common: np.ndarray, lang: str | None, refs: np.ndarray, *, max_class_distance: float = 0.27, max_word_distance: float = 0.34, min_chars: int = 200, min_words: int = 50) -> tuple[bool, float, float]:
    """kept and both distances (0 where a guard leaves the test out) of one text."""
    by_class, by_word = near(classes, common, lang, refs)
    by_class, by_word = by_class if classes.sum() >= min_chars else 0.0, by_word if n_words >= min_words else 0.0
    return not bad and by_class <= max_class_distance and by_word <= max_word_distance, by_class, by_word


def histograms(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms of each document; columns as in COUNTS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            stats = [Stats(t) for t in texts_of(batch)]
            yield record_batch(COUNTS, {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_words": [s.n_words for s in stats], "word_chars": [s.word_chars for s in stats], "n_symbols": [s.symbols for s in stats], "n_dup_lines": [s.dup_lines for s in stats], "n_repeat_words": [s.repeat_words for s in stats], "base_failed": [base_failed(s) for s in stats], "classes": [s.classes for s in stats], "common": [s.common.ravel() for s in stats]})

    return docs.mapInArrow(count, COUNTS)


def _added(rows: Iterable[tuple]) -> pa.RecordBatch:
    """Sums as in SUMS over rows of language, base_failed, and both histograms."""
    total = np.zeros((len(LANGS), _CELLS), np.int64)
    for lang, bad, classes, common in rows:
        if lang in LANGS and not bad:
            k = LANGS.index(lang)
            total[k] += np.concatenate([classes, common[k * WIDTH : (k + 1) * WIDTH]])
    return record_batch(SUMS, {"key": np.arange(total.size, dtype=np.int32), "n": total.ravel()})


def _collected(sums: DataFrame) -> np.ndarray:
    out = np.zeros(len(LANGS) * _CELLS, np.int64)
    for key, n in sums.groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[key] = n
    return out.reshape(len(LANGS), _CELLS)


def learn_references(counts: DataFrame) -> np.ndarray:
    """Summed histograms of the documents that pass the base rules, a row for each language of LANGS."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added(row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("lang", "base_failed", "classes", "common")), strict=True))

    return _collected(counts.select("lang", "base_failed", "classes", "common").mapInArrow(add, SUMS))


def references_of(docs: DataFrame) -> np.ndarray:
    """The same of texts, in one Python step: two in a row would hold two workers for each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added((lang, base_failed(s), s.classes, s.common.ravel()) for batch in slices(freed(batches)) for s, lang in zip(map(Stats, texts_of(batch)), batch.column("lang").to_pylist(), strict=True))

    return _collected(_inputs(docs).mapInArrow(add, SUMS))


def _inputs(docs: DataFrame) -> DataFrame:
    return own_columns(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def quality_rules(docs: DataFrame, references: np.ndarray | None = None, **limits) -> DataFrame:
    """Counts and verdict for each document; columns as in RESULT.

    kept is false if base_failed, else if a distance of a text with min_chars characters (classes) or
    min_words words (common words) exceeds its limit (limits: those of verdict()). references: as
    learn_references() gives them; by default learned from docs themselves. Texts are read once: the
    histograms are stored in the shared folder and judged there.
    """
    counts = stored(histograms(_inputs(docs)), "histograms")
    refs = learn_references(counts) if references is None else references

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [verdict(bad, n, np.array(classes), np.array(common).reshape(len(LANGS), WIDTH), lang, refs, **limits) for bad, n, classes, common, lang in zip(*(batch.column(x).to_pylist() for x in ("base_failed", "n_words", "classes", "common", "lang")), strict=True)]
            kept, by_class, by_word = zip(*rows, strict=True) if rows else ((), (), ())
            same = {x: batch.column(x) for x in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
            yield record_batch(RESULT, same | {"kept": kept, "class_distance": by_class, "word_distance": by_word})

    return counts.mapInArrow(judge, RESULT)


def filter_quality(docs: DataFrame, references: np.ndarray | None = None, **limits) -> DataFrame:
    """The rows of docs, all columns, whose document the rules keep.

    Rows are judged where they are read, so nothing is joined; repeated rows stay or go together.
    """
    refs = references_of(docs) if references is None else references

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            keep = [verdict(base_failed(s), s.n_words, s.classes, s.common, lang, refs, **limits)[0] for s, lang in zip(map(Stats, texts_of(batch)), batch.column("lang").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
