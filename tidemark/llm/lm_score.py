"""Language-model scores by a probabilistic suffix tree over the bytes of the texts.

A text is read as its words, A-Z in lower case, joined by one space and closed by END; such a string
stands for one sequence of words, so the tree's probability of the string is one of the word sequence.
States are contexts of up to DEPTH bytes. A context is considered if it stands LEAST times or more in the
training documents, and retained if its next-byte distribution diverges from its parent's (the context
without its first byte): n * KL must exceed half of ln n for each next byte seen. Distributions are
smoothed with the parent's, which weighs as much as there are next bytes seen, up to the root, which is
smoothed with the uniform one. A byte is scored in the longest suffix of its context that is retained.

The bar is a count and not a share, so the tree grows with the corpus; no task and no driver holds it.
Documents are dealt in groups of about GROUP bytes of text. Each group sends its distinct places (context
of full depth and next byte) once, with their training counts, and gets a log probability for each back.
They travel in blocks: a part of the tree is all contexts that share their nearest NEAR bytes, parts are
dealt to buckets by hash, a bucket for each BUCKET bytes of text, and a block is what one group has for
one bucket, in one compressed row. So Spark moves and sorts few rows, and its memory stays small. A task
holds one bucket of all groups at a time: it sums the counts by place, walks the bucket's parts of the
tree (all states deeper than NEAR - 1, in the order of their bytes from the nearest on) and answers each
block with one. States of less depth are made first; as there are at most 256 ** 3 places of that depth,
they may travel (ROOT_BYTES at most). A bucket is about as large as its share of the text's distinct
places, unless one part is larger: parts are never cut.

Word counts, for the base score, take the same way: a group sends its distinct words once, in blocks by hash.
Each group is scored in a task of its own, which reads its answers and its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunked, opened
from .common import _ASCII_LOWER, record_batch, slices, stored, texts_of, words_of

END, PAD, DEPTH, NEAR, LEAST, GROUP, BUCKET = 10, 13, 5, 3, 5, 48 << 20, 4 << 20
ROOT_BYTES = 2 * 256**3 * 4
PART = 1 << 16  # rows of a batch that is sent, or words that are hashed at once
SENT = 1 << 20  # bytes of blocks that are sent at once
FOLD = 1 << 20  # rows that wait before they are merged
SCORED = 1 << 20  # bytes of text whose places are made, or looked up, at once
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What groups send: slot is 2 * bucket + kind, with a block; or ROOT, with a place of depth NEAR - 1 (a) and its count (n).
GATHERED = "slot long, grp long, a long, n long, block binary"
#: What buckets answer: blocks of kind CONTEXTS or WORDS; or TOTALS, with how many training words there are (n), and distinct ones (a).
ANSWERED = "kind long, grp long, a long, n long, block binary"
#: What meets in a group's task: slot is 4 * group + kind; blocks and chunks.
MET = "slot long, block binary"
CONTEXTS, WORDS, CHUNKS, TOTALS, ROOT = 0, 1, 2, 3, -1


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether crc32 of doc_id as text (null: empty) falls in the fold."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def stream_of(texts: list[str]) -> np.ndarray:
    """The bytes of the texts' strings, each closed by END, with END before the first."""
    parts = [b" ".join(t.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()) for t in texts]
    return np.frombuffer(b"\n" + b"\n".join(parts) + b"\n" if parts else b"\n", np.uint8)


def places_of(stream: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte but the first: its context, the nearest byte highest, and itself in the lowest byte.

    A context ends at the END before the text; PAD stands beyond it.
    """
    padded = np.concatenate([np.full(7, PAD, np.uint8), stream])
    back = np.lib.stride_tricks.as_strided(padded, (len(stream), 8), (1, 1)).view("<u8")[1:, 0]  # each byte highest, then those before it
    key = ((back << np.uint64(8)) >> np.uint64(64 - 8 * depth)) << np.uint64(8) | back >> np.uint64(56)
    ends = np.flatnonzero(stream == END)
    for k in range(1, depth):  # a text's k-th byte has k bytes before it, its END included
        at = ends[:-1] + k
        at = at[at <= ends[1:]]
        beyond = sum(PAD << 8 * (depth - i) for i in range(k, depth))
        key[at - 1] = key[at - 1] & np.uint64(~(((1 << 8 * (depth - k)) - 1) << 8) & (2**64 - 1)) | np.uint64(beyond)
    return key.view(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of what belongs to each."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(key) else n


def summed_words(parts: list[pa.Table]) -> pa.Table:
    """Distinct words, and the sums of what belongs to each (columns word and n); no Python object is held for a word."""
    total = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": total["word"], "n": total["n_sum"]})


def folded(parts: list, merge: Callable, rows: Callable) -> list:
    """The parts, merged into one when those behind the first have as many rows as it: few rows wait, and each is merged few times."""
    return [merge(parts)] if sum(map(rows, parts[1:])) >= max(FOLD, rows(parts[0])) else parts


def packed(first: bytes, second: np.ndarray) -> bytes:
    """A block: bytes and an array, compressed."""
    raw = len(first).to_bytes(8, "little") + first + second.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(block: bytes, dtype: type) -> tuple[bytes, np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    cut = 8 + int.from_bytes(raw[:8], "little")
    return raw[8:cut], np.frombuffer(raw[cut:], dtype)


def packed_places(key: np.ndarray, of: np.ndarray) -> bytes:
    """Places in order, as their differences, with a number for each."""
    return packed(np.diff(key, prepend=0).tobytes(), of)


def unpacked_places(block: bytes, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    key, of = unpacked(block, dtype)
    return np.cumsum(np.frombuffer(key, np.int64)), of


def packed_words(words: list[bytes], of: np.ndarray) -> bytes:
    """Words, which hold no white space and are not empty, with a number for each."""
    return packed(b"\n".join(words), of)


def unpacked_words(block: bytes) -> tuple[pa.Array, np.ndarray]:
    words, of = unpacked(block, np.int64)
    return pa.array(words.split(b"\n"), pa.binary()), of


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each run of equal values, with its bounds."""
    cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(values[a]), int(a), int(b)


def sent_blocks(schema: str, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows with a block each, in batches of SENT bytes or a little more."""
    held, size = [], 0
    for row in rows:
        held.append({"a": 0, "n": 0} | row)
        size += len(row["block"] or b"") + 64
        if size >= SENT:
            yield record_batch(schema, {c: [r[c] for r in held] for c in held[0]})
            held, size = [], 0
    if held:
        yield record_batch(schema, {c: [r[c] for r in held] for c in held[0]})


def bucket_of_parts(key: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """The bucket of each place, the same for all of one part."""
    part = (key >> 8 * (depth - NEAR) + 8).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((part >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def gathered(chunks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Each group's distinct places and words with their counts over the training documents; columns as in GATHERED."""

    def blocks(grp: int, key: np.ndarray, n: np.ndarray, words: pa.Table) -> Iterator[dict]:
        bucket = bucket_of_parts(key, buckets, depth)
        order = np.argsort(bucket, kind="stable")
        key, n = key[order], n[order]
        for at, a, b in runs_of(bucket[order]):
            yield {"slot": 2 * at + CONTEXTS, "grp": grp, "block": packed_places(key[a:b], n[a:b])}
        bucket = np.fromiter((zlib.crc32(w) % buckets for part in words.to_batches(PART) for w in part.column("word").to_pylist()), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        words = words.take(pa.array(order))
        for at, a, b in runs_of(bucket[order]):
            part = words.slice(a, b - a)
            yield {"slot": 2 * at + WORDS, "grp": grp, "block": packed_words(part["word"].to_pylist(), part["n"].to_numpy().astype(np.int64))}

    def sent(grp: int, held: list, words: list) -> Iterator[pa.RecordBatch]:
        key, n = summed(held)
        near, of = summed([(key >> 8 * (depth - NEAR + 1) + 8 << 8 | key & 255, n)])
        for a in range(0, len(near), PART):
            k = near[a : a + PART]
            yield record_batch(GATHERED, {"slot": np.full(len(k), ROOT), "grp": np.full(len(k), grp), "a": k, "n": of[a : a + PART], "block": pa.nulls(len(k), pa.binary())})
        yield from sent_blocks(GATHERED, blocks(grp, key, n, summed_words(words)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, words = None, [], []
        for row, docs in opened(batches):
            if grp is not None and row["grp"].as_py() != grp:
                yield from sent(grp, held, words)
                held, words = [], []
            grp = row["grp"].as_py()
            for part in slices([docs], max_bytes=SCORED):
                texts = texts_of(part)
                known = np.array([not held_out(i) for i in part.column("doc_id").to_pylist()])
                for train in (True, False):
                    key, n = np.unique(places_of(stream_of([t for t, k in zip(texts, known, strict=True) if k == train]), depth), return_counts=True)
                    held.append((key, n if train else np.zeros_like(n)))
                    held = folded(held, summed, lambda x: len(x[0]))
                offsets, ids, own = words_of(texts, lower=True)
                words.append(pa.table({"word": pa.array(own, pa.binary()), "n": np.bincount(ids[np.repeat(known, np.diff(offsets))], minlength=len(own))}))
                words = folded(words, summed_words, len)
        if grp is not None:
            yield from sent(grp, held, words)

    return stored(chunks.select("grp", "payload").mapInArrow(gather, GATHERED), "gathered")


def smoothed(total, seen, c, base, gain, least: int):
    """Whether a context is considered, whether it is retained, and the smoothed probability of a next byte in it."""
    considered = total >= max(1, least)
    return considered, considered & (gain > 0.5 * seen * np.log(np.maximum(total, 1))), (c + seen * base) / np.maximum(total + seen, 1)


def divergence(c: np.ndarray, total: np.ndarray, base: np.ndarray) -> np.ndarray:
    """c times the log of the observed share over base: what a next byte adds to n * KL."""
    return np.where(c > 0, c * np.log(np.maximum(c, 1) / np.maximum(total, 1) / base), 0)


class Root:
    """The states of depth below NEAR: for each context of NEAR - 1 bytes, its smoothed distribution and that of its longest retained suffix."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray, least: int = LEAST) -> None:
        known, row = np.unique(context, return_inverse=True)
        self.index = np.full(1 << 16, -1, np.int32)
        self.index[known] = np.arange(len(known))
        first = np.zeros((256, 256))
        np.add.at(first, (context >> 8, byte), n)
        whole = first.sum(axis=0) + 1
        p0 = whole / whole.sum()
        p1, f1 = self._level(first, p0[None], p0[None], np.zeros(256, bool), least)
        self.p, self.best = np.zeros((len(known), 256), np.float32), np.zeros((len(known), 256), np.float32)
        order = np.argsort(row, kind="stable")
        row, byte, n = row[order], byte[order], n[order]
        for a in range(0, len(known), 4096):  # in parts, so that the counts are never dense as a whole
            b = min(a + 4096, len(known))
            i, j = np.searchsorted(row, (a, b))
            c = np.zeros((b - a, 256))
            np.add.at(c, (row[i:j] - a, byte[i:j]), n[i:j])
            near = known[a:b] >> 8
            self.p[a:b], self.best[a:b] = self._level(c, p1[near], f1[near], known[a:b] & 255 == PAD, least)

    @staticmethod
    def _level(c: np.ndarray, base: np.ndarray, best: np.ndarray, beyond: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        total, seen = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        considered, kept, p = smoothed(total, seen, c, base, divergence(c, total, base).sum(axis=1, keepdims=True), least)
        beyond = beyond[:, None]
        return np.where(considered & ~beyond, p, base), np.where(kept & ~beyond, p, best)


def probabilities(key: np.ndarray, n: np.ndarray, root: Root, depth: int = DEPTH, least: int = LEAST) -> tuple[np.ndarray, int]:
    """For places (distinct, in order, whole parts of the tree) with their counts: each one's probability, and how many contexts of NEAR bytes or more were retained."""
    levels, up = [(key, n)], []
    for _ in range(depth - NEAR):
        k, c = levels[-1]
        shorter, inverse = np.unique(k >> 16 << 8 | k & 255, return_inverse=True)
        up.append(inverse)
        levels.append((shorter, np.bincount(inverse, c, len(shorter))))
    row, byte, states = root.index[levels[-1][0] >> 16], levels[-1][0] & 255, 0
    p, best = root.p[row, byte].astype(np.float64), root.best[row, byte].astype(np.float64)
    for k in range(len(levels) - 1, -1, -1):
        own, c = levels[k]
        if k < len(levels) - 1:
            p, best = p[up[k]], best[up[k]]
        context = own >> 8
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.concatenate([head, [len(own)]]))
        spread = lambda x, size=size: np.repeat(x, size)
        total, seen = np.add.reduceat(c, head), np.add.reduceat((c > 0).astype(np.float64), head)
        gain = np.add.reduceat(divergence(c, spread(total), p), head)
        considered, kept, here = smoothed(spread(total), spread(seen), c, p, spread(gain), least)
        inside = context & 255 != PAD
        best = np.where(kept & inside, here, best)
        p = np.where(considered & inside, here, p)
        states += int((kept & inside)[head].sum())
    return best, states


def answered(sent: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """For each block of sent (as in GATHERED) one with the log10 probabilities of its places, or the counts of its words; columns as in ANSWERED."""
    near = sent.where(F.col("slot") == ROOT).groupBy("a").agg(F.sum("n").alias("n")).toArrow()  # 256 ** 3 rows at most
    key = near["a"].to_numpy()
    root = sent.sparkSession.sparkContext.broadcast(Root(key >> 8, key & 255, near["n"].to_numpy(), least))

    def of_places(grps: list[int], blocks: list[bytes]) -> Iterator[dict]:
        parts = [unpacked_places(x, np.int64) for x in blocks]
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        own, at = np.unique(key, return_inverse=True)
        p, _ = probabilities(own, np.bincount(at, n, len(own)), root.value, depth, least)
        lp, a = np.log10(p).astype(np.float32)[at], 0
        for grp, (k, _) in zip(grps, parts, strict=True):
            yield {"kind": CONTEXTS, "grp": grp, "block": packed_places(k, lp[a : a + len(k)])}
            a += len(k)

    def of_words(grps: list[int], blocks: list[bytes]) -> Iterator[dict]:
        parts = [unpacked_words(x) for x in blocks]
        coded = pa.chunked_array([w for w, _ in parts], pa.binary()).combine_chunks().dictionary_encode()
        at, n = coded.indices.to_numpy(), np.concatenate([x for _, x in parts])
        total, a = np.bincount(at, n, len(coded.dictionary)).astype(np.int64), 0
        yield {"kind": TOTALS, "grp": 0, "a": int((total > 0).sum()), "n": int(total.sum()), "block": None}
        for grp, (w, _) in zip(grps, parts, strict=True):
            yield {"kind": WORDS, "grp": grp, "block": packed_words(w.to_pylist(), total[at[a : a + len(w)]])}
            a += len(w)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        slot, grps, blocks = None, [], []
        for own, part in _runs(batches):
            if slot is not None and own != slot:
                yield from (of_words if slot & 1 == WORDS else of_places)(grps, blocks)
                grps, blocks = [], []
            slot = own
            grps += part.column("grp").to_pylist()
            blocks += part.column("block").to_pylist()
        if slot is not None:
            yield from (of_words if slot & 1 == WORDS else of_places)(grps, blocks)

    blocks = sent.where(F.col("slot") != ROOT).select("slot", "grp", "block").repartition("slot").sortWithinPartitions("slot")
    return stored(blocks.mapInArrow(lambda batches: sent_blocks(ANSWERED, answers(batches)), ANSWERED), "answered")


def score_documents(docs: DataFrame, *, depth: int = DEPTH, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """Counts, base score and the tree's score of each row; columns as in RESULT.

    Null text: no words, only the end. Null doc_id counts as the empty string for the folds. Without
    training documents: N and V are 0 and all states are uniform. Empty table: no rows. Repeated rows
    count and are scored each. Very long texts are whole chunks of their own. Extra columns are ignored.
    """
    chunks = chunked(docs, group=group)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    sent = gathered(chunks, depth, max(1, -(-size // BUCKET)))
    answers = answered(sent, depth, least)
    n_words, n_types = answers.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    n_ends = sent.where((F.col("slot") == ROOT) & (F.col("a").bitwiseAND(255) == END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, types = n_words + n_ends, n_types + (n_ends > 0)
    met = answers.where(F.col("kind") != TOTALS).select((F.col("grp") * 4 + F.col("kind")).alias("slot"), "block")
    met = met.unionByName(chunks.select((F.col("grp") * 4 + CHUNKS).alias("slot"), F.col("payload").alias("block")))
    groups = np.unique(chunks.select("grp").distinct().toArrow()["grp"].to_numpy())
    numbers = docs.sparkSession.createDataFrame(pa.table({"at": np.arange(len(groups), dtype=np.int32), "grp": groups}))  # from Arrow, no Python worker is started for it
    met = met.join(F.broadcast(numbers), F.shiftright("slot", 2) == F.col("grp")).select("at", "slot", "block")
    met = met.repartitionById(max(1, len(groups)), F.col("at")).sortWithinPartitions("slot").select("slot", "block")  # a task has one group, and so has a batch

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, keys, scores, words, counts = None, [], [], [], []
        for slot, part in _runs(batches):
            if slot >> 2 != grp:
                grp, keys, scores, words, counts = slot >> 2, [], [], [], []
            if slot & 3 == CONTEXTS:
                for key, lp in (unpacked_places(x.as_py(), np.float32) for x in part.column("block")):
                    keys.append(key)
                    scores.append(lp)
            elif slot & 3 == WORDS:
                for own, n in (unpacked_words(x.as_py()) for x in part.column("block")):
                    words.append(own)
                    counts.append(n)
            else:
                if isinstance(keys, list):  # all are here, as slots come in order
                    keys, scores = pd.Index(np.concatenate(keys)), np.concatenate(scores)
                    words, counts = pa.chunked_array(words, pa.binary()).combine_chunks(), np.concatenate([*counts, np.zeros(0, np.int64)])
                for payload in part.column("block"):
                    with pa.ipc.open_stream(payload.as_buffer()) as documents:
                        for rows in slices(documents, max_bytes=2 * SCORED):
                            yield scored(rows, keys, scores, words, counts)

    def scored(rows: pa.RecordBatch, keys: pd.Index, scores: np.ndarray, words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        offsets, ids, own = words_of(texts_of(rows), lower=True)
        c = counts[pc.index_in(pa.array(own, pa.binary()), value_set=words).to_numpy(zero_copy_only=False)]
        logs, of = np.log10((c + 1) / (tokens + types + 1)), np.repeat(np.arange(len(rows)), np.diff(offsets))
        base = np.bincount(of, logs[ids], len(rows)) + np.log10((n_ends + 1) / (tokens + types + 1))
        known = np.bincount(of, c[ids] > 0, len(rows)).astype(np.int64) + (n_ends > 0)
        score = [np.zeros(0)]
        for part in slices([rows], max_bytes=SCORED):
            stream = stream_of(texts_of(part))
            each = scores[keys.get_indexer(places_of(stream, depth))].astype(np.float64)
            score.append(np.add.reduceat(each, np.flatnonzero(stream == END)[:-1]))
        score = np.concatenate(score)
        return record_batch(RESULT, {"doc_id": rows.column("doc_id"), "held_out": [held_out(i) for i in rows.column("doc_id").to_pylist()], "n_tokens": np.diff(offsets) + 1, "n_known": known, "train_tokens": np.full(len(rows), tokens), "base_score": base, "score": score})

    return met.mapInArrow(judge, RESULT)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each run of rows of one slot."""
    for batch in batches:
        for slot, a, b in runs_of(batch.column("slot").to_numpy()):
            yield slot, batch.slice(a, b - a)
