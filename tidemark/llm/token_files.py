"""Token files: each document's token ids in a zstandard frame of its own, with a trailing seek table.

A file holds, in ascending doc_id order (null first; ties by text), one frame for each document: its
ids, little-endian and 2 or 4 bytes wide as the vocabulary asks, with zstandard's own content checksum.
A skippable frame follows with the number of documents, the width, and the doc_ids. Last comes the seek
table of the Zstandard seekable format: compressed size, decompressed size and checksum (low half of
XXH64) of each frame. Any zstandard tool decompresses the whole file; TokenFile decompresses only the
documents asked for.

Files are written under a temporary name by whichever attempt of a task gets there and then renamed, so
a lost executor or a second attempt leaves the same bytes under the same name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, new_path, own_columns, record_batch, slices, texts_of

#: Magic numbers of the Zstandard seekable format, and the skippable frame of the index.
SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
END_ID = 0
#: Ids that an encoder remembers, for each piece that it may remember.
LONG = 6
WRITTEN = "shard int, path string, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: The key of a piece of letters behind a space or a line break, maybe with ASCII marks but the apostrophe after them.
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_UNSAFE, _CUT = re.compile(r"\s[ \n]"), re.compile(r"(?<=\S)(?=[ \n])")


class Encoder:
    """Encodes texts piece by piece, each distinct piece once.

    A byte-level tokenizer first cuts a text into pre-tokens, and none of them reaches from a visible
    character over a following space or line break. So the ids of a text are those of its pieces, cut
    there, one after the other. New pieces of letters go straight to the tokenizer's model, spelled in
    its byte alphabet; all others go through the whole tokenizer. The strings of special tokens become
    these tokens, as by the library's default; with special_as_text they are text like any other.
    Tokenizers for which this would not hold are refused.

    Pieces are forgotten, all at once, when there are over most of them or their ids are over LONG times
    as many, so that long pieces are bounded too.
    """

    def __init__(self, path: str, most: int = 1_000_000, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        _refuse_others(json.loads(self.tokenizer.to_str()))
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.most, self.model = most, self.tokenizer.model
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]  # bytes without a visible form stand above 255, in order
        self.spelling = {b: chr(256 + k) for k, b in enumerate(moved)}
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.stops: dict[str, list[int]] = {"": []}  # ids of the marks behind letters, which are pre-tokens of their own
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _ids(self, keys: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        tokenize, spelling, stops, plain = self.model.tokenize, self.spelling, self.stops, _PLAIN.fullmatch
        space, line = spelling[ord(" ")], [self.tokenizer.token_to_id(spelling[ord("\n")])]
        for key in keys:
            if m := plain(key):
                lead, body, stop = m.groups()
                if stop not in stops:
                    stops[stop] = self.tokenizer.encode(stop, add_special_tokens=False).ids
                if not body.isascii():
                    body = body.encode().decode("latin-1").translate(spelling)
                if lead:
                    out.append(line + [t.id for t in tokenize(body)] + stops[stop])
                else:
                    out.append([t.id for t in tokenize(space + body)] + stops[stop])
            else:
                out.append(None)
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([self.spelled(keys[k]) for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        encoded = self._ids(pieces)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        n, total = len(self.known), int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.first):
            self.first, self.length = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        self.first[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(pieces)] = lengths
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used += total

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Keys of the text's pieces.

        A piece of a space and what follows has the latter as its key, one that starts with a line break
        itself, and any other piece itself behind a space, which no other key holds.
        """
        if _UNSAFE.search(text):
            return [p[1:] if p[0] == " " and " " not in p[1:] and p[1:2] != "\n" else p if p[0] == "\n" and " " not in p else " " + p for p in _CUT.split(text) if p]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = " " + parts[0]
        return parts

    @staticmethod
    def spelled(key: str) -> str:
        return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key

    def _places(self, keys: list[str]) -> np.ndarray:
        """The number of each key; new keys are learnt."""
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(at < 0)):
            names = [keys[k] for k in new.tolist()]
            self._learn(list(dict.fromkeys(names)))
            at[new] = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return at

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the keys of pieces() of plain texts, one after the other, and how many each text has; each distinct piece becomes a string once."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        keys, index, head = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), offsets[:-1]
        at = self._places(keys)[index]
        at[head] = self._places([" " + keys[k] for k in index[head].tolist()])
        return at, np.diff(offsets)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any texts."""
        cut = [self.pieces(t) for t in texts]
        return self._places(list(chain.from_iterable(cut))), np.fromiter(map(len, cut), np.int64, len(cut))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most or self.used > LONG * self.most:
            self._reset()
        out, groups = [np.zeros(0, np.uint32)] * len(texts), ([], [])
        for k, t in enumerate(texts):
            if t:
                groups[bool(_UNSAFE.search(t))].append(k)
        for group, cut in zip(groups, (self._split, self._cut), strict=True):
            if group:
                at, sizes = cut([texts[k] for k in group])
                n = self.length[at]
                upto = np.cumsum(n)
                ids = self.flat[np.repeat(self.first[at] - upto + n, n) + np.arange(upto[-1])]
                ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                for k, a, b in zip(group, ends[:-1], ends[1:], strict=True):
                    out[k] = ids[a:b]
        return out


def _refuse_others(spec: dict) -> None:
    """ValueError unless texts may be cut as Encoder cuts them: a plain byte-level BPE, special tokens without white space."""
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(re.fullmatch(r"[^\sA-Za-z\u00c0-\u024f.,]\S*", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    if not plain or not added:
        raise ValueError("only byte-level BPE tokenizers without a normalizer, and with plain added tokens, can be encoded piece by piece")


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    return Encoder(path, special_as_text=special_as_text)


def write_file(out, documents: Iterator[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int]:
    """Write (doc_id, ids) in the given order to an open file; how many documents and ids they are."""
    pack = zstandard.ZstdCompressor(level=1, write_checksum=True)
    table, doc_ids, total = [], [], 0
    for doc_id, ids in documents:
        raw = ids.astype(f"<u{width}").tobytes()
        out.write(frame := pack.compress(raw))
        table.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        doc_ids.append(doc_id)
        total += len(ids)
    index = zstandard.ZstdCompressor(level=3).compress(json.dumps({"width": width, "doc_ids": doc_ids}).encode())
    out.write(struct.pack("<II", INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
    out.write(struct.pack("<II", SEEK_MAGIC, 12 * len(table) + 9) + b"".join(table) + struct.pack("<IBI", len(table), 0x80, FOOTER_MAGIC))
    return len(doc_ids), total


class TokenFile:
    """A token file, opened by its seek table; only documents asked for are decompressed."""

    def __init__(self, path: str) -> None:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.raw, self.sums = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self.offsets = np.cumsum(self.sizes) - self.sizes
        end = size - 9 - 12 * n - 8
        (length,) = struct.unpack("<I", self.file.read_at(4, end - 4))
        index = json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(length, end - 4 - length)))
        self.width, self.doc_ids = index["width"], index["doc_ids"]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def counts(self) -> np.ndarray:
        """Ids of each document, from the seek table alone."""
        return self.raw // self.width

    def read(self, k: int) -> np.ndarray:
        """The ids of document k; ValueError if its bytes do not match the checksum."""
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.sizes[k]), int(self.offsets[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"document {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}").astype(np.uint32)

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, *, special_as_text: bool = False) -> list[dict]:
    """Write the token files of all docs to the folder; a row for each file, in order, with its first start.

    folder: a URI that executors can write to. Null text: only the end. Repeated rows are each written.
    Empty table: no files. Extra columns are ignored. Very long texts are encoded whole, one frame each.
    The rows are also kept in manifest.json there.
    """
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, code = TaskContext.get(), TaskContext.get().partitionId(), encoder(tokenizer, special_as_text)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in slices(freed(batches), max_bytes=1 << 20):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), code.encode(texts_of(batch)), strict=True):
                    yield doc_id, np.append(ids, np.uint32(END_ID))

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{shard:06d}.tokens"
        with fs.open_output_stream(f"{root}/.{name}.{own.taskAttemptId()}") as out:
            n_docs, n_tokens = write_file(out, documents(), code.width)
        if n_docs:
            if fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.File:  # of an earlier attempt; not every file system moves onto it
                fs.delete_file(f"{root}/{name}")
            fs.move(f"{root}/.{name}.{own.taskAttemptId()}", f"{root}/{name}")
            yield record_batch(WRITTEN, {"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})
        else:
            fs.delete_file(f"{root}/.{name}.{own.taskAttemptId()}")

    files = sorted((r.asDict() for r in ordered.mapInArrow(write, WRITTEN).collect()), key=lambda f: f["shard"])
    start = 0
    for f in files:
        f["start"], start = start, start + f["n_tokens"]
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(files).encode())
    return files


def read_tokens(spark, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; columns as in RESULT."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f = TokenFile(path)
                n = f.counts()
                crc = [zlib.crc32(f.read(k).astype("<u4").tobytes()) for k in range(len(f))]
                f.close()
                yield record_batch(RESULT, {"doc_id": f.doc_ids, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    rows = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return rows.repartition(max(1, len(files)), "path").mapInArrow(read, RESULT)


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, *, special_as_text: bool = False) -> DataFrame:
    """Write the token files of docs and read them back; columns as in RESULT."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, folder or new_path(spark, "tokens"), tokenizer, special_as_text=special_as_text))
