"""SimHash near-duplicates: fingerprints within a few differing bits, and their connected components.

Equal fingerprints are one entry throughout, so copies are never paired. Distinct fingerprints meet by
the pigeonhole principle: 64 bits are cut into BLOCKS blocks, and two fingerprints that differ in at
most `bits` bits agree on at least that number less bits of them, so each is dealt under every such choice
of blocks with their values as key. More fingerprints are cut into more blocks, so that groups by chance
stay as small as PER_KEY. A key with more than max_group fingerprints is dealt again, `refine` times at
most, with the same choices made among the bits that it leaves open. What is larger even then, a run of
near fingerprints, is cut into parts of max_group, and each pair of parts is a group. Within a task the fingerprints of all keys are put in Gray order and indexed by a
hierarchy: an upper node keeps the bits that all below it share (mask) and their pattern. Pairs of
nodes are searched from the top; a pair goes as soon as the patterns differ in more than `bits` bits of
the shared mask, since below it differences only grow, and is closed with one link as soon as all below
it must lie within `bits`. Links are reduced to a spanning forest before they leave the task.

Components: each entry takes the smallest entry among its neighbours' until nothing changes
(large-star and small-star steps on links, stored in the shared folder between rounds).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ASCII_LOWER, freed, own_columns, record_batch, slices, spread_join, stored, texts_of, unused, whole_groups

BLOCKS, FAN, PER_KEY = (6, 7, 8, 10), 8, 512


def blocks_for(n: int, bits: int = 4) -> int:
    """The least number of blocks for which n fingerprints leave PER_KEY or fewer for each key."""
    return next((b for b in BLOCKS if n >> 64 * (b - bits) // b <= PER_KEY), BLOCKS[-1])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64, repeats counted; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of each row; null text has no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(freed(batches)):
            fps = np.array([fingerprint(t, size) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield record_batch("doc_id long, th long, fp long", {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": fps})

    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("th", F.xxhash64("text")).mapInArrow(count, "doc_id long, th long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the Gray sequence."""
    out = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Forest:
    """Union-find over numbered entries, for links that come in blocks."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            open_ = a != b
            a, b = a[open_], b[open_]
            if len(a):
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                np.minimum.at(self.root, hi, lo)
                self.root = self.find(np.arange(len(self.root)))


def _levels(group: np.ndarray, fps: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The hierarchy, leaves first: shared mask, pattern, first and last member, and children of each node."""
    n = len(fps)
    level = {"mask": np.full(n, 2**64 - 1, np.uint64), "pattern": fps, "group": group, "first": np.arange(n), "last": np.arange(n)}
    out = [level]
    while True:
        g = level["group"]
        start = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        at = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
        head = np.flatnonzero(at % FAN == 0)
        if len(head) == len(g):
            return out
        both = np.bitwise_and.reduceat(level["pattern"] & level["mask"], head)
        either = np.bitwise_or.reduceat(level["pattern"] & level["mask"], head)
        mask = np.bitwise_and.reduceat(level["mask"], head) & ~(both ^ either)
        level = {"mask": mask, "pattern": both & mask, "group": g[head], "first": level["first"][head], "last": level["last"][np.concatenate([head[1:], [len(g)]]) - 1], "child": head, "children": np.diff(np.concatenate([head, [len(g)]]))}
        out.append(level)


def linked_within(group: np.ndarray, fps: np.ndarray, bits: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a < b after ordering, that span every component of fingerprints of one group within bits.

    group and fps must be ordered by group and Gray rank.
    """
    levels = _levels(group, fps)
    forest = Forest(len(fps))
    top = levels[-1]
    same = np.flatnonzero(np.bincount(top["group"] - top["group"].min()) > 0) if len(fps) else []
    assert len(same) == len(top["group"]) or not len(fps)
    stack = [(len(levels) - 1, np.arange(len(top["group"])), np.arange(len(top["group"])))] if len(fps) else []
    while stack:
        k, a, b = stack.pop()
        if len(a) > block:
            stack += [(k, a[i : i + block], b[i : i + block]) for i in range(0, len(a), block)]
            continue
        x = levels[k]
        shared = x["mask"][a] & x["mask"][b]
        apart = popcount((x["pattern"][a] ^ x["pattern"][b]) & shared)
        near = apart <= bits
        a, b, apart, shared = a[near], b[near], apart[near], shared[near]
        if k == 0:
            forest.link(a, b)
            continue
        sure = apart + 64 - popcount(shared) <= bits
        if sure.any():
            for node in (a[sure], b[sure]):
                node = np.unique(node)
                size = x["last"][node] - x["first"][node] + 1
                inner = np.repeat(x["first"][node], size)
                forest.link(inner, inner + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            forest.link(x["first"][a[sure]], x["first"][b[sure]])
        a, b = a[~sure], b[~sure]
        if len(a):  # nodes that are each one component, and the same one, have nothing to add
            whole = np.minimum.reduceat(r := forest.find(np.arange(len(fps))), x["first"]) == np.maximum.reduceat(r, x["first"])
            done = whole[a] & whole[b] & (r[x["first"][a]] == r[x["first"][b]])
            a, b = a[~done], b[~done]
            na, nb = x["children"][a], x["children"][b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            i = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            ca, cb = x["child"][a][pair] + i // nb[pair], x["child"][b][pair] + i % nb[pair]
            keep = ca <= cb
            stack.append((k - 1, ca[keep], cb[keep]))
    root = forest.find(np.arange(len(fps)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return root[moved], moved


def _block_masks(free: int, blocks: int, keep: int) -> list[int]:
    """Masks of every choice of keep blocks among the bits of free, cut evenly."""
    places = [i for i in range(64) if free >> i & 1]
    cut = [sum(1 << p for p in places[len(places) * k // blocks : len(places) * (k + 1) // blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(cut, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(entries: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each entry and mask: the mask, the bits under it, the fingerprint."""
    return entries.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(entries: DataFrame, bits: int = 4, max_group: int = 20_000, refine: int = 2) -> DataFrame:
    """(lo, hi) links that span the components of the distinct fingerprints in entries (column fp)."""
    blocks = blocks_for(entries.count(), bits)
    rows = _deal(entries, _block_masks(2**64 - 1, blocks, blocks - bits))
    for turn in range(refine + 1):
        large = stored(rows.groupBy("mask", "key").count().where(F.col("count") > max_group), "large-keys")
        if large.isEmpty():
            break
        rest, in_large = rows.join(large, ["mask", "key"], "left_anti"), rows.join(large, ["mask", "key"])
        if turn == refine:
            parts = F.ceil(F.col("count") / max_group).cast("int")
            own, other = F.pmod(F.xxhash64("fp"), parts).cast("int"), F.col("other")
            paired = in_large.select("mask", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            again = paired.select("mask", "key", F.concat_ws(",", F.least("own", other), F.greatest("own", other)).alias("pair"), "fp")
            rows = rest.withColumn("pair", F.lit("")).unionByName(again)
            break
        masks = [r.mask & (2**64 - 1) for r in large.select("mask").distinct().collect()]  # at most as many as there are choices of blocks
        finer = {m: [m | f for f in _block_masks(~m & (2**64 - 1), blocks, blocks - bits)] for m in masks}
        table = F.create_map(*[x for m, fs in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(f)).cast("long") for f in fs]))])
        again = in_large.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        rows = rest.unionByName(again.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))
    # a group goes by the hash of its name: where two meet in one, too many fingerprints are compared, and no link is lost
    name = F.xxhash64("mask", "key", *(["pair"] if "pair" in rows.columns else [])).alias("name")
    dealt = rows.select(name, "fp").repartition("name").sortWithinPartitions("name")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, fp in whole_groups(batches, ("name", "fp"), ("name",), 1 << 17):
            fps = fp.view(np.uint64)
            order = np.lexsort((gray_rank(fps), name))
            name, fps = name[order], fps[order]
            group = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
            alone = np.bincount(group)[group] == 1
            group, fps = np.unique(group[~alone], return_inverse=True)[1], fps[~alone]
            a, b = linked_within(group, fps, bits)
            a, b = fps[a].view(np.int64), fps[b].view(np.int64)
            yield record_batch("lo long, hi long", {"lo": np.minimum(a, b), "hi": np.maximum(a, b)})

    return dealt.mapInArrow(search, "lo long, hi long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has a link.

    Large-star, then small-star, until the links stay as they are. Nodes with many links are joined where
    the links are read.
    """
    edges = stored(edges.select(F.greatest("lo", "hi").alias("u"), F.least("lo", "hi").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = stored(spread_join(both, stored(low, "least"), "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        small_low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = spread_join(large, small_low, "u", "n").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = stored(small, "links")
        same = [new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()]
        edges = new
        if same[0] == same[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """fp, doc_id, th (the text's hash), root (the component's own number) and component_id of each row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "entries")
    roots = components(links(entries.select("fp"), bits))
    named = stored(entries.join(roots, entries.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "rows"), "roots")
    smallest = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    groups = stored(spread_join(named, smallest, "root", "n").select("fp", "root", "component_id", "rows"), "groups")
    return spread_join(prints, groups, "fp", "rows")


def near_duplicates(docs: DataFrame, *, size: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row.

    component_id is the smallest doc_id reachable by links between fingerprints that differ in at most
    bits bits, the row's own included; null only if no reachable row has a doc_id. Null and empty
    texts have fingerprint zero and link as any other. Empty table: no rows. Repeated rows each get
    their row. A bit that exactly half the shingles set is 0. Very long texts count with all their
    shingles. Extra columns are ignored.
    """
    return grouped(docs, size, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, size: int = 4, bits: int = 4) -> DataFrame:
    """One row of each component, all columns: the one with the least doc_id (null last), of equal ones the least hash of the text.

    Of rows equal in doc_id and text, any one stays. Null and empty texts are one component, with all that
    link to fingerprint zero. Empty table: no rows.
    """
    found = stored(grouped(docs, size, bits).select("root", "doc_id", "th"), "components")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    rows = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    chosen = first.select(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t"))
    again = stored(chosen.join(rows, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select("d", "t", "n"), "chosen")
    d, t = unused(docs, "d"), unused(docs, "t")
    again = again.select(F.col("d").alias(d), F.col("t").alias(t), "n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    repeated = docs.join(again.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(again.where("n = 1"), same, "left_semi").unionByName(repeated)
