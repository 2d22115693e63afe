"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is WINDOW consecutive words of an item, or all words of a shorter one. Its tokens are its
shingles of SHINGLE words (all words of a shorter window), as 64-bit hashes. For a window to be
contained whole, none of its shingles may be missing, so the necessary prefix in the order of rarity is
its rarest shingle alone, where rarity is counted over all documents. Document positions join on that
shingle; the length bound (enough words before and after) and the positional bound (the window must
start where the shingle's place in it says) leave one candidate each, which is verified word by word.

The benchmark's side is broadcast only while it is small: up to max_broadcast windows and MAX_BYTES of
their words. Beyond that, positions are joined as numbers by a shuffle, and the texts meet only the candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, own_columns, stored, unused

WINDOW, SHINGLE = 10, 5
MAX_BROADCAST, MAX_BYTES = 200_000, 32 << 20


def word_list(text: Column) -> Column:
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingle(words: Column, at: Column, size: int) -> Column:
    """The hash of size words from place at on."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (its words) of each window of each item with an id and a word."""
    words = own_columns(items, "item_id", "text").where("item_id is not null").select("item_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return words.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("win"))


def positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, th (hash of the text), w (its words), at and key for each shingle of each of the sizes."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), word_list(F.col("text")).alias("w"))
    each = base.select("doc_id", "th", "w", F.posexplode_outer("w").alias("at", "word"))
    keyed = [each.where(F.col("at") + k <= F.size("w")).select("doc_id", "th", "w", "at", shingle(F.col("w"), F.col("at"), k).alias("key")) for k in sizes]
    return reduce(DataFrame.unionByName, keyed)


def windows_found(docs: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, th, start, length, win_id) and the items of each window (win_id, item_id).

    docs has doc_id and text. Equal windows of several items are one win_id.
    """
    of_items = stored(item_windows(items, window), "item-windows")
    wins = stored(of_items.groupBy("win").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("win_id"), "win"), "windows")
    owners = of_items.join(wins, "win").select("win_id", "item_id").distinct()
    sizes = [r[0] for r in wins.select(F.least(F.lit(size), F.size("win")).alias("k")).distinct().collect()]  # at most size numbers
    count, volume = wins.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    few = count <= max_broadcast and volume <= MAX_BYTES
    light = lambda df: F.broadcast(df) if few else df
    if not sizes:
        return docs.select("doc_id", F.xxhash64("text").alias("th"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("win_id")).where("false"), owners
    tokens = []
    for k in sizes:
        of = wins.where(F.least(F.lit(size), F.size("win")) == k)
        tokens.append(of.select("win_id", "win", F.explode(F.sequence(F.lit(0), F.size("win") - k)).alias("off")).select("win_id", "win", "off", shingle(F.col("win"), F.col("off"), k).alias("key")))
    tokens = stored(reduce(DataFrame.unionByName, tokens), "shingles")
    seen = positions(docs, sizes).select("key").join(light(tokens.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(seen, "key", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off", "win")).alias("rarest"))
    prefixes = stored(ranked.where("rarest.n > 0").select("win_id", "rarest.key", "rarest.off", "rarest.win"), "prefixes")
    start = F.col("at") - F.col("off")
    if few:
        found = positions(docs, sizes).join(F.broadcast(prefixes), "key")
        found = found.where((start >= 0) & (start + F.size("win") <= F.size("w"))).where(F.slice("w", start + 1, F.size("win")) == F.col("win"))
        return found.select("doc_id", "th", start.alias("start"), F.size("win").alias("length"), "win_id"), owners
    near = positions(docs, sizes).select("doc_id", "th", "at", F.size("w").alias("n"), "key").join(prefixes.select("key", "off", "win_id", F.size("win").alias("length")), "key")
    near = near.where((start >= 0) & (start + F.col("length") <= F.col("n"))).select("doc_id", "th", start.alias("start"), "length", "win_id").distinct()
    near = near.join(wins, "win_id").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "length", "win_id", "win")).alias("c"))
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), word_list(F.col("text")).alias("w")).dropDuplicates(["d", "t"])
    found = near.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "w", F.explode("c").alias("c")).where(F.slice("w", F.col("c.start") + 1, F.col("c.length")) == F.col("c.win"))
    return found.select("doc_id", "th", "c.start", "c.length", "c.win_id"), owners


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, size: int = SHINGLE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hits (word ranges) of each row.

    Null text or item: no words. Items without an id are left out. Empty table: no rows; no items:
    nothing is hit. Repeated rows each get their row, and repeated items count once. Very long texts
    are matched whole. Of equally rare shingles the one with the least hash is the prefix, which changes
    no result. Extra columns are ignored.
    """
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, owners = windows_found(docs, items, window, size, max_broadcast)
    found = stored(found, "occurrences")
    ranges = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits"))
    end = lambda x: x["start"] + x["length"]
    union = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["end"], end(x)).alias("end"), (a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))).alias("n")))["n"]
    of_items = found.select("doc_id", "th", "win_id").distinct().join(owners, "win_id").select("doc_id", "th", F.col("item_id").cast("string").alias("i")).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("items"))
    hit = ranges.join(of_items, ranges.doc_id.eqNullSafe(of_items.doc_id) & (ranges.th == of_items.th)).select(ranges.doc_id.alias("d"), ranges.th.alias("t"), "hits", union.cast("long").alias("n_hit"), "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hits")


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs; nulls and ties as in contamination()."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, _ = windows_found(own, items, **how)
    d, t = unused(docs, "hit_doc"), unused(docs, "hit_text")
    hit = found.select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t)), "left_anti")


#: DuckDB's version of contamination() with its defaults, without hits.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s : s + l - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, l, s, array_to_string(w[s : s + l - 1], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
), hits AS (
  SELECT doc_id, dw.l, s, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.win = iw.win
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""
