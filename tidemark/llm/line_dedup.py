"""Line dedup: repeated chunks of lines, cut at content-defined boundaries, are removed.

A rolling hash over the hashes of the last three lines marks a line as a boundary where its value falls
in one of DIVISOR classes, unless the line before it is marked too. So boundaries depend on nearby
lines alone, move with them when lines are inserted above, and leave at least two lines to a chunk but
for a text's last. Chunks of two lines or more with a word are compared, as whole texts byte by byte,
over all documents. The first document that has a chunk (least doc_id, null last) keeps it, once; it is
removed everywhere else.

Equal chunks are merged before the shuffle. Decisions go back by the chunk's 64-bit hash: only chunks that
are compared are joined, and those that stand in a large share of all documents where the documents are
read. Where chunks of different bytes share a hash, they go by the bytes. Texts travel once, to meet the
lines that go from them; chunks and lines do not travel with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, spread_join, stored

DIVISOR, BASE, MODULUS = 4, 31, 1_000_003


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


# The outer kinds of explode are used on purpose: for the others Spark infers a filter on the array's size
# and carries it, with all that makes the array, below and into the lambdas, where it runs for each line.


def with_ends(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with lines, and ends: the place of each chunk's last line, counted from 0."""
    step = docs.select("*", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    step = step.withColumn("hashes", F.transform("lines", line_hash))
    back = lambda i, k: F.coalesce(F.get(F.col("hashes"), i - k), F.lit(0).cast("long"))
    step = step.withColumn("marks", F.transform("hashes", lambda x, i: ((back(i, 2) * BASE * BASE + back(i, 1) * BASE + x) % MODULUS) % DIVISOR == 0))
    last = F.size("marks") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & F.get(F.col("marks"), i) & ~F.get(F.col("marks"), i - 1)))
    return step.withColumn("ends", ends).drop("hashes", "marks")


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with lines, ends and chunks: an array of (start, size, body).

    start counts from 0; body is null where a chunk isn't compared.
    """
    start = lambda j: F.coalesce(F.get(F.col("ends"), j - 1) + 1, F.lit(0))
    body = lambda e, j: F.when(e > start(j), F.array_join(F.slice("lines", start(j) + 1, e - start(j) + 1), "\n"))
    chunk = lambda e, j: F.struct(start(j).alias("start"), (e - start(j) + 1).alias("size"), body(e, j).alias("body"))
    compared = lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), F.when(c["body"].rlike(r"[^\x20\x09-\x0D]"), c["body"]).alias("body"))
    return with_ends(docs).withColumn("chunks", F.transform(F.transform("ends", chunk), compared))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines and kept_text of each row.

    Lines are what line feeds separate. Null text: one empty line, kept. Empty table: no rows. Rows
    with equal doc_id are one document for the choice of the first (so are rows without one), and equal
    rows get equal results. Very long texts are cut like any other, in one row. Extra columns are ignored.
    """
    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("*", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("th"))
    cut = with_chunks(docs)
    bodies = cut.select("doc", F.explode_outer("chunks.body").alias("body")).where("body is not null")
    texts = bodies.groupBy("body").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    by_hash = stored(texts.groupBy(F.xxhash64("body").alias("h")).agg(F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")), "chunk-hashes")
    each = cut.select("doc", "th", F.explode_outer("chunks").alias("c")).select("doc", "th", "c.start", "c.size", "c.body").where("body is not null").withColumn("h", F.xxhash64("body"))
    places = stored(each.drop("body"), "chunk-places")
    shared = by_hash.where("kinds > 1").select("h")
    if shared.isEmpty():
        gone = _gone(places, "h", by_hash.where("first < last").select("h", "first", "n"))
    else:
        gone = _gone(places.join(shared, "h", "left_anti"), "h", by_hash.where("kinds = 1 and first < last").select("h", "first", "n"))
        same = stored(each.join(shared, "h", "left_semi").drop("h"), "shared-hashes")
        gone = gone.unionByName(_gone(same, "body", same.groupBy("body").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))))
    flags = stored(gone.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("ranges")), "flags")  # no more than a text has chunks
    before = lambda k: F.coalesce(F.get(F.col("ranges"), k - 1)["start"] + F.get(F.col("ranges"), k - 1)["size"], F.lit(0))
    marks = F.array_join(F.transform("ranges", lambda r, k: F.concat(F.repeat(F.lit("0"), r["start"] - before(k)), F.repeat(F.lit("1"), r["size"]))), "")
    removed = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["size"])
    # for each line whether it goes; made below the join, so that the lambda above it only looks it up
    flags = flags.select("doc", "th", F.transform(F.split(marks, ""), lambda x: x == "1").alias("gone"), F.size("ranges").alias("n_gone"), removed.alias("n_removed_lines"))
    counted = with_ends(docs).select("doc_id", "doc", "th", "text", F.size("lines").cast("long").alias("n_lines"), F.size("ends").cast("long").alias("n_chunks"))
    # a join by shuffle at any size: texts travel once, and the flags, which grow with the corpus, are never broadcast
    joined = counted.join(flags.hint("merge"), ["doc", "th"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.get(F.col("gone"), i), F.lit(False))), "\n")
    kept_text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept)
    none = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return joined.select("doc_id", "n_lines", "n_chunks", none("n_gone").alias("n_removed_chunks"), none("n_removed_lines"), kept_text.alias("kept_text"))


def _gone(places: DataFrame, key: str, first: DataFrame) -> DataFrame:
    """doc, th, start and size of each chunk that an earlier document, or an earlier place in its own, has; first: the first document of each key, and n rows or more that have it."""
    own = ["doc", "th", "start", "size"]
    twice = places.groupBy("doc", "th", key).agg(F.min("start").alias("one"), F.max("start").alias("other")).where("one < other").drop("other")
    again = places.join(twice, ["doc", "th", key]).where("start > one").select(own)
    return spread_join(places, first, key, "n").where("first < doc").select(own).unionByName(again)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB's version of digest(dedup_lines()).
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT r, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM line
), marked AS (
  SELECT r, doc, i, line, ((coalesce(lag(h, 2) OVER w, 0) * 961 + coalesce(lag(h) OVER w, 0) * 31 + h) % 1000003) % 4 = 0 AS mark
  FROM hashed WINDOW w AS (PARTITION BY r ORDER BY i)
), ended AS (
  SELECT *, i > 1 AND mark AND NOT lag(mark) OVER w AS last FROM marked WINDOW w AS (PARTITION BY r ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM ended
), chunk AS (
  SELECT r, doc, j, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY r, doc, j
), compared AS (
  SELECT *, n > 1 AND regexp_matches(body, '[^ 	-
]') AS own FROM chunk
), flagged AS (
  SELECT *, own AND (row_number() OVER (PARTITION BY r, own, body ORDER BY j) > 1 OR min(doc) OVER (PARTITION BY own, body) < doc) AS gone FROM compared
), summed AS (
  SELECT r, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks,
         coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
         coalesce(string_agg(body, chr(10) ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM flagged GROUP BY r
)
SELECT doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, sha256(kept) AS kept_sha256
FROM docs JOIN summed USING (r)
"""
