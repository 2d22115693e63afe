"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. All sources together get `share` times the words there are, dealt by weight. A source whose
target would exceed max_epochs times its own words is clamped there and the excess is dealt among the
others by weight, until none is above. The end of these rounds is found in one step: sources in the
order of cap / weight are clamped up to the first whose share of what is left fits.

Taking. A source with target / words = 1.7 gets each document once whole, and 0.7 of its words from
documents in the order of a seeded hash; the last of them is cut so that the target is met to the word.
The order is never built as a whole: documents fall into 256 buckets by their hash, words are summed by
bucket, and the one bucket per source in which the target falls is cut into 256 again; only the
documents of the bucket that is left then are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_columns, stored

WEIGHTS, DIGITS = (3, 1, 2), (2, 4)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def order_hash(doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that put documents in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size and target; sizes has source and size.

    One row for each source, so the windows here are over as many rows as there are sources.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    whole = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", F.array(*map(F.lit, weights))[(F.row_number().over(by_code) - 1) % len(weights)])
    each = each.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    each = each.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    each = each.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    each = each.withColumn("open", F.col("level") <= F.col("fill")).withColumn("place", F.row_number().over(by_fill))
    each = each.withColumn("level", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole)["level"])
    return each.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def plan(sizes: DataFrame, **how) -> DataFrame:
    """For each source: source_size, target, whole (repetitions of all documents), rest (words beyond them), and the bucket in which the rest ends with the words before it.

    sizes has source, size and u (as of order_hash).
    """
    goal = stored(targets(sizes, **how).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "targets")
    held = goal.withColumns({"edge": F.when(F.col("rest") > 0, F.lit("")), "before": F.lit(0).cast("long")})
    for digits in DIGITS:  # 256 buckets more each time, within the one in which the rest ends
        state = held.select(F.col("source").alias("s"), "rest", "edge", "before")
        within = sizes.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.substring("u", 1, digits - 2) == F.col("edge")))
        buckets = within.groupBy("source", "rest", "before", F.substring("u", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        found = buckets.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        found = found.groupBy(F.col("source").alias("s")).agg(F.min("bucket").alias("edge"), F.min(F.col("upto") - F.col("words")).alias("before"))
        held = stored(goal.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")
    return held


def take(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows (with source, size, doc_id, u) with source_size, target, whole, and part: words of one more, partial repetition."""
    planned = planned.withColumnRenamed("source", "planned_source")
    joined = rows.join(planned, F.col("source").eqNullSafe(F.col("planned_source"))).drop("planned_source")
    bucket = F.substring("u", 1, DIGITS[-1])
    at_edge = F.coalesce(bucket == F.col("edge"), F.lit(False))
    order = Window.partitionBy("source").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    far = joined.where(~at_edge).withColumn("part", F.when(F.col("edge").isNull() & (F.col("rest") <= 0), 0).when(F.col("edge").isNull() | (bucket < F.col("edge")), F.col("size")).otherwise(0).cast("long"))
    near = joined.where(at_edge).withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0)))).cast("long"))
    return far.unionByName(near).drop("rest", "edge", "before")


def mix(docs: DataFrame, *, seed: int = 17, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row; how: weights, share and max_epochs of targets().

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Null doc_id: in the
    order's place of the empty string. Rows with equal doc_id keep one place, the smaller first; equal
    rows are each taken, at most max_epochs times. Empty table: no rows. Extra columns are ignored.
    """
    docs = own_columns(docs, "doc_id", "text", "source")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(word_list(F.col("text"))).cast("long").alias("size"), order_hash(F.col("doc_id"), seed).alias("u")), "sizes")
    return take(sizes, plan(sizes, **how)).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: int = 17, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns.

    The one document per source that is cut keeps its first words, joined by one space.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(word_list(F.col("text"))).cast("long").alias("size"), order_hash(F.col("doc_id"), seed).alias("u"))
    planned = plan(stored(held.drop("row"), "sizes"), **how)
    taken = take(held, planned).withColumn("times", F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).where("times > 0 or (size = 0 and whole > 0)")
    cut = (F.col("k") > F.col("whole")) & (F.col("part") < F.col("size"))
    each = taken.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    short = F.array_join(F.slice(word_list(F.col("row")["text"]), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    each = each.withColumn("short", F.when(cut, short))
    out = {n: F.col("row")[n] for n in names}
    out["text"] = F.when(cut, F.col("short")).otherwise(F.col("row")["text"])
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.length("short")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return each.select(*[c.alias(n) for n, c in out.items()])


#: DuckDB's version of mix() with its defaults.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS u
  FROM documents
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM each
), filled AS (
  SELECT *, cap / weight AS fill FROM weighed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY fill, source NULLS LAST) AS place,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM filled
  WINDOW w AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= fill) * weight, cap)) AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM placed
"""
