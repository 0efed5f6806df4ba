"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its weight's share of all words, at
most ``most_copies`` times its own, the excess going to the other sources by
weight until none is above.  That level is found in one step: with sources in order
of (cap / weight), it is the first at which what is left of the words, shared by
the weights left, doesn't exceed the source's own cap.

A source whose target is r times its words takes floor(r) certain copies of each
of its documents, and a sample for the rest.  The sample is in Pareto order: a
document draws a number u from its id, and is ranked by its random odds u / (1 - u)
divided by its inclusion odds p / (1 - p), where p, the rest over the source's
words, differs from source to source.  The lowest ranks are taken as far as the
words wanted reach, so the size of the sample is fixed, in words, which a draw
document by document wouldn't give.  The first document that doesn't fit is left
out; of the ``LOOK`` that follow in rank, each goes in that still fits what is left, and
at last the smallest of those left out, if that comes nearer.  So a source misses its
target by half of the smallest document left out at most.

Sources are ordered, and documents ranked and summed up, by range partitions that
report one total a group, so a source may hold any share of all rows; what a source
adds to its rows is copied ``SPREAD`` times for the join.

Defined results: a null text has size 0; sources go by code point, null last, and
weights repeat in that order; a source without words has target 0; documents without
words take 0; a null id draws as the empty text; repeated rows are each their own
document and draw alike, and rows of one id with different sizes rank by size; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents tried after the first that doesn't fit.
LOOK = 1000
#: Copies of a source's row that its documents are spread over.
SPREAD = 16
WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, groups: list[str], order: list[str], sums: dict[str, str], name: str) -> tuple[DataFrame, str]:
    """(rows, folder): ``rows`` with sums (new name -> column) over all earlier rows of their groups, by ``order``.

    Rows are range-partitioned by groups and order and fixed in a table of the shared folder; a partition reports
    one total a group, and a row's sum is that of earlier partitions and of the rows before it in its own.
    """
    path = common.shared_path(rows.sparkSession, name)
    ranged = common.stored_at(rows.repartitionByRange(*groups, *order).withColumn("portion", F.spark_partition_id()), path)
    earlier = Window.partitionBy(*groups).orderBy("portion").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("portion", *groups).agg(*(F.sum(c).alias(f"{out}_all") for out, c in sums.items())).select(
        F.col("portion").alias("of_portion"), *(F.col(g).alias(f"of_{g}") for g in groups),
        *(F.coalesce(F.sum(f"{out}_all").over(earlier), F.lit(0)).alias(f"{out}_earlier") for out in sums))
    here = F.col("portion") == F.col("of_portion")
    for g in groups:
        here &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    up_to = Window.partitionBy("portion", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(totals, here).select(*rows.columns, *(
        (F.col(f"{out}_earlier") + F.coalesce(F.sum(c).over(up_to), F.lit(0))).alias(out) for out, c in sums.items())), path


def targets(sizes: DataFrame, weights: tuple[int, ...], most_copies: int) -> tuple[DataFrame, list[str]]:
    """((source, source_size, target), folders) from (source, source_size)."""
    total = sizes.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed"), F.lit(1).alias("one"), F.lit(0).alias("everything"))
    ranked, first_path = running(named, ["everything"], ["unnamed", "source"], {"rank": "one"}, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_copies).withColumn("full", F.col("cap") / F.col("weight"))
    all_weights = capped.agg(F.sum("weight").alias("n")).first()["n"] or 0
    by_level, second_path = running(capped, ["everything"], ["full", "rank"], {"caps_below": "cap", "weights_below": "weight"}, "mix-levels")
    # The words left for this source and those above, if all below take what they can, for each weight left.
    share = (F.lit(total).cast("long") - F.col("caps_below")) / (F.lit(all_weights).cast("long") - F.col("weights_below"))
    level = by_level.withColumn("share", share).where("share <= full").agg(F.min_by("share", F.struct("full", "rank")).alias("share")).first()["share"]
    target = F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("weight"))
    return by_level.select("source", "source_size", target.alias("target")), [first_path, second_path]


def uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that the id and the seed decide: 48 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3, seed: str = "mix", id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target (its source's), copies, taken (words: copies * size)."""
    if not weights or min(weights) < 1 or most_copies < 1:
        raise ValueError("weights and the number of copies must be positive")
    spark = df.sparkSession
    numbered, (doc_id, text, source) = common.picked(df, id_col, text_col, source_col)
    words = F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rows_path = common.shared_path(spark, "mix-rows")
    rows = common.stored_at(numbered.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), words.alias("size")), rows_path)

    by_source, paths = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_copies)
    certain = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    by_source = by_source.withColumn("certain", certain).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    by_source = by_source.withColumn("p", F.try_divide("rest", "source_size")).withColumn("wanted", F.round("rest").cast("long"))
    u = uniform(F.col("doc_id"), seed)
    order = F.coalesce(F.try_divide(u / (1 - u) * (1 - F.col("p")), F.col("p")), u)
    drawn = _with_source(rows, by_source).withColumn("pareto", order)
    ranked, ranks_path = running(
        drawn.withColumn("one", F.lit(1)), ["source"], ["pareto", "doc_id", "size"], {"before": "size", "rank": "one"}, "mix-ranks")
    ranked = common.stored(ranked.drop("one", "pareto"), "mix-ranked")
    for path in (rows_path, ranks_path, *paths):
        common.removed(spark, path)

    # Sums never fall with the rank, so the rows that fit are the first ones; of those after, a bounded number is tried.
    fits = F.col("before") + F.col("size") <= F.col("wanted")
    late = ranked.where(~fits)
    ends = late.groupBy("source").agg(F.min("rank").alias("end"))
    after = _with_source(late, ends).where(F.col("rank") <= F.col("end") + LOOK)
    queues = after.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "size", "before", "wanted"))).alias("queue"))
    filled = queues.select("source", F.explode(F.expr("""
        aggregate(slice(queue, 2, size(queue)),
                  struct(queue[0].wanted - queue[0].before as room, cast(array() as array<bigint>) as taken),
                  (s, d) -> if(d.size <= s.room, struct(s.room - d.size as room, concat(s.taken, array(d.rank)) as taken), s),
                  s -> concat(s.taken, transform(
                      slice(array_sort(transform(filter(queue, d -> d.size < 2 * s.room and not array_contains(s.taken, d.rank)),
                                                 d -> struct(d.size as size, d.rank as rank))), 1, 1),
                      d -> d.rank)))""")).alias("rank")).withColumn("filled", F.lit(True))
    both = ranked.join(filled.withColumnRenamed("source", "filled_source").withColumnRenamed("rank", "filled_rank"),
                       F.col("source").eqNullSafe(F.col("filled_source")) & (F.col("rank") == F.col("filled_rank")), "left")
    sampled = (fits | F.coalesce("filled", F.lit(False))) & (F.col("certain") < most_copies)
    copies = (F.col("certain") + sampled.cast("long")).alias("copies")
    return both.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def _with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source, whose row is copied so that a large source is no hot key."""
    copies = by_source.withColumnRenamed("source", "of_source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spread = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SPREAD)).cast("int")
    joined = rows.withColumn("spread", spread).join(copies, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("spread") == F.col("copy")))
    return joined.drop("spread", "copy", "of_source")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source in the weights 5, 2, 1."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER below, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0))::DOUBLE AS share,
         (3 * source_size)::DOUBLE / weight AS brim
  FROM weighed
  WINDOW below AS (ORDER BY (3 * source_size)::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS MATERIALIZED (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_min(share, {{'brim': brim, 'place': place}}) FROM levels WHERE share <= brim) * weight) AS target
  FROM levels),
rests AS MATERIALIZED (
  SELECT *, target - certain * source_size AS rest, (target - certain * source_size) / nullif(source_size, 0) AS p
  FROM (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS certain FROM aims)),
drawn AS (
  SELECT doc_id, source, size, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM docs),
ranked AS MATERIALIZED (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.certain, round(r.rest)::BIGINT AS wanted,
         coalesce(sum(d.size) OVER earlier, 0)::BIGINT AS before, row_number() OVER (PARTITION BY d.source ORDER BY pareto, d.doc_id NULLS FIRST, d.size) AS place
  FROM (SELECT drawn.*, coalesce(u / (1 - u) * (1 - p) / nullif(p, 0), u) AS pareto FROM drawn JOIN rests ON drawn.source IS NOT DISTINCT FROM rests.source) d
  JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
  WINDOW earlier AS (PARTITION BY d.source ORDER BY pareto, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS MATERIALIZED (SELECT source, min(place) AS place, arg_min(wanted - before, place) AS room FROM ranked WHERE before + size > wanted GROUP BY source),
filling AS (
  SELECT source, place, place AS first_place, room FROM ends
  UNION ALL
  SELECT f.source, min(r.place), any_value(f.first_place), arg_min(f.room - r.size, r.place)
  FROM filling f JOIN ranked r ON r.source IS NOT DISTINCT FROM f.source AND r.place > f.place AND r.place <= f.first_place + {LOOK} AND r.size <= f.room
  GROUP BY f.source),
last AS (
  SELECT r.source, arg_min(r.place, {{'size': r.size, 'place': r.place}}) AS place
  FROM ranked r JOIN (SELECT source, min(room) AS room, min(first_place) AS first_place FROM filling GROUP BY source) e ON r.source IS NOT DISTINCT FROM e.source
  WHERE r.place BETWEEN e.first_place AND e.first_place + {LOOK} AND r.size < 2 * e.room
    AND NOT EXISTS (SELECT 1 FROM filling f WHERE f.source IS NOT DISTINCT FROM r.source AND f.place = r.place AND f.place > f.first_place)
  GROUP BY r.source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.certain + CASE WHEN r.certain < 3 AND (r.before + r.size <= r.wanted OR f.place IS NOT NULL) THEN 1 ELSE 0 END) * r.size AS taken
FROM ranked r LEFT JOIN (SELECT source, place FROM filling WHERE place > first_place UNION ALL FROM last) f ON r.source IS NOT DISTINCT FROM f.source AND r.place = f.place
"""
