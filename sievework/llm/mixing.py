"""Mixing of sources by a time-varying curriculum.

Each source has a schedule, its weight over training time 0 to 1 as straight lines between knots. The schedule's integral
is the source's weight in the whole mix; the inverse of its running integral tells when the next word of the source is
due. Documents take places on their source's running demand in an order by hash, and are sorted by the time so found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Integrals 5, 2 and 1: an early, a steady and a late schedule, dealt to the sources in turn.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Documents of a source are dealt to hash ranges of about so many rows.
RANGE_ROWS = 512


def integral(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def due(share: Column, knots) -> Column:
    """The time at which the share (0 to 1) of a schedule's whole integral has passed."""
    wanted, out, before = share * F.lit(integral(knots)), F.lit(float(knots[-1][0])), 0.0
    pieces = []
    for a, b in zip(knots, knots[1:], strict=False):
        area = (b[0] - a[0]) * (a[1] + b[1]) / 2
        if area > 0:
            rest, slope = wanted - F.lit(before), (b[1] - a[1]) / (b[0] - a[0])
            root = F.sqrt(F.greatest(F.lit(a[1] ** 2) + F.lit(2 * slope) * rest, F.lit(0.0)))
            pieces.append((before + area, F.when(rest <= 0, F.lit(float(a[0]))).otherwise(F.lit(float(a[0])) + F.lit(2.0) * rest / (F.lit(float(a[1])) + root))))
        before += area
    for until, place in reversed(pieces):
        out = F.when(wanted <= F.lit(until), place).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, kind (the schedule's place) and target of (source, source_size).

    Water filling in closed form: with sources in the order of cap over weight, the level is the largest of (what is left
    after capping all before) over (the weights from there on). The windows run over one row for each source.
    """
    by_name, by_ratio = W.orderBy(F.asc_nulls_last("source")), W.orderBy("ratio", "rank")
    before, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("kind", ((F.col("rank") - 1) % len(schedules)).cast("int"))
        .withColumn("weight", F.element_at(weights, F.col("kind") + 1))
        .withColumn("cap", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("wanted", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / (F.sum("weight").over(every) - F.col("passed")))
        .withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
        .select("source", "source_size", "kind", "target")
    )


def mix(docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: id, size, source, source_size, target, taken, copies, position and second_position.

    Size is the text's number of words (null: 0). A source's documents, in the order of their ids' MD5, are passed over
    once and again until its target is reached (cap at most 2): the one at the end is taken in part. position and
    second_position (0 to 1, null: not taken) are the training times of a document's first and second taking. Null is a
    source of its own, the last by name; sources without words get a target of zero; an empty table gives none. Repeated
    rows are taken each. Rows come range-sorted by position, then id. Texts of any length are counted whole; other
    columns are ignored, whatever their names. Sources are a dimension: their targets are worked out in one task, a row
    for each source.
    """
    rows = common.checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
        )
    )
    ranges = rows.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / RANGE_ROWS).alias("ranges"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("ranges")).cast("int")).drop("of", "ranges")
    place = ["source", "range"]
    parts = rows.groupBy(*place).agg(F.sum("size").alias("part_size"))
    plan = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), schedules, share, cap)
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    parts = parts.join(plan, parts["source"].eqNullSafe(plan["source"])).select(parts["source"], "range", "base", "source_size", "kind", "target")
    within = W.partitionBy(*place).orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("passed", F.coalesce(F.sum("size").over(within), F.lit(0)))
    r, p = rows.alias("r"), parts.alias("p")
    rows = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range"))).select("r.id", "r.source", "size", "source_size", "kind", "target", (F.col("base") + F.col("passed")).alias("start"))
    goal = F.floor("target").cast("long")

    def part(k: int) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - F.col("start") - k * F.col("source_size")))

    def time(k: int) -> Column:
        at = (F.col("start") + k * F.col("source_size")) / F.col("target")
        by_kind = F.lit(None).cast("double")
        for kind, knots in enumerate(schedules):
            by_kind = F.when(F.col("kind") == kind, due(at, knots)).otherwise(by_kind)
        return F.when(part(k) > 0, by_kind)

    return (
        rows.select(
            F.col("id").alias(id_col),
            "size",
            F.col("source").alias("source"),
            F.col("source_size").cast("long").alias("source_size"),
            "target",
            (part(0) + part(1)).alias("taken"),
            ((part(0) > 0).cast("int") + (part(1) > 0).cast("int")).alias("copies"),
            time(0).alias("position"),
            time(1).alias("second_position"),
        )
        .repartitionByRange("position", id_col)  # by id as well, so that documents without a position spread over ranges
        .sortWithinPartitions("position", id_col)
    )


def op10_mix_sources(spark, sf_dir):
    mixed = mix(common.read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"), F.round("second_position", 9).alias("second_position"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, (rank - 1) % 3 AS kind FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, kind, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, floor(t.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, goal - start)) AS a, greatest(0, least(size, goal - start - source_size)) AS b, start / target AS u, (start + source_size) / target AS v FROM p)
SELECT doc_id, size, source_size, target, CAST(a + b AS BIGINT) AS taken, CAST((a > 0)::INT + (b > 0)::INT AS INT) AS copies,
       round(CASE WHEN a > 0 THEN CASE kind WHEN 0 THEN 10 * u / (6 + sqrt(36 - 20 * u)) WHEN 1 THEN u ELSE 2 * u / (0.5 + sqrt(0.25 + 2 * u)) END END, 9) AS position,
       round(CASE WHEN b > 0 THEN CASE kind WHEN 0 THEN 10 * v / (6 + sqrt(36 - 20 * v)) WHEN 1 THEN v ELSE 2 * v / (0.5 + sqrt(0.25 + 2 * v)) END END, 9) AS second_position
FROM q
"""
