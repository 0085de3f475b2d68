"""Queries of the augmentation path over rasters made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import augment
from sievework.plans.assets import images, read
from sievework.plans.duplicates import RASTER_SQL, folded, rasters
from sievework.sources.manifest import IMAGES_SQL


def saturation_flood_mask(spark, sf_dir):
    """Size and bounding box of each raster's subject: what the exterior, grown from the border, doesn't reach."""
    return augment.mask_summary(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pixels")), folded)


def seeded_params(spark, sf_dir):
    """Augmentation parameters of each image in SQL mode: uniform draws by hash."""
    return augment.drawn(images(spark, sf_dir).select("doc_id", "relpath"))


def augment_transform(spark, sf_dir):
    """Digest of each augmented raster on a white canvas, seeded by its path."""
    rows = rasters(spark, sf_dir).join(images(spark, sf_dir).select("doc_id", "relpath"), "doc_id")
    return augment.augmented(rows.withColumn("background", F.lit(None).cast("binary")))


def augment_composite(spark, sf_dir):
    """Digest of each raster pasted on the raster of the document before; where there is none, on white."""
    rows = rasters(spark, sf_dir).join(images(spark, sf_dir).select("doc_id", "relpath"), "doc_id")
    scenes = rasters(spark, sf_dir).select((F.col("doc_id") + 1).alias("doc_id"), F.col("pixels").alias("background"))
    return augment.augmented(rows.join(scenes, "doc_id", "left"))


QUERIES = {f.__name__: f for f in (saturation_flood_mask, seeded_params, augment_transform, augment_composite)}
#: The exterior by recursion: border cells that are open, then their open neighbours.
MASK_SQL = f"""WITH RECURSIVE {RASTER_SQL}, cells AS (SELECT doc_id, x, y, g <= 55 AS open FROM px),
outer_cells AS (SELECT doc_id, x, y FROM cells WHERE open AND (x IN (0, 31) OR y IN (0, 31))
  UNION SELECT c.doc_id, c.x, c.y FROM outer_cells o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy), cells c WHERE c.doc_id = o.doc_id AND c.x = o.x + dx AND c.y = o.y + dy AND c.open)
SELECT c.doc_id, count(*) FILTER (o.x IS NULL) AS subject, coalesce(min(c.x) FILTER (o.x IS NULL), -1) AS x0, coalesce(min(c.y) FILTER (o.x IS NULL), -1) AS y0,
  coalesce(max(c.x) FILTER (o.x IS NULL), -1) AS x1, coalesce(max(c.y) FILTER (o.x IS NULL), -1) AS y1
FROM cells c LEFT JOIN outer_cells o ON c.doc_id = o.doc_id AND c.x = o.x AND c.y = o.y GROUP BY c.doc_id"""
ORACLES = {"seeded_params": augment.drawn_sql(IMAGES_SQL), "saturation_flood_mask": MASK_SQL}
