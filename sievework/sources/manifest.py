"""Scans: asset listings, sampling manifests, exclusion lists and the tables that stand for them in queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import names

ASSET_COLUMNS = ("path", "grp", "name", "suffix", "length", "modified")


def list_assets(spark: SparkSession, root: str, suffixes: tuple[str, ...] = names.IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """Images in the folders right below root: path, grp, name, suffix, length, modified and, if asked for, content.

    Deeper files are left out. Without content, only the listing is read. Order by lower(name), name for a stable rank.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the folder's own name tells where the part below the root begins, whatever scheme the paths have
    below = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    depth = F.size(F.split("path", "/")) - F.size(F.split(F.lit(root.rstrip("/")), "/"))
    rows = found.withColumn("__below", below).withColumn("__base", F.lit(root.rstrip("/").rsplit("/", 1)[-1]))
    inside = rows.where(F.element_at(F.split("path", "/"), -3) == F.col("__base")) if "://" in root or root.startswith("file:") else rows.where(F.element_at(F.split("path", "/"), -3) == F.col("__base")).where(depth >= 2)
    out = inside.select(
        "path",
        F.split("__below", "/")[0].alias("grp"),
        F.split("__below", "/")[1].alias("name"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
        *["content"] * content,
    )
    return out.withColumn("suffix", names.suffix(F.col("name"))).where(names.is_image(F.col("name"), suffixes))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(idx, path, count, raw_type): a manifest's entries, numbered from 1, from a JSON file that may begin with a byte order mark.

    path and count are null where they are of another JSON type; the file is small, a row for each source.
    """
    whole = spark.read.option("wholetext", "true").text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    entries = whole.select(F.posexplode(F.from_json(F.get_json_object("value", "$.sources"), "array<string>")).alias("at", "entry"))
    return parse_entries(entries.select((F.col("at") + 1).cast("long").alias("idx"), "entry"))


def parse_entries(entries: DataFrame) -> DataFrame:
    """(idx, path, count, is_object) of (idx, entry), entry being JSON text. Booleans and fractions are no counts."""
    variant = F.try_parse_json("entry")
    kind = F.schema_of_variant(variant)
    count_kind = F.schema_of_variant(F.try_variant_get(variant, "$.count", "variant"))
    path_kind = F.schema_of_variant(F.try_variant_get(variant, "$.path", "variant"))
    return entries.select(
        "idx",
        F.when(path_kind == "STRING", F.try_variant_get(variant, "$.path", "string")).alias("path"),
        F.when(count_kind == "BIGINT", F.try_variant_get(variant, "$.count", "bigint")).alias("count"),
        F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"),
    )


def clean_path(path: Column) -> Column:
    """The path without `.` and empty parts; the query's own escape rule looks at `..`."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != ".")), "/")


def manifest_errors(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """(idx, path, error) of entries (idx, path, count, is_object) that break a rule, against folders (path, available).

    folders may tell where links lead: real, the folder that a path stands for, and inside, whether that is below the root.
    Rules are tried in this order, and the first broken one is told: not an object, path missing or blank, count not a
    positive integer, absolute path, path outside the root, no such folder, folder named before (without regard to
    case), more wanted than available.
    """
    clean = clean_path(F.col("path"))
    real = F.col("real") if "real" in folders.columns else F.lit(None).cast("string")
    within = F.col("inside") if "inside" in folders.columns else F.lit(True)
    told = folders.select(F.col("path").alias("clean"), "available", real.alias("real"), within.alias("within"))
    known = entries.withColumn("clean", clean).join(told, "clean", "left")
    earlier = F.row_number().over(W.partitionBy(F.lower(F.coalesce("real", "clean"))).orderBy("idx")) > 1
    rules = [
        (~F.col("is_object"), "not_object"),
        (F.col("path").isNull() | (F.trim("path") == ""), "bad_path"),
        (F.col("count").isNull() | (F.col("count") < 1), "bad_count"),
        (F.col("path").startswith("/"), "absolute"),
        (F.array_contains(F.split("clean", "/"), "..") | ~F.coalesce("within", F.lit(True)), "outside"),
        (F.col("available").isNull(), "no_folder"),
        (earlier, "repeated"),
        (F.col("count") > F.col("available"), "too_few"),
    ]
    error = F.lit(None).cast("string")
    for broken, code in reversed(rules):
        error = F.when(broken, code).otherwise(error)
    return known.select("idx", "path", error.alias("error")).where("error IS NOT NULL")


def first_manifest_error(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """The one error that a run would stop at."""
    return manifest_errors(entries, folders).groupBy().agg(F.min(F.struct("idx", "error", "path")).alias("e")).where("e IS NOT NULL").select("e.*")


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """The distinct paths of an exclusion list: blank lines and comments dropped, backslashes turned."""
    return parse_exclusions(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_exclusions(lines: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("line", r"[\r\t]", " "))
    return lines.select(F.translate(text, "\\", "/").alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()


#: Stand-ins for file suffixes in queries over tables: images in either case, and two that aren't.
SUFFIX_CYCLE = (".jpg", ".PNG", ".webp", ".txt", ".JPeG", ".gif", ".tar.gz", ".bmp")


def asset_view(documents: DataFrame) -> DataFrame:
    """documents as assets: doc_id, grp, name, relpath, w, h."""
    ending = F.element_at(F.array(*[F.lit(x) for x in SUFFIX_CYCLE]), (F.col("doc_id") % len(SUFFIX_CYCLE) + 1).cast("int"))
    name = F.concat(F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), ending)
    return documents.select(
        "doc_id",
        F.col("source").alias("grp"),
        name.alias("name"),
        F.concat(F.col("source"), F.lit("/"), name).alias("relpath"),
        (F.lit(100) + F.col("n_chars") % 400).alias("w"),
        (F.lit(100) + F.expr("n_chars div 7") % 400).alias("h"),
    )


ASSETS_SQL = """assets AS (
  SELECT doc_id, source AS grp, nm AS name, source || '/' || nm AS relpath, 100 + n_chars % 400 AS w, 100 + (n_chars // 7) % 400 AS h
  FROM (SELECT *, lang || '_' || doc_id || (['.jpg', '.PNG', '.webp', '.txt', '.JPeG', '.gif', '.tar.gz', '.bmp'])[doc_id % 8 + 1] AS nm FROM documents))"""
IMAGES_SQL = ASSETS_SQL + """, images AS (SELECT * FROM assets WHERE lower(regexp_extract(name, '^.+([.][^.]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.gif', '.tif', '.tiff'))"""
