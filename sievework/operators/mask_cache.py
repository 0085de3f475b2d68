"""A cache of subject masks in a shared folder: snapshots of Parquet folders, the later of which win.

`current.json` lists the folders that count, oldest first, and those that the snapshot before listed. A run adds one folder
with what it had to compute; too many are merged into one, with one entry for each key. New folders are written first and
the list is swapped last, in one rename; folders go once neither list names them, so that a reader, who reads the list
once, sees one snapshot throughout. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import augment
from sievework.operators.iteration import checkpointed

SCHEMA = "key string, signature string, w int, h int, mask binary"
#: Goes up when masks are computed in another way.
VERSION = "v1"
#: So many folders are merged into one.
MOST_FOLDERS = 8
LIST = "current.json"


def key() -> Column:
    return F.sha2(F.concat_ws("/", "kind", "relpath"), 256)


def signature(size: Column, modified: Column) -> Column:
    """What an entry's picture must still agree in: its file's size and time."""
    return F.concat_ws("/", F.lit(VERSION), size.cast("string"), F.unix_micros(modified).cast("string"))


def snapshot(spark: SparkSession, folder: str) -> dict:
    """The list: folders that count, oldest first, and those of the snapshot before."""
    try:
        found = spark.read.option("wholetext", "true").text(f"{folder}/{LIST}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    return json.loads(found[0]) if found else {"folders": [], "before": []}


def swap(spark: SparkSession, folder: str, folders: list[str]) -> None:
    """Makes these folders the snapshot, by one rename, and deletes those that neither this one nor the one before names."""
    context = spark.sparkContext
    fs, old = context._jvm.org.apache.hadoop.fs, snapshot(spark, folder)
    place, fresh = fs.Path(f"{folder}/{LIST}"), fs.Path(f"{folder}/.{LIST}-{uuid.uuid4().hex}")
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(fresh)
    out.write(json.dumps({"folders": folders, "before": old["folders"]}).encode())
    out.close()
    overwrite = context._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), context._jsc.hadoopConfiguration()).rename(fresh, place, overwrite)
    for gone in set(old["before"]) - {*folders, *old["folders"]}:
        files.delete(fs.Path(f"{folder}/{gone}"), True)


def entries(spark: SparkSession, folder: str, at: dict | None = None) -> DataFrame:
    """The sound entries (SCHEMA) of a snapshot (none: the current one), of each key the latest; no list means none.

    Files that can't be read are left out.
    """
    folders = (at or snapshot(spark, folder))["folders"]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    found = None
    for k, name in enumerate(folders):
        one = spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(f"{folder}/{name}").where(sound(F.length("mask"))).withColumn("seq", F.lit(k))
        found = one if found is None else found.unionByName(one)
    if len(folders) == 1:
        return found.drop("seq")
    latest = found.groupBy("key").agg(F.max("seq").alias("seq"))  # without the masks
    return found.join(latest, ["key", "seq"], "left_semi").select("key", "signature", "w", "h", "mask")


def add(new: DataFrame, folder: str) -> None:
    """Adds entries (SCHEMA), no two of a key, in a folder of their own; merges all if there are many."""
    spark, name = new.sparkSession, f"masks-{uuid.uuid4().hex}"
    new.write.parquet(f"{folder}/{name}")
    folders = [*snapshot(spark, folder)["folders"], name]
    swap(spark, folder, folders)
    if len(folders) > MOST_FOLDERS:
        compact(spark, folder)


def compact(spark: SparkSession, folder: str) -> None:
    """Merges all folders of the snapshot into one, with one entry for each key."""
    name = f"masks-{uuid.uuid4().hex}"
    entries(spark, folder).write.parquet(f"{folder}/{name}")
    swap(spark, folder, [name])


def sound(cells: Column) -> Column:
    """Whether an entry of so many bytes is a grey mask of its size."""
    return cells == F.col("w").cast("long") * F.col("h")


def hits(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (key, signature, w, h) joined to the sound entries that agree in all four."""
    return wanted.join(known, ["key", "signature", "w", "h"])


def subject_masks(rows: DataFrame, folder: str) -> DataFrame:
    """kind, relpath and mask (row by row; null without a subject) of rows (kind, relpath, signature, shape, picture).

    An entry counts if its signature and size agree. Everything else is computed and added; see add. Rows have
    no two of a kind and relpath; shape is height, width and channels.
    """
    spark = rows.sparkSession
    known = rows.select("kind", "relpath", key().alias("key"), "signature", F.col("shape")[1].alias("w"), F.col("shape")[0].alias("h"))
    held = checkpointed(hits(known, entries(spark, folder)).select("kind", "relpath", "mask"))

    def run(batches):
        for pdf in batches:
            found = []
            for kind, picture, shape in zip(pdf["kind"], pdf["picture"], pdf["shape"], strict=True):
                try:
                    found.append(augment.mask_for(kind, augment.as_rgb(picture, shape)).astype(np.uint8).tobytes())
                except ValueError:  # no subject
                    found.append(None)
            sizes = {"w": [s[1] for s in pdf["shape"]], "h": [s[0] for s in pdf["shape"]]}
            yield pd.DataFrame({"kind": pdf["kind"], "relpath": pdf["relpath"], "signature": pdf["signature"], **sizes, "mask": found})

    missed = rows.join(held.select("kind", "relpath"), ["kind", "relpath"], "left_anti").select("kind", "relpath", "signature", "shape", "picture")
    fresh = checkpointed(missed.repartition("relpath").mapInPandas(run, "kind string, relpath string, signature string, w int, h int, mask binary"))
    new = fresh.where("mask IS NOT NULL").select(key().alias("key"), "signature", "w", "h", "mask")
    if not new.isEmpty():
        add(new, folder)
    return held.unionByName(fresh.select("kind", "relpath", "mask"))
