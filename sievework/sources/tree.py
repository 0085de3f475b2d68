"""Trees of picture files as a data source: groups right below a root, and the files right in each group.

`spark.read.format("picture_tree").option("path", root)` lists; what is chosen from the listing is decoded later, each file
once. Folders must be shared by driver and executors. Folders' listings are spread over tasks; the driver lists the groups.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from sievework.functions import names
from sievework.operators.iteration import checkpointed, shared_folder
from sievework.sources import exif

SCHEMA = "grp string, name string, path string, suffix string, length long, modified timestamp, is_file boolean, is_link boolean"
#: Groups are listed in so many tasks at most, and rows handed to Spark in batches of so many.
TASKS, BATCH = 64, 1 << 12


class Groups(InputPartition):
    """Groups that one task lists: name and folder of each."""

    def __init__(self, groups: list[tuple[str, str]]):
        self.groups = groups


def inside(path: str, root: str) -> bool:
    """Whether a path, links resolved, lies in the root, links resolved."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return os.path.commonpath([real, base]) == base


class TreeReader(DataSourceReader):
    """Lists files; conditions on group and suffix keep folders from being listed and files from becoming rows."""

    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.flat = options.get("flat", "false") == "true"
        self.every = options.get("every", "false") == "true"
        self.empty = options.get("empty", "false") == "true"
        self.folders = json.loads(options.get("folders", "null"))
        self.suffixes = tuple(options.get("suffixes", ",".join(names.IMAGE_SUFFIXES)).split(","))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes `=` and `IN` on grp and suffix; the others stay Spark's. Conditions add up."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in ("grp", "suffix"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Groups]:
        """The groups, dealt to tasks. ValueError: the root is a link or no folder, or a group's link leads out of it."""
        if os.path.islink(self.root) or not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        if self.flat:
            groups = [(os.path.basename(self.root), self.root)]
        elif self.folders is not None:
            groups = [(f, os.path.join(self.root, f)) for f in self.folders if os.path.isdir(os.path.join(self.root, f))]
        else:
            with os.scandir(self.root) as entries:
                groups = sorted((e.name, e.path) for e in entries if e.is_dir() and not e.name.startswith("."))
        groups = [g for g in groups if g[0] in self.wanted.get("grp", {g[0]})]
        for name, folder in groups:
            if not inside(folder, self.root):
                raise ValueError(f"group {name} leads out of {self.root}")
        n = min(TASKS, len(groups))
        return [Groups(groups[k::n]) for k in range(n)] or [Groups([])]

    def fits(self, name: str) -> bool:
        dot = name.rfind(".")
        suffix = name[dot:].lower() if 0 < dot < len(name) - 1 else ""
        return (self.every or suffix in self.suffixes) and suffix in self.wanted.get("suffix", {suffix})

    def rows(self, groups: list[tuple[str, str]]) -> Iterator[tuple]:
        for grp, folder in groups:
            found = False
            with os.scandir(folder) as entries:
                for e in entries:
                    if not self.fits(e.name) or not (self.every or e.is_file()):
                        continue
                    found, told = True, e.stat(follow_symlinks=not e.is_symlink() or os.path.exists(e.path))
                    dot = e.name.rfind(".")
                    suffix = e.name[dot:].lower() if 0 < dot < len(e.name) - 1 else ""
                    yield grp, e.name, e.path, suffix, told.st_size, datetime.fromtimestamp(told.st_mtime, UTC), e.is_file(), e.is_symlink()
            if self.empty and not found:
                yield grp, None, folder, None, None, None, False, os.path.islink(folder)

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.string()), ("name", pa.string()), ("path", pa.string()), ("suffix", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_file", pa.bool_()), ("is_link", pa.bool_())])
        batch: list = []
        for row in self.rows(partition.groups):
            batch.append(row)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*batch, strict=True), schema, strict=True)], schema=schema)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*batch, strict=True), schema, strict=True)], schema=schema)


class PictureTree(DataSource):
    """Options: path; suffixes (comma-separated, lower case); flat: the root itself is the only group, as an output folder
    is; folders: a JSON list of folders below the root, at any depth, that are the groups; every: anything in a folder is a row, whatever its suffix and kind; empty: a group without rows is one, without a name."""

    @classmethod
    def name(cls) -> str:
        return "picture_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def listing(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files of a tree (SCHEMA): regular files and links to such, with an option each of PictureTree's."""
    spark.dataSource.register(PictureTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    told = {k: str(v).lower() if isinstance(v, bool) else ",".join(v) if isinstance(v, tuple) else json.dumps(v) if isinstance(v, list) else v for k, v in options.items()}
    return spark.read.format("picture_tree").options(path=root, **told).load()


def staged(rows: DataFrame, folder: str, reads=None) -> DataFrame:
    """path, key and orientation of the files of rows (path), each linked into the folder under its key, a hash of its path.

    reads: an accumulator that counts files opened. A file that is gone, or can't be read, is left out.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                key = hashlib.sha256(path.encode()).hexdigest()
                target, own = f"{folder}/{key}", f"{folder}/.{key}-{uuid.uuid4().hex}"
                try:
                    with open(path, "rb") as file:
                        turn = exif.orientation(file.read())
                    try:
                        os.link(os.path.realpath(path), own)
                    except OSError:  # another file system
                        shutil.copyfile(path, own)
                    os.replace(own, target)
                except OSError:
                    continue
                finally:
                    if os.path.lexists(own):
                        os.unlink(own)
                if reads is not None:
                    reads.add(1)
                found.append((path, key, turn))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())], names=["path", "key", "orientation"])

    return rows.select("path").distinct().mapInArrow(run, "path string, key string, orientation int")


def decoded(rows: DataFrame, reads=None, decodes=None) -> DataFrame:
    """path, width, height, channels and data (RGB or grey, row by row) of the files of rows (path), upright; checkpointed.

    Only these files are read, and each is decoded once, by Spark's own decoder (JPEG, PNG, GIF, BMP), from a folder of
    links to them that goes when all are done. Files that it can't read are left out: see unreadable. reads and decodes:
    accumulators that count files opened for their orientation, and pictures decoded.
    """
    spark = rows.sparkSession
    base = re.sub("^file:/+", "/", shared_folder(spark))
    folder = f"{base}/pictures-{uuid.uuid4().hex}"
    os.makedirs(folder)
    turns = checkpointed(staged(rows, folder, reads))
    found = spark.read.format("image").option("dropInvalid", "true").load(f"file://{folder}")
    flat = found.select(F.regexp_extract("image.origin", "([^/]+)$", 1).alias("key"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if decodes is not None:
                    decodes.add(1)
                picture = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                picture = exif.UPRIGHT[r.orientation](picture if r.channels == 1 else picture[..., 2::-1])
                out.append((r.path, picture.shape[1], picture.shape[0], picture.shape[2], picture.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data"])

    upright = flat.join(turns, "key").select("path", "orientation", "width", "height", "channels", "data")
    out = checkpointed(upright.mapInPandas(run, "path string, width int, height int, channels int, data binary"))
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return out


def unreadable(rows: DataFrame, pictures: DataFrame) -> DataFrame:
    """path of the rows that decoded() left out: WebP, TIFF, broken ones, and those that are gone."""
    return rows.select("path").distinct().join(pictures.select("path"), "path", "left_anti")
