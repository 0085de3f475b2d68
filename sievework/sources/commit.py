"""Whole folders of files, replaced in two phases.

First a Spark job writes all groups' files into a staging folder that belongs to the job, each attempt of a task under a name
of its own, beside a list of what it wrote. The data source's commit adds one small file that names the attempts that count;
its abort takes the staging folder away. Only then do tasks move the files to their places and delete what isn't expected
there. Both may be done again: after a crash, `recover` ends what was committed and discards what wasn't.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sievework.functions import names
from sievework.operators.iteration import checkpointed
from sievework.sources import tree

STAGING, COMMITTED, LISTED = ".staging-", "committed", "listed.json"
#: Fixed value: the form of numbered outputs.
NUMBERED = r"^\d+\.jpg$"
LISTING = "grp string, name string, staged string"


@dataclass
class Attempt(WriterCommitMessage):
    """What a task tells the driver: its folder, and how many files it wrote."""

    folder: str
    written: int


def plain_name(name: str | None) -> bool:
    """Whether a name can be a file's, right in its folder."""
    return name is not None and re.fullmatch(r"[^/\0]+", name) is not None and not name.startswith(".")


class StagingWriter(DataSourceArrowWriter):
    """Writes rows (grp, name, content) to the staging folder; rows without content, or with no plain name, are left out."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        context = TaskContext.get()
        own = f"{self.folder}/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        os.makedirs(own)
        written = 0
        with open(f"{own}/{LISTED}", "w", encoding="utf-8") as listed:
            for batch in iterator:
                for grp, name, content in zip(*[batch.column(c).to_pylist() for c in ("grp", "name", "content")], strict=True):
                    if content is None or not plain_name(name) or not plain_name(grp):
                        continue
                    staged = f"{own}/{written}"
                    with open(staged, "wb") as out:
                        out.write(content)
                    listed.write(json.dumps({"grp": grp, "name": name, "staged": staged}) + "\n")
                    written += 1
            listed.flush()
            os.fsync(listed.fileno())
        return Attempt(own, written)

    def commit(self, messages: list[Attempt | None]) -> None:
        """One file with a line for each task, in place at once."""
        with open(f"{self.folder}/.{COMMITTED}", "w", encoding="utf-8") as out:
            out.writelines(f"{m.folder}\n" for m in messages if m is not None and m.written)
            out.flush()
            os.fsync(out.fileno())
        os.replace(f"{self.folder}/.{COMMITTED}", f"{self.folder}/{COMMITTED}")

    def abort(self, messages: list[Attempt | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class StagedFiles(DataSource):
    """The sink `staged_files`; option path: a staging folder."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StagingWriter(self.options["path"])


def check(spark: SparkSession, root: str, groups: list[str] | None = None, numbered: bool = False) -> None:
    """Raises ValueError if the root or a group is a link or no folder, or a group holds what such a run doesn't make.

    groups: those to look at (none: all that are there). Nothing is changed. Listings are spread over tasks.
    """
    if not os.path.lexists(root):
        return
    if os.path.islink(root) or not os.path.isdir(root):
        raise ValueError(f"not a folder: {root}")
    with os.scandir(root) as entries:
        odd = [e.path for e in entries if not e.name.startswith(".") and (groups is None or e.name in groups) and (e.is_symlink() or not e.is_dir())]
    if odd:
        raise ValueError(f"not a folder: {min(odd)}")
    every = tree.listing(spark, root, every=True)
    if groups is not None:
        every = every.where(F.col("grp").isin(groups))
    fits = F.col("name").rlike(NUMBERED) if numbered else names.is_image(F.col("name"))
    found = every.where(F.col("is_link") | ~F.col("is_file") | ~fits).select(F.min(F.struct("path", "name")).alias("f")).first()["f"]
    if found:
        raise ValueError(f"{os.path.dirname(found['path'])} holds {found['name']}; nothing was cleared")


def stage(rows: DataFrame, root: str) -> str:
    """Writes and commits rows (grp, name, content) to a new staging folder below root, in one job; the folder."""
    spark = rows.sparkSession
    spark.dataSource.register(StagedFiles)
    folder = f"{os.path.abspath(root)}/{STAGING}{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows.select("grp", "name", "content").write.format("staged_files").mode("append").option("path", folder).save()
    return folder


def moved(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Moves staged files to their places, and tells of each whether it is there now. A place that is a link is left alone."""
    for batch in batches:
        done = []
        for grp, name, staged in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
            place = os.path.join(root, grp, name)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            if not os.path.islink(place) and not os.path.islink(os.path.dirname(place)):
                try:
                    os.replace(staged, place)
                except FileNotFoundError:  # an attempt before this one has moved it
                    pass
            done.append(not os.path.islink(place) and os.path.isfile(place))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["write"] * len(done)), pa.array(done, pa.bool_())], names=["grp", "name", "action", "done"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletes files, and tells of each whether it is gone. Only regular files right in a folder that is no link go."""
    for batch in batches:
        done = []
        for path in batch.column(2).to_pylist():
            safe = not os.path.islink(os.path.dirname(path)) and not os.path.islink(path)
            try:
                if safe and os.path.isfile(path):
                    os.unlink(path)
            except FileNotFoundError:
                pass
            done.append(safe and not os.path.lexists(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["delete"] * len(done)), pa.array(done, pa.bool_())], names=["grp", "name", "action", "done"])


def publish(spark: SparkSession, root: str, folder: str, groups: list[str]) -> tuple[DataFrame, dict]:
    """Moves what a staging folder has committed into root's groups, and deletes what else the groups hold.

    Returns grp, name, action (write or delete) and done for each file, and the numbers written, removed and failed, which
    come from the same jobs. Doing it again, in part or whole, does no harm.
    """
    with open(f"{folder}/{COMMITTED}", encoding="utf-8") as told:
        attempts = [line.rstrip("\n") for line in told]  # a line for each task
    staged = spark.read.schema(LISTING).json([f"{a}/{LISTED}" for a in attempts]) if attempts else spark.createDataFrame([], LISTING)
    out = "grp string, name string, action string, done boolean"
    counts = Observation("written")
    written = checkpointed(staged.mapInArrow(lambda batches: moved(batches, root), out).observe(counts, F.count_if("done").alias("written"), F.count_if(~F.col("done")).alias("failed")))
    there = [g for g in groups if os.path.isdir(os.path.join(root, g))]
    existing = tree.listing(spark, root, every=True).where(F.col("grp").isin(there) & ~F.col("is_link")).select("grp", "name", "path")
    stale = existing.join(written.select("grp", "name"), ["grp", "name"], "left_anti")
    gone = Observation("removed")
    deleted = checkpointed(stale.mapInArrow(removed, out).observe(gone, F.count_if("done").alias("removed"), F.count_if(~F.col("done")).alias("failed")))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    told = {"written": counts.get["written"], "removed": gone.get["removed"], "failed": counts.get["failed"] + gone.get["failed"]}
    return written.unionByName(deleted), told


def remember(folder: str, groups: list[str]) -> None:
    """Keeps with a staging folder which groups it stands for, for recover."""
    with open(f"{folder}/.groups", "w", encoding="utf-8") as out:
        json.dump(groups, out)
    os.replace(f"{folder}/.groups", f"{folder}/groups")


def recover(spark: SparkSession, root: str) -> list[dict]:
    """Ends what earlier runs committed but didn't publish, and discards what they didn't commit; the counts of the former."""
    done = []
    if not os.path.isdir(root):
        return done
    with os.scandir(root) as entries:
        folders = sorted(e.path for e in entries if e.name.startswith(STAGING) and e.is_dir(follow_symlinks=False))
    for folder in folders:
        if os.path.isfile(f"{folder}/{COMMITTED}") and os.path.isfile(f"{folder}/groups"):
            with open(f"{folder}/groups", encoding="utf-8") as told:
                groups = json.load(told)
            done.append(publish(spark, root, folder, groups)[1])
        else:
            shutil.rmtree(folder, ignore_errors=True)
    return done


def replace_folders(rows: DataFrame, root: str, groups: list[str], numbered: bool = False) -> tuple[DataFrame, dict]:
    """Makes root's groups hold the files of rows (grp, name, content) and nothing else; see publish for what is returned.

    groups: all that are concerned, also those that get no file (they are made, and emptied). Names are to be unique in a
    group. ValueError, before anything changes, for a group with foreign content; a failure while files are made leaves
    the groups as they were. One job makes the files of all groups; tasks move and delete them.
    """
    spark = rows.sparkSession
    check(spark, root, groups, numbered)
    os.makedirs(root, exist_ok=True)
    recover(spark, root)
    folder = stage(rows, root)
    remember(folder, groups)
    for grp in groups:
        os.makedirs(os.path.join(root, grp), exist_ok=True)
    return publish(spark, os.path.abspath(root), folder, groups)


def update_files(rows: DataFrame, root: str) -> tuple[DataFrame, dict]:
    """Puts the files of rows (grp, name, content) into root's groups, in the same two phases, and deletes nothing there."""
    spark = rows.sparkSession
    recover(spark, root)
    folder = stage(rows, root)
    remember(folder, [])
    return publish(spark, os.path.abspath(root), folder, [])
