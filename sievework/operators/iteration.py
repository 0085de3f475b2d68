"""Lineage cuts for iterative operators, and graphs that are small enough for one task."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Graphs of no more edges than this are solved in one task.
SMALL_GRAPH = 1 << 17
#: What is before all ids.
BEFORE_ALL = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps: the session's spark.checkpoint.dir.

    In local mode, as in tests, a session without one gets a folder of its own; on a cluster that is an error, as executors
    wouldn't share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """df, written to the session's checkpoint folder with a folder for each value of a column of few values."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.repartition(column).write.partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pairs_out(found: list[tuple[int, int]], names: list[str]):
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)


def roots_of(batches):
    """(node, root) of the nodes of all edges that one task gets, but for those that are the least of their component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    yield from pairs_out([(x, r) for x in list(root) if x != (r := find(x))], ["node", "root"])


def leaders_of(batches):
    """(id, leader) of the nodes that follow one, from all edges (a, b), a < b, that one task gets."""
    before: dict[int, list[int]] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before.setdefault(b, []).append(a)
    follows: dict[int, int] = {}
    for b in sorted(before):
        if (first := min((a for a in before[b] if a not in follows), default=None)) is not None:
            follows[b] = first
    yield from pairs_out(list(follows.items()), ["id", "leader"])
