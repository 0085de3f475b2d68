"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.operators.iteration import checkpointed, shared_folder

__all__ = ["batches_of", "checkpointed", "delete_folder", "id_crc32", "map_text", "only_ids", "read", "shared_folder", "slices", "stored", "with_names_back", "with_plain_names"]

#: Python workers handle about so many characters at once, whatever the size of an Arrow batch.
SLICE_CHARS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc32(id_col: str) -> Column:
    """CRC-32 of the id's decimal text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def slices(values: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of values with about limit characters each; a longer value is a run of its own."""
    start = total = 0
    for k, value in enumerate(values):
        if total and total + len(value) > limit:
            yield start, k
            start, total = k, 0
        total += len(value)
    if start < len(values):
        yield start, len(values)


def map_text(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list[str | None]], Iterable], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row of fn's columns for each row of df, after its id and the columns named in keep.

    fn takes a list of texts (with nulls) and returns one pyarrow array for each column of schema (DDL, without the kept ones).
    """
    kept = [id_col, *keep]
    frame = df.select(*kept, F.col(text_col).alias("__sievework_text"))
    out = frame.select(*kept).schema
    names = StructType.fromDDL(schema).names
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a, b in slices([t or "" for t in texts]):
                arrays = [batch.column(k).slice(a, b - a) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*arrays, *fn(texts[a:b])], names=[*kept, *names])

    return frame.mapInArrow(run, ddl)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most, in jobs that end within; the session's own setting then holds again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet in the shared folder (smaller than a checkpoint), and the folder that it was written to."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """df without most of the rows whose id isn't among ids (one column of longs), by a broadcast bitmap of so many bits.

    Saves dealing out rows that an inner join would drop; of many more ids than bits it would keep all.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("long")
    held = ids.toDF("id").select(place("id").alias("at"))
    held = held.select(F.bitmap_bucket_number("at").alias("__bucket"), F.bitmap_bit_position("at").alias("bit"))
    held = held.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bitmap"))
    at = F.bitmap_bit_position(place(id_col))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = df.join(F.broadcast(held), F.bitmap_bucket_number(place(id_col)) == F.col("__bucket"))
    return rows.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*[df[c] for c in df.columns])


def delete_folder(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def with_plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns renamed by their place, and the new name of each: nothing that an operator adds can clash."""
    names = {c: f"__d{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def with_names_back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])
