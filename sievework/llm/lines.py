"""Removal of repeated lines, found by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

WIDTH = 3


def row_key(id_col: str, text_col: str):
    """What tells a document from others: its id and a hash of its text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """key, at (the first line's place, from 0) and two 64-bit hashes of each window that isn't blank."""
    lines = F.transform(F.split(text_col, "\n", -1), F.trim)

    def hashes(k):
        part = F.slice("lines", k + 1, F.lit(width))
        return F.struct(k.alias("at"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("second"), F.reverse(part)).alias("h2"), (F.array_join(part, "") == "").alias("blank"))

    rows = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), lines.alias("lines")).where(F.size("lines") >= width)
    found = rows.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - width), hashes)).alias("w"))
    return found.where(~F.col("w.blank")).select("key", "w.at", "w.h1", "w.h2")


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """key and the places (places) of windows that occur before, by (id, hash of text, place), in any document."""
    every = windows(docs, id_col, text_col, width)
    first = every.groupBy("h1", "h2").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = every.join(first, ["h1", "h2"]).where(F.struct("key", "at") != F.col("first"))
    return later.groupBy("key").agg(F.collect_set("at").alias("places"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with repeated lines taken out of the text, and the columns __n_lines and __removed (places of the lines).

    A line goes if a window over it occurs before, in the same document or in one that comes earlier by id. Its first
    occurrence stays, so no line is lost from the whole. Lines are compared without spaces at their ends; blank windows
    don't count. Texts of fewer lines than the width, empty and null ones stay as they are; a text whose lines all go
    becomes empty. Rows with equal ids and texts are one document and get equal results. Other columns pass through,
    whatever their names (but for __n_lines and __removed, which this adds).
    """
    columns = docs.columns
    docs, names = common.with_plain_names(docs)
    id_col, text_col = names[id_col], names[text_col]
    later = repeated_windows(docs, id_col, text_col, width).withColumnRenamed("key", "__key")
    rows = docs.withColumn("__row", row_key(id_col, text_col))
    joined = rows.join(later, F.col("__row").eqNullSafe(F.col("__key")), "left")
    lines = F.split(text_col, "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + width - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    text = F.array_join(F.flatten(F.transform(F.array(lines), lambda all_lines: F.transform(kept, lambda k: F.element_at(all_lines, k + 1)))), "\n")
    marked = joined.withColumn("__removed", F.when(F.col("places").isNull(), F.array().cast("array<int>")).otherwise(F.array_sort(covered)))
    return marked.select(
        *[(F.when(F.size("__removed") == 0, F.col(names[c])).otherwise(text) if names[c] == text_col else F.col(names[c])).alias(c) for c in columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("__n_lines"),
        "__removed",
    )


def op4_line_dedup(spark, sf_dir):
    done = drop_repeated_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("n_lines"),
        F.size("__removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("__removed", lambda x: x.cast("string")), ",").alias("removed"),
        F.col("text").alias("kept_text"),
    )


OP4_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, pos, trim(line) AS a, lead(trim(line), 1) OVER d AS b, lead(trim(line), 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE c IS NOT NULL AND a || b || c <> ''),
x AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
g AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed, coalesce(string_agg(x.pos::VARCHAR, ',' ORDER BY l.pos) FILTER (WHERE x.pos IS NOT NULL), '') AS removed,
             coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS kept_text
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, kept_text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
