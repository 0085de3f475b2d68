"""Audit of how quality filters interact: what each removes, in every order in which they could be applied.

Documents shrink to a cube: how many of each part fail exactly which filters. All else is arithmetic on its cells. Orders are
visited by swaps of two neighbours (Steinhaus, Johnson and Trotter), so that one order differs from the next in two steps;
only these are worked out anew, and the sums for Shapley values grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: The least words, the least per cent of distinct words, the most per cent of capitals, and signs of markup.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKUP = 200, 50, 3, r"[#$%&*|]"
FILTERS = "ABCDE"
#: What is counted of each cell: documents, those labelled good and those labelled toxic.
MEASURES = ("n", "good", "toxic")
#: Parts whose rows are made at once.
PARTS = 64


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text (not null), given its words, fails A, B, C and D."""
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(MARKUP),
    ]


def failure_cube(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bit k: fails filter k of FILTERS) and the MEASURES of documents, for the cells that aren't empty.

    A null text is an empty one, and a null part the empty string. E fails where a smaller id has the same text (by its
    MD5): rows of the smallest id don't fail it, and neither do rows without an id, which no label names. Repeated rows
    count each. A document is good (quality = 1) or toxic (toxic = 1) if any of its labels says so. Texts of any length
    are judged whole. Other columns are ignored, whatever their names; an empty table gives no cells.

    Each text is read once, for 16 bytes of digest and its mask. Repeated rows meet before they are shuffled, and both
    sides of the joins come straight from files, so that Spark can split hot keys: copies are joined by text and id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    judged = judged.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    failed = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col("text"), F.col("words")))]
    slim = judged.select("id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), reduce(Column.__add__, failed).alias("mask"))
    rows, folder = common.stored(slim.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit")
    firsts, folder_2 = common.stored(rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")), "audit-firsts")
    told = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told, folder_3 = common.stored(told.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic")), "audit-labels")
    marked = rows.join(firsts.withColumn("first", F.lit(True)), ["digest", "id"], "left").join(told, "id", "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in MEASURES[1:]]]
    cube = common.checkpointed(marked.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(*sums))  # 32 rows a part at most
    for made in (folder, folder_2, folder_3):
        common.delete_folder(spark, made)
    return cube


def swaps(n: int) -> Iterator[int]:
    """The places k of neighbours k and k + 1 to swap, one after another, so that each order of n things comes up once."""
    if n < 2:
        return
    # the last thing wanders from end to end; between its walks, the others take one swap of their own order
    down, inner = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + down
        down = not down


def walk(cells: np.ndarray, names: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters; what each step does in each; and each filter's Shapley sum.

    cells: part, mask, measure. Steps come as part, order, step, and kept, removed, redundant, unique_fails, good_lost,
    toxic_lost; sums as part, filter, over what it removes in all orders.
    """
    n, masks = len(names), np.arange(1 << len(names))
    fails = [masks >> f & 1 == 1 for f in range(n)]

    def step(f: int, before: int) -> np.ndarray:
        live = masks & before == 0
        gone = cells[:, live & fails[f]].sum(axis=1)
        kept, failing, only = cells[:, live & ~fails[f], 0].sum(axis=1), cells[:, fails[f], 0].sum(axis=1), cells[:, 1 << f, 0]
        return np.stack([kept, gone[:, 0], failing - gone[:, 0], only, gone[:, 1], gone[:, 2]], axis=1)

    order = list(range(n))
    now = np.stack([step(f, (1 << f) - 1) for f in order], axis=1)
    orders, steps, shapley = ["".join(names[f] for f in order)], [now.copy()], np.zeros((len(cells), n), np.int64)
    shapley[:, order] += now[:, :, 1]
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        now[:, k], now[:, k + 1] = step(order[k], before), step(order[k + 1], before | 1 << order[k])
        shapley[:, order] += now[:, :, 1]
        orders.append("".join(names[f] for f in order))
        steps.append(now.copy())
    return orders, np.stack(steps, axis=1), shapley


def audit(cube: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order of filters and step, from the cells of failure_cube; see walk for the columns.

    Cells that aren't there count zero; a mask that isn't there in any cell makes no difference, and no cells give no rows.
    Parts are dealt over tasks; a part is 2 ** len(names) cells, whatever the number of its documents.
    """
    cells = cube.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    measured = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                parts, listed = (c.slice(at, PARTS).to_pylist() for c in batch.columns)
                table = np.zeros((len(parts), 1 << len(names), len(MEASURES)), np.int64)
                for k, own in enumerate(listed):
                    for cell in own:
                        table[k, cell["mask"]] += [cell[m] for m in MEASURES]
                orders, steps, shapley = walk(table, names)
                each = len(orders) * len(names)
                filters = np.array([[names.index(x) for x in order] for order in orders])
                columns = [
                    pa.array(np.repeat(np.array(parts, object), each), pa.string()),
                    pa.array(np.tile(np.repeat(np.array(orders, object), len(names)), len(parts)), pa.string()),
                    pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(parts) * len(orders))),
                    *[pa.array(np.ascontiguousarray(steps[..., m]).ravel()) for m in range(len(measured))],
                    pa.array(shapley[:, filters].ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *measured, "shapley"])

    longs = ", ".join(f"{m} long" for m in (*measured, "shapley"))
    return cells.mapInArrow(run, f"part string, filter_order string, step int, {longs}")


def op12_filter_audit(spark, sf_dir):
    return audit(failure_cube(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
  + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(k)),
p AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM p
"""
