"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in a bounded sample of labelled documents; the matrix of log probabilities (buckets x languages)
is broadcast, and numpy scores many texts at once by gathering its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

ORDERS, BUCKET_BITS = (1, 2, 3), 14
#: The classifier is fitted on about so many documents of each language, those with the smallest hashes of their ids.
TRAIN_DOCS = 2000
#: More languages than this are refused: the broadcast matrix has BUCKETS x languages cells.
MOST_LANGUAGES = 512
SMOOTHING = 0.5
UNKNOWN = "und"
PIECE = 1 << 18


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place (shorter by order - 1 than points)."""
    n = len(points) - order + 1
    mixed = np.full(n, 0x9E3779B97F4A7C15 * order & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(order):
        mixed = (mixed ^ points[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def pieces(points: np.ndarray):
    """Overlapping stretches that together hold each n-gram once, with the number of places at which n-grams may begin."""
    for a in range(0, max(len(points), 1), PIECE):
        yield points[a : a + PIECE + max(ORDERS) - 1], min(PIECE, len(points) - a)


def histogram(text: str) -> np.ndarray:
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for part, starts in pieces(code_points(text)):
        for order in ORDERS:
            if len(part) >= order:
                out += np.bincount(buckets(part, order)[:starts], minlength=1 << BUCKET_BITS)
    return out


def scores(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Summed log probabilities, texts x languages. table: languages x buckets, so that each gather stays in one row."""
    out = np.zeros((len(texts), len(table)))
    held: list[tuple[int, np.ndarray, int]] = []

    def flush():
        if not held:
            return
        owners = np.array([k for k, _, _ in held])
        lengths = np.array([len(p) for _, p, _ in held])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        points = np.concatenate([p for _, p, _ in held])
        for order in ORDERS:
            if len(points) < order:
                continue
            found = buckets(points, order)
            # a piece's n-grams begin at its first `starts` places, and must end within it
            last = np.minimum(begins + np.array([s for _, _, s in held]), np.maximum(ends - order + 1, begins))
            for language in range(len(table)):
                running = np.concatenate([[0.0], np.cumsum(table[language][found], dtype=np.float64)])
                np.add.at(out[:, language], owners, running[np.minimum(last, len(found))] - running[np.minimum(begins, len(found))])
        held.clear()

    total = 0
    for k, text in enumerate(texts):
        for part, starts in pieces(code_points(text)):
            held.append((k, part, starts))
            total += len(part)
            if total >= PIECE:
                flush()
                total = 0
    flush()
    return out


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int = TRAIN_DOCS):
    """(languages, table) from the labelled rows of docs; table is languages x buckets, float32."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["n"] for r in labelled.groupBy(lang_col).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, 1 << BUCKET_BITS), np.float32)
    bound = F.lit(None).cast("double")
    for language in languages:
        bound = F.when(F.col(lang_col) == language, F.lit(min(1.0, train_docs / counts[language]))).otherwise(bound)
    place = (F.xxhash64(F.col(id_col)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    sample = labelled.where(place <= bound).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[language] = sums.get(language, 0) + histogram(text)
        for language, counted in sums.items():
            at = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at, pa.int32()), pa.array(counted[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = np.zeros((len(languages), 1 << BUCKET_BITS))
    grouped = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = grouped.toPandas()  # at most languages x buckets rows
    if len(cells):
        counted[[languages.index(x) for x in cells["lang"]], cells["bucket"]] = cells["n"]
    counted += SMOOTHING
    return languages, np.log(counted / counted.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, lang_pred and score (the posterior of lang_pred under equal priors).

    A null text, or one without a letter, gets `und` and 0. So does every text if no language was learned.
    """
    languages, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(texts):
        known = [bool(languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        names, posts = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [k for k, x in enumerate(known) if x]
        if at:
            logs = scores([texts[k] for k in at], shared.value)
            best = logs.argmax(axis=1)
            odds = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, p in zip(at, best, odds, strict=True):
                names[k], posts[k] = languages[b], float(p)
        return [pa.array(names, pa.string()), pa.array(posts, pa.float64())]

    return common.map_text(docs, id_col, text_col, run, "lang_pred string, score double", keep)


def op8_language_id(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(common.id_crc32("doc_id") % 5 == 0, F.lit(False)))
    model = train(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    return identify(docs, model, keep=("held_out",))
