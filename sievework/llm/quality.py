"""Document quality by a linear-chain conditional random field over lines.

Each line is good (1) or bad (0). Unary scores see the line's own features and those of the lines before and after it;
transitions tie neighbouring labels. Forward-backward gives each line's probability of being good, and a document's score
is their mean weighted by length. Recursions run in log odds, in numpy, over all documents of a batch at once.

Only whole documents are labelled. So that the field sees labels change, it is also fitted on documents into which lines
of a document of the other label are spliced, and then once more with the lines of bad documents, all but the worst of
each, labelled as the first fit judges them: a bad document may hold good lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

#: The field is fitted on about so many labelled documents, those with the smallest hashes of their ids, of at most so many lines.
TRAIN_DOCS, TRAIN_LINES = 3000, 200
STEPS, RATE, RIDGE = 120, 0.1, 1e-4
THRESHOLD = 0.7
SYMBOLS = "#$%&*@^~<>{}[]\\|/=+_"
FEATURES, AS_BEFORE = 14, 12
#: Splices: so many copies of each training document, with up to so many lines of another.
SPLICES, SPLICED_LINES, SEED = 1, 4, 17


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [lines, FEATURES], lines' lengths, number of lines of each text). A text has a line more than line feeds."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    feeds = np.flatnonzero(points == 10)
    begins = np.concatenate([[0], feeds[:-1] + 1])
    lengths = feeds - begins
    counts = np.array([t.count("\n") + 1 for t in texts])

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, begins, dtype=np.int64).astype(float)

    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE))
    lower = ((points >= 97) & (points <= 122)) | ((points > 0xDE) & (points < 0x2000)) | (points >= 0x3000)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    small = np.minimum(points, 128)
    symbol_table = np.zeros(129, bool)
    symbol_table[[ord(c) for c in SYMBOLS]] = True
    n = np.maximum(lengths, 1)
    letters = np.maximum(per_line(upper | lower), 1)

    # words: hashed by a polynomial over their characters, taken from running sums
    inner = ~space
    first = np.flatnonzero(inner & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(inner & np.concatenate([space[1:], [True]])) + 1
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(len(points), base, np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(7)) * powers)])
        back = np.uint64(pow(int(base), -1, 1 << 64))
        inverse = np.cumprod(np.full(len(points), back, np.uint64))
        words = (running[last] - running[first]) * inverse[first]
    of_line = np.searchsorted(feeds, first)
    n_words = np.bincount(of_line, minlength=len(feeds)).astype(float)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of_line[1:] == of_line[:-1])
    repeats = np.bincount(of_line, weights=same, minlength=len(feeds))
    full = np.zeros(len(feeds), np.uint64)
    np.add.at(full, of_line, words)
    as_before = np.zeros(len(feeds))
    as_before[1:] = (full[1:] == full[:-1]) & (lengths[1:] > 0)
    starts = np.cumsum(counts) - counts
    as_before[starts] = 0

    symbols, bangs, pipes = per_line(symbol_table[small]) / n, per_line(points == 33) / n, per_line(points == 124) / n
    uppers, repeated = per_line(upper) / letters, repeats / np.maximum(n_words - 1, 1)
    final = points[np.maximum(feeds - 1, 0)]
    columns = [
        np.log1p(lengths) / 5,
        (n_words > 1) * 1.0,
        np.isin(final, [33, 46, 63]) * (lengths > 0),
        per_line((points >= 48) & (points <= 57)) / n,
        np.minimum(1, 10 * symbols),
        np.minimum(1, 10 * bangs),
        np.minimum(1, 10 * pipes),
        np.minimum(1, 2 * uppers),
        repeated,
        (symbols > 0.05) * 1.0,
        (uppers > 0.6) * 1.0,
        (repeated > 0.25) * 1.0,
        as_before,
        np.ones(len(feeds)),
    ]
    return np.stack(columns, axis=1).astype(np.float32), lengths, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, then the line's before it and after it in the same text (zeros at the ends)."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - counts], after[ends - 1] = 0, 0
    return np.concatenate([own, before, after], axis=1)


def chain(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) log odds of each line; moves[i, j] scores label j after label i. Forward holds the line's own unary."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, sorted_counts = starts[order], counts[order]
    forward, backward = unary.astype(float), np.zeros(len(unary))
    longest = int(sorted_counts[0]) if len(counts) else 0
    active = np.searchsorted(-sorted_counts, -np.arange(1, longest + 1), side="right")  # texts of more than t lines
    for t in range(1, longest):
        at = starts[: active[t]] + t
        a = forward[at - 1]
        forward[at] = unary[at] + np.logaddexp(moves[0, 1], a + moves[1, 1]) - np.logaddexp(moves[0, 0], a + moves[1, 0])
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        v = unary[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(moves[1, 0], v + moves[1, 1]) - np.logaddexp(moves[0, 0], v + moves[0, 1])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def spliced(parts: list[np.ndarray], labels: list[int], line_labels: list[np.ndarray], splices: int = SPLICES) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(features, line labels) of the documents and of copies that hold a run of lines of a document of the other label."""
    rng = np.random.default_rng(SEED)
    features, lines = list(parts), list(line_labels)
    of_label = [[k for k, y in enumerate(labels) if y == want] for want in (0, 1)]
    for _ in range(splices):
        for part, y, own in zip(parts, labels, line_labels, strict=True):
            if not of_label[1 - y]:
                continue
            chosen = of_label[1 - y][rng.integers(len(of_label[1 - y]))]
            other = parts[chosen]
            n = min(int(rng.integers(1, SPLICED_LINES + 1)), len(other))
            a, at = int(rng.integers(len(other) - n + 1)), int(rng.integers(len(part) + 1))
            whole = np.concatenate([part[:at], other[a : a + n], part[at:]])
            for edge in (at, at + n):
                if edge < len(whole):
                    whole[edge, AS_BEFORE] = 0
            features.append(whole)
            lines.append(np.concatenate([own[:at], line_labels[chosen][a : a + n], own[at:]]))
    return features, lines


def fit(own: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) by Adam on the penalised conditional likelihood of the lines' labels."""
    x, y = with_neighbours(own, counts).astype(float), labels.astype(float)
    ends = np.cumsum(counts)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    here = np.flatnonzero(inner)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    seen = np.array([np.sum((y[here] == i) & (y[here + 1] == j)) for i in (0, 1) for j in (0, 1)], float)
    for step in range(1, STEPS + 1):
        moves = theta[-4:].reshape(2, 2)
        unary = x @ theta[:-4]
        forward, backward = chain(unary, counts, moves)
        after = unary[here + 1] + backward[here + 1]
        cells = np.stack([moves[0, 0] + 0 * after, moves[0, 1] + after, forward[here] + moves[1, 0], forward[here] + moves[1, 1] + after])
        cells = np.exp(cells - cells.max(axis=0)) if len(here) else cells
        expected = (cells / cells.sum(axis=0)).sum(axis=1) if len(here) else np.zeros(4)
        slope = np.concatenate([x.T @ (y - sigmoid(forward + backward)), seen - expected]) / len(y) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_spliced(parts: list[np.ndarray], labels: list[int], line_labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    features, lines = spliced(parts, labels, line_labels)
    return fit(np.concatenate(features), np.array([len(p) for p in features]), np.concatenate(lines))


def line_chances(own: np.ndarray, counts: np.ndarray, model) -> np.ndarray:
    """Each line's probability of being good."""
    weights, moves = model
    return sigmoid(np.add(*chain(with_neighbours(own, counts) @ weights, counts, moves)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS):
    """The field's (weights, moves), from documents with a label of 0 or 1; without any, weights that give 1/2."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    total = known.count()
    place = (F.xxhash64("__id").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    chosen = known.where(place <= min(1.0, train_docs / max(total, 1)))  # about train_docs rows: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").select("label", "text")

    def run(batches):
        for batch in batches:
            kept = [(y, t) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and t.count("\n") < TRAIN_LINES]
            for a, b in common.slices([t for _, t in kept]):
                own, _, counts = line_features([t for _, t in kept[a:b]])
                parts = np.split(own, np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in kept[a:b]], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "lines"])

    got = sorted(((r["label"], bytes(r["lines"])) for r in rows.mapInArrow(run, "label int, lines binary").collect()))
    if not got:
        return np.zeros(3 * FEATURES), np.zeros((2, 2))
    parts, known = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x in got], [y for y, _ in got]
    lines = [np.full(len(p), y) for p, y in zip(parts, known, strict=True)]
    model = fit_spliced(parts, known, lines)
    counts = np.array([len(p) for p in parts])
    good = np.split(line_chances(np.concatenate(parts), counts, model), np.cumsum(counts)[:-1])
    lines = [own if y else ((x > 0.5) & (x > x.min())).astype(int) for own, y, x in zip(lines, known, good, strict=True)]
    return fit_spliced(parts, known, lines)


def assess(texts: list[str], model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, probability of each line, number of lines of each text)."""
    own, lengths, counts = line_features(texts)
    good = line_chances(own, counts, model)
    heavy, at = np.maximum(lengths, 1), np.cumsum(counts) - counts
    return np.add.reduceat(good * heavy, at) / np.add.reduceat(heavy, at), good, counts


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """id, the columns of keep, score, predicted and, with lines, bad_lines: the places (from 0) of lines labelled bad.

    A null text counts as empty; an empty one is a single empty line. Repeated rows are scored each, and equal texts get
    equal scores. A text is scored whole, in memory of some 40 bytes for each of its characters. Other columns are ignored,
    whatever their names; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        score, good, counts = assess([t or "" for t in texts], shared.value)
        out = [pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
        if lines:
            out.append(pa.array([np.flatnonzero(x < 0.5).tolist() for x in np.split(good, np.cumsum(counts)[:-1])], pa.list_(pa.int32())))
        return out

    return common.map_text(docs, id_col, text_col, run, "score double, predicted int" + ", bad_lines array<int>" * lines, keep)


def op2_quality_classifier(spark, sf_dir):
    held = F.coalesce(common.id_crc32("doc_id") % 4 == 2, F.lit(False))
    docs = common.read(spark, sf_dir, "documents").withColumn("held_out", held)
    model = train(docs.where(~F.col("held_out")), common.read(spark, sf_dir, "labels").where(~held))
    return score_quality(docs, model, keep=("held_out",))
