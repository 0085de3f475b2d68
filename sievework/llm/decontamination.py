"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to k edits. Of its k + 1 pieces at least one then occurs unchanged, so an Aho-Corasick
automaton over all pieces finds every place worth a look, and Myers' bit-parallel distance decides there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

#: Edits allowed for each character of an item. Pieces have about 1 / rate characters; shorter ones are hit by chance too often.
ERROR_RATE = 0.06
#: Items are broadcast in blocks of about so many characters, a pass over the documents each.
BLOCK_CHARS = 1 << 22
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"
MATCH = "array<struct<item_id:{kind},distance:int,start:int,end:int>>"


def normalized(text: Column) -> Column:
    """Lower-case words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def cut(pattern: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of about equal length."""
    bounds = [len(pattern) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, pattern[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def best_end(pattern_masks: dict[str, int], m: int, text: str, start: int, end: int) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a part of text[start:end], and the first end with it."""
    top, full = 1 << m - 1, (1 << m) - 1
    plus, minus, score = full, 0, m
    best, at = m, start
    get = pattern_masks.get
    for k in range(start, end):
        eq = get(text[k], 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(eq | plus), plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, k + 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
    return best, at


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, pattern in items:
            errors = int(len(pattern) * rate)
            if pattern:
                for offset, piece in cut(pattern, errors):
                    pieces.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((key, pattern, errors, masks(pattern)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item's key, distance, start, end) of the best occurrence of each item within its budget; start is approximate by the budget."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for item, offset in uses:
                starts.setdefault(item, set()).add(last + 1 - size - offset)
        out = []
        for item, places in starts.items():
            key, pattern, errors, pattern_masks = self.items[item]
            m, best = len(pattern), None
            runs: list[list[int]] = []
            for place in sorted(places):
                low, high = max(0, place - errors), min(len(text), place + m + errors)
                if high - low < m - errors:
                    continue
                if runs and low <= runs[-1][1]:
                    runs[-1][1] = high
                else:
                    runs.append([low, high])
            for low, high in runs:
                distance, end = best_end(pattern_masks, m, text, low, high)
                if distance <= errors and (best is None or distance < best[1]):
                    best = (key, distance, max(0, end - m), end)
            if best:
                out.append(best)
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS):
    """Lists of (id, normalised text), about block_chars characters each; null and wordless texts are left out, null ids aren't."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), normalized(F.col(text_col)).alias("t"))
    blocks = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        yield sorted(((r["k"], r["t"]) for r in rows.where("t <> ''").collect()), key=lambda x: (x[0] is None, *x[x[0] is None :]))


def id_kind(benchmark: DataFrame, item_col: str) -> str:
    return "string" if dict(benchmark.dtypes)[item_col] == "string" else "bigint"


def match_block(docs: DataFrame, items: list[tuple], kind: str, id_col: str, text_col: str, keep: tuple[str, ...], rate: float) -> DataFrame:
    """id, the columns of keep and matches, for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    state: dict = {}
    field = pa.list_(pa.struct([("item_id", pa.string() if kind == "string" else pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts):
        if "matcher" not in state:
            state["matcher"] = Matcher(shared.value, rate)
        found = [[dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in state["matcher"].find(t)] if t else [] for t in texts]
        return [pa.array(found, field)]

    rows = docs.select(id_col, *keep, normalized(F.col(text_col)).alias("__sievework_normal"))
    return common.map_text(rows, id_col, "__sievework_normal", run, f"matches {MATCH.format(kind=kind)}", keep)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, item_id, distance, start, end (in the normalised text): one row for each document and item that it holds.

    Null and empty texts and items match nothing; repeated rows match each. Items with equal texts are found each. Texts
    of any length are searched whole; an empty benchmark gives no rows. Other columns are ignored, whatever their names.
    """
    kind = id_kind(benchmark, item_col)
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        found = match_block(docs, items, kind, id_col, text_col, (), rate).select(id_col, F.explode("matches").alias("m")).select(id_col, "m.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.where("false").select(id_col, F.lit(None).cast(kind).alias("item_id"), *[F.lit(0).alias(c) for c in ("distance", "start", "end")])
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the documents that hold an item; columns as before, whatever their names.

    Null and empty texts stay, and so does everything where the benchmark is empty; repeated rows go or stay together.
    Texts of any length are searched whole.
    """
    rows, names = common.with_plain_names(docs)
    kept = tuple(n for c, n in names.items() if c != id_col)
    for items in item_blocks(benchmark, item_col, item_text_col, block_chars):
        marked = match_block(rows, items, id_kind(benchmark, item_col), names[id_col], names[text_col], kept, rate)
        rows = marked.where(F.size("matches") == 0).select(*names.values())
    return common.with_names_back(rows, names)


def op3_decontamination(spark, sf_dir):
    return find_contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
