"""Secret scanning with built-in functions only.

Three kinds of secrets have fixed patterns; two more, long runs of base64 or of hexadecimal characters, count where a
sliding window's Shannon entropy is high. A window's counts are a string with a character for each symbol of the class:
when the window moves, one count falls and one rises, and the sum of n log2 n changes by the two differences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

#: Kinds in the order in which ties are listed, with pattern, the group that is measured and its least length.
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)  # whole runs match, so the least lengths of the last two may stand in the patterns; one of assign's may not, as short matches use up text
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 24
#: Entropy kinds: name, characters, candidate pattern, least bits a character of a window (case of hexadecimal digits counts).
ENTROPY_KINDS = (
    ("base64_entropy", DIGITS + LOWER + UPPER + "+/_-=", r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW, 4.02),
    ("hex_entropy", DIGITS + "abcdefABCDEF", r"[0-9A-Fa-f]{%d,}" % WINDOW, 3.02),
)
#: Candidates that match one of these are known to be harmless: words joined by separators, numbers, UUIDs, rules,
#: alphabets, and placeholders. A repeated group must be possessive: Java's matcher keeps a stack frame for each repeat else.
ALLOW_LIST = (
    r"^[/_+=-]*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_+=-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[/_+=-]*+$",
    r"^[0-9]+$",
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|dummy|xxxx|abcdefghij|0123456789|your[_-]",
    r"(.)\1{7,}",
)
#: Positions add up within blocks of so many matches, then over blocks.
BLOCK = 256
SCALE = 1_000_000  # entropies are whole millionths of a bit, so that sums are exact

SPAN = "struct<s:int,e:int>"
EMPTY = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def located(text: Column, pattern: str, group: int) -> Column:
    """array<struct<s, e, value>> of the leftmost non-overlapping matches; value is the given group's text.

    The gaps (by split) and the matches alternate, so running sums of their lengths are the positions, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value")), lambda x: x["hit"].isNotNull())
    steps = F.transform(pieces, lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["hit"]).alias("h"), x["value"].alias("value")))
    kind = "struct<s:int,e:int,value:string>"

    def in_block(state, step):
        start = state["at"] + step["g"]
        span = F.struct(start.alias("s"), (start + step["h"]).alias("e"), step["value"].alias("value"))
        return F.struct((start + step["h"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def over_blocks(state, block):
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), in_block)
        return F.aggregate(F.array(inner), state, lambda _, x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    def blocks(all_steps):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_steps, k * BLOCK + 1, F.lit(BLOCK)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    # steps are an array of one element here, so that they are made once
    spans = F.flatten(F.transform(F.array(steps), lambda x: F.aggregate(blocks(x), start, over_blocks, lambda s: F.flatten(s["out"]))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{kind}>"))


def base_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(located(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).cast(EMPTY)


def harmless(value: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW_LIST:
        out = out | value.rlike(pattern)
    return out


def high_entropy(candidate: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """array<struct<s, e>>: merged windows of the candidate {s, e, value} whose entropy is at least so many bits a character."""
    terms = F.array(*[F.lit(0)] + [F.lit(round(SCALE * n * math.log2(n))) for n in range(1, window + 1)])
    most = round(SCALE * window * (math.log2(window) - bits))
    n = F.length(candidate["value"])
    codes = F.transform(F.slice(F.split(candidate["value"], "", -1), F.lit(1), n), lambda c: F.position(c, F.lit(alphabet)))
    events = F.flatten(F.transform(F.array(codes), lambda c: F.flatten(F.zip_with(F.slice(F.concat(F.array_repeat(F.lit(0), window), c), F.lit(1), n), c, lambda old, new: F.array(-old, new)))))
    blank = " " * len(alphabet)
    state = F.struct(
        F.lit(0).alias("i"),
        F.lit(0).cast("int").alias("sum"),
        F.lit(blank).alias("counts"),
        F.lit(-1).alias("s"),
        F.lit(-1).alias("e"),
        no_spans().alias("out"),
    )

    def moved(st, event):
        at = F.abs(event)
        had = F.ascii(F.substring(st["counts"], at, 1)) - 32
        has = had + F.signum(event).cast("int")
        return F.struct(
            F.when(event > 0, st["i"] + 1).otherwise(st["i"]).alias("i"),
            (st["sum"] + F.element_at(terms, has + 1) - F.element_at(terms, had + 1)).cast("int").alias("sum"),
            F.overlay(st["counts"], F.chr((has + 32).cast("long")), at, F.lit(1)).alias("counts"),
            st["s"].alias("s"),
            st["e"].alias("e"),
            st["out"].alias("out"),
        )

    def step(st, event):
        def judge(_, x):
            high = (event > 0) & (x["i"] >= window) & (x["sum"] <= most)
            joins = x["i"] - window <= x["e"]
            return F.when(
                high,
                F.struct(
                    x["i"].alias("i"),
                    x["sum"].alias("sum"),
                    x["counts"].alias("counts"),
                    F.when(joins, x["s"]).otherwise(x["i"] - window).alias("s"),
                    x["i"].alias("e"),
                    F.when(joins | (x["e"] < 0), x["out"]).otherwise(F.concat(x["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))).alias("out"),
                ),
            ).otherwise(x)

        return F.when(event == 0, st).otherwise(F.aggregate(F.array(moved(st, event)), st, judge))

    def finish(st):
        return F.when(st["e"] < 0, st["out"]).otherwise(F.concat(st["out"], F.array(F.struct(st["s"].alias("s"), st["e"].alias("e")))))

    spans = F.aggregate(events, state, step, finish)
    return F.transform(spans, lambda x: F.struct((candidate["s"] + x["s"]).alias("s"), (candidate["s"] + x["e"]).alias("e"))).cast(EMPTY)


def entropy_spans(text: Column, alphabet: str, pattern: str, bits: float) -> Column:
    doubtful = F.filter(located(text, pattern, 0), lambda x: ~harmless(x["value"]))
    return F.flatten(F.transform(doubtful, lambda x: high_entropy(x, alphabet, bits)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, for each kind, an array of (s, e): code points, the end exclusive, in order of place.

    The allow-list silences entropy kinds only. A null text counts as empty; repeated rows are scanned each; other columns
    are ignored, whatever their names; an empty table gives none. Texts of any length are scanned whole: no pattern keeps
    a stack that grows with the text.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    columns = [base_spans(text, pattern, group, least).alias(kind) for kind, pattern, group, least in BASE_KINDS]
    columns += [entropy_spans(text, *rest).alias(kind) for kind, *rest in ENTROPY_KINDS]
    return rows.select(F.col(id_col), *columns)


def joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""

    def tagged(k: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    ordered = F.array_sort(F.concat(*[tagged(k, kind) for k, kind in enumerate(kinds)]))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir):
    found = scan_secrets(common.read(spark, sf_dir, "documents"))
    base, more = [k[0] for k in BASE_KINDS], [k[0] for k in ENTROPY_KINDS]
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in base + more],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(base + more).alias("spans"),
    )
