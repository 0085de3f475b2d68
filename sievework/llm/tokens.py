"""Token counts by a two-tier lookup on the map side.

With this kind of vocabulary no piece holds a word start after another character, so merges never cross the point before
a run of spaces, and a text's count is the sum over its pre-tokens (a run of spaces and what follows it up to the next).
Tier one is a broadcast table of frequent pre-tokens' lengths; misses go to the tokenizer, behind a cache in each worker.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common

#: Bounds of the broadcast table: entries, and characters of an entry.
TABLE_ENTRIES, ENTRY_CHARS = 1 << 15, 48
#: A task reports at most so many pre-tokens for the table, and a worker caches at most so many.
TASK_ENTRIES, CACHE_ENTRIES = 1 << 11, 1 << 18
COUNTER_ENTRIES = 1 << 17
#: What is frequent is learned from one document in so many, by the hash of its id; all documents are counted.
LEARN_FROM = 8
MARK = "▁"
PRE_TOKEN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens without their first space; the tokenizer itself adds one before each text."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in PRE_TOKEN.findall(" " + text)]
    return text.split(" ")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer; raises ValueError if counts of its pre-tokens don't add up."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
    for k in range(model.get_piece_size()):
        if MARK in model.id_to_piece(k).lstrip(MARK):
            raise ValueError(f"{name}: a piece crosses a word start")
    return model


class Lengths(dict):
    """Token counts by pre-token; what is missing is encoded and, up to a bound, kept."""

    def __init__(self, table: dict[str, int], model):
        super().__init__(table)
        self.model, self.base = model, table

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word, num_threads=1)) if word else 1  # a lone space is a piece of its own
        if len(word) <= ENTRY_CHARS:
            if len(self) >= CACHE_ENTRIES + len(self.base):
                self.clear()
                self.update(self.base)
            self[word] = n
        return n


def frequent_pre_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) for what may be frequent: each task reports its most frequent ones, and these are added up."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            for a, b in common.slices(texts):
                seen.update(itertools.chain.from_iterable(map(pre_tokens, texts[a:b])))
                if len(seen) > COUNTER_ENTRIES:
                    seen = Counter({w: n for w, n in seen.items() if n > 1 and len(w) <= ENTRY_CHARS})
                    if len(seen) > COUNTER_ENTRIES // 2:
                        seen = Counter(dict(seen.most_common(COUNTER_ENTRIES // 4)))
        top = [(w, n) for w, n in seen.most_common(TASK_ENTRIES) if n > 1 and len(w) <= ENTRY_CHARS]
        if top:
            words, counts = zip(*top, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts, pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, model_name: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each text, exactly as the tokenizer counts whole texts.

    A null text counts as empty and has no tokens; repeated rows count each; other columns are ignored. The table of
    frequent pre-tokens only saves time: counts don't depend on what is in it.
    """
    spark = docs.sparkSession
    model = load(model_name)
    learned = docs.where(F.pmod(F.xxhash64(F.lit("table"), id_col), F.lit(LEARN_FROM)) == 0)
    top = frequent_pre_tokens(learned, text_col).orderBy(F.desc("n"), "word").limit(TABLE_ENTRIES).collect()
    fresh = Lengths({}, model)
    table = spark.sparkContext.broadcast({r["word"]: fresh[r["word"]] for r in top})
    state: dict = {}

    def run(texts):
        if "lengths" not in state:
            state["lengths"] = Lengths(table.value, load(model_name))
        count = state["lengths"].__getitem__
        tokens = [sum(map(count, pre_tokens(t))) if t else 0 for t in texts]
        return [pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]

    return common.map_text(docs, id_col, text_col, run, "n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir):
    return count_tokens(common.read(spark, sf_dir, "documents"))
