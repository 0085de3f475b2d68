"""Byte-level BPE: encoding by contiguous arrays of part ids and adjacent ranks, and decoding.

A text is cut at its special strings and then into pre-tokens. A pre-token of few bytes is a row of a matrix: the ids of its
parts, and beside them the rank of each adjacent pair. Step by step each row's least rank is sought, the boundary in that
pair is deleted, and the ranks of the pairs on both sides are looked up anew, until no row has a rank left. Longer ones
would take too many steps over too long a row; they go pair by pair through a queue, which gives the same parts.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import common
from sievework.llm.tokens import model_path

#: Widths of the matrices, in bytes; what is longer than the last one goes through the queue.
WIDTHS = (8, 16, 32)
#: Words to a matrix, pre-tokens that are held at once, cached words, and bytes of a cached word.
ROWS, BLOCK_WORDS, CACHE_ENTRIES, ENTRY_BYTES = 1 << 13, 1 << 17, 1 << 19, 48
NO_RANK = np.int32(np.iinfo(np.int32).max)
#: The pre-tokens of a text of ASCII alone: contractions, letters, digits, other signs, white space.
ASCII_WORD = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary of a tokenizer file: pairs and their ranks, the bytes of each token, special strings."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, ids = byte_letters(), told["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*ids.values(), *[t["id"] for t in told["added_tokens"]]]))
        for token, k in ids.items():
            self.bytes[k] = bytes(letters[x] for x in token)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        for content, k in self.special.items():
            self.bytes[k] = content.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.of_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.any_word = regex.compile(PATTERN)
        # with letters so new that not all libraries' tables have them, the tokenizer's own cut holds
        newest = newest_letters()
        self.newest = min((a for a, _ in newest), default=sys.maxunicode + 1)
        self.unknown = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in newest) + "]" if newest else "(?!)")
        self.own_cut = Tokenizer.from_file(path).pre_tokenizer

    def words(self, text: str) -> Iterator[str]:
        """The pre-tokens of a text without special strings."""
        if self.only_old(text):
            return (m.group() for m in (ASCII_WORD if text.isascii() else self.any_word).finditer(text))
        return (text[a:b] for _, (a, b) in self.own_cut.pre_tokenize_str(text))

    def all_words(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each of many texts that aren't long."""
        if self.only_old("".join(texts)):
            return [(ASCII_WORD if t.isascii() else self.any_word).findall(t) for t in texts]
        return [list(self.words(t)) for t in texts]

    def only_old(self, text: str) -> bool:
        """Whether the text has none of the newest letters."""
        return text.isascii() or np.frombuffer(text.encode("utf-32-le"), "<u4").max() < self.newest or not self.unknown.search(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NO_RANK where they never merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def encode_short(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of 1 to width bytes, worked out side by side, one after another, and how many each has."""
        row, n = np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8)].reshape(-1, width)
        place = np.arange(width - 1)
        ranks = np.where(place < n[:, None] - 1, self.rank(ids[:, :-1], ids[:, 1:]), NO_RANK)
        final, sizes = np.zeros_like(ids), np.zeros_like(n)
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            done, left = least == NO_RANK, least != NO_RANK
            final[row[done]], sizes[row[done]] = ids[done], n[done]
            row, n, ids, ranks, at, least = row[left], n[left] - 1, ids[left], ranks[left], at[left], least[left]
            each = np.arange(len(row))
            ids[each, at] = self.merged[least]
            # the boundary after `at` goes: parts to its right, and ranks from `at` on, move up by one
            ids[:, :-1] = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(place[:-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            after, before = at < n - 1, at > 0
            ranks[each[after], at[after]] = self.rank(ids[each[after], at[after]], ids[each[after], at[after] + 1])
            ranks[each[before], at[before] - 1] = self.rank(ids[each[before], at[before] - 1], ids[each[before], at[before]])
        return final[np.arange(width) < sizes[:, None]], sizes

    def encode_long(self, word: bytes) -> np.ndarray:
        """The ids of a word of any length: a queue of pairs by rank and place, parts linked to their neighbours."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k) for k in range(n - 1) if (r := self.of_pair.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            if ids[k] < 0 or (j := following[k]) >= n or self.of_pair.get(ids[k] << 32 | ids[j]) != r:
                continue  # one of the two has merged meanwhile
            ids[k], ids[j] = int(self.merged[r]), -1
            following[k] = following[j]
            if following[k] < n:
                previous[following[k]] = k
            for a, b in ((previous[k], k), (k, following[k])):
                if a >= 0 and b < n and (r := self.of_pair.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(queue, (r, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_words(self, words: list[str], pack) -> dict[str, bytes]:
        """What pack makes of the ids of each of these words; it takes the ids of many and gives as many bytes for each id."""
        found, narrow = {}, 0
        raw = [w.encode() for w in words]
        for width in WIDTHS:
            some = [k for k, b in enumerate(raw) if narrow < len(b) <= width]
            for at in range(0, len(some), ROWS):
                part = some[at : at + ROWS]
                ids, sizes = self.encode_short([raw[k] for k in part], width)
                packed = pack(ids)
                ends = (np.cumsum(sizes) * (len(packed) // len(ids))).tolist()
                found.update((words[k], packed[a:b]) for k, a, b in zip(part, [0, *ends], ends, strict=False))
            narrow = width
        found.update((w, pack(self.encode_long(b))) for w, b in zip(words, raw, strict=True) if len(b) > narrow)
        return found


_loaded: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a tokenizer file, read once in each worker."""
    if name not in _loaded:
        _loaded[name] = Vocabulary(model_path(name))
    return _loaded[name]


def newest_letters() -> list[tuple[int, int]]:
    """Runs of letters and numbers that the standard library's tables don't have yet: first and last code point."""
    import regex

    every = "".join(map(chr, itertools.chain(range(0x80, 0xD800), range(0xE000, sys.maxunicode + 1))))
    new = np.array([ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"], np.int64)
    runs = np.split(new, np.flatnonzero(np.diff(new) > 1) + 1) if len(new) else []
    return [(int(r[0]), int(r[-1])) for r in runs]


class Encoder:
    """Words to packed values behind a bounded cache: pack turns the ids of a word into what is kept and joined."""

    def __init__(self, words: Vocabulary, pack=lambda ids: ids.astype("<u4").tobytes(), entries: int | None = None):
        self.words, self.pack, self.cache, self.long = words, pack, {}, []
        self.entries = CACHE_ENTRIES if entries is None else entries

    def learned(self, words: list[str]) -> dict[str, bytes]:
        """The cache, once it has all these words; it starts anew where it would get too large."""
        missing = set(words).difference(self.cache)
        if len(self.cache) + len(missing) > self.entries:
            self.cache, missing = {}, set(words)
        if missing:
            self.cache.update(self.words.encode_words(list(missing), self.pack))
            self.long += [w for w in missing if len(w) > ENTRY_BYTES]
        return self.cache

    def trimmed(self) -> None:
        """Takes long words out of the cache again."""
        for w in self.long:
            self.cache.pop(w, None)
        self.long = []

    def plain(self, text: str) -> bytes:
        """The packed values of a text of any length without special strings, a block of words at a time."""
        out, words = [], self.words.words(text)
        while block := list(itertools.islice(words, BLOCK_WORDS)):
            out.append(b"".join(map(self.learned(block).__getitem__, block)))
        return b"".join(out)

    def encode(self, texts: list[str], specials: bool = True) -> list[bytes]:
        """The packed values of each text's words; special strings become their tokens, or else are text."""
        out: list = [None] * len(texts)
        cut, short = self.words.cut if specials else None, []
        for k, text in enumerate(texts):
            ends = [(m.start(), m.end()) for m in cut.finditer(text)] if cut else []
            if not ends and len(text) <= BLOCK_WORDS:
                short.append(k)
                continue
            parts, start = [], 0
            for a, b in ends:
                parts += [self.plain(text[start:a]), self.pack(np.array([self.words.special[text[a:b]]], np.int32))]
                start = b
            out[k] = b"".join([*parts, self.plain(text[start:])])
        words = self.words.all_words([texts[k] for k in short])
        held = self.learned(list(itertools.chain.from_iterable(words))).__getitem__
        for k, own in zip(short, words, strict=True):
            out[k] = b"".join(map(held, own))
        self.trimmed()
        return out


def encode_texts(docs: DataFrame, model_name: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """id and ids of each text: its token ids as little-endian unsigned numbers of 32 bits, packed in a binary.

    The ids are those of the tokenizer file's own library without tokens around the text. Special strings in a text are
    their tokens (specials) or plain text. A null text has the ids of an empty one: none. Repeated rows are encoded each,
    ties don't matter, a table without rows gives none; texts of any length are encoded whole, a block of words at a time.
    Other columns are ignored, whatever their names.
    """
    state: dict = {}

    def run(texts):
        if "encoder" not in state:
            state["encoder"] = Encoder(vocabulary(model_name))
        return [pa.array(state["encoder"].encode([t or "" for t in texts], specials), pa.binary())]

    return common.map_text(docs, id_col, text_col, run, "ids binary")


def decode_ids(encoded: DataFrame, model_name: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in keep, and text of rows with packed ids: their tokens' bytes as UTF-8 (else U+FFFD).

    Null ids give a null text, and no ids an empty one; ids that the vocabulary doesn't have stand for nothing. Repeated
    rows are decoded each, ties don't matter, a table without rows gives none; long ones go a block of ids at a time.
    Other columns are ignored, whatever their names.
    """
    kept = [id_col, *keep]
    rows = encoded.select(*kept, F.col(ids_col).alias("__sievework_ids"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def text(packed: bytes, table: list[bytes]) -> str:
        decoder, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        ids = np.frombuffer(packed, "<u4")
        for k in range(0, len(ids), BLOCK_WORDS):
            part = ids[k : k + BLOCK_WORDS]
            out.append(decoder.decode(b"".join(map(table.__getitem__, part[part < len(table)].tolist()))))
        return "".join(out) + decoder.decode(b"", final=True)

    def run(batches):
        table = vocabulary(model_name).bytes
        for batch in batches:
            packed = batch.column(len(kept)).to_pylist()
            for a, b in common.slices([v or b"" for v in packed], 4 * common.SLICE_CHARS):
                texts = [None if v is None else text(v, table) for v in packed[a:b]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(len(kept))], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, f"{ddl}, text string")


def op13_bpe(spark, sf_dir):
    encoded = encode_texts(common.read(spark, sf_dir, "documents"))
    told = encoded.select("doc_id", "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    decoded = decode_ids(told, keep=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
