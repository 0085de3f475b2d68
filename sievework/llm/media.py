"""Telephony audio columns: companded or ADPCM bytes in a RIFF container, decoded to PCM and resampled.

Codecs: G.711 mu-law and A-law (one byte a sample, expanded by a lookup table of 256 entries that is built from the
companding rule) and IMA ADPCM (four bits a sample, blocks decoded side by side: numpy works on one sample position of
all blocks at a time).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm import common

RATE, TARGET_RATE = 8000, 16000
#: Payload bytes are padded to a multiple of this with spaces; an ADPCM block holds as many bytes of nibbles.
UNIT = 192
CODECS = ("mulaw", "alaw", "ima_adpcm")
#: Fixed values of the RIFF registry.
FORMAT_TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
#: Fixed values of IMA ADPCM: how each code's magnitude moves the step index.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: Fixed values of IMA ADPCM: the step sizes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
BLOCKS_AT_ONCE = 8192
SAMPLES_AT_ONCE = 1 << 19


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, step = (code & 0x70) >> 4, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, step + 8, step + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def pack(payload: bytes, codec: str) -> bytes:
    """A RIFF/WAVE file whose samples are the payload. ADPCM nibbles get a block header (predictor and index zero) for every UNIT bytes."""
    align, bits, extra = 1, 8, b""
    if codec == "ima_adpcm":
        align, bits, extra = UNIT + 4, 4, struct.pack("<H", 2 * UNIT + 1)
        blocks = np.zeros((len(payload) // UNIT, align), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        payload = blocks.tobytes()
    form = struct.pack("<HHIIHHH", FORMAT_TAGS[codec], 1, RATE, RATE * align // (2 * UNIT + 1 if bits == 4 else 1), align, bits, len(extra)) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unpack(media: bytes) -> tuple[str, bytes]:
    """The codec and the data chunk's bytes. Raises ValueError for anything but a RIFF file of a known codec."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        kind, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next((c for c, t in FORMAT_TAGS.items() if t == tag), None)
        elif kind == b"data" and codec:
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no known codec or no data chunk")


def payload_of(codec: str, data: bytes) -> bytes:
    """The payload that pack() was given."""
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes() if codec == "ima_adpcm" else data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples [blocks, 2 * UNIT + 1] of uint8 blocks [blocks, UNIT + 4]; a step index beyond the table counts as its last."""
    steps, moves = np.array(STEPS, np.int32), np.array(INDEX_MOVES, np.int32)
    predictor = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((blocks.shape[1] - 4) * 2 * len(blocks), np.uint8).reshape(-1, len(blocks))
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 0x0F).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = predictor
    for k, code in enumerate(codes):
        step, size = steps[index], code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        predictor = np.clip(np.where(code & 8, predictor - change, predictor + change), -32768, 32767)
        index = np.clip(index + moves[size], 0, len(STEPS) - 1)
        out[k + 1] = predictor
    return out.T


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """int16 PCM of each file at RATE; the ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray] = [None] * len(files)
    pending: list[tuple[int, np.ndarray]] = []
    for k, media in enumerate(files):
        codec, data = unpack(media)
        raw = np.frombuffer(data, np.uint8)
        if codec == "ima_adpcm":
            pending.append((k, raw.reshape(-1, UNIT + 4)))
        else:
            out[k] = TABLES[codec][raw]
    if pending:
        blocks = np.concatenate([b for _, b in pending])
        pcm = np.concatenate([decode_adpcm(blocks[a : a + BLOCKS_AT_ONCE]) for a in range(0, len(blocks), BLOCKS_AT_ONCE)])
        at = 0
        for k, b in pending:
            out[k] = pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the rounded-down mean of it and the next (the last one's own value)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    following = np.concatenate([pcm[1:], pcm[-1:]])
    for a in range(0, len(pcm), SAMPLES_AT_ONCE):
        b = a + SAMPLES_AT_ONCE
        out[1::2][a:b] = (pcm[a:b].astype(np.int32) + following[a:b]) >> 1
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """Integer features of resampled PCM, the same on every machine."""
    total = 0
    for a in range(0, len(pcm), SAMPLES_AT_ONCE):
        part = pcm[a : a + SAMPLES_AT_ONCE].astype(np.int64)
        total += int(part @ part)
    signs = pcm < 0
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1]))
    digest = hashlib.sha256(pcm.astype("<i2").tobytes()).hexdigest()
    return f"codec={codec};rate={TARGET_RATE};samples={len(pcm)};mean_square={total // len(pcm)};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={crossings};pcm_sha256={digest}"


def payload_from_text(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def audio_of(texts: list[str | None]) -> tuple[tuple[int, ...], list[str], list[bytes], list[np.ndarray]]:
    """(bytes, codec, WAVE file and resampled PCM) of each text."""
    sizes, files = zip(*((n, pack(p, CODECS[zlib.crc32(p) % len(CODECS)])) for n, p in map(payload_from_text, texts)), strict=True)
    return sizes, [unpack(f)[0] for f in files], list(files), [resample(x).astype("<i2") for x in decode_many(list(files))]


def store_text_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, codec, media (a WAVE file) and pcm (resampled, 16-bit little-endian) of each text.

    The codec follows from the payload's CRC-32, so equal texts give equal files. A null text counts as empty; an empty
    one is stored as UNIT spaces. Repeated rows are stored each. Columns besides id and text are ignored.
    """

    def run(texts):
        sizes, codecs, files, pcm = audio_of(texts)
        return [pa.array(sizes, pa.int64()), pa.array(codecs, pa.string()), pa.array(files, pa.binary()), pa.array([x.tobytes() for x in pcm], pa.binary())]

    return common.map_text(docs, id_col, text_col, run, "n_bytes long, codec string, media binary, pcm binary")


DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(n_bytes: int, codec: str, media: bytes, pcm: np.ndarray) -> tuple:
    """The columns of DESCRIBED, from the stored bytes alone."""
    payload = payload_of(*unpack(media))
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(codec, pcm)


def columns_of(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]


def describe_audio(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of store_text_as_audio()'s rows, from the stored bytes alone."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n_bytes, codec, media, pcm = (batch.column(c)[k].as_py() for c in range(1, 5))
                row = described(n_bytes, codec, media, np.frombuffer(pcm, "<i2"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *columns_of([row])], names=names)

    kind = stored.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.strip().split(" ")[0] for x in DESCRIBED.split(","))]
    return stored.select(id_col, "n_bytes", "codec", "media", "pcm").mapInArrow(run, f"`{id_col}` {kind}, {DESCRIBED}")


def described_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What describe_audio() tells of store_text_as_audio()'s rows, without dealing files and PCM, some ten times the text, to other workers.

    Each slice of texts is stored, read back and described before the next, so that a worker holds one slice's audio.
    """

    def run(texts):
        return columns_of([described(*one) for one in zip(*audio_of(texts), strict=True)])

    return common.map_text(docs, id_col, text_col, run, DESCRIBED)


def op5_telephony_audio(spark, sf_dir):
    return described_texts(common.read(spark, sf_dir, "documents"))
