"""Telephony audio in media columns: G.711 and IMA ADPCM in WAV, decoded by tables and across blocks."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.arrowtext import passes, string_buffer
from tessella.llm.staging import stage

RATE, UNIT, BLOCK_HEAD = 8000, 192, 4
#: WAVE format tags.
ALAW, MULAW, ADPCM = 6, 7, 0x11
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}

# Fixed values of the IMA ADPCM format: step sizes and the step index's changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 mu-law codes."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 A-law codes."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
#: What a nibble adds to the predictor at each step index.
_nibble = np.arange(16)
CHANGE = np.stack([np.where(_nibble & 8, -1, 1) * ((s >> 3) + (_nibble >> 2 & 1) * s + (_nibble >> 1 & 1) * (s >> 1) + (_nibble & 1) * (s >> 2)) for s in STEPS]).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM mono blocks (one per row): all blocks advance together, one nibble at a time."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - BLOCK_HEAD), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, BLOCK_HEAD:] & 15).T, (blocks[:, BLOCK_HEAD:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k, code in enumerate(codes):
        value = np.clip(value + CHANGE[index, code], -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


def double_rate(pcm: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Twice the sampling rate by the half-band filter (-1 9 9 -1) / 16, within each of the clips that ``edges`` bound;
    beyond a clip's ends its first and last sample go on."""
    at = np.arange(len(pcm))
    n = np.diff(edges)
    low, high = np.repeat(edges[:-1], n), np.repeat(edges[1:] - 1, n)
    x = lambda k: pcm[np.clip(at + k, low, high)].astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x(0) + x(1)) - x(-1) - x(2) + 8) >> 4, -32768, 32767)
    return out


def wav(codec: int, payload: bytes) -> bytes:
    """A mono 8 kHz WAV file that holds the payload bytes as its samples, unchanged.

    G.711 keeps one byte a sample.  ADPCM keeps two nibbles a byte in blocks of 192 bytes, each behind a header of
    predictor and step index 0.  Payloads are multiples of 192 bytes.
    """
    if codec == ADPCM:
        raw = np.zeros((len(payload) // UNIT, BLOCK_HEAD + UNIT), np.uint8)
        raw[:, BLOCK_HEAD:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        samples = 2 * UNIT + 1
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * raw.shape[1] // samples, raw.shape[1], 4, 2, samples)
        data, count = raw.tobytes(), samples * len(raw)
    else:
        form, data, count = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), payload, len(payload)
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", form), (b"fact", struct.pack("<I", count)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def open_wav(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Format tag, block size and sample bytes of a WAV file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data":
            data = np.frombuffer(raw, np.uint8, min(size, len(raw) - at - 8), at + 8)
        at += 8 + size + size % 2
    return form[0], form[4], np.asarray(data, np.uint8)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text (null: empty) padded with spaces to a positive multiple of 192 bytes
    and stored as telephony audio; equal texts get equal files, the codec going by the payload's CRC."""

    def run(batches):
        for batch in batches:
            data, offs = string_buffer(batch.column(1))
            for i, j in passes(offs):
                raw, o = data[offs[i] : offs[j]].tobytes(), offs[i : j + 1] - offs[i]
                texts = [raw[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                full = [t + b" " * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts]
                media = [wav(CODECS[zlib.crc32(p) % len(CODECS)], p) for p in full]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _samples(files: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """16-bit samples of the files one after another, their offsets, and each file's sample bytes without headers."""
    clips: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    bodies = [b for _, _, b in files]
    for size in {s for t, s, _ in files if t == ADPCM}:
        own = [k for k, (t, s, _) in enumerate(files) if t == ADPCM and s == size]
        rows = [files[k][2][: len(files[k][2]) // size * size].reshape(-1, size) for k in own]
        pcm = np.split(decode_adpcm(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
        for k, r, p in zip(own, rows, pcm, strict=True):
            clips[k], bodies[k] = p.reshape(-1), np.ascontiguousarray(r[:, BLOCK_HEAD:]).reshape(-1)
    for k, (t, _, b) in enumerate(files):
        if t in TABLES:
            clips[k] = TABLES[t][b]
    return np.concatenate(clips) if clips else np.zeros(0, np.int16), np.concatenate([[0], np.cumsum([len(c) for c in clips])]).astype(np.int64), bodies


def decode(media: DataFrame, pcm: bool = True) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the payload read back, features and, if ``pcm``, 16 kHz 16-bit PCM.

    Mu-law and A-law expand by lookup, ADPCM blocks of all files in a batch decode together; features are exact
    integers of the resampled signal, so they don't depend on what shares a batch.  Null media give nulls.
    """

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            sizes = np.array([len(column[k].as_buffer()) if column[k].is_valid else 0 for k in range(len(column))], np.int64)
            for i, j in passes(np.concatenate([[0], np.cumsum(sizes)]), 1 << 18):
                raws = column.slice(i, j - i).to_pylist()
                some = [k for k, r in enumerate(raws) if r is not None]
                files = [open_wav(raws[k]) for k in some]
                signal, edges, bodies = _samples(files)
                out = double_rate(signal, edges)
                edges2 = edges * 2
                wide = out.astype(np.int64)
                power = np.concatenate([[0], np.cumsum(wide * wide)])
                turn = np.concatenate([[0], np.cumsum(np.diff(np.signbit(out).astype(np.int8), prepend=0) != 0)])
                rows = [[None] * (j - i) for _ in range(8)]
                for x, k in enumerate(some):
                    a, b = int(edges2[x]), int(edges2[x + 1])
                    body, clip = bodies[x].tobytes(), out[a:b]
                    peak = int(np.abs(wide[a:b]).max()) if b > a else 0
                    level = int((power[b] - power[a]) // max(1, b - a)) if b > a else 0
                    name = NAMES.get(files[x][0], str(files[x][0]))
                    crossings = int(turn[b] - turn[a + 1]) if b > a else 0
                    text = f"codec={name};samples={b - a};mean_square={level};peak={peak};crossings={crossings}"
                    values = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(raws[k]), hashlib.sha256(raws[k]).hexdigest(), text, 2 * RATE, clip.tobytes() if pcm else None)
                    for c, v in enumerate(values):
                        rows[c][k] = v
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(r, t) for r, t in zip(rows, kinds, strict=True))], names=OUT)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sample_rate int, pcm binary"
    OUT = [c.split()[0] for c in schema.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def store_pcm(media: DataFrame, path: str) -> None:
    """Write the decoded and resampled PCM of a media table as Parquet, compressed."""
    decode(media).select("doc_id", "sample_rate", "pcm", "feature").write.option("compression", "zstd").parquet(path)


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as telephony audio and read back."""
    media = stage(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return decode(media, pcm=False).drop("sample_rate", "pcm")
