"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, expanded to PCM and resampled.

Mu-law and A-law expand by tables of 256 values. ADPCM blocks are decoded side by side: one numpy step handles the n-th
nibble of every block. The decoded PCM is resampled by linear interpolation and stored as little-endian 16-bit samples.

Scale: a map over batches without shuffle; a row is one clip. Clips are decoded together up to ``BYTES`` of them, a longer one
alone, and ADPCM in parts of blocks, so memory is bounded by the PCM of so many bytes or of one clip.

Edge cases: null bytes are an empty clip; a clip that is not of a known format raises no error but decodes to null; any byte
is a valid sample; ADPCM step indices above 88 count as 88; repeated rows and null ids are treated row by row; clips of any
length are whole; an empty table gives an empty table; input columns named like the results give way to them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unpacked

#: The WAV format tags, and the step sizes and index changes of IMA ADPCM.
MULAW, ALAW, ADPCM = 7, 6, 17
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
BLOCK = 64
#: Blocks decoded at once.
PART = 16384
#: Bytes of clips decoded together, and rows.
BYTES, ROWS = 1 << 20, 256


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, part = (code & 15) << 4, code >> 4 & 7
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: (n, BLOCK) bytes, mono: two bytes of first sample, its step index, one unused, then nibbles, low one first."""
    n = len(blocks)
    out = np.empty((1 + 2 * (BLOCK - 4), n), dtype=np.int16)  # by sample, so that each step writes one run
    level = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = level
    codes = blocks[:, 4:].T
    for k in range(2 * (BLOCK - 4)):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        step = STEPS[index]
        change = step >> 3
        change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        level = np.clip(np.where(code & 8, level - change, level + change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, 88)
        out[k + 1] = level
    return out.T.reshape(-1)


def wav(payload: bytes, kind: int, rate: int = 8000) -> bytes:
    """The payload, unchanged, as the data chunk of a mono WAV file."""
    if kind == ADPCM:
        form = struct.pack("<HHIIHHHH", kind, 1, rate, rate * BLOCK // (2 * (BLOCK - 4) + 1), BLOCK, 4, 2, 2 * (BLOCK - 4) + 1)
    else:
        form = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0)
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(clip: bytes) -> tuple[int, int, bytes] | None:
    """Format tag, rate and data of a WAV file; None if it is not one."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        return None
    at, kind, rate, data = 12, None, 0, None
    while at + 8 <= len(clip):
        name, size = clip[at : at + 4], struct.unpack("<I", clip[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, rate = struct.unpack("<H", clip[at + 8 : at + 10])[0], struct.unpack("<I", clip[at + 12 : at + 16])[0]
        elif name == b"data":
            data = clip[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return None if kind is None or data is None else (kind, rate, data)


def expand(clips: list[tuple[int, bytes] | None]) -> list[np.ndarray | None]:
    """PCM of each clip (format tag, data); the ADPCM blocks of all of them are decoded together."""
    out: list[np.ndarray | None] = []
    blocks: list[np.ndarray] = []
    for clip in clips:
        kind, data = clip or (0, b"")
        raw = np.frombuffer(data, dtype=np.uint8)
        own = raw[: len(raw) - len(raw) % BLOCK].reshape(-1, BLOCK) if kind == ADPCM else raw[:0].reshape(-1, BLOCK)
        blocks.append(own)
        out.append(TABLES[kind][raw] if kind in TABLES else None)
    whole = np.concatenate(blocks) if blocks else np.empty((0, BLOCK), dtype=np.uint8)
    samples = np.concatenate([adpcm(whole[k : k + PART]) for k in range(0, max(len(whole), 1), PART)])
    ends = np.cumsum([0, *[len(x) for x in blocks]]) * (1 + 2 * (BLOCK - 4))
    return [samples[x:y] if clip and clip[0] == ADPCM else pcm for clip, pcm, x, y in zip(clips, out, ends[:-1], ends[1:], strict=True)]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    if not len(pcm) or rate == to:
        return pcm
    n = len(pcm) * to // rate
    at = np.arange(n, dtype=np.int64) * rate
    left, part = at // to, at % to
    a, b = pcm[left].astype(np.int64), pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (to - part) + b * part) // to).astype(np.int16)


def slices(sizes: list[int], most: int = BYTES, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Runs of at most so many rows and bytes, of one row at least: (start, length)."""
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and (held + n > most or k - at == rows):
            yield at, k - at
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes) - at


def mapped(df: DataFrame, inputs: list[str], work, added: dict[str, str]) -> DataFrame:
    """All columns, then those that work(lists of input values) makes for a few rows at a time, as a list of rows. The first
    input is binary."""
    columns = df.columns
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in columns]).alias("_row"), *[df[c].alias(f"_in{k}") for k, c in enumerate(inputs)])
    schema = rows.select("_row", *[F.lit(None).cast(t).alias(f"_out{k}") for k, t in enumerate(added.values())]).schema
    kinds = [
        {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]
        for t in added.values()
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                part = b.slice(at, n)
                made = work(*[part.column(k + 1).to_pylist() for k in range(len(inputs))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(v, t) for v, t in zip(zip(*made, strict=True), kinds, strict=True)]], names=schema.names
                )

    return unpacked(rows.mapInArrow(run, schema), columns, {c: F.col(f"_out{k}") for k, c in enumerate(added)})


def store(df: DataFrame, payload: str = "payload", *, kind: str | None = None, output: str = "media") -> DataFrame:
    """All columns, then the payload (bytes) as a WAV file. kind: a column with the format tag; mu-law without one."""
    rows = df.withColumn("_kind", F.lit(MULAW) if kind is None else F.col(kind))

    def work(payloads: list, kinds: list) -> list[tuple]:
        return [(wav(bytes(x or b""), int(k or MULAW)),) for x, k in zip(payloads, kinds, strict=True)]

    return mapped(rows, [payload, "_kind"], work, {output: "binary"}).drop("_kind")


def decode(df: DataFrame, media: str = "media", *, rate: int = 16000, keep_pcm: bool = True) -> DataFrame:
    """All columns, then data (the stored bytes), codec, pcm (resampled to rate; null unless kept), its CRC, peak, energy
    and zero crossings."""

    def heard(found: tuple | None, pcm: np.ndarray | None) -> tuple:
        if found is None or pcm is None:
            return None, None, None, None, None, None, None
        out = resample(pcm, found[1], rate).astype("<i2")
        wide = out.astype(np.int32)
        peak = int(np.abs(wide).max()) if len(out) else 0
        raw = out.tobytes()
        energy = int(np.dot(wide.astype(np.float64), wide)) if len(out) < 1 << 22 else int((wide.astype(np.int64) ** 2).sum())
        return found[2], found[0], raw if keep_pcm else None, zlib.crc32(raw), peak, energy, int(
            np.count_nonzero((out[1:] < 0) != (out[:-1] < 0))
        )

    def work(clips: list) -> list[tuple]:
        found = [read_wav(bytes(c or b"")) for c in clips]
        return [heard(f, pcm) for f, pcm in zip(found, expand([f and (f[0], f[2]) for f in found]), strict=True)]

    return mapped(
        df, [media], work,
        {"data": "binary", "codec": "int", "pcm": "binary", "pcm_crc32": "long", "peak": "int", "energy": "long", "crossings": "int"}
    )
