"""Telephony audio columns: G.711 mu-law and A-law, and IMA ADPCM in WAVE form.

Decoding: both G.711 laws expand by tables of 256 entries made from their rules. ADPCM blocks start
from their own state, so all blocks of a batch are decoded side by side, one numpy step for each
nibble place. Decoded sound is resampled linearly and stored as 16-bit PCM in WAVE form again.

``carry`` stores any payload losslessly: each payload byte is one mu-law or A-law sample, or one
byte (two nibbles) of an ADPCM block whose header is the zero state. Reading parses the stored
WAVE bytes; nothing is taken from the writer.

Everything is row by row (no shuffle); a batch is worked in pieces of bounded size, so a task's
memory follows its longest row.

Defined cases: null is the empty text; any bytes are legal sound. Equal texts give
equal values: the codec is chosen by the payload's CRC. Ids may be of any type and null; repeated rows are worked each;
an empty table gives an empty result. Results have only the columns named at the functions: extra columns are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches, text_bytes

#: Fixed values of the WAVE registry.
PCM, A_LAW, MU_LAW, IMA = 0x0001, 0x0006, 0x0007, 0x0011
RATE, TARGET_RATE = 8000, 16000
UNIT = 192
#: Payload bytes of an ADPCM block after its 4 bytes of state.
BLOCK = 192

# The step sizes and index changes of IMA ADPCM.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit values of the 256 mu-law codes: inverted bits of sign, exponent and mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit values of the 256 A-law codes: every other bit inverted, no offset in the lowest segment."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_TABLE, A_TABLE = mu_law_table(), a_law_table()


def decode_ima(data: np.ndarray) -> np.ndarray:
    """Samples (blocks x 1 + 2 * bytes) of mono IMA blocks (blocks x 4 + bytes), low nibble first."""
    n = len(data)
    value = np.ascontiguousarray(data[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(data[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (data.shape[1] - 4), n), np.int16)
    out[0] = value
    nibbles = np.empty((2 * (data.shape[1] - 4), n), np.uint8)
    nibbles[0::2] = data[:, 4:].T & 15
    nibbles[1::2] = data[:, 4:].T >> 4
    for k, code in enumerate(nibbles, 1):
        step = IMA_STEPS[index]
        size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code], 0, 88)
        out[k] = value
    return out.T


def wave(tag: int, data: bytes, rate: int = RATE, align: int = 1, bits: int = 8, samples: int = 0) -> bytes:
    """A mono WAVE file."""
    extra = struct.pack("<H", samples) if tag == IMA else b""
    per_second = rate * align if tag != IMA else rate * align // max(samples, 1)
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, per_second, align, bits, len(extra)) + extra
    pad = b"\x00" * (len(data) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(stored: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block align, data) of a mono WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            if fmt is None:
                break
            return fmt[0], fmt[2], fmt[4], stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without format or data")


def carry(payload: bytes) -> bytes:
    """The payload as a stored file; the codec follows from the payload alone."""
    tag = (MU_LAW, A_LAW, IMA)[zlib.crc32(payload) % 3]
    if tag != IMA:
        return wave(tag, payload)
    rows = np.zeros((-(-len(payload) // BLOCK), 4 + BLOCK), np.uint8)
    rows[:, 4:] = np.frombuffer(payload.ljust(len(rows) * BLOCK, b"\x00"), np.uint8).reshape(-1, BLOCK)
    return wave(IMA, rows.tobytes(), align=4 + BLOCK, bits=4, samples=1 + 2 * BLOCK)


def carried(stored: bytes) -> bytes:
    """The payload of a file made by ``carry``."""
    tag, _, align, data = parse_wave(stored)
    if tag != IMA:
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


def decode(stored: list[bytes]) -> list[np.ndarray]:
    """16-bit samples of WAVE files; the ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray | None] = [None] * len(stored)
    ima: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, each in enumerate(stored):
        tag, _, align, data = parse_wave(each)
        raw = np.frombuffer(data, np.uint8)
        if tag == MU_LAW:
            out[i] = MU_TABLE[raw]
        elif tag == A_LAW:
            out[i] = A_TABLE[raw]
        elif tag == IMA:
            ima.setdefault(align, []).append((i, raw[: len(raw) // align * align].reshape(-1, align)))
        elif tag == PCM:
            out[i] = raw[: len(raw) // 2 * 2].view("<i2")
        else:
            raise ValueError(f"format {tag} is not telephony audio")
    for files in ima.values():
        many = np.concatenate([x for _, x in files])
        done = np.concatenate([decode_ima(many[k : k + 4096]) for k in range(0, len(many), 4096)]) if len(many) else np.zeros((0, 0), np.int16)
        at = 0
        for i, x in files:
            out[i] = done[at : at + len(x)].reshape(-1)
            at += len(x)
    return out  # type: ignore[return-value]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling in whole numbers, so that results don't depend on the machine."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = len(samples) * to // rate
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[0::2] = samples
        wide = samples.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = samples[-1]
        return out
    place = np.arange(n, dtype=np.int64) * rate
    low, part = place // to, place % to
    high = np.minimum(low + 1, len(samples) - 1)
    wide = samples.astype(np.int64)
    return ((wide[low] * (to - part) + wide[high] * part) // to).astype(np.int16)


def features(samples: np.ndarray) -> str:
    """Peak, mean square, zero crossings and the CRC of the samples."""
    wide = samples.astype(np.int64)
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"n={len(samples)};peak={int(np.abs(wide).max(initial=0))};power={int((wide * wide).sum()) // max(1, len(samples))};zc={crossings};crc={zlib.crc32(samples.astype('<i2').tobytes()):08x}"


NAMES = {MU_LAW: "mulaw", A_LAW: "alaw", IMA: "ima", PCM: "pcm"}


def payload_of(text: bytes, unit: int = UNIT) -> bytes:
    """The text with spaces up to a positive multiple of ``unit``."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): every text's payload as a stored file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(1))
            for lo, hi in blocks(off, 4 << 20):
                media = [carry(payload_of(raw[off[i] : off[i + 1]].tobytes(), unit)) for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off[lo : hi + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(media: DataFrame, to_rate: int = TARGET_RATE, keep_pcm: bool = True) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the payload read back, its features and resampled PCM in WAVE form."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(2))
            for lo, hi in blocks(off, 2 << 20):
                stored = [raw[off[i] : off[i + 1]].tobytes() for i in range(lo, hi)]
                back = [carried(x) for x in stored]
                out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm")}
                for x, payload, sound in zip(stored, back, decode(stored), strict=True):
                    tag, rate, _, _ = parse_wave(x)
                    pcm = resample(sound, rate, to_rate)
                    out["payload_bytes"].append(len(payload))
                    out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                    out["media_bytes"].append(len(x))
                    out["media_sha256"].append(hashlib.sha256(x).hexdigest())
                    out["feature"].append(f"codec={NAMES[tag]};{features(pcm)}")
                    out["pcm"].append(wave(PCM, pcm.astype("<i2").tobytes(), rate=to_rate, align=2, bits=16) if keep_pcm else None)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", "n_bytes", *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")
