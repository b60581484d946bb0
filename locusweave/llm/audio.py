"""Media columns: lossless 8-bit sound, polyphase resampling, log-mel features, hysteresis segments.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, are the samples of an 8-bit mono WAV file. Features
come from the stored file, read back: samples are halved in rate by a polyphase filter, cut into overlapping frames, and
turned into log-mel bands; frame energies start a segment above one threshold and end it below a lower one; each segment is
a tensor of one fixed shape with a time span.

A null text is an empty one: 192 spaces. A null doc_id is kept. Repeated rows and equal texts give equal values. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_of, to_batch

UNIT, RATE = 192, 8000
BANDS, FRAME, HOP, SLOTS = 16, 128, 64, 8
#: Energies relative to the median frame, in units of natural logarithm, that begin and end a segment.
BEGIN, STOP = 0.15, 0.0


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file; a chunk of odd size is filled up, as the format asks."""
    pad = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """Rate and samples of a file of to_wav's kind; chunks of other kinds are passed over."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc for a change of rate by up / down."""
    width = max(up, down)
    n = np.arange(-half * width, half * width + 1)
    h = np.sinc(n / width) / width * (0.5 + 0.5 * np.cos(np.pi * n / (half * width + 1)))
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, h: np.ndarray) -> np.ndarray:
    """Polyphase resampling: each output sample uses the one phase of the filter that meets input samples."""
    n = -(-len(x) * up // down)
    taps = -(-len(h) // up)
    padded = np.zeros(len(x) + 2 * taps + len(h) // up + 1, np.float32)
    padded[taps : taps + len(x)] = x
    out = np.empty(n, np.float32)
    for number in range(min(n, up)):
        at = number * down + len(h) // 2
        own = h[at % up :: up][::-1]
        count = len(range(number, n, up))
        first = at // up + 1 + taps - len(own)
        windows = np.lib.stride_tricks.as_strided(padded[first:], (count, len(own)), (4 * down, 4))
        out[number::up] = windows @ own
    return out


def mel_bank(bands: int = BANDS, size: int = FRAME, rate: int = RATE // 2) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, one column for each band."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    bins = np.arange(size // 2 + 1) * rate / size
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_FILTER, _BANK, _HANN = low_pass(1, 2), mel_bank(), np.hanning(FRAME + 2)[1:-1].astype(np.float32)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames (half overlapping, the last filled up with silence) by bands."""
    y = resample((samples.astype(np.float32) - 128) / 128, 1, 2, _FILTER)
    n = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    y = np.concatenate((y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32))) if len(y) < (n - 1) * HOP + FRAME else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n] * _HANN
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(power.astype(np.float32) @ _BANK + np.float32(1e-6))


def segments(energy: np.ndarray, begin: float = BEGIN, stop: float = STOP) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of frames that start above ``begin`` and last while energies stay at ``stop`` or above (over the median)."""
    e = energy - np.sort(energy)[len(energy) // 2]
    low = np.zeros(len(e) + 2, np.int8)
    low[1:-1] = e >= stop
    edge = np.diff(low)
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    loud = np.flatnonzero(e > begin)
    if not len(loud) or not len(opens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(loud, opens)
    first = loud[np.minimum(at, len(loud) - 1)]
    keep = (at < len(loud)) & (first < closes)
    return first[keep], closes[keep]


def tensors_of(mel: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Frames ``begin`` to ``end`` of each segment averaged into SLOTS by BANDS; short segments repeat frames."""
    slot = np.arange(SLOTS + 1)
    edge = begin[:, None] + slot * (end - begin)[:, None] // SLOTS
    low, high = edge[:, :-1], np.maximum(edge[:, :-1] + 1, edge[:, 1:])
    sums = np.concatenate((np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)))
    return ((sums[high] - sums[low]) / (high - low)[:, :, None]).astype(np.float32)


def features(stored: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Time spans in milliseconds, tensors (segments, SLOTS, BANDS) and the number of frames."""
    rate, payload = from_wav(stored)
    mel = log_mel(np.frombuffer(payload, np.uint8))
    begin, end = segments(mel.mean(axis=1))
    ms = 2000 / rate
    spans = np.stack([np.round(begin * HOP * ms), np.round(((end - 1) * HOP + FRAME) * ms)], axis=1).astype(np.int32)
    return spans, tensors_of(mel, begin, end), len(mel)


_SEGMENT = pa.struct([("begin_ms", pa.int32()), ("end_ms", pa.int32()), ("mel", pa.list_(pa.float32()))])
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("frames", pa.int32()), ("segments", pa.list_(_SEGMENT))])


def audio_column(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, frames, segments): the stored file and its features; ``mel`` has SLOTS x BANDS values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                raw = texts_of(part.column(1))
                media, frames, found = [], [], []
                for text in raw:
                    stored = to_wav(text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" "))
                    spans, tensors, n = features(stored)
                    media.append(stored)
                    frames.append(n)
                    found.append((spans, tensors))
                spans, tensors = np.concatenate([s for s, _ in found]), np.concatenate([t for _, t in found])
                mel = pa.ListArray.from_arrays(pa.array(np.arange(len(tensors) + 1, dtype=np.int32) * (SLOTS * BANDS)), pa.array(tensors.ravel()))
                flat = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1]), mel], fields=list(_SEGMENT))
                ends = np.cumsum([0] + [len(s) for s, _ in found]).astype(np.int32)
                yield to_batch({"doc_id": part.column(0), "n_bytes": list(map(len, raw)), "media": media, "frames": frames, "segments": pa.ListArray.from_arrays(pa.array(ends), flat)}, _ROWS)

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary, frames int, segments array<struct<begin_ms int, end_ms int, mel array<float>>>")


def as_tensors(mel: pa.Array) -> pa.ExtensionArray:
    """Lists of SLOTS x BANDS values as Arrow's fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SLOTS, BANDS), dim_names=["slot", "band"])
    flat = pa.array(mel.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False))  # a copy without the slice's offset
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, SLOTS * BANDS))


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored files, read back, and of their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _DIGEST}
            for n, stored in enumerate(b.column(2).to_pylist()):
                _, payload = from_wav(stored)
                begin, end, mel = b.column(4)[n].values.flatten()
                own = as_tensors(mel)
                digest = zlib.crc32(own.to_numpy_ndarray().astype("<f4", order="C").tobytes()) if len(own) else 0
                spans = zlib.crc32(np.stack([begin.to_numpy(), end.to_numpy()], 1).astype("<i4").tobytes())
                feature = f"frames={b.column(3)[n]};segments={len(own)};spans={spans:08x};mel={digest:08x}"
                for key, value in zip(out, (b.column(0)[n].as_py(), b.column(1)[n].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature), strict=True):
                    out[key].append(value)
            yield to_batch(out, _DIGEST)

    found = audio_column(table(spark, sf_dir, "documents"))
    return found.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
