"""Audio features of 8-bit sample media: polyphase resampling, overlapped log-mel filterbanks, hysteresis segments, Arrow tensors.

Media are WAV files of unsigned 8-bit mono samples, which hold any payload without loss. ``features`` reads the stored bytes back: samples go by
a polyphase filter from ``rate`` to ``rate * up / down``; overlapping windows give log-mel rows; energy opens a segment above one threshold and closes it
below a lower one. The rows are stored as fixed-shape Arrow tensors (``frames`` x ``mels`` each, the last filled up with the floor) in an Arrow
stream with the time span of each tensor and of each segment; such streams are a column of a written table, and what is told of the features is read from there.

Defined cases: null and empty texts are one frame of filler bytes; equal payloads (ties, repeated rows) give equal bytes, tensors and features; media are resampled and turned into features in pieces of
``piece`` frames, so that beside a very long medium itself only its 8-bit samples and its rows are held; bytes that aren't such a WAV file raise ValueError; an empty table gives an empty result. These are column
functions: other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F

HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class Audio:
    rate: int = 16000
    up: int = 5
    down: int = 8
    window: int = 250  # of resampled samples, 25 ms
    hop: int = 100
    fft: int = 256
    mels: int = 24
    frames: int = 32
    open_db: float = 3.0  # above the mean energy
    close_db: float = -1.0
    floor: float = -8.0


def payload_of(text: str | None, unit: int = 576) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def wav_of(payload: bytes, rate: int) -> bytes:
    odd = len(payload) % 2
    return HEADER.pack(b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\x00" * odd


def payload_in(wav: bytes) -> bytes:
    riff, _, wave, fmt, _, codec, channels, _, _, _, bits, data, n = HEADER.unpack_from(wav)
    if (riff, wave, fmt, data, codec, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(wav) < HEADER.size + n:
        raise ValueError("not a WAV file of 8-bit mono samples")
    return wav[HEADER.size : HEADER.size + n]


def polyphase_bank(up: int, down: int, half: int = 8) -> tuple[np.ndarray, int]:
    """One filter column for each of the ``up`` phases, over windows of the input that start every ``down`` samples, and the samples before the first."""
    reach = half * max(up, down)
    t = np.arange(-reach, reach + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    h *= up / h.sum()
    before = reach // up
    width = before + down + reach // up + 2
    bank = np.zeros((width, up), np.float32)
    for r in range(up):  # output r of a window stands at r * down / up input samples
        for j in range(width):
            at = (j - before) * up - r * down
            if -reach <= at <= reach:
                bank[j, r] = h[at + reach]
    return bank, before


def resampled(x: np.ndarray, a: Audio, first: int = 0, last: int | None = None) -> np.ndarray:
    """Samples ``first`` up to ``last`` (all) of the signal at the new rate. ``x`` may be unsigned 8-bit samples or floats."""
    bank, before = polyphase_bank(a.up, a.down) if a != Audio() else _BANK
    total = -(-len(x) * a.up // a.down)
    last = total if last is None else min(last, total)
    w0, w1 = first // a.up, -(-last // a.up)  # windows of the input, ``up`` outputs each
    lo, hi = w0 * a.down - before, (w1 - 1) * a.down - before + len(bank)
    part = x[max(0, lo) : max(0, hi)]
    part = (part.astype(np.float32) - 128) / 128 if part.dtype == np.uint8 else part
    padded = np.zeros(hi - lo, np.float32)
    padded[max(0, -lo) : max(0, -lo) + len(part)] = part
    return (sliding_window_view(padded, len(bank))[:: a.down] @ bank).reshape(-1)[first - w0 * a.up : last - w0 * a.up]


def mel_bank(a: Audio) -> np.ndarray:
    rate = a.rate * a.up / a.down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), a.mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(a.fft, 1 / rate)[:, None]
    low, mid, high = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


_BANK, _MELS, _HANN = polyphase_bank(5, 8), mel_bank(Audio()), np.hanning(250).astype(np.float32)


def log_mels(y: np.ndarray, a: Audio, piece: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Rows of log-mel values and the energy of each frame in dB, of a signal at the new rate."""
    return _log_mels(lambda i, j: y[i:j], len(y), a, piece)


def media_mels(x: np.ndarray, a: Audio, piece: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The same of samples at the old rate, resampled piece by piece."""
    return _log_mels(lambda i, j: resampled(x, a, i, j), -(-len(x) * a.up // a.down), a, piece)


def _log_mels(signal, length: int, a: Audio, piece: int) -> tuple[np.ndarray, np.ndarray]:
    mels, hann = (_MELS, _HANN) if a == Audio() else (mel_bank(a), np.hanning(a.window).astype(np.float32))
    n = max(1, 1 + (length - a.window) // a.hop)
    rows, energy = np.empty((n, a.mels), np.float32), np.empty(n, np.float32)
    for i in range(0, n, piece):
        j = min(n, i + piece)
        y = signal(i * a.hop, min(length, (j - 1) * a.hop + a.window))
        y = np.pad(y, (0, max(0, a.window - len(y))))
        w = sliding_window_view(y, a.window)[:: a.hop]
        energy[i:j] = 10 * np.log10(1e-8 + np.einsum("ij,ij->i", w, w) / a.window)
        spectrum = np.fft.rfft(w * hann, a.fft, axis=1)
        rows[i:j] = np.log10(10.0**a.floor + (spectrum.real**2 + spectrum.imag**2) @ mels)
    return rows, energy


def segments_of(energy: np.ndarray, a: Audio) -> np.ndarray:
    """(first frame, frame after the last) of the stretches of sound."""
    middle = float(energy.mean())
    mark = np.where(energy >= middle + a.open_db, 1, np.where(energy < middle + a.close_db, -1, 0)).astype(np.int8)
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[np.maximum(last, 0)] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def _schema(a: Audio) -> pa.Schema:
    return pa.schema([("kind", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float16(), (a.frames, a.mels)))])


def tensors_of(rows: np.ndarray, segments: np.ndarray, a: Audio) -> bytes:
    """An Arrow stream: a row per tensor with its time span, then a row per segment with a null tensor."""
    seconds = a.hop * a.down / (a.rate * a.up)
    n = math.ceil(len(rows) / a.frames)
    flat = np.full((n * a.frames, a.mels), a.floor, np.float16)
    flat[: len(rows)] = rows
    kind = _schema(a).field("log_mel").type
    k = len(segments)
    blank = np.zeros(k * a.frames * a.mels, np.float16)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([flat.reshape(-1), blank])), a.frames * a.mels, mask=pa.array([False] * n + [True] * k))
    starts = np.concatenate([np.arange(n) * a.frames, segments[:, 0]]) * seconds
    ends = np.concatenate([np.minimum((np.arange(n) + 1) * a.frames, len(rows)), segments[:, 1]]) * seconds
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _schema(a)) as out:
        out.write_batch(pa.record_batch([pa.array(["mel"] * n + ["segment"] * k), pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(kind, storage)], schema=_schema(a)))
    return sink.getvalue().to_pybytes()


def digest_of(tensors: bytes, a: Audio) -> str:
    """A short text form of a stored feature stream: frames, segments, share of sound, and mean level of each band in quarters."""
    with pa.ipc.open_stream(tensors) as r:
        t = r.read_all()
    seconds = a.hop * a.down / (a.rate * a.up)
    kinds = np.array(t["kind"].to_pylist())
    mel, seg = kinds == "mel", kinds == "segment"
    spans = np.round(np.array(t["end_s"]) / seconds).astype(int) - np.round(np.array(t["start_s"]) / seconds).astype(int)
    n = int(spans[mel].sum())
    storage = t["log_mel"].combine_chunks().storage.slice(0, int(mel.sum())).flatten().to_numpy().astype(np.float64).reshape(-1, a.mels)[:n]
    return f"{n}f;{int(seg.sum())}s;{round(1000 * int(spans[seg].sum()) / max(1, n))}m;" + ",".join(str(round(4 * v)) for v in storage.mean(0))


def _by_parts(rows: pa.Array, f, many: int = 500) -> pa.Array:
    """``f`` over slices of a batch, so that Python objects of few rows are held at once."""
    return pa.concat_arrays([f(rows.slice(i, many)) for i in range(0, max(1, len(rows)), many)])


def to_media(text, a: Audio = Audio()):
    """WAV bytes of a text column."""

    @F.arrow_udf("binary")
    def media(texts: pa.Array) -> pa.Array:
        return _by_parts(texts, lambda part: pa.array([wav_of(payload_of(t), a.rate) for t in part.to_pylist()], pa.binary()))

    return media(text)


def features(media, a: Audio = Audio()):
    """Of a column of media: the payload's length, hash and tail checksum, the media's length and hash, and the tensors."""
    kind = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int32()), ("n_segments", pa.int32()), ("tensors", pa.binary())])

    def part_of(wavs: pa.Array) -> pa.Array:
        out = []
        for w in wavs:
            wav = w.as_py()
            payload = payload_in(wav)
            rows, energy = media_mels(np.frombuffer(payload, np.uint8), a)
            segments = segments_of(energy, a)
            out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(wav), "media_sha256": hashlib.sha256(wav).hexdigest(), "n_frames": len(rows), "n_segments": len(segments), "tensors": tensors_of(rows, segments, a)})
        return pa.array(out, kind)

    @F.arrow_udf("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_frames int, n_segments int, tensors binary")
    def read(wavs: pa.Array) -> pa.Array:
        return _by_parts(wavs, part_of)

    return read(media)


def digest(tensors, a: Audio = Audio()):
    @F.arrow_udf("string")
    def of(streams: pa.Array) -> pa.Array:
        return pa.array([digest_of(s, a) for s in streams.to_pylist()], pa.string())

    return of(tensors)
