"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segmentation.

A media column holds WAV bytes (8-bit unsigned mono PCM). The features of a clip: it is resampled by UP/DOWN with a
polyphase windowed-sinc filter, cut in overlapping frames, and given log-mel energies; frames whose energy rises
above HIGH (relative to the clip's range) open a segment that lasts until it falls below LOW. The log-mel frames are
stored as fixed-shape Arrow tensors: an Arrow stream of chunks of FRAMES x MELS floats (the last one padded with
zeros) with each chunk's span in seconds and its number of frames.

Every clip is computed by itself, so equal clips give equal bytes; spectra are made in blocks of frames, and what
grows with a clip's length is a few times its own size.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, utf8

#: Fixed values of the WAV format: chunk ids, PCM, the header's size.
RIFF, WAVE_FMT, DATA, PCM, HEADER = b"RIFF", b"WAVEfmt ", b"data", 1, 44
RATE, UP, DOWN, TAPS = 16000, 5, 8, 16
WINDOW, HOP, FFT, MELS, FRAMES = 256, 128, 256, 32, 64
HIGH, LOW, LEAST = 0.6, 0.4, 3
#: Frames, or outputs of a phase, that are computed at once.
BLOCK = 4096
ALIGN = 64


def le32(n: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def wav(samples: Column, rate: int = RATE) -> Column:
    """WAV bytes of 8-bit mono samples."""
    n = F.octet_length(samples)
    fmt = RIFF, WAVE_FMT + struct.pack("<IHHIIHH", 16, PCM, 1, rate, rate, 1, 8) + DATA
    return F.concat(F.lit(fmt[0]), le32(n + HEADER - 8), F.lit(fmt[1]), le32(n), samples)


def payload(data: Column) -> Column:
    """Bytes with zeros up to a positive multiple of ALIGN."""
    n = F.octet_length(data)
    return F.rpad(data, F.greatest(F.lit(ALIGN), F.ceil(n / ALIGN) * ALIGN).cast("int"), F.lit(b"\0"))


def read_wav(data) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file of 8-bit mono PCM; ValueError for others."""
    view = memoryview(data)
    if view[:4] != RIFF or view[8:12] != WAVE_FMT[:4]:
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(view):
        (n,) = struct.unpack_from("<I", view, at + 4)
        if view[at : at + 4] == WAVE_FMT[4:]:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (kind, channels, bits) != (PCM, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif view[at : at + 4] == DATA:
            if rate is None or at + 8 + n > len(view):
                raise ValueError("broken WAV file")
            return np.frombuffer(view[at + 8 : at + 8 + n], dtype=np.uint8), rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


@functools.cache
def filters(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both rates, by phase: row p weighs the samples around an output p / up after one."""
    half = -(-TAPS * max(2 * up, down) // (2 * up))  # as many zero crossings at any ratio
    t = np.arange(-half, half + 1)[None, :] - np.arange(up)[:, None] / up
    bank = np.sinc(min(1.0, up / down) * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / (half + 1), -1, 1)))
    return (bank / bank.sum(axis=1, keepdims=True)).astype(np.float32)


@functools.cache
def mel_bank(rate: float) -> np.ndarray:
    """Triangles of equal width in mel, from 0 to half the rate: (FFT / 2 + 1) x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.linspace(0, mel(rate / 2), MELS + 2)
    at = mel(np.arange(FFT // 2 + 1) * rate / FFT)[:, None]
    up, down = (at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Samples at up / down times their rate; output k lies at input k * down / up. Each phase filters every up-th output."""
    bank, n = filters(up, down), -(-len(x) * up // down)
    half = bank.shape[1] // 2
    padded = np.concatenate([np.zeros(half, np.float32), x, np.zeros(half + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, bank.shape[1])
    out = np.empty(n, dtype=np.float32)
    for first in range(min(up, n)):
        begin, phase = divmod(first * down, up)
        for k in range(first, n, up * BLOCK):
            own = out[k : k + up * BLOCK : up]
            at = begin + down * ((k - first) // up)
            own[:] = windows[at : at + down * (len(own) - 1) + 1 : down] @ bank[phase]
    return out


HANN = np.hanning(WINDOW + 2)[1:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Log-mel energies of frames of WINDOW samples every HOP; a clip has one frame at least, the last one padded."""
    n = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    out = np.empty((n, MELS), dtype=np.float32)
    bank = mel_bank(rate)
    for at in range(0, n, BLOCK):
        s = np.fft.rfft(frames[at : at + BLOCK] * HANN, FFT)
        out[at : at + BLOCK] = (s.real**2 + s.imag**2).astype(np.float32) @ bank
    return np.log10(out + np.float32(1e-10))


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames [first, end): opened above HIGH, closed below LOW of the clip's energy range, LEAST frames or more."""
    energy = mel.mean(axis=1)
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-6:
        return []
    level = (energy - low) / (high - low)
    state = np.where(level >= HIGH, 1, np.where(level < LOW, 0, -1))
    # frames between both thresholds keep the state of the last decided one
    decided = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(decided >= 0, state[np.maximum(decided, 0)], 0)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True) if b - a >= LEAST]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
CHUNKS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32()), ("log_mel", TENSOR)])


def tensors(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of CHUNKS."""
    n = -(-len(mel) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), dtype=np.float32)
    full[: len(mel)] = mel
    first = np.arange(n) * FRAMES
    count = np.minimum(FRAMES, len(mel) - first)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
    b = pa.RecordBatch.from_arrays([pa.array(first * HOP / rate), pa.array(((first + count - 1) * HOP + WINDOW) / rate), pa.array(count, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, storage)], schema=CHUNKS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CHUNKS) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """The chunks of a stored feature column; log_mel.chunk(0).to_numpy_ndarray() is an array (chunk, FRAMES, MELS)."""
    return pa.ipc.open_stream(data).read_all()


FEATURES = "reason string, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, segments array<struct<start_s double, end_s double>>, tensors binary"


def features_of(media, up: int = UP, down: int = DOWN) -> tuple:
    """FEATURES of one clip; the reason is null unless media is no clip, and then all others are."""
    try:
        samples, rate = read_wav(b"" if media is None else media)
    except (ValueError, struct.error) as e:
        return "no media" if media is None else str(e), *[None] * 6
    rate = rate * up / down
    mel = log_mel(resample((samples.astype(np.float32) - 128) / 128, up, down), rate)
    found = [{"start_s": a * HOP / rate, "end_s": ((e - 1) * HOP + WINDOW) / rate} for a, e in segments(mel)]
    return None, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ALIGN:]), len(mel), found, tensors(mel, rate)


def _features(up: int, down: int):
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["reason", "payload_bytes", "payload_sha256", "tail_crc32", "n_frames", "segments", "tensors"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), spans, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, at = [], 0, 0
            for i in range(len(b)):
                held.append(features_of(b.column(1)[i].as_buffer(), up, down))
                size += len(held[-1][-1] or b"")
                if size > 8 << 20 or i == len(b) - 1:
                    columns = [pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0)[at : i + 1], *columns], names=["key", *names])
                    held, size, at = [], 0, i + 1

    return run


def audio_features(clips: DataFrame, key_col: str, media_col: str = "media", up: int = UP, down: int = DOWN) -> DataFrame:
    """Features of every clip, resampled by up / down: key_col, reason, payload_bytes (samples), payload_sha256, tail_crc32 (of
    the last 64 samples), n_frames, segments (spans in seconds) and tensors (an Arrow stream, see read_tensors()).

    Rows may repeat, null keys are kept, other columns have no influence. A clip without samples has one frame of
    silence; long ones are read whole. Where media is null or no WAV of 8-bit mono PCM, reason says so and the features
    are null. An empty table gives an empty result.
    """
    kind = clips.schema[key_col].dataType.simpleString()
    rows = clips.select(F.col(key_col).alias("key"), F.col(media_col).alias("media"))
    return rows.mapInArrow(_features(up, down), f"key {kind}, {FEATURES}").withColumnRenamed("key", key_col)


def text_clips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts' UTF-8 bytes (null: empty), padded, as clips: id_col, n_bytes, media."""
    data = utf8(F.col(text_col))
    return docs.select(F.col(id_col), F.octet_length(data).cast("long").alias("n_bytes"), wav(payload(data)).alias("media"))


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    clips = text_clips(table(spark, sf_dir, "documents"))
    key = F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    got = audio_features(clips.select(key.alias("key"), "media"), "key")
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("log_mel="), F.sha2("tensors", 256)))
    return got.select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "key.media_bytes", "key.media_sha256", feature.alias("feature"))
