"""Media columns: texts as WAV files, their short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples of an 8-bit mono WAV file written
and read back by the wave module. Frames of FRAME samples, HOP apart, are transformed; in each frame the strongest bin of
each band that exceeds the file's mean is a peak; every peak is paired with the peak of the next band in its own frame and
with the peaks of its own band in the next FAN frames. A pair is coded as (bin, other bin, distance) and stored with its
time, as an array of time << 32 | code.

Transforms run over blocks of at most BLOCK frames, so temporary memory does not grow with a text beyond its own bytes.

Defined results: a null text is an empty one (64 bytes 0, no peaks); equal texts give equal values; repeated rows stay;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RATE, UNIT = 8000, 64
FRAME, HOP, BANDS, FAN, BLOCK = 128, 64, 4, 2, 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)

RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("fingerprint", T.ArrayType(T.LongType())),
    ]
)


def encode(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(strongest bin of each band, whether it is a peak), one row a frame."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-max(0, len(x) - FRAME) // HOP) + 1
    edges = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)
    bins, power = np.zeros((n, BANDS), np.int64), np.zeros((n, BANDS), np.float32)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = x[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (b - a - 1) * HOP + FRAME - len(part)))
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        s = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))
        for i in range(BANDS):
            band = s[:, edges[i] : edges[i + 1]]
            bins[a:b, i] = band.argmax(axis=1) + edges[i]
            power[a:b, i] = band.max(axis=1)
    return bins, (power > power.mean(dtype=np.float64)) & (power > 1e-3)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs, by time, distance and band: time << 32 | bin << 20 | other bin << 8 | distance."""
    bins, is_peak = peaks(samples)
    t, band = np.nonzero(is_peak[:, :-1] & is_peak[:, 1:])
    found = [(t << 32) | (bins[t, band] << 20) | (bins[t, band + 1] << 8)]
    for d in range(1, FAN + 1):
        both = is_peak[:-d] & is_peak[d:] if len(bins) > d else np.zeros((0, BANDS), bool)
        t, band = np.nonzero(both)
        found.append((t << 32) | (bins[t, band] << 20) | (bins[t + d, band] << 8) | d)
    return np.sort(np.concatenate(found)).astype(np.int64)


def media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (unpadded), media (a WAV file) and its fingerprint."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(C.column(batch, "text"))
            for a, b in C.slices(offsets):
                sizes, files, prints = [], [], []
                for i in range(a, b):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    sizes.append(len(raw))
                    files.append(encode(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))))
                    prints.append(fingerprint(decode(files[-1])))
                yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], names=RESULT.names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


DIGEST = T.StructType(
    [
        *(T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_pairs", T.LongType()))),
    ]
)


def digest(stored: DataFrame) -> DataFrame:
    """What the media hold, from their stored bytes."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                file = C.column(batch, "media")[i].as_buffer()
                payload = decode(file)
                pairs = C.column(batch, "fingerprint")[i].values.to_numpy()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), hashlib.sha256(struct.pack("<q", len(pairs)) + pairs.tobytes()).hexdigest()[:32], len(pairs)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), C.column(batch, "n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=DIGEST.names)

    return stored.mapInArrow(run, DIGEST)


def op7_media(spark, sf_dir):
    return digest(media(C.table(spark, sf_dir, "documents")))
