"""Shared pieces: shared-folder checkpoints and vectorised work on Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: An odd base of the polynomial hash modulo 2^64 and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset on one machine (local master) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: written as Parquet to the shared folder and read again, so a lost executor costs no recomputation.

    The folder must outlive the lazily evaluated result; whoever owns spark.checkpoint.dir expires ``quillstone-*`` in it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many 64-bit keys (with little beside them) are broadcast; beyond that a join is left to Spark.
BROADCAST_KEYS = 1_000_000


def small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """keys, counted first and marked for broadcast if they are few; read twice, so they should be persisted."""
    return F.broadcast(keys) if keys.count() <= most else keys


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """By name; the operators select their inputs first, so a name is unique."""
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets.astype(np.int64) - first


def slices(offsets: np.ndarray, most: int = 1 << 18):
    """Row ranges of at most `most` bytes, a longer text alone, so that temporary arrays stay small and in the cache."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


#: Bytes hashed at a time, so that tables of powers and prefix sums stay as small for a text of any length.
CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2^64 for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK + 8)
        for key, base in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, U64(base), U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """H with H[e] - H[s] = sum of value(byte) * BASE**i over s <= i < e; a byte's value is itself + 1 if none are given."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1) if values is None else values[data]) * up[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hash of words that follow each other, CHUNK bytes at a time; a longer word piece by piece."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        first = starts[at]
        to = int(np.searchsorted(ends, first + CHUNK, "right"))
        if to > at:
            h = prefix_hash(data[first : ends[to - 1]])
            out[at:to] = span_hash(h, starts[at:to] - first, ends[at:to] - first)
        else:
            to, total = at + 1, 0
            for x in range(int(first), int(ends[at]), CHUNK):
                total += int(prefix_hash(data[x : min(x + CHUNK, ends[at])])[-1]) * pow(BASE, x - int(first), 2**64)
            out[at] = mix(np.array([total % 2**64], U64))[0]
        at = to
    return out


class Spans:
    """Hashes of spans of one text's bytes, each call's in order and none over the next; of a long text CHUNK bytes at a time."""

    def __init__(self, data: np.ndarray):
        self.data, self.h = data, prefix_hash(data) if len(data) <= CHUNK else None

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return word_hashes(self.data, starts, ends) if self.h is None else span_hash(self.h, starts, ends)


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_bytes(separators) -> np.ndarray:
    """True for the bytes of words; bytes of 0x80 and up belong to words."""
    t = np.ones(256, bool)
    for a, b in separators:
        t[a : b + 1] = False
    return t


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z, and `[^\x20\x09-\x0D]+`.
ALNUM = word_bytes(((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))
UNSPACED = word_bytes(((0x20, 0x20), (0x09, 0x0D)))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of all words, and for each text the index of its first word (with a last entry for the end)."""
    inside = is_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sub(offsets: np.ndarray, data: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    return data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
