"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of `window` consecutive words of a benchmark item; an item with fewer words is one pattern.
Patterns of one length share a SHIFT table over blocks of two words (one for single-word patterns): a position whose
block is in no pattern is skipped by as much as the table allows. Where the shift is 0, the block's hash picks a bucket
of patterns; their words' hashes and at last the bytes themselves are compared.

The benchmark is normalised and cut into pieces by the executors, and dealt out in blocks of at most BLOCK_CHARS
characters. A block is broadcast as text; each Python worker builds its tables once, as arrays (some 70 bytes a word:
hashes, shifts, buckets, owners; windows are places in them, not texts). Each block is one pass over the documents, so the
benchmark may be of any size.

Defined results: a null or empty text has no words and is clean; a null item text has no patterns; an item with a null
id contaminates but is not listed; repeated items and documents are looked up row by row; other columns of either table
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
#: Characters of benchmark text searched for in one pass over the documents, and windows of one piece of an item.
BLOCK_CHARS, PIECE_WINDOWS = 8 << 20, 100_000
LANE = 512
_K1 = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("text_id", T.LongType()),
    ]
)


def hashed_words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, first word of each text, hash of each word)."""
    low = C.lower_table()[data]
    starts, ends, first = C.words(low, offsets, C.ALNUM)
    return low, starts, ends, first, C.word_hashes(low, starts, ends)


def _in_order(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[i] - 1 for each i, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Length:
    """The tables for all patterns of one length in words: arrays over the words of the block's pieces."""

    def __init__(self, m: int, data, starts, ends, h: np.ndarray, wins: np.ndarray, owners: np.ndarray):
        """wins: first word of each window; owners: its item."""
        self.m, self.block, self.h = m, min(2, m), h
        self.data, self.starts, self.ends = data, starts, ends
        same = np.zeros(len(wins), np.uint64)
        for j in range(m):
            same = C.mix(same * _K1 + h[wins + j])
        order = np.argsort(same, kind="stable")
        wins, owners = wins[order], owners[order]
        new = np.zeros(len(wins), bool)
        new[:1] = True
        for j in range(m):  # equal windows follow each other
            new[1:] |= h[wins[1:] + j] != h[wins[:-1] + j]
        self.first = wins[new].astype(np.int32)
        pairs = np.unique(np.stack([np.cumsum(new) - 1, owners]), axis=1)
        self.owners = pairs[1][pairs[1] >= 0].astype(np.int32)
        self.bounds = np.searchsorted(pairs[0][pairs[1] >= 0], np.arange(len(self.first) + 1)).astype(np.int32)
        self.mask = np.uint64((1 << max(12, int(len(h) * 8).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint8 if m < 250 else np.int32)
        blocks = self.blocks(h)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, (blocks[self.first + j] & self.mask).astype(np.int64), m - 1 - j)
        last = blocks[self.first + m - 1]
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.suffix = last[self.order]

    def text(self, p: int) -> bytes:
        i = self.first[p]
        return self.data[self.starts[i] : self.ends[i + self.m - 1]].tobytes()

    def items(self, p: int) -> np.ndarray:
        return self.owners[self.bounds[p] : self.bounds[p + 1]]

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at each word."""
        if self.block == 1:
            return h
        out = h.copy()
        out[1:] = C.mix(h[:-1] * _K1 + h[1:])
        return out

    def occurrences(self, h, first, text_of):
        """(index of the last word, pattern) of all occurrences inside single texts."""
        m = self.m
        lo, hi = first[:-1] + (m - 1), first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // LANE))
        at = np.repeat(lo, lanes) + LANE * _in_order(lanes)
        end = np.minimum(at + LANE, np.repeat(hi, lanes))
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks, found = self.blocks(h), []
        while len(at):  # all lanes step together
            s = self.shift[(blocks[at] & self.mask).astype(np.int64)]
            found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            still = at < end
            at, end = at[still], end[still]
        at = np.concatenate(found)
        a, b = np.searchsorted(self.suffix, blocks[at], "left"), np.searchsorted(self.suffix, blocks[at], "right")
        n = b - a
        where = np.repeat(at, n)
        pattern = self.order[np.repeat(a, n) + _in_order(n)]
        for j in range(m):  # from the prefix on; few remain after the first
            same = h[where - m + 1 + j] == self.h[self.first[pattern] + j]
            where, pattern = where[same], pattern[same]
        exact = np.fromiter((self.text(p) == text_of(w - m + 1, w) for w, p in zip(where, pattern, strict=True)), bool, len(where))
        return where[exact], pattern[exact]


def _pieces(window: int):
    """item and its words, one space between; a long item in pieces that have each of its windows once."""

    def run(batches):
        for batch in batches:
            data, offsets = C.text_buffers(C.column(batch, "text"))
            item, texts = [], []
            for i, name in enumerate(C.column(batch, "item").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                low = C.lower_table()[raw]
                starts, ends, _ = C.words(low, np.array([0, len(low)]), C.ALNUM)
                for at in range(0, max(min(1, len(starts)), len(starts) - window + 1), PIECE_WINDOWS):
                    part = slice(at, at + PIECE_WINDOWS + window - 1)
                    item.append(name)
                    texts.append(b" ".join(low[x:y].tobytes() for x, y in zip(starts[part].tolist(), ends[part].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["item", "words"])

    return run


def tables(block: tuple[list[str | None], list[bytes]], window: int) -> tuple[list[str], list[Length]]:
    """(names of the items, tables of each pattern length) of a block of pieces."""
    names, texts = block
    known = sorted({n for n in names if n is not None})
    number = {n: i for i, n in enumerate(known)}
    item = np.array([number.get(n, -1) for n in names], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    low, starts, ends, first, h = hashed_words(data, offsets)
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    counts = np.diff(first)
    m = np.minimum(window, counts)
    found = []
    for k in np.unique(m[m > 0]).tolist():
        own = np.flatnonzero(m == k)
        n = counts[own] - k + 1
        found.append(Length(k, low, starts, ends, h, np.repeat(first[own], n) + _in_order(n), np.repeat(item[own], n)))
    return known, found


_built: dict[str, tuple[list[str], list[Length]]] = {}


def _tables_of(name: str, shared, window: int) -> tuple[list[str], list[Length]]:
    """Built once in a Python worker, which holds one block's tables at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = tables(shared.value, window)
    return _built[name]


def searched(texts: pa.Array, known: list[str], lengths: list[Length]):
    """For each text: (words, indices of hit words, items)."""
    data, offsets = C.text_buffers(texts)
    for a, b in C.slices(offsets):
        part, off = C.sub(offsets, data, a, b)
        low, starts, ends, first, h = hashed_words(part, off)
        text_of = lambda i, j: b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(i, j + 1))  # noqa: B023, E731
        hit, items = np.zeros(len(h) + 1, np.int32), {}
        for x in lengths:
            last, pattern = x.occurrences(h, first, text_of)
            np.add.at(hit, last - x.m + 1, 1)
            np.add.at(hit, last + 1, -1)
            for row, p in set(zip((np.searchsorted(first, last, "right") - 1).tolist(), pattern.tolist(), strict=True)):
                items.setdefault(row, set()).update(x.items(p).tolist())
        inside = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
        bounds = np.searchsorted(inside, first)
        for i in range(b - a):
            yield int(first[i + 1] - first[i]), inside[bounds[i] : bounds[i + 1]] - first[i], sorted(known[k] for k in items.get(i, ()))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_chars: int):
    """Broadcast blocks of pieces of at most block_chars bytes, or of one longer piece, with a name each; one at least."""
    pieces = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(_pieces(window), "item string, words string")
    share = lambda names, texts: (uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast((names, texts)))
    names, texts, size = [], [], 0
    for item, words in pieces.toLocalIterator():
        words = words.encode()
        if names and size + len(words) > block_chars:
            yield share(names, texts)
            names, texts, size = [], [], 0
        names.append(item)
        texts.append(words)
        size += len(words)
    yield share(names, texts)


def search(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, hits (indices of hit words, ascending), items (ids as strings, sorted)."""
    out = []
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_id"))
    for name, shared in _blocks(benchmark, item_col, item_text_col, window, block_chars):

        def run(batches, name=name, shared=shared):
            for batch in batches:
                found = searched(C.column(batch, "text"), *_tables_of(name, shared, window))
                n, hits, items = zip(*found, strict=True) if len(batch) else ((), (), ())
                yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), C.column(batch, "text_id")], names=["doc_id", "n_words", "hits", "items", "text_id"])

        out.append(docs.mapInArrow(run, SCHEMA))
    if len(out) == 1:
        return out[0].drop("text_id")
    every = out[0].withColumn("copy", F.lit(1))
    for more in out[1:]:
        every = every.unionAll(more.filter("size(hits) > 0").withColumn("copy", F.lit(0)))
    merged = every.groupBy("doc_id", "text_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum("copy").alias("copies"),
    )  # a group: the blocks' rows of one document, of repeated ones once
    return merged.select("doc_id", "n_words", "hits", "items", F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy")).drop("copy")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, in whose text no window occurs. With more than one block of benchmark, the texts' hashes
    are gathered from each pass and taken out at the end."""
    blocks = list(_blocks(benchmark, item_col, item_text_col, window, block_chars))
    if len(blocks) == 1:
        position = documents.columns.index(text_col)
        name, shared = blocks[0]

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([not len(hits) for _, hits, _ in searched(batch.column(position), *_tables_of(name, shared, window))], pa.bool_()))

        return documents.mapInArrow(run, documents.schema)
    docs, hit = documents.select(F.col(text_col).alias("text"), F.md5(text_col).alias("text_id")), None
    for name, shared in blocks:

        def bad(batches, name=name, shared=shared):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([C.column(batch, "text_id").filter(pa.array([len(hits) > 0 for _, hits, _ in searched(C.column(batch, "text"), *_tables_of(name, shared, window))], pa.bool_()))], names=["__hit"])

        found = docs.mapInArrow(bad, "__hit string")
        hit = found if hit is None else hit.unionAll(found)
    hit = C.small(C.persisted(hit.distinct(), "benchmark-hits"))
    return documents.join(hit, F.md5(text_col) == F.col("__hit"), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op1_decontaminate(spark, sf_dir):
    return digest(search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")))


_W = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_W}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_W}) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
s AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
      FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
o AS (SELECT s.doc_id, s.i, s.m, p.item_id FROM s JOIN p ON s.m = p.m AND s.t = p.t),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
