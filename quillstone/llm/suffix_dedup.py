"""Removal of repeated byte strings of `length` bytes by threshold-bounded interval expansion on a BWT.

All strings of `length` bytes are cut into segments by content: each string has an anchor, its leftmost smallest hash of
GRAM bytes, and neighbouring strings with one anchor form a segment. Equal strings have equal anchors, so repeats are
found among segments with the same anchor:

1. anchors that occur once are dropped (counts are combined before the shuffle);
2. equal segments collapse to their first occurrence, all others are repeats as a whole;
3. segments that differ but share an anchor are compared: many anchors' segments make one text; from its Burrows-Wheeler
   transform, kept as a wavelet matrix, intervals of strings are extended backward breadth first. Strings of 1, 2, 3 ...
   bytes fix the boundaries in the suffix array where the common prefix is 0, 1, 2 ... bytes; expansion stops at `length`,
   and what no boundary divides shares at least `length` bytes. Of each such class all but the earliest are repeats.

An anchor with over HOT different segments (a common line after ever new text) is split before its strings are compared:
its segments are texts that are cut again by the smallest hash of a longer gram, at last of `length` bytes, and steps 1-3
are taken for these smaller segments. So one task's text is bounded for any number of them.

Texts are cut into pieces of SLICE bytes that overlap by `length` - 1, so that memory does not grow with a text's length.
Anchors and segments are known by two 64-bit hashes with unlike values for a byte; two segments are taken for equal if
both agree. Strings of different segments are compared byte by byte.

Defined results: a null text is an empty one; texts shorter than `length` are kept whole; a null id comes last; rows with
one id and text are one document (repeated rows get equal results); different texts of one id, or without an id, are
documents of their own, in the order of a 64-bit hash of the text, `variant`, which is 0 where an id occurs once; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 100, 32
#: Different segments of one anchor that one BWT may hold (each of less than 2 * LENGTH bytes).
HOT = 4096
#: Bytes of one BWT.
TEXT_BYTES = 1 << 20
#: Bytes of documents cut into segments at a time; temporary arrays take some 150 bytes for each and fit a core's cache.
SLICE = 1 << 17
_VALUES = C.mix(np.arange(256) + 0x5A17)

_SEGMENTS = "doc_id long, variant long, anchor long, seg long, a int, n int"
_RUNS = "doc_id long, variant long, a int, n int"
_DOC = ["doc_id", "variant"]


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, anchor hash, segment hash, first start in the text, number of strings) of all segments."""
    n, width = len(data), length - gram + 1
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    h = C.prefix_hash(data)
    at = np.arange(n - gram + 1)
    grams = C.span_hash(h, at, at + gram)
    bits = np.uint64((1 << max(22, n.bit_length())) - 1)
    keyed = (grams & ~bits) | at.astype(np.uint64)
    padded = np.full(-(-len(keyed) // width) * width + width, np.uint64(2**64 - 1))
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    counts = sizes[long] - length + 1
    text = np.repeat(long, counts)
    start = np.repeat(offsets[long], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (np.minimum(ahead[start], behind[start + width - 1]) & bits).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(start)))
    a = start[first]
    whole = C.span_hash(C.prefix_hash(data, _VALUES), a, a + runs - 1 + length)
    return text[first], grams[anchor[first]].view(np.int64), whole.view(np.int64), a - offsets[text[first]], runs


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions sorted by at least their first `depth` codes, by prefix doubling from 8 codes on."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    known = 8
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order
        ordered = key[order]
        new = np.ones(n, np.uint64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        later = np.zeros(n, np.uint64)
        later[: n - known] = rank[known:] if known < n else 0
        key = (rank << np.uint64(32)) | later
        known *= 2


class WaveletMatrix:
    """Ranks of all symbols over a sequence of small codes."""

    def __init__(self, codes: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, rest = [], codes
        for b in range(self.bits - 1, -1, -1):
            is_zero = (rest >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(is_zero)]).astype(np.int32))
            rest = np.concatenate([rest[is_zero], rest[~is_zero]])
        self.start = np.zeros(1 << self.bits, np.int32)
        values, at = np.unique(rest, return_index=True)
        self.start[values] = at

    def symbols(self, lo: np.ndarray, hi: np.ndarray):
        """For all intervals: (symbol, its rank before lo, its rank before hi), present symbols only."""
        symbol = np.zeros(len(lo), np.int32)
        for zeros in self.zeros:
            l0, h0 = zeros[lo], zeros[hi]
            l1, h1 = zeros[-1] + lo - l0, zeros[-1] + hi - h0
            a, b = h0 > l0, h1 > l1
            lo, hi = np.concatenate([l0[a], l1[b]]), np.concatenate([h0[a], h1[b]])
            symbol = np.concatenate([symbol[a] << 1, (symbol[b] << 1) | 1])
        return symbol, lo - self.start[symbol], hi - self.start[symbol]


def boundaries(codes: np.ndarray, order: np.ndarray, n_symbols: int, length: int) -> np.ndarray:
    """True at i if the suffixes order[i - 1] and order[i] share fewer than `length` codes. Code 0 divides texts: it is the
    last code of a string if it occurs in it at all."""
    n = len(codes)
    matrix = WaveletMatrix(codes[order - 1], n_symbols)  # the code before each suffix: the Burrows-Wheeler transform
    before = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1 << matrix.bits))]).astype(np.int32)
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)  # half the room of int64: this loop is most of the work
    for common in range(length):  # strings of `common` codes become strings of one more
        symbol, lo, hi = matrix.symbols(lo, hi)
        if common:
            own = symbol > 0
            symbol, lo, hi = symbol[own], lo[own], hi[own]
        lo, hi = lo + before[symbol], hi + before[symbol]
        new = ~fixed[hi]
        lo, hi = lo[new], hi[new]
        fixed[hi] = True
        if not len(hi):
            break
        hi, at = np.unique(hi, return_index=True)
        lo = lo[at]
    return fixed[:n]


def repeats(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, variants: np.ndarray, starts: np.ndarray, length: int):
    """(segment, offset, count) arrays: runs of strings that also occur earlier, by (doc, variant, start), in these segments,
    whose bytes are data[offsets[i] : offsets[i + 1]]."""
    sizes = np.diff(offsets)
    code = np.zeros(256, np.uint8)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    code[used] = np.arange(1, len(used) + 1)
    codes = np.zeros(len(data) + len(sizes), np.uint8)  # 0 after each segment
    codes[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = code[data]
    order = suffix_order(codes, length)
    fixed = boundaries(codes, order, len(used) + 2, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(codes)) - (offsets[:-1] + np.arange(len(sizes)))[owner]
    whole = (offset + length <= sizes[owner])[order]
    classes, at = np.cumsum(fixed)[whole], order[whole]
    several = np.bincount(classes, minlength=1)[classes] > 1
    classes, at = classes[several], at[several]
    sort = np.lexsort((starts[owner[at]] + offset[at], variants[owner[at]], docs[owner[at]], classes))
    classes, at = classes[sort], at[sort]
    later = np.zeros(len(at), bool)
    later[1:] = classes[1:] == classes[:-1]
    found = np.sort(at[later])
    first = np.ones(len(found), bool)
    first[1:] = np.diff(found) != 1
    first = np.flatnonzero(first)
    return owner[found[first]], offset[found[first]], np.diff(np.append(first, len(found)))


def _pieces(offsets: np.ndarray, length: int):
    """(text, start in it, first byte, last byte) of overlapping pieces of at most SLICE string starts."""
    n = np.maximum(1, -(-(np.diff(offsets) - length + 1) // SLICE))
    text = np.repeat(np.arange(len(n)), n)
    start = SLICE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return text, start, offsets[text] + start, np.minimum(offsets[text] + start + SLICE + length - 1, offsets[text + 1])


def _segment_rows(length: int, gram: int, column: str = "text"):
    """Of texts, or of segments cut before, whose place in the text is `a`."""

    def run(batches):
        for batch in batches:
            ids, variants = (C.column(batch, c).to_numpy(zero_copy_only=False) for c in _DOC)
            base = C.column(batch, "a").to_numpy().astype(np.int64) if "a" in batch.schema.names else np.zeros(len(batch), np.int64)
            data, offsets = C.text_buffers(C.column(batch, column))
            text, start, low, high = _pieces(offsets, length)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(high, low[at] + SLICE, "right")))
                if to - at == 1:
                    part, off = data[low[at] : high[at]], np.array([0, high[at] - low[at]])
                else:  # short texts, which follow each other
                    part, off = data[low[at] : high[to - 1]], np.append(low[at:to], high[to - 1]) - low[at]
                own, anchor, seg, a, n = segments_of(part, off, length, gram)
                row = text[at:to][own]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(variants[row]), pa.array(anchor), pa.array(seg), pa.array((a + start[at:to][own] + base[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names=[*_DOC, "anchor", "seg", "a", "n"])
                at = to

    return run


def _expanded(length: int):
    """Batches of segments, sorted by (anchor, seg): runs of repeats, anchors kept together, many in one BWT."""
    names = ("anchor", "seg", *_DOC, "a")

    def found(rows, data, offsets):
        _, _, docs, variants, starts = rows
        own, offset, n = repeats(data, offsets, docs, variants, starts.astype(np.int64), length)
        return pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(variants[own]), pa.array((starts[own] + offset).astype(np.int32)), pa.array(n.astype(np.int32))], names=[*_DOC, "a", "n"])

    def run(batches):
        rows, data, offsets = None, np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for batch in batches:
            more = [C.column(batch, c).to_numpy(zero_copy_only=False) for c in names]
            bytes_, ends = C.text_buffers(C.column(batch, "bytes"))
            rows = more if rows is None else [np.concatenate(x) for x in zip(rows, more, strict=True)]
            data, offsets = np.concatenate([data, bytes_]), np.concatenate([offsets, offsets[-1] + ends[1:]])
            new = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1  # anchors that begin; the last may go on in the next batch
            at = 0
            for to in new[np.flatnonzero(np.diff(offsets[new] // TEXT_BYTES))].tolist():
                yield found([x[at:to] for x in rows], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                at = to
            rows, data, offsets = [x[at:] for x in rows], data[offsets[at] :], offsets[at:] - offsets[at]
        if rows is not None and len(rows[0]):
            yield found(rows, data, offsets)

    return run


def _picked(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with these ids, and the others; few ids are broadcast, so that only picked texts are shuffled later."""
    side = C.small(C.persisted(ids.select(*_DOC).distinct(), "suffix-picked"))
    return docs.join(side, _DOC, "left_semi"), docs.join(side, _DOC, "left_anti")


def _with_variant(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with `variant`, a hash of the text where the id occurs more than once, otherwise 0; and one row of each text."""
    again = C.persisted(docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id", F.lit(True).alias("again")), "suffix-ids")
    zero = F.lit(0).cast("long")
    if again.isEmpty():
        docs = docs.withColumn("variant", zero)
        return docs, docs
    marked = docs.join(C.small(again), "doc_id", "left").select("doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(zero).alias("variant"), "again")
    more = C.persisted(marked.filter("again").groupBy(*_DOC).agg(F.max("text").alias("text")), "suffix-repeated")
    return marked.drop("again"), marked.filter("again is null").select("doc_id", "text", "variant").unionByName(more)


def _repeated(segments: DataFrame) -> DataFrame:
    """Those whose anchor occurs again. Both sides of the join are written or plain, so Spark may split a frequent anchor."""
    anchors = C.persisted(segments.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "suffix-anchors")
    return C.persisted(segments.join(anchors, "anchor", "left_semi"), "suffix-rows")


def _compared(rows: DataFrame, docs: DataFrame, length: int, grams: list[int], hot: int) -> DataFrame:
    """rows: segments whose anchors occur again, written out. Runs of strings that also start earlier."""
    first = C.persisted(rows.groupBy("anchor", "seg").agg(F.min(F.struct(*_DOC, "a")).alias("f"), F.max("n").alias("n"), F.count("*").alias("c")), "suffix-first")
    again = first.filter("c > 1").select("anchor", "seg", F.col("f.doc_id").alias("d"), F.col("f.variant").alias("v"), F.col("f.a").alias("b"))
    copies = rows.join(again, ["anchor", "seg"]).filter("doc_id <> d or variant <> v or a <> b").select(*_DOC, "a", "n")
    differing = C.persisted(first.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"), "suffix-differing")
    wanted = first.join(differing, "anchor").select("anchor", "seg", "k", F.col("f.doc_id").alias("doc_id"), F.col("f.variant").alias("variant"), F.col("f.a").alias("a"), "n")
    texts, _ = _picked(docs, wanted)
    body = F.substring(F.col("text").cast("binary"), F.col("a") + 1, F.col("n") + (length - 1))
    wanted = C.persisted(wanted.join(texts, _DOC).select("anchor", "seg", "k", *_DOC, "a", body.alias("bytes")), "suffix-bytes")
    differ = wanted.filter(F.col("k") <= hot).drop("k").repartition("anchor").sortWithinPartitions("anchor", "seg").mapInArrow(_expanded(length), _RUNS)
    out = copies.unionAll(differ)
    many = wanted.filter(F.col("k") > hot)
    if grams and not many.isEmpty():
        smaller = C.persisted(many.select(*_DOC, "a", "bytes").mapInArrow(_segment_rows(length, grams[0], "bytes"), _SEGMENTS), "suffix-smaller")
        out = out.unionAll(_compared(_repeated(smaller), docs, length, grams[1:], hot))
    return out


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: (doc_id long, variant long, neither ever null, together one row's; text). Runs of starts (doc_id, variant, a, n)
    of strings that also start earlier."""
    rows = _repeated(docs.mapInArrow(_segment_rows(length, gram), _SEGMENTS))
    return _compared(rows, docs, length, [(gram + length) // 2, length], hot)


def _cut(length: int):
    """(doc_id, text, runs): what remains of each text, as intervals, so that memory follows the text and its runs."""

    def run(batches):
        for batch in batches:
            out = []
            data, offsets = C.text_buffers(C.column(batch, "text"))
            for i, spans in enumerate(C.column(batch, "runs")):
                raw = data[offsets[i] : offsets[i + 1]]
                a, n = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate((a + n - 1 + length)[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                low, high = a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
                kept = [raw[x:y] for x, y in zip([0, *high.tolist()], [*low.tolist(), len(raw)], strict=True)]
                out.append((len(raw), int((high - low).sum()), len(low), np.concatenate(kept).tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes)."""
    last = F.lit(2**63 - 1)
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs, once = _with_variant(docs)
    runs = C.persisted(repeated_runs(once, length, gram, hot), "suffix-runs")
    cut, whole = _picked(docs, runs)
    by_doc = runs.groupBy(*_DOC).agg(F.collect_list(F.struct("a", "n")).alias("runs"))  # bounded by the document
    cut = cut.join(by_doc, _DOC).select("doc_id", "text", "runs").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionAll(whole).withColumn("doc_id", F.nullif("doc_id", last))


def op9_suffix_dedup(spark, sf_dir):
    return deduplicated(C.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
x AS (SELECT doc_id, min(i) AS low, max(i) + {LENGTH} AS high FROM g GROUP BY doc_id, span),
y AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM x),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept,
             sum(high - low) AS n_removed, count(*) AS n_spans FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
}


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
