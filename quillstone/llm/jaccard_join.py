"""N-gram Jaccard join with signature trees.

Two documents link if 100 * shared shingles >= `percent` * all their shingles; the result has each document's component.

1. Equal sets collapse by a 64-bit sum of scrambled hashes (chance of any false match: documents squared / 2^65). One text
   speaks for all that have its set.
2. Sets that may link are brought together without losing a pair: sets of about one size are cut by a hash of the
   shingles into more parts than two linked sets can differ in shingles, by 1 + `spare`: so many parts are equal in both.
   A set with at most `spare` empty parts drops, of its shared parts, as many as it has fewer empty ones than that, those
   that most sets have; the rarest part that two linked sets share is never dropped, and a set with too few shared parts
   has no link at all. Other sets have keys for their empty parts too, which only such sets share, and drop none: a linked
   set without such keys may share but one part with them. Sets with a key in common are candidates, within one class of
   sizes; a set near the end of its class is in the next one too, as a node of its own.
3. The sets of a connected component of candidate nodes are the leaves of a signature tree, whose nodes hold OR-combined bitmaps
   of shingles, ranges of sizes and the most shingles hidden by shared bits. A dual traversal drops pairs of nodes whose
   largest possible overlap is too small, and pairs that are connected already; pairs of leaves left are compared exactly.
4. A component of more than a block (BLOCK sets or SHINGLES shingles) is joined in two rounds. First every set meets, in
   blocks, the first set of its rarest key; near copies settle there. Then only keys whose sets are not yet connected
   count: the sets outside the largest group of such a component, in blocks, meet each other and all of it, in blocks. So
   a group of near copies costs about its size, and what remains costs (sets not settled) x (sets) / block rows.

Texts are shingled anew in each step rather than kept, since a set takes more room than its text.

Defined results: null and blank texts have no shingles and are alone; a text of one or two words has one shingle; equal
sets of any size link; rows with a null id take part and are never a component's id (which is null where all of its rows
have none); different texts of one id are documents of their own that bear the same id; repeated rows get equal results;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORDS, PERCENT = 3, 90
#: Sets and shingles of a block; shingles gathered before a tree is built; children of a node.
BLOCK, SHINGLES, GATHER, FANOUT = 4096, 3_000_000, 2_000_000, 8

_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingles(texts: pa.Array, words: int = WORDS):
    """For row ranges: (first row, last row, sorted distinct hashes of all rows, row of each, bounds of each row's hashes)."""
    data, offsets = C.text_buffers(texts)
    for x, y in C.slices(offsets):
        part, off = C.sub(offsets, data, x, y)
        low = C.lower_table()[part]
        starts, ends, first = C.words(low, off, C.UNSPACED)
        w = C.word_hashes(low, starts, ends)
        counts = np.diff(first)
        n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
        row = np.repeat(np.arange(y - x), n)
        at = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = np.zeros(len(at), np.uint64)
        last = first[1:][row]
        for j in range(words):  # a short text's missing words count as 0
            inside = at + j < last
            h = C.mix(h * _A + np.where(inside, w[np.minimum(at + j, max(0, len(w) - 1))] if len(w) else 0, np.uint64(0)) + _B)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[fresh], row[fresh]
        yield x, y, h, row, np.searchsorted(row, np.arange(y - x + 1))


def _node(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h ^ _C), dtype=np.uint64)])
    return C.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _least_size(percent: int) -> int:
    """The smallest set that can link with a different one: it shares all its shingles with a set of one more."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


class Classes:
    """Classes of sizes with their numbers of parts. A set has its class's label, and the next one's if it may link there."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.edges, self.parts, self.spare = percent, [_least_size(percent)], [], []
        while self.edges[-1] <= largest or len(self.edges) < 3:
            self.edges.append(self.edges[-1] * 3 // 2 + 1)
        for top in self.edges[1:]:
            most = 2 * (top - 1) * (100 - percent) // (100 + percent)  # shingles that only one of two linked sets has
            self.spare.append(2 + most // 8)
            self.parts.append(most + 1 + self.spare[-1])

    def labels(self, n: np.ndarray):
        """(set, label) pairs."""
        own = np.searchsorted(self.edges, n, "right") - 1
        large = np.flatnonzero(own >= 0)
        own = own[large]
        edges = np.array([*self.edges, 1 << 60])
        more = np.flatnonzero((100 * n[large] >= self.percent * edges[own + 1]) & (own + 1 < len(self.parts)))
        return np.concatenate([large, large[more]]), np.concatenate([own, own[more] + 1])


def part_keys(h: np.ndarray, bounds: np.ndarray, percent: int):
    """Of all parts that are not empty: (index of the set's label, key); of all labels, by set: (set, need, label): a link shares
    at least `need` of these keys. A label whose set has more empty parts than the spare ones has a key for them too; it may be
    linked to a set that has none for its up to `spare` empty ones, so only one shared key is certain."""
    n = np.diff(bounds)
    classes = Classes(percent, int(n.max(initial=0)) * 2)
    sets, labels = classes.labels(n)
    order = np.argsort(sets, kind="stable")
    sets, labels = sets[order], labels[order]
    m, spare = np.array(classes.parts, np.int64)[labels], np.array(classes.spare, np.int64)[labels]
    base = np.cumsum(m) - m
    size = n[sets]
    pair = np.repeat(np.arange(len(sets)), size)
    element = np.repeat(bounds[sets], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    part = (C.mix(h[element] + labels[pair].astype(np.uint64) * _A) % m[pair].astype(np.uint64)).astype(np.int64)
    slot = base[pair] + part
    total = np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, slot, C.mix(h[element] ^ _B))
    filled = np.bincount(slot, minlength=len(total)) > 0
    owner = np.repeat(np.arange(len(sets)), m)
    empty = np.bincount(owner[~filled], minlength=len(sets))
    used = filled | (empty > spare)[owner]
    number = np.arange(len(total)) - base[owner]
    where = labels[owner].astype(np.uint64) * _C + number.astype(np.uint64)
    key = C.mix(total + C.mix(where))
    return owner[used], key[used], sets, 1 + spare - np.minimum(empty, spare), labels


def _described(words: int):
    def run(batches):
        for batch in batches:
            for x, y, h, _, bounds in shingles(C.column(batch, "text"), words):
                n = np.diff(bounds)
                rows = batch.slice(x, y - x)
                yield pa.RecordBatch.from_arrays([C.column(rows, "sid"), C.column(rows, "doc_id"), pa.array(n.astype(np.int64)), pa.array(_node(h, bounds).view(np.int64), mask=n == 0)], names=["sid", "doc_id", "n", "node"])

    return run


def _parts(percent: int, words: int):
    def run(batches):
        for batch in batches:
            sids = C.column(batch, "sid")
            for x, y, h, _, bounds in shingles(C.column(batch, "text"), words):
                owner, keys, sets, need, label = part_keys(h, bounds, percent)
                per_label = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(sets) + 1)).astype(np.int32)), pa.array(keys.view(np.int64)))
                groups = pa.StructArray.from_arrays([pa.array(label.astype(np.int32)), pa.array(need.astype(np.int32)), per_label], names=["label", "need", "keys"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(sets, np.arange(y - x + 1)).astype(np.int32)), groups)
                yield pa.RecordBatch.from_arrays([sids.slice(x, y - x), lists], names=["sid", "labels"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for x, y, h, _, bounds in shingles(C.column(batch, "text"), words):
                rows = batch.slice(x, y - x)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(C.column(rows, c) for c in ("sid", "comp", "i", "j", "root")), lists], names=["sid", "comp", "i", "j", "root", "hashes"])

    return run


class Tree:
    """Levels of nodes over sorted leaves; level 0 has the leaves."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray, roots: np.ndarray):
        sizes = np.array([len(s) for s in sets])
        bits = 1 << max(9, min(14, int(4 * np.median(sizes)).bit_length()))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = C.mix(s + _A) % np.uint64(bits)
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        hidden = sizes - np.bitwise_count(maps).sum(axis=1)
        self.levels = [(maps, sizes, sizes, hidden, groups, groups, roots, roots)]
        while len(maps) > FANOUT:
            at = np.arange(0, len(maps), FANOUT)
            maps, low, high, hidden, a, b, p, q = self.levels[-1]
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            least, most = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((maps, least(low, at), most(high, at), most(hidden, at), least(a, at), most(b, at), least(p, at), most(q, at)))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        maps, low, high, hidden, a, b, p, q = self.levels[level]
        keep = (a[x] <= b[y]) & (a[y] <= b[x]) & (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        keep &= (p[x] != q[x]) | (p[y] != q[y]) | (p[x] != p[y])  # all of one root
        x, y, at = x[keep], y[keep], np.flatnonzero(keep)
        shared = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[x], hidden[y])
        shared = np.minimum(shared, np.minimum(high[x], high[y]))
        return at[(100 + percent) * shared >= percent * (low[x] + low[y])]

    def pairs(self, percent: int, most: int = 1 << 12):
        """Blocks of pairs of different leaves that may link."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        x, y = np.triu_indices(n)
        stack = [(top, x, y)]
        while stack:
            level, x, y = stack.pop()
            if len(x) > most:
                stack.append((level, x[most:], y[most:]))
                x, y = x[:most], y[:most]
            keep = self.possible(level, x, y, percent)
            x, y = x[keep], y[keep]
            if not level:
                differ = x != y
                yield x[differ], y[differ]
                continue
            n = len(self.levels[level - 1][1])
            i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
            x, y = (x[:, None] * FANOUT + i).ravel(), (y[:, None] * FANOUT + j).ravel()
            inside = (x < n) & (y < n) & (x <= y)
            if inside.any():
                stack.append((level - 1, x[inside], y[inside]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def tree_join(ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(id, smallest id) of the components of links within groups, except where they are the same. Sets of one root are
    connected already."""
    order = np.lexsort(([len(s) for s in sets], [int(s[0]) for s in sets], roots, groups))
    ids, sets, groups = ids[order], [sets[i] for i in order], groups[order]
    _, first, root_of = np.unique(np.stack([groups, roots[order]]), axis=1, return_index=True, return_inverse=True)
    root_of = root_of.ravel()
    parent = first[root_of]

    def roots_now() -> np.ndarray:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        return parent

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in Tree(sets, groups, root_of).pairs(percent):
        for k in range(0, len(x), 1024):
            own = roots_now()
            apart = own[x[k : k + 1024]] != own[y[k : k + 1024]]
            for i, j in zip(x[k : k + 1024][apart].tolist(), y[k : k + 1024][apart].tolist(), strict=True):
                p, q = root(i), root(j)
                if p != q and linked(sets[i], sets[j], percent):
                    parent[max(p, q)] = min(p, q)
    own = roots_now()
    least: dict[int, int] = {}
    for r, n in zip(own.tolist(), ids.tolist(), strict=True):
        least[r] = min(n, least.get(r, n))
    return [(n, least[r]) for r, n in zip(own.tolist(), ids.tolist(), strict=True) if n != least[r]]


def _joined(percent: int):
    def run(batches):
        ids, sets, groups, roots, seen, size = [], [], [], [], {}, 0

        def flush():
            found = tree_join(np.array(ids), sets, np.array(groups), np.array(roots), percent)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            lists = C.column(batch, "hashes")
            for r in range(len(batch)):
                group = tuple(C.column(batch, c)[r].as_py() for c in ("comp", "i", "j"))
                if size > GATHER and group not in seen:
                    yield flush()
                    ids, sets, groups, roots, seen, size = [], [], [], [], {}, 0
                ids.append(C.column(batch, "sid")[r].as_py())
                roots.append(C.column(batch, "root")[r].as_py())
                sets.append(lists[r].values.to_numpy().view(np.uint64).copy())
                groups.append(seen.setdefault(group, len(seen)))
                size += len(sets[-1])
        if ids:
            yield flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). The star of each connected component: (a, b), b its smallest node, a every other node.

    Alternating large and small stars; each round is written out, and no group is ever gathered in one place: the smallest
    neighbours are broadcast if the edges, which were counted, are few; else they are written too, so that both sides of a
    join are plain scans, which Spark splits where a centre has a large share of the rows.
    """
    tie = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, known = C.persisted(tie(edges), "components"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == known or not mark[0]:
            return now
        known = mark
        smallest = F.broadcast if mark[0] <= C.BROADCAST_KEYS else lambda df: C.persisted(df, "components-least")
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = tie(both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(now.join(least, F.col("a") == F.col("u")).select("a", F.col("m").alias("b"))))
        large = C.persisted(large, "components")
        least = smallest(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = large.join(least, F.col("a") == F.col("u"))
        now = C.persisted(tie(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))), "components")


def _starred(star: DataFrame) -> DataFrame:
    """(sid, comp) of all nodes of a star's components, centres included."""
    return star.select(F.col("a").alias("sid"), F.col("b").alias("comp")).unionAll(star.select(F.col("b").alias("sid"), F.col("b").alias("comp")).distinct())


def _identified(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, text, sid, __row with all columns), and one (sid, text) for each sid: the id, or a 64-bit hash of
    the text where the id is null or stands for several texts."""
    own = F.xxhash64("text")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(f"`{c}`" for c in documents.columns)).alias("__row"))
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(own).alias("x"), F.max(own).alias("y"))
    again = C.persisted(by_id.filter("c > 1 or doc_id is null").select("doc_id", (F.col("doc_id").isNull() | (F.col("x") != F.col("y"))).alias("several")), "jaccard-ids")
    if again.isEmpty():
        docs = docs.withColumn("sid", F.col("doc_id"))
        return docs, docs.select("sid", "text")
    # Rows without an id have no place in a join, where all would meet in one task.
    marked = docs.filter("doc_id is not null").join(C.small(again.filter("doc_id is not null")), "doc_id", "left")
    marked = marked.unionByName(docs.filter("doc_id is null").withColumn("several", F.lit(True)))
    marked = marked.withColumn("sid", F.when(F.col("several"), own).otherwise(F.col("doc_id")))
    once = marked.filter("several is null").select("sid", "text")
    more = C.persisted(marked.filter("several is not null").groupBy("sid").agg(F.max("text").alias("text")), "jaccard-repeated")
    return marked.select("doc_id", "text", "sid", "__row"), once.unionAll(more)


def _linked(dealt: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """dealt: (sid, comp, i, j, root). Links within the tasks (comp, i, j)."""
    dealt = C.persisted(dealt, "jaccard-dealt")
    ids = C.persisted(dealt.select("sid").distinct(), "jaccard-wanted")
    picked = texts.join(C.small(ids), "sid", "left_semi")
    sets = picked.join(dealt, "sid").select("text", "sid", "comp", "i", "j", "root").mapInArrow(_sets(words), "sid long, comp long, i int, j int, root long, hashes array<long>")
    return C.persisted(sets.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_joined(percent), "a long, b long"), "jaccard-links")


def _blocks(rows: DataFrame, by: str, block: int) -> DataFrame:
    """rows: (sid, n, ...). Per value of `by`: the blocks that its sets need."""
    return rows.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks"))


def _part(salt: str, blocks: str = "blocks"):
    return F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(blocks)).cast("int")


def _described_rows(docs: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Per row of docs: doc_id, sid, n, node (of its set), root (of its component; null without shingles)."""
    described = C.persisted(docs.mapInArrow(_described(words), "sid long, doc_id long, n long, node long"), "jaccard-nodes")
    own = C.persisted(described.filter("node is not null").groupBy("node").agg(F.min("sid").alias("sid"), F.max("n").alias("n")), "jaccard-own")
    # One text speaks for a set; its id, unlike the set's hash, takes few bytes in a shuffle. Keys are computed twice rather
    # than kept: first only counted, then joined with those that occur again.
    speakers = texts.join(C.small(own.select("sid")), "sid", "left_semi")
    labels = speakers.mapInArrow(_parts(percent, words), "sid long, labels array<struct<label:int,need:int,keys:array<long>>>")
    parts = labels.select("sid", F.explode("labels").alias("x")).select("sid", "x.label", "x.need", F.explode("x.keys").alias("key"))
    shared = parts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    by_rarity = Window.partitionBy("sid", "label").orderBy(F.desc("c"), "key")  # a set's parts at most
    rare = parts.join(shared, "key").withColumn("r", F.row_number().over(by_rarity)).filter("r >= need")
    rare = C.persisted(rare.select("key", "sid", "label").distinct(), "jaccard-rare")
    keys = C.persisted(rare.groupBy("key").agg(F.min("sid").alias("m"), F.count("*").alias("g")).filter("g > 1"), "jaccard-keys")
    starred = rare.join(keys, "key")
    node = lambda c: F.xxhash64(c, "label")  # noqa: E731  a set in a class of sizes
    star = components(starred.filter("sid <> m").select(node("sid").alias("a"), node("m").alias("b")))
    placed = rare.select("sid", "label").distinct().withColumn("node", node("sid")).join(_starred(star).withColumnRenamed("sid", "node"), "node")
    members = C.persisted(placed.join(own.select("sid", "n"), "sid").select("sid", "label", "comp", "n"), "jaccard-members")
    blocks = C.persisted(_blocks(members, "comp", block), "jaccard-blocks")
    placed = members.join(blocks, "comp")
    zero = F.lit(0)
    whole = placed.filter("blocks = 1").select("sid", "comp", zero.alias("i"), zero.alias("j"), F.col("sid").alias("root"))
    large = C.persisted(placed.filter("blocks > 1").select("sid", "label", "n"), "jaccard-large")
    if large.isEmpty():
        links = components(_linked(whole, texts, words, percent))
    else:
        # The first round: with the first set of the rarest key; sets that are first in all their keys are centres only.
        nearest = starred.filter("sid <> m").groupBy("sid", "label").agg(F.min(F.struct("g", "key", "m")).alias("x")).select("sid", "label", F.col("x.m").alias("m"))
        nearest = C.persisted(large.join(nearest, ["sid", "label"]).select("sid", "n", "m", node("m").alias("comp")), "jaccard-nearest")
        sizes = C.persisted(_blocks(nearest, "comp", block), "jaccard-blocks")
        each = nearest.join(sizes, "comp").select("sid", "comp", _part("round 1").alias("i"), F.lit(1).alias("j"))
        centres = nearest.select("m", "comp").distinct().join(sizes, "comp").select(F.col("m").alias("sid"), "comp", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.lit(1).alias("j"))
        links = _linked(whole.unionAll(each.unionAll(centres).withColumn("root", F.col("sid"))), texts, words, percent)
        # The second: keys whose sets are not all connected.
        linked_now = C.persisted(components(links).select(F.col("a").alias("sid"), F.col("b").alias("root")), "jaccard-roots")
        roots = C.persisted(large.join(linked_now, "sid", "left").select("sid", "label", "n", F.coalesce("root", "sid").alias("root")), "jaccard-rooted")
        rooted = rare.join(roots, ["sid", "label"])
        mixed = C.persisted(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("sid").alias("m")).filter("x <> y").select("key", "m"), "jaccard-mixed")
        if not mixed.isEmpty():
            again = components(rooted.join(mixed, "key").filter("sid <> m").select(node("sid").alias("a"), node("m").alias("b")))
            rest = C.persisted(roots.withColumn("node", node("sid")).join(_starred(again).withColumnRenamed("sid", "node"), "node").drop("node"), "jaccard-rest")
            main = rest.groupBy("comp", "root").agg(F.count("*").alias("c")).groupBy("comp").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
            rest = C.persisted(rest.join(main, "comp").withColumn("other", F.col("root") != F.col("main")), "jaccard-rest")
            settled = _blocks(rest.filter("not other"), "comp", block).withColumnRenamed("blocks", "settled")
            others = _blocks(rest.filter("other"), "comp", block).withColumnRenamed("blocks", "others")
            rest = rest.join(settled, "comp").join(others, "comp").withColumn("mine", F.when(F.col("other"), _part("others", "others")).otherwise(_part("settled", "settled")))
            meet = lambda n, i, j: rest.filter("other").select("sid", "comp", "root", "mine", F.explode(F.expr(f"sequence(0, {n} - 1)")).alias("k")).select("sid", "comp", i.alias("i"), j.alias("j"), "root")
            k, mine = F.col("k"), F.col("mine")
            dealt = meet("others", F.least(mine, k), F.greatest(mine, k)).unionAll(meet("settled", mine, -1 - k))
            dealt = dealt.unionAll(rest.filter("not other").select("sid", "comp", F.explode(F.expr("sequence(0, others - 1)")).alias("i"), (-1 - mine).alias("j"), "root"))
            links = links.unionAll(_linked(dealt, texts, words, percent))
        links = components(links)
    nodes = own.join(links.select(F.col("a").alias("sid"), F.col("b").alias("root")), "sid", "left").select("node", F.coalesce("root", "sid").alias("root"))
    return described.join(nodes, "node", "left")


def join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs, texts = _identified(documents, id_col, text_col)
    rows = C.persisted(_described_rows(docs.select("sid", "doc_id", "text"), texts, words, percent, block), "jaccard-rows")
    least = C.persisted(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, one row of each component: that with the smallest id (null last), then the smallest hash
    of its text. Of repeated rows (one id, or none, and one text) one stays, whichever columns' hash is smallest."""
    docs, texts = _identified(documents, id_col, text_col)
    rows = C.persisted(_described_rows(docs.select("sid", "doc_id", "text"), texts, words, percent, BLOCK), "jaccard-rows")
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "sid")
    inside = rows.filter("root is not null").select("root", "sid", "doc_id", place.alias("place"))
    least = C.persisted(inside.groupBy("root").agg(F.min("place").alias("least")), "jaccard-least")
    gone = C.persisted(inside.join(least, "root").filter("place <> least").select(F.col("sid").alias("__sid"), F.col("doc_id").alias("__id")).distinct(), "jaccard-gone")
    same = (F.col("sid") == F.col("__sid")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = docs.join(C.small(gone), same, "left_anti")
    twice = C.persisted(rows.groupBy("sid", "doc_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("sid").alias("__sid"), F.col("doc_id").alias("__id")), "jaccard-twice")
    if not twice.isEmpty():
        twice = C.small(twice)
        by = F.xxhash64(*(f"__row.`{c}`" for c, t in documents.dtypes if "map<" not in t and t != "variant"))
        once = kept.join(twice, same, "left_semi").groupBy("sid", "doc_id").agg(F.min_by("__row", by).alias("__row")).select("__row")
        kept = kept.join(twice, same, "left_anti").select("__row").unionAll(once)
    return kept.select("__row.*")


def op10_jaccard_join(spark, sf_dir):
    return join(C.table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op10_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT min(doc_id) AS rep, list(doc_id) AS ids FROM (SELECT doc_id, list(s ORDER BY s) AS x FROM s GROUP BY doc_id) GROUP BY x),
c AS (SELECT s.doc_id, s.s FROM s JOIN k ON s.doc_id = k.rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS v, rep AS u FROM k UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
g AS (SELECT v, min(u) AS least FROM r GROUP BY v),
h AS (SELECT unnest(ids) AS doc_id, least FROM k JOIN g ON k.rep = g.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(h.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN h ON d.doc_id = h.doc_id"""
}


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id) by all pairs that share a shingle, for tests."""
    import re

    sets, holders, parent = {}, {}, {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        parent[doc] = doc
        for s in sets[doc]:
            holders.setdefault(s, []).append(doc)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, own in sets.items():
        shared: dict[int, int] = {}
        for s in own:
            for b in holders[s]:
                if b < a:
                    shared[b] = shared.get(b, 0) + 1
        for b, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[b]) - n):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), root(d)) for d, s in sets.items()}
