"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to classes: insult, threat, target, negation, reported speech, the two halves of separable
verbs, other. Five small transducers over classes (a verb and its particle that are a threat together, negation near an
insult or threat, reported speech before it, a target before or after it, and the weight that remains) are composed into
one, which walks every clause; a clause is what lies between full stops, marks, line ends and the like. A document's score
joins its matched clauses, not isolated words: a threat counts only towards a target, a denied or reported insult counts
less, an addressed one more. What a target would add to earlier words is held open until one follows in the clause.

The lexicon has a few words per language as fixed values, and words, and beginnings of words, learned from labelled rows:
insults, which occur in far more toxic documents than others; threats, which do so only in clauses with a target; targets,
which do so only in clauses with a threat. Learning uses at most about SAMPLE labelled documents, spread by a hash of the
id, one of each group that shares its smallest hash of five words (copies would make all their words look telling).

Defined results: a null or empty text scores like one without matches (the constant term alone); rows with a null label
are not learned from; without any labelled rows the fixed values alone decide; a document with several labels counts once
for each different one; of rows that repeat an id one text is learned from; repeated rows are scored one by one; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE = 20_000
#: Bytes of beginnings of words, the least log-odds and log-likelihood ratio of what is learned, words that a negation reaches.
BEGINNINGS, LEAST_ODDS, LEAST_RATIO, REACH = range(5, 12), 2.0, 20.0, 3
#: Threats and targets have lower odds than this without a target and at large.
MOST_ODDS = 1.0
THRESHOLD = 0.3

#: Fixed values.
INSULTS = "idiot moron imbecile stupid dumb loser scum bastard asshole bitch whore cunt retard vermin parasite idiotin dummkopf arschloch hurensohn crétin connard salaud imbécile idiota imbécil estúpido cabrón".split()
THREATS = "kill murder strangle shoot stab hang lynch behead slaughter umbringen töten erschießen tuer étrangler égorger matar asesinar".split()
TARGETS = "you your u he she him her they them du dich dir ihr euch tu toi vous te usted ustedes vosotros".split()
NEGATIONS = "not never no cannot nicht kein keine nie pas jamais aucun ningún nunca".split()
REPORTS = "said says quoted quote called reported alleged sagte sagt zitierte angeblich dit disait déclaré dijo dice".split()
#: Separable verbs whose particle makes them a threat (Ich bringe dich um).
VERBS, PARTICLES = "bringe bringst bringt bringen brachte".split(), "um".split()
SEED_WEIGHT = 3.0
#: Factors of a denied and of a reported insult or threat, and of an insult with a target in its clause.
DENIED, REPORTED, ADDRESSED = 0.3, 0.3, 1.25

_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(c) for c in ".!?;\n\r|"]] = True

RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.LongType()), T.StructField("strongest", T.DoubleType()), T.StructField("rest", T.DoubleType())])
#: How matched clauses become a score where nothing was learned: constant, strongest, sum of the rest, more than one.
DEFAULT = (-3.0, 1.0, 0.5, 0.0)
MOST = 30.0


def _terms(strongest, rest, n):
    return np.stack([np.ones(len(n)), np.minimum(strongest, MOST), np.minimum(rest, MOST), (np.asarray(n) > 1).astype(float)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method; ridge holds coefficients to the defaults where rows are few."""
    base = np.array(DEFAULT)

    def loss(c):
        z = x @ c
        return np.logaddexp(0, z).sum() - (y * z).sum() + ridge / 2 * ((c - base) ** 2).sum()

    c = base
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * (c - base))
        while loss(c + step) > loss(c) and np.abs(step).max() > 1e-9:
            step = step / 2
        c = c + step
    return c.tolist()


class Transducer:
    """step(state, symbol) -> (symbol or None, factor, state); starts in state 0."""

    def __init__(self, step):
        self.step = step

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: what this one puts out goes into `after`. States are pairs."""

        def step(state, symbol):
            a, b = state or (0, 0)
            out, x, a = self.step(a, symbol)
            out, y, b = after.step(b, out)
            return out, x * y, (a, b)

        return Transducer(step)


def _separable(state, symbol):
    if symbol == "v":
        return "o", 1.0, 1
    if symbol == "u":
        return ("t" if state else "o"), 1.0, 0
    return symbol, 1.0, state


def _negation(state, symbol):
    if symbol == "n":
        return "o", 1.0, REACH
    if symbol in "it" and state:
        return symbol, DENIED, state - 1
    return symbol, 1.0, max(0, state - 1)


def _report(state, symbol):
    if symbol == "r":
        return "o", 1.0, 1
    return symbol, REPORTED if state and symbol in "it" else 1.0, state


def _target(state, symbol):
    """Puts out m for what has its target, h for an open threat, i for an open insult, a for the target of open ones."""
    if symbol == "g":
        return ("o" if state else "a"), 1.0, 1
    if symbol == "t":
        return ("m" if state else "h"), 1.0, state
    if state and symbol == "i":
        return "m", ADDRESSED, state
    return symbol, 1.0, state


def _matched(state, symbol):
    return symbol, 1.0 if symbol in "imh" else 0.0, state


GRAMMAR = Transducer(_separable) @ Transducer(_negation) @ Transducer(_report) @ Transducer(_target) @ Transducer(_matched)


def word_weight(events: list[tuple[int, str, float]], memo: dict) -> float:
    """What the grammar is held against: the words' weights alone."""
    return sum(w for _, symbol, w in events if symbol in "it")


def clause_weight(events: list[tuple[int, str, float]], memo: dict) -> float:
    """events: (word's place, class, weight) of one clause, in order; other words lie between."""
    state, total, open_, last = 0, 0.0, 0.0, None
    for place, symbol, weight in events:
        for s in "o" * min(REACH + 1, place - last - 1 if last is not None else 0) + symbol:
            found = memo.get((state, s))
            if found is None:
                found = memo[state, s] = GRAMMAR.step(state, s)
            out, factor, state = found
            if s == symbol:
                if out == "a":
                    total, open_ = total + open_, 0.0
                elif out == "h":
                    open_ += weight * factor
                else:
                    total += weight * factor
                    open_ += weight * factor * (ADDRESSED - 1) if out == "i" else 0.0
        last = place
    return total


def _lowered(texts: pa.Array):
    """For row ranges: (first row, last row, bytes, words' starts and ends, first word of each row, hashes of spans, clause of
    each word)."""
    data, offsets = C.text_buffers(pc.utf8_lower(pc.replace_substring(texts, "’", "'")))
    for a, b in C.slices(offsets):
        part, off = C.sub(offsets, data, a, b)
        starts, ends, first = C.words(part, off, C.ALNUM)
        row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        yield a, b, part, starts, ends, first, C.Spans(part), np.cumsum(_CLAUSE[part])[starts] + row if len(starts) else row


def _denying(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words t of isn't, don't, can't ..., whose apostrophe parts words."""
    t = np.flatnonzero((ends - starts == 1) & (starts >= 2))
    at = starts[t]
    return t[(part[at] == ord("t")) & (part[at - 1] == ord("'")) & (part[at - 2] == ord("n"))]


def _hash(word: bytes) -> np.uint64:
    raw = np.frombuffer(word, np.uint8)
    return C.span_hash(C.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]


def _beginning(h: np.ndarray, n: int) -> np.ndarray:
    """Beginnings and whole words are different features."""
    return C.mix(h + np.uint64(n))


def _features(starts, ends, spans):
    """(hash, index of the word) of whole words and of their beginnings."""
    yield spans(starts, ends), np.arange(len(starts))
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts > n)
        yield _beginning(spans(starts[long], starts[long] + n), n), long


FIXED = ((INSULTS, "i"), (THREATS, "t"), (TARGETS, "g"), (NEGATIONS, "n"), (REPORTS, "r"), (VERBS, "v"), (PARTICLES, "u"))


class Lexicon:
    """learned: (feature, class, weight)."""

    def __init__(self, learned: list[tuple[int, str, float]], coefficients=DEFAULT, weigh=clause_weight):
        known = {int(np.uint64(k & (2**64 - 1))): (symbol, w) for k, symbol, w in learned}
        for words, symbol in FIXED:
            for w in words:
                known.setdefault(int(_hash(w.encode())), (symbol, SEED_WEIGHT if symbol in "itu" else 0.0))
        self.keys = np.array(sorted(known), np.uint64)
        self.symbols = [known[int(k)][0] for k in self.keys]
        self.weights = np.array([known[int(k)][1] for k in self.keys])
        self.counts = np.array([s in "itv" for s in self.symbols])
        self.denies = int(np.searchsorted(self.keys, _hash(b"not")))
        self.coefficients, self.weigh = np.array(coefficients), weigh
        self.memo: dict = {}

    def scored(self, texts: pa.Array):
        """(score, matched clauses, strongest weight, sum of the other weights) for each text."""
        for a, b, part, starts, ends, first, spans, clauses in _lowered(texts):
            denying = _denying(part, starts, ends)
            where, which = [denying], [np.full(len(denying), self.denies)]
            for keys, word in _features(starts, ends, spans):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[at] == keys
                where.append(word[hit])
                which.append(at[hit])
            where, which = np.concatenate(where), np.concatenate(which)
            order = np.lexsort((-self.weights[which], where))
            where, which = where[order], which[order]
            best = np.ones(len(where), bool)
            best[1:] = where[1:] != where[:-1]
            where, which = where[best], which[best]
            clause = clauses[where]
            row = np.searchsorted(first, where, "right") - 1
            keep = np.isin(clause, clause[self.counts[which]])
            found: dict[int, dict[int, list]] = {}
            for w, k, c, r in zip(where[keep].tolist(), which[keep].tolist(), clause[keep].tolist(), row[keep].tolist(), strict=True):
                found.setdefault(r, {}).setdefault(c, []).append((w, self.symbols[k], float(self.weights[k])))
            weights = [[x for x in (self.weigh(e, self.memo) for e in found.get(i, {}).values()) if x > 0] for i in range(b - a)]
            n = [len(x) for x in weights]
            strongest = np.array([max(x, default=0.0) for x in weights])
            rest = np.array([sum(x) for x in weights]) - strongest
            z = np.clip(_terms(strongest, rest, n) @ self.coefficients, -30, 30)
            yield from zip((1 / (1 + np.exp(-z))).tolist(), n, strongest.tolist(), rest.tolist(), strict=True)


def _group_keys(batches):
    """doc_id and the smallest hash of five words."""
    for batch in batches:
        keys = []
        for a, b, _, starts, ends, first, spans, _ in _lowered(C.column(batch, "text")):
            w = spans(starts, ends)
            five = C.mix(w[:-4] + w[1:-3] * np.uint64(3) + w[2:-2] * np.uint64(5) + w[3:-1] * np.uint64(7) + w[4:] * np.uint64(11)) if len(w) > 4 else w[:0]
            for i in range(b - a):
                own = five[first[i] : max(first[i], first[i + 1] - 4)]
                keys.append(int((own.min() if len(own) else np.bitwise_xor.reduce(w[first[i] : first[i + 1]], initial=np.uint64(0))).view(np.int64)))
        yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(keys, pa.int64())], names=["doc_id", "key"])


#: Where a feature is counted: anywhere, in clauses with a target, in those without, in clauses with a threat.
WHERE = ("any", "to", "un", "by")


def _counts(batches):
    """feature, and toxic (a) and other (b) documents that have it in each kind of clause, summed up per row range."""
    targets, threats = (np.sort(np.array([_hash(w.encode()) for w in words])) for words in (TARGETS, THREATS))
    for batch in batches:
        toxic = C.column(batch, "toxic").to_numpy(zero_copy_only=False).astype(bool)
        for a, _, _, starts, ends, first, spans, clause in _lowered(C.column(batch, "text")):
            if not len(starts):
                continue
            whole = spans(starts, ends)
            to, by = (np.isin(clause, clause[np.isin(whole, known)]) for known in (targets, threats))
            row = np.searchsorted(first, np.arange(len(starts)), "right") - 1 + a
            keys, word = map(np.concatenate, zip(*_features(starts, ends, spans), strict=True))
            # A document's flags of a feature: one row for each, whose places are joined by "or".
            order = np.lexsort((row[word], keys))
            keys, word = keys[order], word[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (row[word[1:]] != row[word[:-1]])
            at = np.flatnonzero(new)
            flags = [np.ones(len(at), bool), *(np.logical_or.reduceat(x[word], at) for x in (to, ~to, by))]
            keys, hot = keys[at], toxic[row[word[at]]]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            own = np.cumsum(fresh) - 1
            columns = [pa.array(np.bincount(own, x & y, own[-1] + 1).astype(np.int64)) for x in flags for y in (hot, ~hot)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), *columns], names=["feature", *_COUNTED])


_COUNTED = [f"{x}_{w}" for w in WHERE for x in "ab"]


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, weigh=clause_weight) -> tuple[list[tuple[int, str, float]], list[float]]:
    """(learned features with classes and weights, coefficients); of bounded size, since a feature is learned only if it occurs
    in several documents of the bounded sample."""
    known = C.persisted(labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().distinct(), "toxicity-labels")
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = C.persisted(texts, "toxicity-sample")
    groups = texts.mapInArrow(_group_keys, "doc_id long, key long").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    texts = texts.join(F.broadcast(groups.select("doc_id").distinct()), "doc_id")
    na, nb = texts.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not na or not nb:
        return [], list(DEFAULT)
    schema = "feature long, " + ", ".join(f"{c} long" for c in _COUNTED)
    counts = texts.select("text", (F.col("toxic") > 0).alias("toxic")).mapInArrow(_counts, schema).groupBy("feature").agg(*(F.sum(c).cast("double").alias(c) for c in _COUNTED))
    n, p = float(na + nb), na / (na + nb)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    for w in WHERE:
        x, y = F.col(f"a_{w}"), F.col(f"b_{w}")
        both = x + y
        ratio = 2 * (term(x, both * p) + term(y, both * (1 - p)) + term(na - x, (n - both) * p) + term(nb - y, (n - both) * (1 - p)))
        counts = counts.withColumn(f"odds_{w}", F.log((x + 0.5) / (na + 1)) - F.log((y + 3) / (nb + 6))).withColumn(f"ratio_{w}", ratio)
    telling = lambda w: (F.col(f"odds_{w}") >= LEAST_ODDS) & (F.col(f"ratio_{w}") >= LEAST_RATIO)
    kind = F.when(telling("to") & (F.col("odds_un") < MOST_ODDS) & (F.col("b_un") >= F.col("a_un")) & (F.col("b_un") > 0), "t").when(telling("any"), "i").when(telling("by") & (F.col("odds_any") < MOST_ODDS), "g")
    weight = F.when(F.col("kind") == "t", F.col("odds_to")).when(F.col("kind") == "i", F.col("odds_any")).otherwise(0.0)
    learned = [(r.feature, r.kind, r.w) for r in counts.withColumn("kind", kind).filter("kind is not null").select("feature", "kind", weight.alias("w")).collect()]
    # At most about SAMPLE rows of four numbers.
    rows = np.array(score(texts.withColumn("doc_id", F.col("toxic").cast("long")), (learned, DEFAULT), weigh=weigh).select("strongest", "rest", "n_clauses", "doc_id").collect(), float)
    return learned, _logistic(_terms(*rows[:, :3].T), (rows[:, 3] > 0).astype(float))


def score(documents: DataFrame, model: tuple[list[tuple[int, str, float]], list[float]], id_col: str = "doc_id", text_col: str = "text", weigh=clause_weight) -> DataFrame:
    """Per document: doc_id, score, n_clauses (matched), the weight of the strongest and the sum of the rest."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lexicon = Lexicon(*shared.value, weigh)
        for batch in batches:
            columns = zip(*lexicon.scored(C.column(batch, "text")), strict=True) if len(batch) else [()] * 4
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=RESULT.names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_toxicity(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
