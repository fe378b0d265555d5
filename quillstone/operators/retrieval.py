"""Retrieval: vector similarity, BM25, rank fusion, hybrid scores, fuzzy text matching, chunking, log compaction, metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+"


# Vectors
def cosine(a: Column, b: Column) -> Column:
    """In double; 0 for different lengths, empty vectors, zero norms and values that are not finite."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    score = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)


def top_by_cosine(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors nearest to a query given as a literal: one scan and a bounded heap per task, no join."""
    given = F.array(*map(F.lit, map(float, query)))
    scored = vectors.filter(F.size(vector_col) == len(query)).select(id_col, cosine(F.col(vector_col), given).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def similar_to(vectors: DataFrame, seed: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    row = vectors.filter(F.col(id_col) == seed).select(vector_col).first()
    return top_by_cosine(vectors.filter(F.col(id_col) != seed), list(row[0]) if row else [], k, id_col, vector_col)


# Text
def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def scanned(documents: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, len (tokens), tf0, tf1 ... (of the distinct terms in order) and lexical (`overlap`). Texts are tokenised
    once; the numbers, some 50 bytes a document, are kept for whatever is derived from them."""
    own = documents.select(id_col, tokens(F.col(text_col)).alias("t"))
    counts = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(_terms(query))]
    return own.select(id_col, F.size("t").alias("len"), *counts, overlap_of(query, F.col("t")).alias("lexical")).persist()


def _terms(query: list[str]) -> list[str]:
    return sorted({w.lower() for w in query})


def bm25(documents: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, binary_tf: bool = False, scan: DataFrame | None = None) -> DataFrame:
    """(id, score) of documents with any term, the best score being 1. binary_tf counts each term once. `scan` is `scanned`
    of the same documents and query, where it is there already."""
    terms = _terms(query)
    if not terms:
        return documents.select(id_col).limit(0).withColumn("score", F.lit(0.0))
    own = scanned(documents, query, id_col, text_col) if scan is None else scan
    stats = own.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    both = own.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf = F.least(F.col(f"tf{i}"), F.lit(1)) if binary_tf else F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean")))

    raw = both.select(id_col, sum((part(i) for i in range(1, len(terms))), part(0)).alias("raw"))
    most = raw.agg(F.max("raw").alias("most"))
    return raw.crossJoin(F.broadcast(most)).select(id_col, (F.col("raw") / F.col("most")).alias("score"))


def rrf(rankings: list[DataFrame], id_col: str, k: int = 60) -> DataFrame:
    """Fuses rankings of (id, score), each cut to its best already, by reciprocal ranks from 0, the best fused score being 1."""
    parts = []
    for r in rankings:
        order = Window.orderBy(F.desc("score"), id_col)  # a ranking is a top-k list
        parts.append(r.select(id_col, (1.0 / (max(1, k) + F.row_number().over(order) - 1)).alias("s")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    fused = every.groupBy(id_col).agg(F.sum("s").alias("s"))
    most = fused.agg(F.max("s").alias("most"))
    return fused.crossJoin(F.broadcast(most)).select(id_col, (F.col("s") / F.col("most")).alias("score"))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def overlap_of(query: list[str], own: Column) -> Column:
    """Share of query terms that one of the tokens equals or, both of four letters or more, misses by one edit."""

    def near(q: str):
        if len(q) < 4:
            return lambda t: t == q
        return lambda t: F.length(t).between(max(4, len(q) - 1), len(q) + 1) & ((t == q) | (F.levenshtein(t, F.lit(q), 1) >= 0))

    hits = [F.exists(own, near(q)).cast("int") for q in query]
    return sum(hits[1:], hits[0]) / len(hits) if hits else F.lit(0.0)


def overlaps(documents: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of all documents, tokenised once."""
    return documents.select(id_col, tokens(F.col(text_col)).alias("t")).select(id_col, overlap_of(query, F.col("t")).alias("score"))


def adaptive_threshold(n_terms: int, mixed_script: bool = False, base: float = 0.18) -> float:
    moved = base + (0.04 if n_terms <= 3 else -0.03 if n_terms >= 12 else 0.0) - (0.015 if mixed_script else 0.0)
    return max(0.05, min(0.40, moved))


def weighted_hybrid(cos: Column, lexical: Column, boost: Column | float = 0.0, mixed_script: bool = False) -> Column:
    v, w = (0.88, 0.12) if mixed_script else (0.82, 0.18)
    boost = boost if isinstance(boost, Column) else F.lit(boost)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * F.greatest(F.lit(0.0), cos) + w * lexical + boost))


def penalised(score: Column, name: Column, suffixes: tuple[str, ...], by: float = 0.05) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.lower(name).endswith(s)
    return score - F.when(hit, by).otherwise(0.0)


def phrases(question: str, longest: int = 3) -> list[str]:
    """Words of two characters or more, then runs of two, then of three, without repeats."""
    words = [w for w in re.split(r"[\s,.;:!?()\[\]{}\"'/\\]+", question) if len(w) >= 2]
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)))


def fuzzy_lookup(questions: DataFrame, values: DataFrame, least: float = 0.75, top: int = 3) -> DataFrame:
    """questions: (phrase, place): a question's phrases in order; values: (value). Of each phrase the best values, and of each
    value the best phrase, the first among equals. Joined on shared trigrams, not all with all."""
    p = questions.select("phrase", "place").withColumn("g", F.explode(trigrams(F.col("phrase"))))
    v = values.select("value").filter("length(value) <= 200").distinct().withColumn("g", F.explode(trigrams(F.col("value"))))
    scored = p.join(v, "g").select("phrase", "place", "value").distinct().withColumn("score", trigram_similarity(F.col("phrase"), F.col("value"))).filter(F.col("score") >= least)
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "value")
    kept = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    best = F.min(F.struct((-F.col("score")).alias("less"), "place", "phrase")).alias("b")
    return kept.groupBy("value").agg(best).select("value", F.col("b.phrase").alias("phrase"), (-F.col("b.less")).alias("score"))


def excerpt(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def chunks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 700) -> DataFrame:
    """(id, section, chunk, text). A line that starts with '#' opens a section; paragraphs are packed up to `most` characters."""
    lines = documents.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("i", "line")).filter(F.trim("line") != "")
    by_doc = Window.partitionBy(id_col).orderBy("i")
    lines = lines.withColumn("section", F.sum(F.col("line").startswith("#").cast("int")).over(by_doc))
    # Sections are packed by a fold over their paragraphs.
    grouped = lines.groupBy(id_col, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("p"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, x):
        fits = (F.length(a["open"]) == 0) | (F.length(a["open"]) + 1 + F.length(x) <= most)
        joined = F.when(F.length(a["open"]) == 0, x).otherwise(F.concat(a["open"], F.lit("\n"), x))
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    packed = F.aggregate("p", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return grouped.select(id_col, F.col("section").cast("long").alias("section"), F.posexplode(packed).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


#: What makes a log line important; the last two as they are written, all others in any case.
IMPORTANT = ("[error", "[warn", "[fatal", "exception", "critical", "threat detected", "malware", "quarantine", "security", "breach", "timeout", "denied", "root cause", "post-incident", "escalation", "exfiltration")
IMPORTANT_AS_WRITTEN = ("  at ", "--- ")
WHOLE_LINES, FIRST_LINES = 80, 10


def important_line(line: Column) -> Column:
    low, out = F.lower(line), F.lit(False)
    for w in IMPORTANT:
        out = out | F.contains(low, F.lit(w))
    for w in IMPORTANT_AS_WRITTEN:
        out = out | F.contains(line, F.lit(w))
    return out


def line_signature(line: Column) -> Column:
    masked = F.regexp_replace(line, r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+", "TS")
    return F.substring(F.regexp_replace(masked, "[0-9]+", "N"), 1, 80)


def compacted_log(lines: DataFrame, file: str, place: str, line: str, important=important_line, whole: int = WHOLE_LINES, first: int = FIRST_LINES) -> DataFrame:
    """lines: one row a line, numbered by `place` in its file. Kept lines (file, place, line, omitted): a file of at most `whole`
    lines as it is; of others, without blanks and outer spaces, every important line and, of the routine ones, the first of
    each signature. Once `first` lines are kept, a new routine line after a repeat goes too, up to the next important one.
    `omitted` counts what was left out just before an important line; left-outs at the end follow as a row without a line."""
    by_file = Window.partitionBy(file)
    order = by_file.orderBy(place)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select(file, place, line).withColumn("n", F.count("*").over(by_file))
    short = rows.filter(F.col("n") <= whole).select(file, place, line, F.lit(0).cast("bigint").alias("omitted"))
    rows = rows.filter(F.col("n") > whole).withColumn(line, F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))).filter(F.length(line) > 0)
    rows = rows.withColumn("imp", important(F.col(line))).withColumn("sig", F.when(~F.col("imp"), line_signature(F.col(line))))
    seen = F.row_number().over(Window.partitionBy(file, "imp", "sig").orderBy(place)) > 1
    rows = rows.withColumn("repeat", ~F.col("imp") & seen)
    # Lines between two important ones form a part; a part with a repeat ends with a note, which counts as a line kept.
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("imp").cast("int")).over(before), F.lit(0)))
    in_part = Window.partitionBy(file, "part").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after_repeat", F.coalesce(F.max("repeat").over(in_part), F.lit(False)))
    rows = rows.withColumn("note", F.col("imp") & F.col("after_repeat"))
    # Until `first` lines are kept nothing but repeats goes, so these counts are exact up to there, and stay over it later.
    kept = F.coalesce(F.sum((~F.col("repeat")).cast("int") + F.col("note").cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("gone", F.col("repeat") | (~F.col("imp") & F.col("after_repeat") & (kept >= first)))
    omitted = F.coalesce(F.sum(F.col("gone").cast("int")).over(in_part), F.lit(0))
    long = rows.withColumn("omitted", F.when(F.col("imp"), omitted).otherwise(0).cast("bigint"))
    last = long.groupBy(file, "part").agg(F.max("imp").alias("closed"), F.sum(F.col("gone").cast("bigint")).alias("omitted"), F.max(place).alias(place)).filter("not closed and omitted > 0")
    tail = last.select(file, place, F.lit(None).cast("string").alias(line), "omitted")
    return short.unionAll(long.filter("not gone").select(file, place, line, "omitted")).unionAll(tail)


NEWEST, DEGENERATE = 2000, 5


def past_questions(traces: DataFrame, id_col: str, script_col: str, error_col: str, newest: int = NEWEST, degenerate: int = DEGENERATE) -> DataFrame:
    """The corpus of past questions: the newest traces (by id) with a script and no error, without those whose script occurs
    `degenerate` times or more among them (0: all scripts stay)."""
    good = traces.filter(F.col(script_col).isNotNull() & F.col(error_col).isNull()).orderBy(F.desc(id_col)).limit(newest)
    if not degenerate:
        return good
    same = Window.partitionBy(F.md5(script_col))  # at most `newest` rows
    return good.withColumn("__n", F.count("*").over(same)).filter((F.col("__n") < degenerate) | (F.length(script_col) == 0)).drop("__n")


def grounded_share(text: Column, evidence: Column) -> Column:
    own = F.array_distinct(F.filter(tokens(text), lambda x: F.length(x) >= 4))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, tokens(evidence))) / F.size(own))


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results: (case, rank from 1, id); expected: (case, id). Per case: first hit, recall@1/3/5/10, reciprocal rank, NDCG@5."""
    sizes = expected.groupBy("case").agg(F.count("*").alias("wanted"))
    hits = results.join(expected, ["case", "id"], "left_semi")
    gain = F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = hits.groupBy("case").agg(F.min("rank").alias("first_hit"), *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5, 10)), gain.alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = sizes.join(found, "case", "left")
    zero = F.lit(0.0)
    return out.select("case", "first_hit", *((F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("wanted")).alias(f"recall_{k}") for k in (1, 3, 5, 10)), F.coalesce(1 / F.col("first_hit"), zero).alias("reciprocal_rank"), (F.coalesce("gain", zero) / ideal).alias("ndcg_5"))
