"""Retrieval, text functions, catalogue and comparison as queries over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import catalog, compare
from quillstone.operators import retrieval as R
from quillstone.planner.ir import Measure, QueryIR, compiled
from quillstone.planner.rewrite import Grounding, fix_grain
from quillstone.plans.shapes import plan
from quillstone.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS

c = F.col
TERMS = ["the", "token", "scum"]
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})))"


def _seed(t):
    return list(t.embeddings.filter("vec_id = 0").first().embedding)


plan(
    "vec_cosine",
    lambda t: t.embeddings.select("vec_id", F.round(R.cosine(c("embedding"), F.array(*map(F.lit, _seed(t)))), 6).alias("score")),
    f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
)
plan("vec_topk", lambda t: R.top_by_cosine(t.embeddings, _seed(t), 10).withColumn("score", F.round("score", 6)), f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {_COS} DESC, vec_id LIMIT 10")
plan("vec_similar_to", lambda t: R.similar_to(t.embeddings, 5, 10).withColumn("score", F.round("score", 6)), f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 5) b WHERE a.vec_id <> 5 ORDER BY {_COS} DESC, vec_id LIMIT 10")
plan(
    "vec_penalised",
    lambda t: t.embeddings.select("vec_id", F.round(R.penalised(R.cosine(c("embedding"), F.array(*map(F.lit, _seed(t)))), c("label").cast("string"), ("1", "3")), 6).alias("score")),
    f"SELECT a.vec_id, round({_COS} - CASE WHEN CAST(label AS VARCHAR) LIKE '%1' OR CAST(label AS VARCHAR) LIKE '%3' THEN 0.05 ELSE 0 END, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
)
_BM25 = (
    f"own AS (SELECT doc_id, len(t) AS len, " + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(sorted(TERMS))) + f" FROM (SELECT doc_id, {_TOK} AS t FROM documents)), "
    "st AS (SELECT count(*) AS n, avg(len) AS mean, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS))) + " FROM own), "
    "raw AS (SELECT doc_id, " + " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * len / mean))" for i in range(len(TERMS))) + " AS raw FROM own, st WHERE " + " OR ".join(f"tf{i} > 0" for i in range(len(TERMS))) + "), "
    "bm AS (SELECT doc_id, raw / (SELECT max(raw) FROM raw) AS score FROM raw)"
)


def _best(df, k=20):
    return df.orderBy(F.desc("score"), "doc_id").limit(k)


plan("bm25_topk", lambda t: _best(R.bm25(t.documents, TERMS)).withColumn("score", F.round("score", 6)), f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")


def _lexical(t):
    return R.overlaps(t.documents, TERMS)


def _near(q):
    return f"CASE WHEN len(list_filter(t, lambda x: x = '{q}'" + (f" OR (length(x) >= 4 AND abs(length(x) - {len(q)}) <= 1 AND levenshtein(x, '{q}') <= 1)" if len(q) >= 4 else "") + ")) > 0 THEN 1 ELSE 0 END"


_LEX = "lx AS (SELECT doc_id, (" + " + ".join(map(_near, TERMS)) + f") / {len(TERMS)}.0 AS score FROM (SELECT doc_id, {_TOK} AS t FROM documents))"
plan("lex_overlap", lambda t: _lexical(t).withColumn("score", F.round("score", 6)), f"WITH {_LEX} SELECT doc_id, CAST(round(score, 6) AS DOUBLE) AS score FROM lx")
_RANKED = "(SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {0} QUALIFY r <= 20)"
_FUSED = f"{_BM25}, {_LEX}, fu AS (SELECT doc_id, sum(1.0 / (60 + r - 1)) AS s FROM (SELECT * FROM {_RANKED.format('bm')} UNION ALL SELECT * FROM {_RANKED.format('lx')}) GROUP BY doc_id), rr AS (SELECT doc_id, s / (SELECT max(s) FROM fu) AS score FROM fu)"


def _fused(t, scan):
    return R.rrf([_best(R.bm25(t.documents, TERMS, scan=scan)), _best(scan.select("doc_id", c("lexical").alias("score")))], "doc_id")


plan("rrf_fuse", lambda t: _fused(t, R.scanned(t.documents, TERMS)).withColumn("score", F.round("score", 6)), f"WITH {_FUSED} SELECT doc_id, round(score, 6) AS score FROM rr")


def _hybrid_rag(t):
    scan = R.scanned(t.documents, TERMS)
    both = _fused(t, scan).withColumnRenamed("score", "fused").join(scan.select("doc_id", "lexical"), "doc_id")
    return both.filter("fused >= 0.18 or lexical >= 0.18").orderBy(F.desc("fused"), "doc_id").limit(5).select("doc_id", F.round("fused", 6).alias("fused"))


plan("hybrid_rag", _hybrid_rag, f"WITH {_FUSED} SELECT doc_id, round(rr.score, 6) AS fused FROM rr JOIN lx USING (doc_id) WHERE rr.score >= 0.18 OR lx.score >= 0.18 ORDER BY rr.score DESC, doc_id LIMIT 5")


def _hybrid_weighted(t):
    """Vectors and texts are matched by id where both exist."""
    cos = t.embeddings.select(c("vec_id").alias("doc_id"), R.cosine(c("embedding"), F.array(*map(F.lit, _seed(t)))).alias("cos"))
    both = cos.join(_lexical(t), "doc_id").select("doc_id", R.weighted_hybrid(c("cos"), c("score"), 0.015).alias("s"))
    return both.filter(c("s") >= R.adaptive_threshold(len(TERMS))).select("doc_id", F.round("s", 6).alias("score"))


plan("hybrid_weighted", _hybrid_weighted, f"WITH {_LEX}, cs AS (SELECT a.vec_id AS doc_id, {_COS} AS cos FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b), h AS (SELECT doc_id, greatest(0.0, least(1.0, 0.82 * greatest(0.0, cos) + 0.18 * score + 0.015)) AS s FROM cs JOIN lx USING (doc_id)) SELECT doc_id, CAST(round(s, 6) AS DOUBLE) AS score FROM h WHERE s >= 0.22")
_TRI = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: substr('  ' || lower({0}) || '  ', i, 3)))"
_SIM = f"CASE WHEN lower({{0}}) = lower({{1}}) THEN 1.0 ELSE len(list_intersect({_TRI.format('{0}')}, {_TRI.format('{1}')})) / len(list_distinct(list_concat({_TRI.format('{0}')}, {_TRI.format('{1}')}))) END"
plan(
    "trigram_similarity",
    lambda t: t.customer.select("c_custkey", F.round(R.trigram_similarity(c("c_name"), F.lit("Customer 12")), 6).alias("s")),
    f"SELECT c_custkey, CAST(round({_SIM.format('c_name', chr(39) + 'Customer 12' + chr(39))}, 6) AS DOUBLE) AS s FROM customer",
)
_QUESTION = "orders from nation 12, NATION_2 or the Nationn_07?"
_PHRASES = list(enumerate(R.phrases(_QUESTION)))
_PHRASE_ROWS = ", ".join(f"({i}, '{p}')" for i, p in _PHRASES)
plan(
    "fuzzy_lookup",
    lambda t: R.fuzzy_lookup(t.spark.createDataFrame([(p, i) for i, p in _PHRASES], "phrase string, place int"), t.nation.select(c("n_name").alias("value"))).withColumn("score", F.round("score", 6)),
    f"""WITH s AS (SELECT place, phrase, n_name AS value, CAST(round({_SIM.format('phrase', 'n_name')}, 6) AS DOUBLE) AS score FROM (VALUES {_PHRASE_ROWS}) v(place, phrase), (SELECT DISTINCT n_name FROM nation)),
k AS (SELECT * FROM s WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY score DESC, value) <= 3)
SELECT value, phrase, score FROM k QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, place) = 1""",
)
plan(
    "corpus_dedupe",
    lambda t: R.past_questions(t.documents.join(t.labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("error")).distinct(), "doc_id", "left"), "doc_id", "text", "error").select("doc_id", F.md5("text").alias("h")),
    f"""WITH r AS (SELECT doc_id, md5(text) AS h, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id DESC LIMIT {R.NEWEST})
SELECT doc_id, h FROM r QUALIFY count(*) OVER (PARTITION BY h) < {R.DEGENERATE} OR text = ''""",
)
plan(
    "chunk_sections",
    lambda t: R.chunks(t.documents).select("doc_id", "section", "chunk", F.md5("text").alias("h")),
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, sum(CASE WHEN line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l WHERE trim(line) <> ''),
n AS (SELECT doc_id, section, line, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS k FROM m),
p AS (SELECT doc_id, section, k, line, CAST(0 AS BIGINT) AS chunk, length(line) AS size FROM n WHERE k = 1
      UNION ALL
      SELECT n.doc_id, n.section, n.k, n.line, CASE WHEN size + 1 + length(n.line) <= 700 THEN chunk ELSE chunk + 1 END, CASE WHEN size + 1 + length(n.line) <= 700 THEN size + 1 + length(n.line) ELSE length(n.line) END
      FROM p JOIN n ON n.doc_id = p.doc_id AND n.section = p.section AND n.k = p.k + 1)
SELECT doc_id, CAST(section AS BIGINT) AS section, chunk, md5(string_agg(line, chr(10) ORDER BY k)) AS h FROM p GROUP BY doc_id, section, chunk""",
)
plan("excerpt", lambda t: t.documents.select("doc_id", R.excerpt(c("text")).alias("excerpt")), "SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 277) || '...' ELSE text END AS excerpt FROM documents")
_LOG = ("(?i)token|licen", 6, 4)  # the texts have no log levels and few long ones, so other words and smaller limits
plan(
    "log_signature_dedup",
    lambda t: R.compacted_log(t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")), "doc_id", "place", "line", lambda x: x.rlike(_LOG[0]), _LOG[1], _LOG[2]).select("doc_id", c("place").cast("bigint").alias("place"), F.md5("line").alias("h"), "omitted"),
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
a AS (SELECT doc_id, place, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM n WHERE n > {_LOG[1]}),
b AS (SELECT *, regexp_matches(line, '{_LOG[0]}') AS imp, substr(regexp_replace(regexp_replace(line, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\.[0-9]+', 'TS', 'g'), '[0-9]+', 'N', 'g'), 1, 80) AS sig FROM a WHERE length(line) > 0),
d AS (SELECT *, NOT imp AND EXISTS (SELECT 1 FROM b e WHERE e.doc_id = b.doc_id AND NOT e.imp AND e.sig = b.sig AND e.place < b.place) AS rep FROM b),
f AS (SELECT *, coalesce(sum(CAST(imp AS INT)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM d),
g AS (SELECT *, coalesce(max(CAST(rep AS INT)) OVER (PARTITION BY doc_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM f),
h AS (SELECT *, coalesce(sum(CAST(NOT rep AS INT) + CAST(imp AND late AS INT)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept FROM g),
i AS (SELECT *, rep OR (NOT imp AND late AND kept >= {_LOG[2]}) AS gone FROM h),
j AS (SELECT *, coalesce(sum(CAST(gone AS INT)) OVER (PARTITION BY doc_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS omitted FROM i)
SELECT doc_id, place, md5(line) AS h, CAST(0 AS BIGINT) AS omitted FROM n WHERE n <= {_LOG[1]}
UNION ALL SELECT doc_id, place, md5(line), CAST(CASE WHEN imp THEN omitted ELSE 0 END AS BIGINT) FROM j WHERE NOT gone
UNION ALL SELECT doc_id, max(place), NULL, CAST(sum(CAST(gone AS INT)) AS BIGINT) FROM j GROUP BY doc_id, part HAVING NOT bool_or(imp) AND sum(CAST(gone AS INT)) > 0""",
)
plan(
    "grounding_overlap",
    lambda t: t.conversations.filter("role = 'assistant'").alias("a").join(t.conversations.filter("role = 'user'").alias("u"), (c("a.conv_id") == c("u.conv_id")) & (c("a.turn") == c("u.turn") + 1)).select(c("a.conv_id").alias("conv_id"), c("a.turn").alias("turn"), F.round(R.grounded_share(c("a.text"), c("u.text")), 6).alias("share")),
    "SELECT conv_id, turn, CASE WHEN len(o) = 0 THEN 0.0 ELSE round(len(list_intersect(o, e)) / len(o), 6) END AS share FROM (SELECT a.conv_id, a.turn, list_distinct(list_filter(regexp_extract_all(lower(a.text), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS o, regexp_extract_all(lower(u.text), '[a-z0-9]+') AS e FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')",
)


def _metrics(t):
    """Cases are labels of vectors; the first vector of each asks for the ten nearest others, and all of its label are due."""
    asked = t.embeddings.groupBy(c("label").alias("case")).agg(F.min_by("embedding", "vec_id").alias("query"), F.min("vec_id").alias("asked"))
    # A row for each label, which are few by definition; of each task's vectors ten a case go on.
    scored = t.embeddings.crossJoin(F.broadcast(asked)).filter("vec_id <> asked").select("case", c("vec_id").alias("id"), R.cosine(c("embedding"), c("query")).alias("score"))
    order = Window.partitionBy("case").orderBy(F.desc("score"), "id")
    results = scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    expected = t.embeddings.join(F.broadcast(asked.select("case", "asked")), c("label") == c("case")).filter("vec_id <> asked").select("case", c("vec_id").alias("id"))
    found = R.retrieval_metrics(results, expected)
    return found.select("case", c("first_hit").cast("bigint").alias("first_hit"), *(F.round(x, 6).alias(x) for x in ("recall_1", "recall_3", "recall_5", "recall_10", "reciprocal_rank", "ndcg_5")))


plan(
    "retrieval_metrics",
    _metrics,
    f"""WITH b AS (SELECT label AS "case", min(vec_id) AS asked, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
r AS (SELECT b."case", a.label, row_number() OVER (PARTITION BY b."case" ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a, b WHERE a.vec_id <> b.asked QUALIFY rank <= 10),
w AS (SELECT label AS "case", count(*) - 1 AS wanted FROM embeddings GROUP BY label HAVING count(*) > 1),
f AS (SELECT "case", min(rank) AS first_hit, {', '.join(f'count(*) FILTER (rank <= {k}) AS h{k}' for k in (1, 3, 5, 10))}, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM r WHERE "case" = label GROUP BY "case")
SELECT "case", first_hit, {', '.join(f'round(coalesce(h{k}, 0) / wanted, 6) AS recall_{k}' for k in (1, 3, 5, 10))}, round(coalesce(1.0 / first_hit, 0.0), 6) AS reciprocal_rank,
round(coalesce(gain, 0.0) / list_sum(list_transform(range(1, least(wanted, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_5 FROM w LEFT JOIN f USING ("case")""",
)

# Text functions
plan(
    "str_fold_camel",
    lambda t: t.part.select("p_partkey", X.fold_camel(F.concat(F.lit("partTypeHTTPCode_"), c("p_type"))).alias("folded")),
    r"SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('partTypeHTTPCode_' || p_type, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_.-]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS folded FROM part",
)
_MIXED = "Aé، كـتاب ۱۲٣ x+y؟ "
plan(
    "str_normalize",
    lambda t: t.conversations.select("conv_id", "turn", X.normalized(F.concat(F.lit(_MIXED), "text"), X.nfkc()).alias("folded")),
    rf"SELECT conv_id, turn, trim(regexp_replace(translate(lower(regexp_replace('{_MIXED}' || text, '[\p{{Cc}}\p{{Mn}}]', '', 'g')), '{''.join(X.FOLDED)}', '{''.join(X.FOLDED.values())}'), '[\p{{P}}\p{{Z}}]+', ' ', 'g')) AS folded FROM conversations",
)
plan("str_ws", lambda t: t.documents.select("doc_id", F.md5(X.squeezed(c("text"))).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS h FROM documents")
_ARABIC = "مرحبا بالعالم كله من هنا "


def _with_arabic(t):
    """English texts begin with Arabic, as much as the first 40 characters hold or little."""
    return F.concat(F.when(c("lang") == "en", F.lit(_ARABIC * 4)).otherwise(F.lit(_ARABIC[:6])), F.when(c("n_chars") > 300, F.substring("text", 1, 40)).otherwise(c("text")))


_WITH_ARABIC = f"(SELECT doc_id, CASE WHEN lang = 'en' THEN '{_ARABIC * 4}' ELSE '{_ARABIC[:6]}' END || CASE WHEN n_chars > 300 THEN substr(text, 1, 40) ELSE text END AS text FROM documents)"
plan("str_lang_share", lambda t: t.documents.select("doc_id", _with_arabic(t).alias("text")).select("doc_id", F.round(X.arabic_share(c("text")), 6).alias("share"), X.language(c("text")).alias("language")), rf"SELECT doc_id, round(s, 6) AS share, CASE WHEN s >= 0.30 THEN 'ar' ELSE 'en' END AS language FROM (SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\p{{L}}')) = 0 THEN 0.0 ELSE len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]')) / len(regexp_extract_all(text, '\p{{L}}')) END AS s FROM {_WITH_ARABIC})")
plan("str_script_profile", lambda t: t.documents.select("doc_id", _with_arabic(t).alias("text")).select("doc_id", X.script_profile(c("text")).alias("profile")), rf"SELECT doc_id, CASE WHEN least(a, l) >= 8 AND least(a, l) >= 0.25 * greatest(a, l) THEN 'mixed' WHEN a > l THEN 'arabic' WHEN l > 0 THEN 'latin' ELSE 'none' END AS profile FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}]')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM {_WITH_ARABIC})")
plan("str_natural_keys", lambda t: t.orders.select("o_orderkey", F.array_join(X.natural_keys(F.concat(F.lit("see ORD-"), c("o_orderkey").cast("string"), F.lit("-7, not x-y"))), ",").alias("keys")), r"SELECT o_orderkey, array_to_string(regexp_extract_all('see ORD-' || o_orderkey || '-7, not x-y', '\b[A-Za-z]{1,6}-\d[\d-]*'), ',') AS keys FROM orders")

# Catalogue
_FKS = " UNION ALL ".join(f"SELECT '{k.table}' AS from_table, '{k.column}' AS from_column, '{k.target}' AS to_table, '{k.target_column}' AS to_column" for k in FOREIGN_KEYS if {k.table, k.target} == {"orders", "customer"})
_FOLDER = ", ".join(f"'{n}'" for n in PRIMARY_KEYS)  # a connection may have other views
plan("meta_list_tables", lambda t: catalog.tables(t), f"SELECT view_name AS table_name FROM duckdb_views() WHERE NOT internal AND view_name IN ({_FOLDER})")
plan("meta_columns", lambda t: catalog.columns(t, "orders").select("column_name", "ordinal"), "SELECT column_name, CAST(ordinal_position AS BIGINT) AS ordinal FROM information_schema.columns WHERE table_name = 'orders'")
plan("meta_column_type", lambda t: catalog.column_type(t, "orders", "o_totalprice").select("column_name", F.upper("data_type").alias("data_type")), "SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'orders' AND column_name = 'o_totalprice'")
plan("meta_search_tables", lambda t: catalog.tables(t, like="e"), f"SELECT view_name AS table_name FROM duckdb_views() WHERE NOT internal AND view_name IN ({_FOLDER}) AND view_name LIKE '%e%'")
plan("meta_relationship", lambda t: catalog.relationships(t, "customer", "orders"), _FKS)
_KNOWN = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_comment"], "events": ["event_id", "gone"]}
_KNOWN_ROWS = ", ".join(f"('{n}', '{x}')" for n, xs in _KNOWN.items() for x in xs)
plan(
    "meta_schema_diff",
    lambda t: catalog.schema_diff(t, _KNOWN, list(_KNOWN)),
    f"""WITH k AS (SELECT * FROM (VALUES {_KNOWN_ROWS}) v(table_name, column_name)),
l AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN (SELECT table_name FROM k))
SELECT 'added' AS change, * FROM (FROM l EXCEPT FROM k) UNION ALL SELECT 'removed', * FROM (FROM k EXCEPT FROM l)""",
)
#: Stored queries, and what they refer to, read by hand: query, table, column (none: the table itself).
_STORED = {
    "fine": "WITH big AS (SELECT * FROM orders o WHERE o.o_totalprice > 1) SELECT b.o_orderkey FROM big b JOIN customer AS c ON c.c_custkey = b.o_custkey",
    "renamed": "SELECT o.o_gone, c.c_name FROM orders o JOIN customer c ON c.c_key = o.o_custkey WHERE c.c_name <> 'from vanished'",
    "dropped": "SELECT count(*) FROM vanished v JOIN nation ON nation.n_nationkey = v.x AND nation.n_size > 0",
}
_REFERRED = [("fine", "orders", None), ("fine", "orders", "o_totalprice"), ("fine", "customer", None), ("fine", "customer", "c_custkey"), ("renamed", "orders", None), ("renamed", "orders", "o_gone"), ("renamed", "orders", "o_custkey"), ("renamed", "customer", None), ("renamed", "customer", "c_name"), ("renamed", "customer", "c_key"), ("dropped", "vanished", None), ("dropped", "nation", None), ("dropped", "nation", "n_nationkey"), ("dropped", "nation", "n_size")]
_REFERRED_ROWS = ", ".join(f"('{q}', '{n}', " + (f"'{x}')" if x else "NULL)") for q, n, x in _REFERRED)
plan(
    "meta_drift",
    lambda t: catalog.drift(t, _STORED),
    f"""SELECT query, r.table_name, r.column_name FROM (VALUES {_REFERRED_ROWS}) r(query, table_name, column_name)
WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns i WHERE i.table_name = r.table_name AND (r.column_name IS NULL OR i.column_name = r.column_name))""",
)
plan("probe_sample_values", lambda t: catalog.sample_values(t.customer, "c_mktsegment"), "SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1 LIMIT 10")
plan("probe_lookup_values", lambda t: catalog.lookup_values(t.nation, "n_name"), "SELECT DISTINCT n_name AS value FROM nation WHERE length(n_name) >= 2")
plan("probe_inline_enums", lambda t: catalog.inline_enums(t.orders), "SELECT 'o_orderstatus' AS column_name, v AS value FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) UNION ALL SELECT 'o_orderpriority', v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)")
plan("pii_redact", lambda t: catalog.redacted(t.customer.select("c_custkey", c("c_name").alias("who"), "c_acctbal"), {"c_name"}), "SELECT c_custkey, '[REDACTED]' AS who, c_acctbal FROM customer")
#: Grouped by a label, which repeats: the repair puts the part's key before it.
_BY_LABEL = QueryIR("lineitem", ("part",), group=("p_name",), measures=(Measure("count", "*", "n"),))
plan("repair_group_grain", lambda t: compiled(fix_grain(_BY_LABEL, Grounding(), {"p_name": "p_partkey"}), t), "SELECT p_partkey, p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")

# Comparison


def _multisets(t):
    """Equal in another order and with other names and types; unequal with a row more and with a value changed."""
    own = t.nation.select("n_nationkey", "n_name")
    other = t.nation.select(c("n_name").alias("x"), c("n_nationkey").cast("double").alias("y"))
    cases = {"renamed": other, "repeated": other.unionAll(other.limit(1)), "changed": other.withColumn("x", F.when(c("y") == 3, "none").otherwise(c("x")))}
    found = [compare.multiset_equal(own, df).select(F.lit(name).alias("case"), "equal") for name, df in cases.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


plan(
    "ex_multiset",
    _multisets,
    """WITH a AS (SELECT CAST(n_nationkey AS DOUBLE) AS y, n_name AS x, count(*) AS n FROM nation GROUP BY ALL),
b AS (SELECT 'renamed' AS "case", CAST(n_nationkey AS DOUBLE) AS y, n_name AS x FROM nation
      UNION ALL SELECT 'repeated', CAST(n_nationkey AS DOUBLE), n_name FROM nation UNION ALL (SELECT 'repeated', CAST(n_nationkey AS DOUBLE), n_name FROM nation LIMIT 1)
      UNION ALL SELECT 'changed', CAST(n_nationkey AS DOUBLE), CASE WHEN n_nationkey = 3 THEN 'none' ELSE n_name END FROM nation),
g AS (SELECT "case", y, x, count(*) AS n FROM b GROUP BY ALL)
SELECT "case", count(*) = (SELECT count(*) FROM a) AND count(*) = count(a.n) AS equal FROM g LEFT JOIN a ON g.y = a.y AND g.x = a.x AND g.n = a.n GROUP BY "case" """,
)
plan("vote_fingerprint", lambda t: compare.fingerprint(t.nation).select((c("fingerprint") == compare.fingerprint(t.nation.orderBy(F.desc("n_name"))).first()["fingerprint"]).alias("same"), "n_rows"), "SELECT true AS same, count(*) AS n_rows FROM nation")

# Windows over event time; on a stream see quillstone.streaming
for _name, _slide in (("evt_tumbling", None), ("evt_sliding", "1 day")):
    plan(
        _name,
        lambda t, s=_slide: t.events.groupBy(F.window(c("ts").cast("timestamp"), "2 days" if s else "1 day", s).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(c("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"),
        "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, "
        + ("unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])" if _slide else "date_trunc('day', ts)")
        + " AS start FROM events) GROUP BY ALL",
    )
