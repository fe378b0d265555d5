import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions.semantics import boundary_diff
from quillstone.operators import catalog, compare, percentiles
from quillstone.operators import retrieval as R
from quillstone.sources import configs, files
from quillstone.sources.tables import Tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("unit", "a", "b", "want"),
    [("hour", "2024-01-01 00:59:00", "2024-01-01 01:01:00", 1), ("day", "2024-01-01 23:59:00", "2024-01-02 00:01:00", 1), ("week", "2025-01-05 12:00:00", "2025-01-06 00:00:00", 1), ("month", "2024-01-31 00:00:00", "2024-02-01 00:00:00", 1), ("quarter", "2024-03-31 00:00:00", "2024-04-01 00:00:00", 1), ("year", "2023-12-31 23:00:00", "2024-01-01 00:00:00", 1), ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:00", 1)],
)
def test_boundaries(spark, unit, a, b, want):
    assert one(spark, boundary_diff(unit, F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))) == want


def test_percentiles_with_ties_and_nulls(spark):
    rows = [("a", float(x % 7)) for x in range(500)] + [("b", None), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.m, r.p) for r in percentiles.nearest_ranks(df, ["g"], "v", {"m": 0.5, "p": 0.95}).collect()}
    values = sorted(x % 7 for x in range(500))
    assert got == {"a": (values[250], values[475]), "c": (4.0, 4.0)}


@pytest.mark.parametrize("limit", [1 << 20, 40, 5])
def test_percentiles_cut_again(spark, limit):
    """Ranges are divided until few rows are left, or one value."""
    values = [float((i * 7919) % 3001) for i in range(3000)] + [17.0] * 900
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)] * 300, "g string, v double")
    ranks = {f"r{k}": F.lit(k) for k in (0, 17, 299)}
    got = {r.g: r.asDict() for r in percentiles.values_at(df, ["g"], "v", ranks, limit).collect()}
    assert [got["a"][f"r{k}"] for k in (0, 17, 299)] == [sorted(values)[k] for k in (0, 17, 299)]
    assert got["a"]["__n"] == 3900 and got["b"] == {"g": "b", "r0": 5.0, "r17": 5.0, "r299": 5.0, "__n": 300}


@pytest.mark.parametrize("few", [percentiles.FEW, 3])
def test_top_percent(spark, monkeypatch, few):
    monkeypatch.setattr(percentiles, "FEW", few)
    rows = [(i, float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v double")
    for percent in (1, 5, 12.5, 100):
        n = -int(-200 * percent // 100)
        want = sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:n])
        assert sorted(map(tuple, percentiles.top_percent(df, percent, "v", "k").collect())) == want
    assert percentiles.top_percent(df.limit(0), 5, "v", "k").count() == 0


def _compacted(lines, whole, first):
    """The rules, line by line."""
    if len(lines) <= whole:
        return [(x, 0) for x in lines]
    out, left, n, seen = [], 0, 0, set()
    for x in lines:
        x = x.strip()
        if not x:
            continue
        if "ERROR" in x:
            if left:
                n += 1
            out.append((x, left))
            n, left = n + 1, 0
            continue
        sig = re.sub(r"\d+", "N", x)[:80]
        if sig in seen or (n >= first and left):
            left += 1
        else:
            out.append((x, 0))
            n += 1
        seen.add(sig)
    return out + ([(None, left)] if left else [])


def test_log_compaction(spark):
    rng = random.Random(4)
    files = {f: [rng.choice(["load 1", "load 22", " save 3 ", "", "[ERROR x", "tick", "a b", f"new {'abcdefgh'[i % 8]}", "free"]) for i in range(rng.choice([3, 9, 30, 90]))] for f in range(40)}
    rows = [(f, i, x) for f, xs in files.items() for i, x in enumerate(xs)]
    got = {f: [] for f in files}
    for r in R.compacted_log(spark.createDataFrame(rows, "f int, i int, x string"), "f", "i", "x", whole=8, first=6).orderBy("f", "i", F.col("x").isNull()).collect():
        got[r.f].append((r.x, r.omitted))
    assert got == {f: _compacted(xs, 8, 6) for f, xs in files.items()}


def test_important_lines(spark):
    for text, want in (("2024 [Error] x", True), ("at rest", False), ("  at Foo.Bar()", True), ("--- end", True), ("ROOT CAUSE: y", True), ("all fine", False)):
        assert one(spark, R.important_line(F.lit(text))) is want
    assert one(spark, R.line_signature(F.lit("2024-01-02 03:04:05.678 job 17 took 5 ms"))) == "TS job N took N ms"


def test_fuzzy_lookup(spark):
    assert R.phrases("the Cat, the dog a") == ["the", "Cat", "dog", "the Cat", "Cat the", "the dog", "the Cat the", "Cat the dog"]
    asked = spark.createDataFrame([(p, i) for i, p in enumerate(R.phrases("open tickts in North America now"))], "phrase string, place int")
    values = spark.createDataFrame([("North America",), ("Tickets",), ("Opening",), ("x" * 300,)], "value string")
    got = {r.value: (r.phrase, round(r.score, 2)) for r in R.fuzzy_lookup(asked, values, least=0.5).collect()}
    assert got["North America"] == ("North America", 1.0) and got["Tickets"][0] == "tickts" and set(got) == {"North America", "Tickets"}


def test_past_questions(spark):
    rows = [(i, f"q{i % 7}" if i % 3 else "same", "bad" if i % 10 == 0 else None) for i in range(100)] + [(200, None, None), (201, "", None)]
    got = sorted(r.id for r in R.past_questions(spark.createDataFrame(rows, "id long, script string, error string"), "id", "script", "error", newest=30, degenerate=5).collect())
    newest = [r for r in sorted(rows, reverse=True, key=lambda r: r[0]) if r[1] is not None and r[2] is None][:30]
    assert got == sorted(i for i, s, _ in newest if s == "" or sum(x[1] == s for x in newest) < 5)


def test_tables_of_a_folder(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "notes.txt").write_text("x")
    assert [r.table_name for r in catalog.tables(Tables(spark, str(tmp_path))).collect()] == ["a", "b"]


def test_cosine_guards(spark):
    vec = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert one(spark, R.cosine(vec(1.0, 0.0), vec(1.0, 0.0))) == pytest.approx(1)
    for a, b in ((vec(1.0), vec(1.0, 2.0)), (vec(), vec()), (vec(0.0), vec(1.0)), (vec(float("nan")), vec(1.0))):
        assert one(spark, R.cosine(a, b)) == 0


def test_trigrams(spark):
    assert one(spark, R.trigram_similarity(F.lit("Abc"), F.lit("aBC"))) == 1
    assert 0 < one(spark, R.trigram_similarity(F.lit("abcd"), F.lit("abce"))) < 1


def test_chunks(spark):
    text = "intro\n# One\n" + "a" * 400 + "\n" + "b" * 400 + "\n# Two\nend"
    rows = R.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section", "chunk").collect()
    assert [(r.section, r.chunk, len(r.text)) for r in rows] == [(0, 0, 5), (1, 0, 406), (1, 1, 400), (2, 0, 9)]


def test_empty_bm25(spark):
    assert R.bm25(spark.createDataFrame([(1, "x")], "doc_id long, text string"), []).count() == 0


def test_folding(spark):
    assert one(spark, X.fold_camel(F.lit("HTTPStatusCode_of.customerName"))) == "http status code of customer name"
    assert one(spark, X.language(F.lit("مرحبا world"))) == "ar"
    assert one(spark, X.script_profile(F.lit("مرحبا بالعالم كله hello world"))) == "mixed"
    assert one(spark, X.normalized(F.lit("ﬁne، ١٢ Ünï"), X.nfkc())) == "fine 12 ünï"
    assert one(spark, X.normalized(F.lit(" كـتاب؟ ۱۲٣ أهلاً x+y\tz!"), X.nfkc())) == "ك تاب 123 اهلا x+yz"


def test_redaction_follows_lineage(spark):
    df = spark.range(3).select((F.col("id") * 2).alias("secret"), F.lit(1).alias("open")).select(F.col("secret").alias("harmless"), "open")
    assert catalog.redacted(spark.createDataFrame([(1, "x")], "a int, b string").select(F.upper("b").alias("c")), {"b"}).first().c == catalog.REDACTED
    assert df.columns == ["harmless", "open"]


def test_multisets(spark):
    a = spark.createDataFrame([(1, "X "), (2, None), (2, None)], "a int, b string")
    same = spark.createDataFrame([(None, 2.00001), ("x", 1.0), (None, 2.0)], "p string, q double")
    assert compare.multiset_equal(a, same).first()["equal"]
    assert not compare.multiset_equal(a, a.distinct()).first()["equal"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A")
    (tmp_path / "in/b.bin").write_bytes(b"\0")
    assert [r.text for r in files.corpus(spark, str(tmp_path / "in")).collect()] == ["# A"]
    assert sorted((r.length, r.text) for r in files.attachments(spark, str(tmp_path / "in")).collect())[0] == (1, None)
    log = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, v int, s string")
    files.append(log, str(tmp_path / "log"))
    assert sorted(r.s for r in files.latest(spark.read.parquet(str(tmp_path / "log")), "k", "v").collect()) == ["new", "x"]
    rows = one(spark, files.json_rows(F.lit('[{"a": 1, "b": {"c": 2}}, {"a": null}]')))
    many = one(spark, files.json_rows(F.lit("[" + ", ".join("{" + ", ".join(f'"p{i:02}": "{"x" * 300}"' for i in range(30)) + "}" for _ in range(25)) + "]")))
    assert len(many) == 20 and all(sorted(m) == [f"p{i:02}" for i in range(20)] and {len(v) for v in m.values()} == {250} for m in many)
    assert rows[0]["a"] == "1" and rows[0]["b"] == '{"c":2}'


def test_configs(spark, tmp_path):
    (tmp_path / "suites").mkdir()
    (tmp_path / "suites/a.json").write_text('{"name": "A", "version": "1", // a note\n "Scenarios": [{"Code": "c1", "Question": "how many", "ExpectedScalar": 3, "ExpectedAggregations": [{"function": "count", "column": "*"}]}, {"Code": "c2", "ExpectedSql": "SELECT 1", "Unknown": 1}]}')
    (tmp_path / "suites/b.json").write_text('{"name": "B", "Scenarios": []}')
    rows = {r.Code: r for r in configs.suites(spark, str(tmp_path / "suites")).collect()}
    assert set(rows) == {"c1", "c2"} and rows["c1"].ExpectedScalar == 3 and rows["c1"].ExpectedAggregations[0].function == "count" and rows["c2"].place == 1 and rows["c2"].Question is None
    (tmp_path / "cues.json").write_text('{"default": "F", "patterns": [{"shape": "X", "keywords": ["a", "b"], "regex": ["c+"]}, {"shape": "Y", "keywords": ["d"]}]}')
    assert sorted(map(tuple, configs.cues(spark, str(tmp_path / "cues.json")).collect())) == [(0, "X", "a", False), (0, "X", "b", False), (0, "X", "c+", True), (1, "Y", "d", False)]
    (tmp_path / "tools.json").write_text('{"tools": [{"toolKey": "k2", "keywordHints": "x, y", "sortOrder": 2}, {"toolKey": "k1", "sortOrder": 1, "isEnabled": true}, {"toolKey": "off", "isEnabled": false}]}')
    assert [(r.toolKey, r.keywordHints) for r in configs.tools(spark, str(tmp_path / "tools.json")).collect()] == [("k1", None), ("k2", ["x", "y"])]


def test_stream(spark, tmp_path):
    from quillstone.streaming.events import append_to, event_stream, windowed

    (tmp_path / "ev").mkdir()
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 9), "view", 1.0) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = event_stream(spark, str(tmp_path / "ev"), "event_id long, ts timestamp_ntz, event_type string, value double")
    q = append_to(windowed(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() >= 7 and {r.n for r in out.collect()} == {10}
