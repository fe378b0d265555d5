"""The text-preparation operators: DuckDB twins, brute force, round trips, held-out accuracy and odd inputs."""

import cmath
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, decontaminate, jaccard_join, langid, licences, media, mixing, pii, queries, suffix_dedup, toxicity

ODD = "doc_id long, text string, source string, lang string, n_words string, hits int, size int, copies int, target int, __hash int, window int"


def odd(spark, rows=None):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    long = "lorem ipsum dolor " * 20_000
    rows = rows if rows is not None else [(1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (2, None, None, None), (3, "", "s", None), (None, "a b c d", None, "en"), (4, long, "t", "en"), (5, " \t\n", "t", "de")]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


# 1
def test_decontaminate_blocks_and_odd_rows(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (None, "a b c"), (2, "short ITEM"), (4, "")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    docs = odd(spark, [(1, "x one two three four five six seven eight nine ten y", "s", "en"), (1, "x one two three four five six seven eight nine ten y", "s", "en"), (2, "a short, item! short", None, None), (3, None, None, None), (4, "a b c", "s", "en"), (5, "", "s", "en")])
    want = [(1, 12, 10, ["1"]), (1, 12, 10, ["1"]), (2, 4, 2, ["2"]), (3, 0, 0, []), (4, 3, 3, []), (5, 0, 0, [])]
    for chars in (1 << 20, 15):  # the benchmark in one pass and in several
        got = decontaminate.search(docs, bench, block_chars=chars).collect()
        assert sorted((r.doc_id, r.n_words, len(r.hits), list(r["items"])) for r in got) == want
        assert sorted(r.doc_id for r in decontaminate.clean(docs, bench, block_chars=chars).collect()) == [3, 5]
    assert decontaminate.search(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontaminate.search(docs.limit(0), bench).count() == 0


def test_decontaminate_many_blocks_as_sql(spark, sf_dir, duck, monkeypatch):
    """The query over blocks of 2,000 characters, and items in pieces, gives the rows of the twin."""
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 7)
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.digest(decontaminate.search(docs, bench, block_chars=2000)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.sql(queries.ORACLE_SQL["op1_decontaminate"]).fetchall())


def test_decontaminate_tables_are_small():
    """A block of 1 MB: arrays of less than 20 bytes for each of its characters."""
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 10**6, 1000)) for _ in range(130)]
    names, (length,) = decontaminate.tables(([str(i) for i in range(130)], texts), 10)
    size = sum(x.nbytes for x in vars(length).values() if isinstance(x, np.ndarray))
    assert len(names) == 130 and size < 20 * sum(map(len, texts))
    found = list(decontaminate.searched(pa.array([texts[7][:500].decode() + " end", "a b"]), names, [length]))
    assert found[0][2] == ["7"] and len(found[0][1]) >= found[0][0] - 3 and not found[1][2]


def test_decontaminate_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["aa", "ab", "b", "cé", "d1"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(0, 7)))) for i in range(40)]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).collect()
    for r in got:
        w, hit, found = docs[r.doc_id][1].split(), set(), set()
        for item, text in items:
            v = text.split()
            m = min(4, len(v))
            for k in range(len(v) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == v[k : k + m]:
                        hit |= set(range(i, i + m))
                        found.add(str(item))
        assert (sorted(hit), sorted(found)) == (list(r.hits), list(r["items"]))


def test_texts_of_30_mb():
    """The functions on whole texts take one of 30 MB, and one long word, as they take short ones."""
    base = "".join(f"w{i * 7919 % 100_003} " for i in range(100_000))
    long = (base * 46)[:30_000_000] + " one two three four five six seven eight nine ten idiot."
    texts = pa.array([long, "x" * 3_000_000, base])
    known, lengths = decontaminate.tables((["7"], [b"one two three four five six seven eight nine ten"]), 10)
    n, hits, items = next(decontaminate.searched(texts, known, lengths))
    assert n == len(long.split()) + long.count("idiot.") - 1 and hits.tolist() == list(range(n - 11, n - 1)) and items == ["7"]
    sizes = [np.diff(bounds).tolist() for _, _, _, _, bounds in jaccard_join.shingles(texts, 3)]
    assert sizes[1] == [1] and 100_000 < sizes[0][0] < 100_100 and sizes[2][0] == 99_998
    word = next(jaccard_join.shingles(pa.array(["x" * 2_999_999 + "y"]), 3))[2]
    assert word[0] != list(jaccard_join.shingles(texts, 3))[1][2][0]
    assert [n for _, n, _, _ in toxicity.Lexicon([]).scored(texts)] == [1, 0, 0]
    raw = long.encode()
    assert media.decode(media.encode(raw)) == raw and len(media.fingerprint(raw[:3_000_000]))
    judge = langid.Judge({"en": b"one two three four five " * 40, "w": base[:30_000].encode()})
    assert judge(long)[0] in ("en", "w")


# 2
def test_language_held_out(spark):
    rows = queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    right, n = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_language_odd_rows(spark):
    known = langid.fit(odd(spark))
    got = langid.identify(odd(spark, [(1, None, None, None), (2, "", None, None), (3, "12 34!", None, None), (None, "lorem dolor", None, None)]), known).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got)
    assert langid.fit(odd(spark, [])) == {}
    assert langid.identify(odd(spark), {}).filter("lang_pred <> 'und'").count() == 0


def test_language_learns_all_languages(spark):
    """A hundred languages of their own letters; with fewer pieces for each, all are told."""
    rng = random.Random(2)
    alphabets = [[chr(x) for x in rng.sample(range(0x4E00, 0x9000), 12)] for _ in range(100)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(4)) for _ in range(60))
    known = langid.fit(spark.createDataFrame([(i, text(i % 100), f"l{i % 100}") for i in range(400)], "doc_id long, text string, lang string"))
    assert len(known) == 100
    got = langid.identify(spark.createDataFrame([(k, text(k)) for k in range(100)], "doc_id long, text string"), known).collect()
    assert sum(r.lang_pred == f"l{r.doc_id}" for r in got) >= 98


def test_language_accepted_odd_rows(spark):
    known = langid.fit(odd(spark, [(i, t, "s", x) for i, (t, x) in enumerate([("alpha beta gamma delta " * 40, "en"), ("eins zwei drei vier " * 40, "de")] * 3)]))
    df = odd(spark, [(1, "alpha beta gamma delta " * 20, None, None), (2, None, None, None), (3, "", "s", "en"), (None, "eins zwei drei vier " * 20, "s", "en"), (4, "12 34", "s", "en"), (1, "alpha beta gamma delta " * 20, None, None)])
    got = langid.accepted(df, known)
    assert got.columns == df.columns and sorted((r.doc_id for r in got.collect()), key=repr) == [1, 1, None]
    assert langid.accepted(odd(spark, []), known).count() == 0 and langid.accepted(df, {}).count() == 0


# 3
def test_toxicity_held_out(spark):
    rows = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    tp, fp, fn = rows.agg(F.expr("count_if(predicted = 1 and toxic = 1)"), F.expr("count_if(predicted = 1 and toxic = 0)"), F.expr("count_if(predicted = 0 and toxic = 1)")).first()
    assert tp / (tp + fp) >= 0.9 and tp / (tp + fn) >= 0.85


def test_toxicity_grammar():
    w = lambda *e: toxicity.clause_weight(list(e), {})
    insult = (5, "i", 3.0)
    assert w(insult) == 3 and w((4, "n", 0.0), insult) < 3 and w((0, "n", 0.0), insult) == 3
    assert w((0, "r", 0.0), insult) < 3 < w((0, "g", 0.0), insult)
    assert w((3, "t", 3.0)) == 0 and w((0, "g", 0.0), (3, "t", 3.0)) == 3


def test_toxicity_target_follows():
    w = lambda *e: toxicity.clause_weight(list(e), {})
    threat, insult, target = (3, "t", 3.0), (3, "i", 3.0), (0.0,)
    before, after = (0, "g", *target), (5, "g", *target)
    assert w(threat, after) == w(before, threat) == w(before, threat, after) == 3
    assert w(insult, after) == w(before, insult) == w(before, insult, after) == 3.75
    assert w((2, "n", 0.0), threat, after) == w(before, (2, "n", 0.0), threat) < 3
    assert w(threat, (4, "t", 3.0), after, (6, "g", 0.0)) == 6 and w(threat) == 0
    texts = pa.array(["they should shoot them all", "I will kill you", "I kill. You", "shoot the film"])
    assert [n for _, n, _, _ in toxicity.Lexicon([]).scored(texts)] == [1, 1, 0, 0]


def test_toxicity_grammar_brute_force():
    """The composed transducers against the rules written out, on random clauses."""
    rng = random.Random(12)
    for _ in range(3000):
        places = sorted(rng.sample(range(14), rng.randrange(1, 7)))
        events = [(p, s := rng.choice("itgnr"), float(rng.randrange(1, 5)) if s in "it" else 0.0) for p in places]
        aimed = any(s == "g" for _, s, _ in events)
        want = 0.0
        for p, s, w in events:
            if s in "it":
                w *= toxicity.DENIED if any(x == "n" and 0 < p - q <= toxicity.REACH for q, x, _ in events) else 1
                w *= toxicity.REPORTED if any(x == "r" and q < p for q, x, _ in events) else 1
                want += w * (toxicity.ADDRESSED if aimed else 1) if s == "i" else w * aimed
        assert toxicity.clause_weight(events, {}) == pytest.approx(want)


def test_toxicity_clauses_of_texts():
    def found(*texts):
        return [round(s + r, 6) for _, _, s, r in toxicity.Lexicon([]).scored(pa.array(texts))]

    plain, aimed = 3.0, 3.75
    assert found("what an idiot", "You are an idiot", "you aren't an idiot", "you aren’t an idiot", "he said: you idiot") == [plain, aimed, aimed * 0.3, aimed * 0.3, aimed * 0.3]
    assert found("I will kill you.", "I won't kill you", "kill the lights", "Ich bringe dich um", "Ich bringe das Buch", "um dich", "") == [3, 0.9, 0, 3, 0, 0, 0]


def _sentences(rng, n):
    """(text, toxic): the same words either way; only what the clause says of them differs."""
    other = "the house green walks water seldom paper runs you are they them all should will now an a I he said called aren not dich das Buch process film tea".split()
    filler = lambda: " ".join(rng.choice(other) for _ in range(rng.randrange(8, 20)))
    toxic = ["you are an idiot", "you stupid loser", "I will kill you", "they should shoot them all", "Ich bringe dich um", "zorgle you now"]
    clean = ["you aren't an idiot", "he said you are an idiot", "you are not a stupid loser", "he called him an idiot", "I will kill the process", "shoot the film", "Ich bringe das Buch um", "zorgle the tea now"]
    return [(f"{filler()}. {rng.choice(toxic if i % 2 else clean)}. {filler()}", i % 2) for i in range(n)]


def test_toxicity_grammar_wins(spark):
    """Held out, the grammar tells negated, reported and untargeted clauses; the words alone can't. zorgle is learned as a
    threat: it is toxic only with a target."""
    rng = random.Random(13)
    rows = [(i, t, y) for i, (t, y) in enumerate(_sentences(rng, 1200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train, held = df.filter("doc_id < 800"), df.filter("doc_id >= 800")
    right = {}
    for weigh in (toxicity.clause_weight, toxicity.word_weight):
        model = toxicity.fit(train, train, weigh=weigh)
        assert (int(toxicity._hash(b"zorgle").view(np.int64)), "t") in {(k, s) for k, s, _ in model[0]}
        got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(held, model, weigh=weigh).collect()}
        right[weigh.__name__] = np.mean([got[d] == y for d, _, y in rows if d >= 800])
    assert right["clause_weight"] >= 0.95 and right["word_weight"] <= 0.75


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.score(odd(spark), toxicity.fit(odd(spark), known)).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark, []), ([], toxicity.DEFAULT)).count() == 0


# 4
def test_surrogates(spark):
    text = "Mail Ann.B@firm.com or ann.b@firm.com, +1 (916) 555-6549, card 4539 1488 0343 6467, 4539148803436467, 10.20.30.40, Frau Maria Schmidt and Frau Schmidt, г-жа Анна Иванова, token = \"abcdef0123456789\"."
    out = pii.surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k1").first()
    for private in ("Ann.B", "ann.b", "firm.com", "555-6549", "0343", "10.20.30.40", "Schmidt", "Maria", "Иванова", "abcdef"):
        assert private not in out.text
    assert out.n_entities == 10
    words = out.text.split(" ")
    assert words[1] == words[3].rstrip(",") and words[1].count("@") == 1
    digits = "".join(c for c in out.text.split("card ")[1][:19] if c.isdigit())
    assert digits in out.text and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    frau = out.text.split("Frau ")
    assert frau[1].split()[1] == frau[2].split(",")[0] and frau[1].split()[0].endswith("a")
    assert all("а" <= c <= "я" for c in out.text.split("г-жа ")[1].split(",")[0].replace(" ", "").lower())


def test_surrogates_stay_distinct(spark):
    """One-letter addresses meet at once; all must end apart, and equal ones together."""
    rows = [(i, f"to {chr(97 + i % 26)}@x{i // 26}.org now") for i in range(260)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    assert pii.exceptions(pii.entities(df), "k1") is not None
    got = {}
    for r in pii.surrogates(df, "k1").collect():
        got.setdefault(r.doc_id, set()).add(r.text)
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == 260


def test_surrogates_odd_rows(spark):
    got = {(r.doc_id, r.text, r.n_entities) for r in pii.surrogates(odd(spark, [(1, None, None, None), (2, "", None, None), (None, "a\x01b \x02a x", None, None)]), "k1").collect()}
    assert got == {(1, None, 0), (2, "", 0), (None, "a\x01b \x02a x", 0)}
    assert pii.rewritten(odd(spark), "k1").columns == odd(spark).columns and pii.rewritten(odd(spark, []), "k1").count() == 0


def _drawn(spark, key, *texts):
    rows = pii.surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_surrogates_leave_other_numbers(spark):
    """Versions, ISBNs, card-like numbers without a check digit, and words after a secret's name stay."""
    texts = ["see version 1.2.3.4", "ISBN 9783161484100", "9807915762804490", "no 4539148803436468", "the secret: everything", "x = 12.5.2020"]
    assert _drawn(spark, "k1", *texts) == texts
    secret = ["DB_PASSWORD=hunter2hunter2", "aws_secret_access_key = AKIA1234567890", '{"password": "open.sesame-now"}', "X-Api-Key: eyJhbGci.eyJzdWIi.c2ln9"]
    for a, b, value in zip(secret, _drawn(spark, "k1", *secret), ("hunter2hunter2", "AKIA1234567890", "open.sesame-now", "eyJhbGci.eyJzdWIi.c2ln9"), strict=True):
        assert value not in b and a.split(value)[0] == b[: len(a.split(value)[0])] and len(a) == len(b)


def test_surrogates_keep_coreference_when_redrawn(spark, monkeypatch):
    """Surnames that meet are drawn anew; each keeps one surrogate with and without given names, and domains stay distinct."""
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("bd", "a", "a", "n"))  # a few dozen names
    names = [a + b for a in ("Ad", "Be", "Co", "Da", "Ek") for b in ("ler", "mann", "stein", "witz")]
    texts = [t for n in names for t in (f"Frau {n} came", f"Herr {n} left", f"Frau Maria {n} spoke")]
    late = pii.exceptions(pii.entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "k1")
    assert late.filter("kind = 'surname'").count() > 0 and late.filter(f"attempt >= {pii.WIDE}").count() > 0
    out = _drawn(spark, "k1", *texts)
    surnames = []
    for i in range(0, len(texts), 3):
        own = {out[i].split()[1], out[i + 1].split()[1], out[i + 2].split()[2]}
        assert len(own) == 1
        surnames += own
    assert len(set(surnames)) == len(names) and not set(surnames) & set(names)
    mails = [f"x@d{i}.org y@d{i}.org" for i in range(300)]
    got = [t.split() for t in _drawn(spark, "k2", *mails)]
    assert all(a.split("@")[1] == b.split("@")[1] and a != b for a, b in got) and len({a.split("@")[1] for a, _ in got}) == 300


def test_surrogates_of_full_formats(spark):
    """More entities than one draw can keep apart end distinct, longer ones if need be."""
    rows = [f"it is 10.0.{i // 250}.{i % 250} here" for i in range(1500)] + [f"card {4}{i:011d}" for i in range(3)]
    got = _drawn(spark, "k1", *rows)
    assert len(set(got[:1500])) == 1500 and not set(got[:1500]) & set(rows)


def test_surrogates_need_a_key(spark):
    df = odd(spark)
    with pytest.raises(TypeError):
        pii.surrogates(df)
    key = pii.session_key(spark)
    assert key == pii.session_key(spark) and len(key) == 64
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.session_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert _drawn(spark, "k1", "Mr Smith") != _drawn(spark, "k2", "Mr Smith")


# 5
def test_mixing_targets(spark):
    docs = [(i, "w " * (1 + i % 5), ["a", "b", "c", None][i % 4] if i % 40 else "tiny") for i in range(2000)]
    rows = mixing.plan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(docs[r.doc_id][2], []).append(r)
        assert r.copies <= 3
    for own in by.values():
        size, target = own[0].source_size, own[0].target
        assert target <= 3 * size + 1e-6 and abs(sum(r.taken for r in own) - target) <= 0.05 * target + 5
    assert abs(sum(own[0].target for own in by.values()) - total) < 1e-3 * total


def test_mixing_odd_rows(spark):
    got = mixing.plan(odd(spark)).collect()
    assert len(got) == 7 and mixing.plan(odd(spark, [])).count() == 0
    first, again = (sorted(mixing.mixed(odd(spark)).select("doc_id", "copy").collect(), key=repr) for _ in range(2))
    assert first == again
    blank = mixing.plan(odd(spark, [(1, None, "a", None), (2, "", "a", None)])).collect()
    assert all(r.taken == 0 and r.target == 0 for r in blank)


# 6
def test_chat_round_trip(spark):
    nasty = "\\ \\. <|end|> </s>[INST] <<SYS>> \\\\. <|turn|>x<|text|>"
    rows = [(1, 0, "system", "be " * 30)] + [(1, i, "user" if i % 2 else "assistant", nasty + " w" * (9 * i)) for i in range(1, 9)] + [(2, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, n int")
    out = chat.windows(df, budget=200, history=40)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert got[1].turns == "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1) and got[1].n_turns == 9
    assert got[1].loss == "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (got[2].turns, got[3].n_turns, got[3].loss, got[None].turns) == ("\n\n", 2, "", "user\nx\n")
    windows = [r for r in out.collect() if r.conv_id == 1]
    assert len(windows) > 2 and all(w.formatted.startswith("<|turn|>system<|text|>be") for w in windows)
    assert any(w.n_repeated > 1 for w in windows)
    inner = windows[0].formatted
    for c in chat.CONTROL[1:]:
        assert c not in inner
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_chat_budget(spark):
    """A long system turn is held once only, windows keep the budget or say so, and repetition is bounded."""
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "system", words(600))] + [(1, i, "user" if i % 2 else "assistant", words(16)) for i in range(1, 200)]
    rows += [(2, 0, "system", words(100))] + [(2, i, "user" if i % 2 else "assistant", words(900 if i == 5 else 30)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df).collect()
    for w in out:
        n = sum(len(t.split("<|text|>")[1].split()) + chat.OVERHEAD for t in w.formatted.split("<|end|>")[:-1])
        assert w.n_tokens == n and w.over_budget == (n > chat.BUDGET)
    first = [w for w in out if w.conv_id == 1]
    assert [w.over_budget for w in sorted(first, key=lambda w: w.window)] == [True] + [False] * (len(first) - 1)
    assert sum(len(w.formatted) for w in first) < 2.2 * sum(len(t) + 40 for c, _, _, t in rows if c == 1)
    assert sum(w.over_budget for w in out if w.conv_id == 2) <= 2 and all(words(100) in w.formatted for w in out if w.conv_id == 2)


# 7
def test_media_as_sql_and_by_hand(spark, sf_dir, duck):
    """What SQL can tell of the stored files, and the fingerprint of some by sums and loops."""
    got = {r.doc_id: r for r in queries.QUERIES["op7_media"](spark, sf_dir).collect()}
    pad = "greatest(64, 64 * CAST(ceil(octet_length(encode(coalesce(text, ''))) / 64.0) AS BIGINT))"
    hexed = f"hex(encode(coalesce(text, ''))) || repeat('00', {pad} - octet_length(encode(coalesce(text, ''))))"
    little = lambda x: f"printf('%02X%02X%02X%02X', ({x}) & 255, ({x}) >> 8 & 255, ({x}) >> 16 & 255, ({x}) >> 24 & 255)"
    header = f"hex(encode('RIFF')) || {little('n + 36')} || hex(encode('WAVEfmt ')) || '1000000001000100401F0000401F000001000800' || hex(encode('data')) || {little('n')}"
    sql = f"SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b, n, sha256(unhex(h)) AS payload, n + 44 AS m, sha256(unhex({header} || h)) AS media FROM (SELECT doc_id, text, {pad} AS n, {hexed} AS h FROM documents)"
    rows = duck.sql(sql).fetchall()
    assert len(rows) == len(got)
    for d, b, n, payload, m, stored in rows:
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].media_bytes, got[d].media_sha256) == (b, n, payload, m, stored)
    for text in ("", "the and thing", "Zürich ist schön. " * 30):
        raw = text.encode()
        samples = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        n = -(-max(0, len(samples) - 128) // 64) + 1
        edges, power, best = [1, 17, 33, 49, 65], [], []
        window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 127) for i in range(128)]
        for f in range(n):
            x = [v - 128 for v in samples[f * 64 : f * 64 + 128]]
            x += [0] * (128 - len(x))
            mean = sum(x) / 128
            s = [abs(sum((v - mean) * w * cmath.exp(-2j * math.pi * k * i / 128) for i, (v, w) in enumerate(zip(x, window, strict=True)))) for k in range(65)]
            best.append([max(range(edges[i], edges[i + 1]), key=lambda k: s[k]) for i in range(4)])  # noqa: B023
            power.append([s[k] for k in best[-1]])
        level = sum(map(sum, power)) / (4 * n)
        peak = [[p > level and p > 1e-3 for p in row] for row in power]
        want = [(t << 32) | (best[t][b] << 20) | (best[t][b + 1] << 8) for t in range(n) for b in range(3) if peak[t][b] and peak[t][b + 1]]
        want += [(t << 32) | (best[t][b] << 20) | (best[t + d][b] << 8) | d for d in (1, 2) for t in range(n - d) for b in range(4) if peak[t][b] and peak[t + d][b]]
        assert sorted(want) == media.fingerprint(samples).tolist()


def test_media(spark):
    rows = media.media(odd(spark)).collect()
    for r, (_, text) in zip(rows, [(x.doc_id, x.text) for x in odd(spark).collect()], strict=True):
        raw = (text or "").encode()
        payload = media.decode(r.media)
        assert payload == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)) and r.n_bytes == len(raw)
    assert rows[0].media == rows[1].media and rows[0].fingerprint == rows[1].fingerprint
    d = media.digest(media.media(odd(spark))).collect()
    assert d[2].payload_bytes == 64 and d[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert media.digest(media.media(odd(spark, []))).count() == 0
    clash = media.media(odd(spark)).withColumn("payload_sha256", F.lit("x")).withColumn("feature", F.lit(1)).withColumn("n_pairs", F.lit("y"))
    assert media.digest(clash).collect() == d


def test_peaks_find_a_tone():
    t = np.arange(64 * 100)
    tone = (128 + 60 * np.sin(2 * np.pi * t * 10 / media.FRAME)).astype(np.uint8).tobytes()
    bins, is_peak = media.peaks(tone)
    assert (bins[1:-2, 0] == 10).all() and is_peak[1:-2, 0].all() and len(media.fingerprint(tone))


# 8
def test_licences(spark):
    rows = [(1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "a/b/x.py", "x"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "x = f(y)\n" * 20), (4, "c/z.py", None), (5, "LICENSE", "This is free and unencumbered software released into the public domain."), (6, None, ""), (2, "a/b/x.py", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, dir string")
    got = sorted((r.doc_id, r.licence, r.inherited_licence, r.licence_dir) for r in licences.scan(df).collect())
    assert got == [(1, "MIT", "MIT", "a"), (2, None, "MIT", "a"), (2, None, "MIT", "a"), (3, "Apache-2.0", "MIT", "a"), (4, None, "Unlicense", ""), (5, "Unlicense", "Unlicense", ""), (6, None, "Unlicense", "")]
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_headers(spark):
    """SPDX lines, null paths, texts and ids, and a very long file of headers."""
    long = "x = 1\n# This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\n" * 20_000
    rows = [(1, "a/x.py", "# SPDX-License-Identifier: Apache-2.0\nx = 1\ny = 2\nz = 3"), (2, None, None), (None, "b/y.py", "// SPDX-License-Identifier: GPL-3.0\n" + "f(x)\n" * 9), (3, "c/z", long), (4, "d/w", "a licence to kill time")]
    got = {r.doc_id: (r.licence, r.n_headers, r.inherited_licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", 1, None), 2: (None, 0, None), None: ("GPL-3.0", 1, None), 3: ("MPL-2.0", 20_000, "MPL-2.0"), 4: (None, 1, None)}


# 9
def test_suffix_dedup_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ab cdé") for _ in range(700))
    rows = [(i, ("".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) + base[rng.randrange(300) : rng.randrange(300, 700)] + "xyz" * rng.randrange(90))[: rng.randrange(900)]) for i in range(50)]
    rows += [(60, "a" * 350), (61, None), (62, ""), (63, base), (64, base), (65, "ab" * 120)]
    want = suffix_dedup.brute_force(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, a int, anchor string")
    for hot in (suffix_dedup.HOT, 3):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.deduplicated(df, hot=hot).collect()}
        assert got == want


def test_suffix_dedup_odd_rows(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(odd(spark)).collect()}
    assert got[2] == (0, 0) and got[4][1] > 300_000 and got[None] == (7, 0)
    assert suffix_dedup.deduplicated(odd(spark, [])).count() == 0


def test_suffix_dedup_texts_without_own_id(spark):
    """Different texts of one id or of none, of several lengths, and a repeated row."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    new = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(1, new(150) + base[:250]), (None, new(700) + base[100:400] + new(40)), (None, new(130)), (None, base[200:340]), (None, new(20) + base[150:700]), (None, None), (7, base[500:900]), (7, new(120)), (7, new(60) + base[450:650]), (None, new(500) + base[:130])]
    rows.append(rows[4])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in df.distinct().orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = suffix_dedup.brute_force(list(enumerate(order)))
    ids = dict((t, d) for d, t in rows)
    want = sorted([(ids[order[i]], *w) for i, w in want.items()] + [(None, *want[order.index(rows[4][1])])], key=repr)
    for hot in (suffix_dedup.HOT, 1):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.deduplicated(df, hot=hot).collect()]
        assert sorted(got, key=repr) == want


def test_suffix_dedup_hot_anchors(spark):
    """A common line between ever new texts, and texts that differ in the middle, split by longer grams."""
    rng = random.Random(6)
    new = lambda n: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
    line, start, end = new(130), new(60), new(60)
    rows = [(i, new(rng.randrange(5, 120)) + line + new(rng.randrange(5, 120))) for i in range(40)]
    rows += [(100 + i, new(50) + start + new(rng.choice([3, 20])) + end + new(50)) for i in range(40)] + [(200 + i, rng.choice(rows)[1][rng.randrange(40) :]) for i in range(20)]
    want = suffix_dedup.brute_force(rows)
    for hot in (1, 4):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
        assert got == want


def test_suffix_dedup_long_texts(spark, monkeypatch):
    """Texts of many pieces, by small pieces and by a text of 30 MB."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, base), (2, "x" * 77 + base[:1500] + "y" + base[1400:]), (3, base[500:900] + "zz" + base[2000:2600])]
    offsets = np.array([0, 3000, 3050, 6050])
    monkeypatch.setattr(suffix_dedup, "SLICE", 256)
    text, start, low, high = suffix_dedup._pieces(offsets, 100)
    starts = [(t, s + i) for t, s, a, b in zip(text.tolist(), start.tolist(), low.tolist(), high.tolist(), strict=True) for i in range(b - a - 99)]
    assert starts == [(t, i) for t in (0, 2) for i in range(2901)]
    monkeypatch.undo()
    long = "".join(rng.choice("abcdefgh ") for _ in range(1000)) * 30_000
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(spark.createDataFrame([*rows, (4, long)], "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()}
    want = suffix_dedup.brute_force(rows)
    assert all(got[d] == want[d][:2] for d, _ in rows) and got[4] == (30_000_000, 30_000_000 - 1000)


def test_boundaries_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        codes = rng.integers(1, 3, 200).astype(np.uint8)
        codes[rng.integers(0, 200, 6)] = 0
        codes[-1] = 0
        order = suffix_dedup.suffix_order(codes, 12)
        fixed = suffix_dedup.boundaries(codes, order, 3, 12)
        text = bytes(codes)
        for i in range(1, len(order)):
            a, b = text[order[i - 1] :].split(b"\0")[0][:12], text[order[i] :].split(b"\0")[0][:12]
            if len(a) == 12 or len(b) == 12:
                assert fixed[i] == (a != b)


# 10
def _near_rows():
    rng = random.Random(5)
    vocabulary, rows = [f"w{i}" for i in range(400)], []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 11, 12, 15, 30, 60, 120, 300]))]
        for _ in range(10):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    return [*rows, (1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "a"), (1005, "  ")]


@pytest.mark.parametrize("how", [{}, {"block": 5}, {"words": 5, "percent": 80}])
def test_jaccard_brute_force(spark, how):
    rows = _near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert got == jaccard_join.brute_force(rows, **{k: v for k, v in how.items() if k != "block"})


def test_jaccard_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd(spark)).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 3, 4), (5, 0, 5)], key=repr)
    assert jaccard_join.join(odd(spark, [])).count() == 0
    assert jaccard_join.representatives(odd(spark)).columns == odd(spark).columns


def test_jaccard_null_and_repeated_ids(spark):
    """Rows without an id link and are matched; one id on two texts is two documents; of equal rows one stays."""
    a = " ".join(f"a{i}" for i in range(30))
    b = " ".join(f"b{i}" for i in range(30))
    c = " ".join(f"c{i}" for i in range(30))
    rows = [(None, a), (5, a + " end"), (None, b), (None, b + " x"), (None, b), (7, c), (7, "d e f g h i j"), (8, c + " y"), (None, None), (9, ""), (9, "")]
    df = odd(spark, [(*r, "s", "en") for r in rows])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()), key=repr)
    assert got == sorted([(None, 28, 5), (5, 29, 5), (None, 28, None), (None, 29, None), (None, 28, None), (7, 28, 7), (7, 5, 7), (8, 29, 7), (None, 0, None), (9, 0, 9), (9, 0, 9)], key=repr)
    kept = [(r.doc_id, r.text) for r in jaccard_join.representatives(df).collect()]
    assert len(kept) == 6 and {(5, a + " end"), (7, c), (7, "d e f g h i j"), (None, None), (9, "")} < set(kept)
    assert sum(t in (b, b + " x") for _, t in kept) == 1


@pytest.mark.parametrize("how, texts", [({}, ["k435069 k224491 k494138 k524947 k960069 k898937 k576610 k548975 k804551 k424771 k958278"]), ({"words": 5, "percent": 80}, ["k592921 k129815 k993473 k234083 k661259 k657911 k611316 k993744"])])
def test_jaccard_two_documents(spark, how, texts):
    for t in texts:
        got = jaccard_join.join(spark.createDataFrame([(1, t), (2, t + " k64867")], "doc_id long, text string"), **how).collect()
        assert {r.component_id for r in got} == {1}


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_two_sets_of_all_sizes(percent):
    """Of two sets alone in a table, all sizes 1-40 that can link, a common key is kept by both."""
    rng, links = np.random.default_rng(9), 0
    for n in range(1, 41):
        for m in range(n, 41):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared > n:
                continue
            for _ in range(6):
                h = rng.integers(0, 2**63, n + m - shared).astype(np.uint64)
                pair = [np.sort(h[:n]), np.sort(np.concatenate([h[:shared], h[n:]]))]
                assert jaccard_join.linked(*pair, percent)
                if n == m == shared:
                    continue
                links += 1
                owner, keys, of, need, *_ = jaccard_join.part_keys(np.concatenate(pair), np.array([0, n, n + m]), percent)
                common = set(keys[of[owner] == 0].tolist()) & set(keys[of[owner] == 1].tolist())
                kept = [set(), set()]
                for label, s in enumerate(of):
                    kept[s] |= set(sorted(common & set(keys[owner == label].tolist()))[need[label] - 1 :])
                assert kept[0] & kept[1]
    assert links > 500


@pytest.mark.parametrize("how", [{}, {"words": 5, "percent": 80}, {"block": 1}])
def test_jaccard_pairs_of_all_sizes(spark, how):
    """Families of their own words, of all sizes, whose members may be in different classes of sizes: with one word more at the
    end, the most words more that still link, and one more than that."""
    rng, rows = random.Random(17), []
    words, percent = how.get("words", 3), how.get("percent", 90)
    for n in [*range(1, 90), 130, 131, 200, 300]:
        base = [f"f{n}x{rng.randrange(10**6)}" for _ in range(n + words - 1)]
        most = n * (100 - percent) // percent
        for more in {0, 1, most, most + 1}:
            rows.append((len(rows), " ".join(base + [f"e{n}y{more}z{k}" for k in range(more)])))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert got == jaccard_join.brute_force(rows, words, percent)


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 100])
def test_jaccard_large_clusters(spark, block):
    """A thousand near copies, beside families that share parts with them but do not all link."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(1000):
        t = list(base)
        t[rng.randrange(len(t))] = f"x{i}"
        rows.append((i, " ".join(t)))
    for i in range(300):
        t = list(base)
        for _ in range(rng.choice([2, 3, 4, 5, 6, 8, 12])):
            t[rng.randrange(len(t))] = f"y{rng.randrange(60)}"
        rows.append((2000 - i, " ".join(t)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == jaccard_join.brute_force(rows)


@pytest.mark.parametrize("hot", [0, 12])
@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_small_sets_keep_a_common_part(percent, hot):
    """Sets of 4-13 shingles, alone and in hot groups: all linked pairs share a key that neither drops."""
    links = 0
    for seed in range(25):
        rng, family = np.random.default_rng(seed), {}
        for f in range(40):
            base = rng.integers(0, 2**63, rng.integers(4, 14)).tolist()
            for _ in range(4 + hot):
                own = base[rng.integers(2) :] + rng.integers(0, 2**63, rng.integers(2)).tolist()
                family[tuple(sorted(own))] = f
        sets, family = [np.array(x, np.uint64) for x in family], list(family.values())
        owner, keys, of, need, *_ = jaccard_join.part_keys(np.concatenate(sets), np.cumsum([0, *(len(x) for x in sets)]), percent)
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        kept = [set() for _ in sets]
        for label, s in enumerate(of):
            mine = which[owner == label]
            mine = mine[count[mine] > 1]
            kept[s] |= set(mine[np.lexsort((mine, -count[mine]))][need[label] - 1 :].tolist())
        for i in range(len(sets)):
            for j in range(i):
                if family[i] == family[j] and jaccard_join.linked(sets[i], sets[j], percent):
                    links += 1
                    assert kept[i] & kept[j]
    assert links > 500


@pytest.mark.parametrize("few", [jaccard_join.C.BROADCAST_KEYS, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join.C, "BROADCAST_KEYS", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r.a: r.b for r in jaccard_join.components(edges).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {95: 90, 100: 90}


# Pipeline
def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    from quillstone.llm import common

    docs = common.table(spark, sf_dir, "documents")
    names = docs.columns
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, common.persisted(stage(spark, kept, sf_dir), name)
        assert kept.columns == names
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(kept) <= ids(before)
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert ids(kept) == {d for d, (_, c) in jaccard_join.brute_force(rows, 5, 80).items() if c == d}
        if name == "benchmark":
            hit = decontaminate.search(before, common.table(spark, sf_dir, "benchmark")).filter("size(hits) > 0")
            assert ids(kept) == ids(before) - ids(hit)
        if name == "personal":
            assert kept.filter(r"text rlike '@mail\\d'").count() == 0 and kept.filter("n_chars <> length(text)").count() == 0
    mixed = P.STAGES[-1][1](spark, kept, sf_dir)
    taken = {(r.doc_id, r.copies) for r in mixing.plan(kept).filter("copies > 0").collect()}
    assert {(r.doc_id, r.n) for r in mixed.groupBy("doc_id").agg(F.max("copy").alias("n")).collect()} == taken
    assert sorted(r.doc_id for r in P.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in mixed.collect())


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, letterless and repeated rows, an empty table and columns of clashing names through every
    stage, in the order of the pipeline."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda "
    rows = [(1, base * 3 + "Mr Smith, a.b@c.org", "s", "en"), (1, base * 3 + "Mr Smith, a.b@c.org", "s", "en"), (2, None, None, None), (3, "", "s", "en"), (None, base * 3 + "Mr Smith, a.b@c.org", None, None), (5, "12 34", "t", "en")]
    rows += [(6, "eins zwei drei vier fuenf sechs sieben acht neun zehn elf zwoelf", None, "de"), (7, "alpha one two three four five six seven eight nine ten beta gamma", "s", "en"), (None, "eins zwei drei vier fuenf sechs sieben acht", "u", "de")]
    rows += [(10 + i, base + f"mu nu xi no{i} omicron pi{i}", "s", "en") for i in range(4)]
    for given in (rows, []):
        kept = odd(spark, given)
        names = kept.columns
        for name, stage in P.STAGES:
            kept = P.common.persisted(stage(spark, kept, str(tmp_path)), f"odd-{name}")
            assert kept.columns == [*(n for n in names if n != "copy"), *(["copy"] if name == "mixing" else [])]
            ids = sorted((r.doc_id for r in kept.collect()), key=repr)
            if not given:
                assert ids == []
            elif name == "language":  # null, empty and letterless texts go
                assert not {2, 3, 5} & set(ids) and ids.count(1) == 2
            elif name == "near_copies":  # of repeated rows, and of those with the same text but no id, one
                assert ids.count(1) == 1 and kept.filter("text like '%Smith%'").count() == 1
            elif name == "benchmark":
                assert 7 not in ids and 1 in ids
            elif name == "personal":
                assert kept.filter("text like '%Smith%' or text like '%a.b@c.org%'").count() == 0
