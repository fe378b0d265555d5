"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses (not after words like version or section), card numbers (with a card's first
digit and a valid check digit), phone numbers, IBANs, US social security numbers, secrets assigned to a name with a word
like token or password in it, and persons after a title (Mr, Frau, Madame, Señora, г-жа ...). Not detected: names without a
title, street addresses, secrets of less than 8 characters or, unless quoted, without a digit.

An entity is made of parts, each with a surrogate of its own that depends on the key, the part's kind and its normal form
(lower case, digits alone, ...): an e-mail address of its local part and its domain, a person of given names (by the title's
gender) and a surname, all others of one. So a surname keeps its surrogate with any given name or none, and addresses of one
domain stay together, however they are written. A surrogate has the type and the format of the original: letters for
letters, digits for digits, punctuation, case and script kept, a valid check digit where there was one, domains of the
reserved kind.

Distinctness is checked over the whole table, part by part: parts whose surrogates meet, or whose surrogate is a part that
occurs, are drawn anew until none is left. From draw WIDE on a surrogate is longer than its original, so that a format with
too few values for what occurs still gets distinct ones. Only these exceptions (normally none) are looked up again for the
texts that hold them, by a broadcast of a counted size where they are few; all other surrogates are computed in place, so a
common entity causes no skew.

The key has no default in the operators. The query and the pipeline take it from spark.quillstone.pii.key; where that is
unset they draw one at random for the application, so that nobody can repeat or invert its surrogates. A key stands in
plans and event logs like any literal.

Defined results: a null text stays null with no entities; texts without entities stay as they are; repeated rows stay;
no other column is read or changed, whatever its name (but `rewritten` sets n_chars where there is one).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEY_SETTING = "spark.quillstone.pii.key"
#: The first draw that is longer than its original.
WIDE = 6
#: Texts with exceptions whose lists of draws are broadcast.
BROADCAST_TEXTS = 100_000

#: Titles before a name.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "госпожа", "г-жа", "Κυρία")
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος")
#: Names that secrets are assigned to.
SECRETS = ("token", "secret", "password", "passwd", "pwd", "api[_-]?key", "access[_-]?key", "auth[_-]?key", "private[_-]?key")
#: Words before four numbers that are no address.
NUMBERED = ("version", "versions", "ver", "release", "build", "section", "chapter", "rev", "revision", "firmware")

_START = r"(?<![\p{L}\p{N}._%+-])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "(?:" + "|".join(FEMALE + MALE) + r")\.?\s"
_SECRET = "(?:" + "|".join(SECRETS) + r")[\p{L}\p{N}_-]{0,24}[\"']?\s{0,4}[:=]\s{0,4}"
_UNQUOTED = r"(?=[^\s\"'<>,;]{0,400}\d)[^\s\"'<>,;]{7,}[\p{L}\p{N}+/=_-]"
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+",
    "ip": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([-. ])\d{3}\1\d{4})",
    "card": r"[2-6](?:[ -]?\d){12,18}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "person": rf"{_TITLE}{_NAME}(?:\s{_NAME}){{0,2}}",
    "secret": rf"(?i:{_SECRET})(?:\"[^\"\s]{{8,}}|'[^'\s]{{8,}}|{_UNQUOTED})",
}
#: What must not stand before and after an entity; a first look spares most places the rest. A secret's name may have a
#: prefix (DB_PASSWORD), which stays.
_FIRST = "".join(sorted({w[0] for w in FEMALE + MALE}))
_BEFORE = {"ip": r"(?=\d{1,3}\.\d)(?<!(?i:" + "|".join(NUMBERED) + r")[ .:]{1,2})", "ssn": r"(?=\d)", "card": r"(?=\d)", "phone": r"(?=[\d(+])", "person": f"(?=[{_FIRST}])"}
_AFTER = {"ip": r"(?![\d.]*\d)", "ssn": r"(?!\d)", "phone": r"(?!\d)", "card": r"(?!\d)", "iban": r"(?![\p{L}\p{N}])"}
# A phone number may begin with a plus sign, which _START takes for a part of a word only before it.
_PLAIN = "|".join(_BEFORE.get(k, "") + p.replace(r"\1", r"[-. ]") + _AFTER.get(k, "") for k, p in PATTERNS.items() if k != "secret")
ANY = rf"{_START}(?:{_PLAIN})|(?=[{''.join(sorted({c for w in SECRETS for c in (w[0], w[0].upper())}))}])(?<![\p{{L}}\p{{N}}])" + PATTERNS["secret"]


def _matches(kind: str, x: Column) -> Column:
    """Of what ANY found, so what stands before and after it is in order."""
    return x.rlike(f"^(?:{PATTERNS[kind]})$")


def kind_of(x: Column) -> Column:
    """Null for what only looks like an entity: a number without a valid check digit."""
    out = F.when(F.contains(x, F.lit("@")) & _matches("email", x), "email")
    for k in ("ip", "ssn", "phone"):
        out = out.when(_matches(k, x), k)
    out = out.when(_matches("card", x), F.when(_luhn_sum(_digits(x)) % 10 == 0, "card"))
    for k in ("iban", "person", "secret"):
        out = out.when(_matches(k, x), k)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _secret_value(x: Column) -> Column:
    return F.regexp_extract(x, rf"(?s)^(?i:{_SECRET})[\"']?(.*)$", 1)


def _name_words(x: Column) -> Column:
    return F.slice(F.split(F.regexp_replace(F.lower(x), r"\s+", " "), " "), 2, 8)


def _gender(x: Column) -> Column:
    return F.when(x.rlike("^(?:" + "|".join(FEMALE) + r")\.?\s"), "f").otherwise("m")


def parts_of(kind: Column, x: Column) -> Column:
    """An entity's parts: array of (kind, normal form)."""
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("normal"))
    normal = F.when(kind.isin("ssn", "phone", "card"), _digits(x)).when(kind == "iban", F.replace(x, F.lit(" "))).when(kind == "secret", _secret_value(x)).otherwise(x)
    words = _name_words(x)
    named = lambda w, i: part(F.when(i == F.size(words) - 1, "surname").otherwise(F.concat(F.lit("given_"), _gender(x))), w)
    mail = F.array(part(F.lit("local"), F.lower(x)), part(F.lit("domain"), F.substring_index(F.lower(x), "@", -1)))
    return F.when(kind == "email", mail).when(kind == "person", F.transform(words, named)).otherwise(F.array(part(kind, normal)))


def _digest(key: str, *what: Column) -> Column:
    """128 hex digits."""
    seed = F.concat_ws("\x1f", F.lit(key), *what)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))


def _number(digest: Column, at: Column) -> Column:
    """The at-th (from 0, cyclic) byte of a digest."""
    return F.conv(F.substr(digest, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _redrawn(x: Column, digest: Column) -> Column:
    """Letters for letters of the same script and case, digits for digits."""

    def one(c, i):
        n = _number(digest, i)
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(n % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
            .when(c.rlike(r"\p{L}"), _pick("éüñôàçöâ", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(x, ""), one), "")


#: Syllables of surrogate names by script: consonants, vowels, last letter of women's and of men's given names.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "a", "n"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу", "а", "н"), "greek": ("βγδζκλμνπρστφχ", "αεηιο", "α", "ς")}


def _syllables(script: str, digest: Column, count: int) -> Column:
    consonants, vowels, _, _ = SYLLABLES[script]
    return F.concat(*(_pick(x, _number(digest, F.lit(2 * k + j))) for k in range(count) for j, x in enumerate((consonants, vowels))))


def _name(kind: Column, word: Column, digest: Column, wide: Column) -> Column:
    """A surname or given name in the word's script, longer if it is wide."""

    def written(script):
        consonants, _, female, male = SYLLABLES[script]
        made = lambda n: F.when(kind == "surname", F.concat(_syllables(script, digest, n + 1), _pick(consonants, _number(digest, F.lit(2 * n + 2))))).otherwise(F.concat(_syllables(script, digest, n), F.when(kind == "given_f", female).otherwise(male)))
        return F.when(wide, made(9)).otherwise(made(3))

    return F.when(word.rlike(r"\p{IsCyrillic}"), written("cyrillic")).when(word.rlike(r"\p{IsGreek}"), written("greek")).otherwise(written("latin"))


def _luhn_sum(digits: Column) -> Column:
    reversed_digits = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_digits, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _card(normal: Column, digest: Column) -> Column:
    drawn = _redrawn(normal, digest)
    body = drawn.substr(F.lit(1), F.length(drawn) - 1)
    check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn_sum(normal) % 10 == 0, F.concat(body, check)).otherwise(drawn)


def surrogate_of(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """A part's surrogate in normal form. A local part's is followed by the real domain, within which it is distinct."""
    wide = attempt >= WIDE
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)

    def made(digest: Column) -> Column:
        more = F.when(wide, F.substring(F.regexp_replace(F.reverse(digest), "[a-f]", ""), 1, 18)).otherwise("")
        ip = F.array_join(F.transform(F.sequence(F.lit(0), F.when(wide, 11).otherwise(3)), lambda i: (_number(digest, i) % 223 + 1).cast("string")), ".")
        prefix = lambda n: F.concat(F.substring(normal, 1, n), _redrawn(normal.substr(F.lit(n + 1), F.length(normal)), digest), more)
        hexadecimal = F.substr(F.repeat(digest, F.floor(F.length(normal) / 128).cast("int") + 1), F.lit(1), F.length(normal))
        return (
            F.when(kind == "local", F.concat(_redrawn(local, digest), more, F.lit("@"), domain))
            .when(kind == "domain", F.concat(_redrawn(F.rpad(F.substring_index(domain, ".", 1), 6, "x"), digest), more, F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _number(digest, F.lit(63)) % 3 + 1)))
            .when(kind == "ip", ip)
            .when(kind == "card", F.concat(_card(normal, digest), more))
            .when(kind == "phone", F.when(F.length(normal) > 8, prefix(1)).otherwise(F.concat(_redrawn(normal, digest), more)))
            .when(kind == "iban", prefix(2))
            .when((kind == "secret") & normal.rlike("^[0-9a-f]+$"), F.concat(hexadecimal, more))
            .when((kind == "secret") & normal.rlike("^[0-9A-F]+$"), F.concat(F.upper(hexadecimal), more))
            .when(kind.isin("surname", "given_f", "given_m"), _name(kind, normal, digest, wide))
            .otherwise(F.concat(_redrawn(normal, digest), more))
        )

    # Bound to a variable, so that it is computed once for all letters.
    return F.element_at(F.transform(F.array(_digest(key, kind, normal, attempt.cast("string"))), made), 1)


def _dressed(kind: Column, surface: Column, made: Column) -> Column:
    """The parts' surrogates written as the original was; what a wide one has more comes last."""
    normal = made[0]
    place = lambda i: F.length(F.regexp_replace(surface.substr(F.lit(1), i + 1), r"\D", ""))
    rest = lambda n: normal.substr(n + 1, F.length(normal))
    over = F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(normal, place(i), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(normal, F.length(F.replace(surface.substr(F.lit(1), i + 1), F.lit(" "))), F.lit(1)))), "")
    mail = F.concat(F.substring_index(normal, "@", 1), F.lit("@"), made[1])
    return (
        F.when(kind.isin("ssn", "phone", "card"), F.concat(over, rest(F.length(_digits(surface)))))
        .when(kind == "email", F.when(F.upper(surface) == surface, F.upper(mail)).otherwise(mail))
        .when(kind == "iban", F.concat(spaced, rest(F.length(F.replace(surface, F.lit(" "))))))
        .when(kind == "secret", F.concat(surface.substr(F.lit(1), F.length(surface) - F.length(_secret_value(surface))), normal))
        .when(kind == "person", F.concat(F.regexp_extract(surface, r"^(\S+\s)", 1), F.initcap(F.array_join(made, " "))))
        .otherwise(normal)
    )


_A, _B = "\x01", "\x02"


def _parts(text: Column) -> Column:
    """The text cut before and after every entity: entities have odd places (from 0). Marks in the text are escaped."""
    escaped = F.replace(F.replace(text, F.lit(_B), F.lit(_B + "b")), F.lit(_A), F.lit(_B + "a"))
    return F.split(F.regexp_replace(escaped, ANY, f"{_A}$0{_A}"), _A, -1)


def _joined(parts: Column) -> Column:
    return F.replace(F.replace(F.array_join(parts, ""), F.lit(_B + "a"), F.lit(_A)), F.lit(_B + "b"), F.lit(_B))


def _annotated(pieces: Column) -> Column:
    """Each piece x with its kind and parts, null where it is no entity. One step at a time keeps the expressions small."""
    kinds = F.transform(pieces, lambda x, i: F.struct(x.alias("x"), F.when(i % 2 == 1, kind_of(x)).alias("kind")))
    return F.transform(kinds, lambda s: F.struct(s["x"].alias("x"), s["kind"].alias("kind"), F.when(s["kind"].isNotNull(), parts_of(s["kind"], s["x"])).alias("parts")))


def _parts_in(annotated: Column) -> Column:
    return F.flatten(F.transform(F.filter(annotated, lambda s: s["kind"].isNotNull()), lambda s: s["parts"]))


def entities(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct parts of entities: kind, normal."""
    some = documents.select(F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    return some.select(F.explode(_parts_in(_annotated(_parts(F.col("t"))))).alias("e")).select("e.kind", "e.normal").distinct()


def exceptions(found: DataFrame, key: str) -> DataFrame | None:
    """Parts that need another draw than the first: kind, normal, attempt. None if there are none, as is usual. Ends since
    wide draws hardly ever meet."""
    drawing = lambda df, n: df.withColumn("attempt", F.lit(n)).withColumn("made", surrogate_of(F.col("kind"), F.col("normal"), F.col("attempt"), key))
    drawn, attempt = C.persisted(drawing(found, 0), "pii-entities"), 0
    while True:
        real = drawn.select("kind", F.col("normal").alias("made"))
        # The first of those that meet keeps its draw; a draw that is a real part is kept by none.
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "normal")).alias("keep"), F.count("*").alias("n")).filter("n > 1").select("kind", "made", "keep")
        met = drawn.join(first, ["kind", "made"]).filter(F.col("keep.normal") != F.col("normal")).select("kind", "normal")
        taken = drawn.join(real, ["kind", "made"], "left_semi").select("kind", "normal")
        again = C.persisted(met.unionAll(taken).distinct(), "pii-again")
        if again.isEmpty():
            break
        attempt += 1
        drawn = C.persisted(drawn.join(again, ["kind", "normal"], "left_anti").unionByName(drawing(again, attempt)), "pii-entities")
    return C.persisted(drawn.filter("attempt > 0").select("kind", "normal", "attempt"), "pii-late") if attempt else None


def _replaced(annotated: Column, attempt_of, key: str) -> Column:
    made = lambda s: F.transform(s["parts"], lambda p: surrogate_of(p["kind"], p["normal"], attempt_of(p), key))
    drawn = F.transform(annotated, lambda s: F.struct(s["x"].alias("x"), s["kind"].alias("kind"), F.when(s["kind"].isNotNull(), made(s)).alias("made")))
    return F.transform(drawn, lambda s: F.when(s["kind"].isNull(), s["x"]).otherwise(_dressed(s["kind"], s["x"], s["made"])))


def _rewrite(documents: DataFrame, text_col: str, key: str) -> DataFrame:
    """Adds __new and __n (entities)."""
    late = exceptions(entities(documents, text_col), key)
    docs = documents.withColumn("__parts", _parts(F.col(text_col)))
    attempt = lambda p: F.lit(0)
    if late is not None:
        sep = F.lit("\x1f")
        own = docs.filter(F.size("__parts") > 1).select(F.md5(text_col).alias("__id"), F.explode(_parts_in(_annotated(F.col("__parts")))).alias("e"))
        own = own.select("__id", "e.kind", "e.normal").distinct().join(C.small(late), ["kind", "normal"])
        maps = C.persisted(own.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", sep, "normal"), "attempt"))).alias("__late")), "pii-late-texts")
        # Texts are shuffled only where very many hold exceptions; both sides are then plain, so a common text can be split.
        docs = docs.withColumn("__id", F.md5(text_col)).join(C.small(maps, BROADCAST_TEXTS), "__id", "left").drop("__id")
        attempt = lambda p: F.coalesce(F.col("__late")[F.concat(p["kind"], sep, p["normal"])], F.lit(0))
    docs = docs.withColumn("__said", F.when(F.size("__parts") > 1, _annotated(F.col("__parts"))))
    new = F.when(F.col("__said").isNull(), F.col(text_col)).otherwise(_joined(_replaced(F.col("__said"), attempt, key)))
    n = F.coalesce(F.size(F.filter("__said", lambda s: s["kind"].isNotNull())), F.lit(0))
    return docs.withColumn("__new", new).withColumn("__n", F.greatest(n, F.lit(0)).cast("long"))


def surrogates(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    own = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _rewrite(own, "text", key).select("doc_id", F.col("__new").alias("text"), F.col("__n").alias("n_entities"))


def rewritten(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with surrogates in the text and n_chars to match."""
    names = documents.columns
    out = _rewrite(documents, text_col, key).withColumn(text_col, F.col("__new"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(documents.schema["n_chars"].dataType))
    return out.select(*(f"`{n}`" for n in names))


_drawn_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """From KEY_SETTING; where it is unset, a random one that lives as long as the application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def op4_pii(spark, sf_dir):
    return surrogates(C.table(spark, sf_dir, "documents"), session_key(spark))
