"""Roles inferred from schemas, and linking of questions to tables and values. All on the driver, over names only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from quillstone.planner.graph import closure
from quillstone.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey

#: Name parts that hint at roles.
LABEL_HINTS = ("name", "title", "label", "code")
PERSON_HINTS = ("customer", "user", "employee", "agent", "person", "supplier")
PRIVATE_HINTS = ("email", "phone", "address", "national", "ssn", "passport", "birth", "iban", "password")
DATE_ROLES = {"created": ("created", "signup", "order", "issued"), "due": ("due", "deadline"), "closed": ("closed", "resolved", "completed", "paid", "ship"), "changed": ("updated", "modified")}
LOOKUP_COLUMNS = 6
#: Foreign keys that point at a table of persons at least.
PERSON_KEYS = 3


@dataclass(frozen=True)
class TableRoles:
    name: str
    label: str | None
    is_lookup: bool
    is_bridge: bool
    is_person: bool
    soft_delete: str | None
    private: tuple[str, ...]
    dates: dict[str, str]


def inferred(name: str, schema: T.StructType, keys: tuple[ForeignKey, ...] = FOREIGN_KEYS) -> TableRoles:
    columns = [f.name for f in schema]
    out = [k for k in keys if k.table == name]
    into = [k for k in keys if k.target == name]
    text = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    label = next((c for h in LABEL_HINTS for c in text if c.lower().endswith(h)), None)
    dates = {}
    for f in schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            role = next((r for r, hints in DATE_ROLES.items() if any(h in f.name.lower() for h in hints)), "other")
            dates.setdefault(role, f.name)
    return TableRoles(
        name,
        label,
        is_lookup=not out and bool(into) and len(columns) <= LOOKUP_COLUMNS and label is not None and name in PRIMARY_KEYS,
        is_bridge=len(out) == 2 and len(columns) <= 4,
        is_person=any(h in name for h in PERSON_HINTS) and len(into) >= PERSON_KEYS,
        soft_delete=next((c for c in columns if re.search(r"is_?deleted$", c, re.I)), None),
        private=tuple(c for c in columns if any(h in c.lower() for h in PRIVATE_HINTS)),
        dates=dates,
    )


def trigram(a: str, b: str) -> float:
    grams = lambda s: {f"  {s.lower()}  "[i : i + 3] for i in range(len(s) + 2)}
    if a.lower() == b.lower():
        return 1.0
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def singular(word: str) -> str:
    for end, new in (("ies", "y"), ("sses", "ss"), ("s", "")):
        if word.endswith(end) and not word.endswith("ss") and len(word) > len(end) + 2:
            return word[: -len(end)] + new
    return word


def linked_tables(question: str, tables: set[str], synonyms: dict[str, str] | None = None, values: dict[str, str] | None = None, least: float = 0.70, hops: int = 4) -> set[str]:
    """Tables that the question names (as they are, in the singular, by synonym, nearly) or anchors by a value, and those
    between them. values: lower-cased value to table."""
    words = re.findall(r"\w+", question.lower())
    found = set()
    for w in words:
        for t in tables:
            if singular(w) == singular(t) or (len(w) >= 4 and trigram(singular(w), singular(t)) >= least):
                found.add(t)
        found |= {t for t in ((synonyms or {}).get(w), (synonyms or {}).get(singular(w)), (values or {}).get(w)) if t in tables}
    return closure(found, hops) if found else found


def folded(text: str) -> str:
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    return re.sub(r"[^\w]+|_", " ", text).lower().strip()


#: Words that make a following value a verb of the sentence, not a filter.
VERB_CONTEXT = ("to", "will", "can", "must", "should", "please")


def linked_values(question: str, index: dict[str, str], least: float = 0.75) -> dict[str, str]:
    """Values of the index (value to column) in the question, whole words only, longest first, at most four words: as they
    are or in the plural, else nearly."""
    words, used, found = folded(question).split(), set(), {}
    known = {folded(v): v for v in index if len(folded(v)) >= 3}
    for n in range(4, 0, -1):
        for i in range(len(words) - n + 1):
            if used & set(range(i, i + n)) or (i and words[i - 1] in VERB_CONTEXT):
                continue
            phrase = " ".join(words[i : i + n])
            value = known.get(phrase) or known.get(singular(phrase))
            if value is None and len(phrase) >= 5:
                best = max(known, key=lambda k: trigram(phrase, k), default=None)
                value = known[best] if best and trigram(phrase, best) >= least else None
            if value is not None:
                used |= set(range(i, i + n))
                found[value] = index[value]
    return found


#: Cues of questions.
CUES = {
    "superlative": r"\b(?:most|least|highest|lowest|largest|smallest|best|worst|top|bottom)\b",
    "negation": r"\b(?:not|no|without|never|except|excluding)\b",
    "range": r"\b(?:between|from .+ to|more than|less than|at least|at most|over|under)\b",
    "granularity": r"\b(?:daily|weekly|monthly|quarterly|yearly|per (?:day|week|month|quarter|year)|by (?:day|week|month|quarter|year))\b",
    "lifecycle": r"\b(?:created|opened|closed|resolved|shipped|paid|signed up)\b",
    "all_time": r"\b(?:all time|ever|so far|in total)\b",
    "distinct": r"\b(?:distinct|different|unique)\b",
}


def cues(question: str) -> frozenset[str]:
    return frozenset(name for name, p in CUES.items() if re.search(p, question, re.I))
