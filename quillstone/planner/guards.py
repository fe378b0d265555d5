"""Guards around a question: write intent, rate, retries, scope, parts, and votes among candidate results."""

from __future__ import annotations

import re
import time
from collections import Counter, defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from quillstone.planner.execute import Result

LONGEST = 2000
#: What asks for a change. `some` stands for up to n words between a verb and what it changes.
_some = lambda n, least=0: rf"(?:[\w-]+\s+){{{least},{n}}}"
WRITES = (
    r"\bdelete\b",
    rf"\b(?:drop|dropped|dropping|drp|dropp|droping)\s+{_some(4)}(?:table|column|index|database|view|schema|entire\s+database|everything|all)s?\b",
    r"\b(?:truncate|truncating|trunc)\b",
    r"\b(?:insert|insrt)\s+(?:a\s+|an\s+|new\s+|into|row|record|entry)",
    rf"\b(?:update|updated|updating|updat|updte)\s+{_some(4, 1)}(?:to|set|=|with)(?:\b|\s)",
    rf"\balter\s+{_some(4)}(?:table|column|database|schema)s?\b",
    rf"\bcreate\s+{_some(3)}(?:table|user|account|role|index|view|database|schema)s?\b",
    rf"\bmodify\s+{_some(5, 1)}(?:to|set|with)\b",
    rf"\bremove\s+{_some(5, 1)}(?:from|where|with)\b",
    rf"\bset\s+{_some(2)}[\w-]+\s*=\s*\S",
    rf"\b(?:mark|assign)\s+{_some(5)}(?:as|=|to)(?:\b|\s)",
    r"\bget\s+rid\s+of\b|\b(?:wip(?:e|ed|ing)|clean(?:ing)?|clear)\s+out\b|\b(?:purg(?:e|es|ed|ing)|eradicat(?:e|ing)|nuk(?:e|ed|ing)|zap|zapped)\b",
    r"\b(?:grant|revoke|merge|erase|wipe)\b\s+(?:all|the|every|a|an|my|this|from|into|table|records?|rows?)\b",
    "احذف|حذف|امسح|مسح|أنشئ|انشاء|عدّل|عدل|تعديل|أدخل|إدخال|ادخال|غيّر|تغيير|أضف|اضف|أضيفي|إضافة|اضافة|أزل|ازل|إزالة|ازالة",
)
_WRITES = re.compile("|".join(WRITES), re.I)
#: What parts a question into steps, and into questions of their own.
_SEQUENCE = re.compile(r"\s*(?:,\s*then\b|\.\s*then\b|\band\s+then\b|\bthen\b|\bafter\s+that\b|\bfor\s+(?:those|these)\b|\bof\s+those\b|\bbased\s+on\s+(?:those|that|these)\b)", re.I)
_PARALLEL = re.compile(r"\s*(?:;\s*(?:and\s+)?(?:also\b[, ]?)?|\?\s*and\s+|\?\s+(?=\w)|\.\s*also[, ]|\band\s+also\b|\balso\b|\bas\s+well\s+as\b|\bversus\b|\bvs\.?\s|\bcompared\s+to\b|\band\s+(?=how\s+(?:many|much|long|often)\b)|\band\s+(?=what\s+(?:is|are|was|were)\b))\s*", re.I)
#: What is asked for in one result stays one question.
_TOGETHER = re.compile(r"\bin\s+(?:one|a\s+single|the\s+same)\s+(?:list|table|result|query|output)\b|\bcombined\b|\btogether\b|\bas\s+(?:one|a\s+single)\b|\bside\s+by\s+side\b", re.I)


def wants_write(question: str) -> bool:
    return bool(_WRITES.search(question))


@dataclass
class RateLimiter:
    """At most `most` questions in any `window_s` seconds of a conversation."""

    most: int = 30
    window_s: float = 60.0
    clock: Callable[[], float] = time.monotonic
    seen: dict[str, deque] = field(default_factory=lambda: defaultdict(deque))

    def admits(self, conversation: str) -> bool:
        now, log = self.clock(), self.seen[conversation]
        while log and now - log[0] >= self.window_s:
            log.popleft()
        if len(log) >= self.most:
            return False
        log.append(now)
        return True


@dataclass
class RetryBudget:
    left: int = 7

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def in_scope(schema_similarity: float, question_similarity: float, least_schema: float = 0.55, least_question: float = 0.20) -> bool:
    """Refused only if both similarities are low; two exact zeros mean that none was computed."""
    if schema_similarity == 0 and question_similarity == 0:
        return True
    return schema_similarity >= least_schema or question_similarity >= least_question


def decomposed(question: str) -> tuple[str, list[str]]:
    """('sequential' | 'parallel' | 'single', parts). A grouped question ('by', 'per') is one question, and so is one whose
    parts are wanted together."""
    if _TOGETHER.search(question):
        return "single", [question.strip()]
    if _SEQUENCE.search(question):
        return "sequential", [p.strip(" ,.?") for p in _SEQUENCE.split(question) if p.strip(" ,.?")]
    parts = [p.strip(" ,.?") for p in _PARALLEL.split(question) if p.strip(" ,.?")]
    if len(parts) > 1 and not re.search(r"\b(?:by|per|each)\b", question, re.I):
        return "parallel", parts
    return "single", [question.strip()]


def print_of(result: Result, digits: int = 4) -> str:
    """One cell as it is; else the number of rows and all rows in any order."""
    value = lambda v: f"{round(v, digits):g}" if isinstance(v, float) else str(v)
    if len(result.rows) == 1 and len(result.rows[0]) == 1:
        return "=" + value(result.rows[0][0])
    return f"{len(result.rows)}:" + "|".join(sorted(",".join(map(value, r)) for r in result.rows))


def vote(results: list[Result], lossy: list[bool] | None = None) -> int | None:
    """The index of the winner: a majority of two or more; else the first, then the least lossy, then the most rows."""
    lossy = lossy or [False] * len(results)
    good = [i for i, r in enumerate(results) if not r.error]
    if not good:
        return None
    counts = Counter(print_of(results[i]) for i in good)
    best, n = counts.most_common(1)[0]
    if n >= 2 and sum(c == n for c in counts.values()) == 1:
        return next(i for i in good if print_of(results[i]) == best)
    tied = [i for i in good if counts[print_of(results[i])] == n]
    return min(tied, key=lambda i: (i != 0, lossy[i], -len(results[i].rows)))
