"""What names of columns say: hints, tokens and similarity."""

from __future__ import annotations

import difflib
import re

# Parts of names that hint at a meaning.
DATE_HINTS = ("date", "time", "timestamp", "day", "month", "year", "created", "updated", "dob", "birth", "signup", "joined", "expiry", "expires", "_at", "_on")
ID_NAME = re.compile(r"(?:^|_)(?:id|pk|uuid|guid|key|code|number|num|no|sku|ssn)(?:_|$)", re.I)
ARTIFACT_NAME = re.compile(r"(?:^|_)(?:index|unnamed|row_?(?:id|num|number)|internal|record_number|import_timestamp|raw|checksum|hash)(?:_|$)", re.I)
NON_NEGATIVE_NAME = re.compile(r"(?:^|_)(?:qty|quantity|count|amount|price|total|age|cost|sales|units|stock|salary|income|revenue)(?:_|$)", re.I)
METRIC_HINTS = ("amount", "total", "price", "sales", "revenue", "income", "cost", "value", "charge", "profit", "quantity", "score")
GROUP_HINTS = ("category", "segment", "region", "country", "type", "status", "group", "department", "product", "channel", "city", "state")
TARGET_NAMES = ("target", "label", "churn", "class", "y", "outcome", "result", "default", "fraud")
#: Words that names of columns abbreviate.
WORDS = ("account", "address", "amount", "category", "customer", "date", "department", "description", "employee", "invoice", "location", "manager", "number", "order", "organization", "percent", "phone", "product", "quantity", "reference", "transaction", "user")
#: Short forms that no rule would find.
SHORT_FORMS = {"no": "number", "txn": "transaction", "tel": "phone", "mob": "phone"}


def written_out(part: str) -> str:
    """The word that a part of a name abbreviates, or the part itself.

    A short form has the letters of its word in order, from the first on: either two letters alike at
    the start, as in dept, or no vowel after the first, as in qty.  Plurals lose their s.
    """
    if part in SHORT_FORMS:
        return SHORT_FORMS[part]
    for form in (part, part[:-1] if part.endswith("s") else ""):
        if form in WORDS:
            return form
        bare = len(form) >= 2 and not set(form[1 if len(form) > 2 else 0 :]) & set("aeiou")
        for word in WORDS:
            left = iter(word)
            alike = len(form) >= 3 and form[:2] == word[:2]
            if form[:1] == word[0] and (bare or alike) and len(form) < len(word) and all(c in left for c in form):
                return word
    return part


def tokens(name: str) -> list[str]:
    """The parts of a name, abbreviations written out."""
    parts = re.findall(r"[a-z]+|\d+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())
    return [written_out(p) for p in parts]


def similarity(a: str, b: str) -> float:
    """1 for the same parts; else the larger of their Jaccard and 0.85 of the ratio of matching blocks."""
    ta, tb = tokens(a), tokens(b)
    ca, cb = " ".join(ta), " ".join(tb)
    if ca and (ca == cb or _without_repeats(ta) == _without_repeats(tb)):
        return 1.0
    sa, sb = set(ta), set(tb)
    jaccard = len(sa & sb) / len(sa | sb) if sa | sb else 0.0
    return max(jaccard, 0.85 * difflib.SequenceMatcher(None, ca, cb).ratio())


def _without_repeats(parts: list[str]) -> list[str]:
    return [p for k, p in enumerate(parts) if k == 0 or p != parts[k - 1]]


def type_agreement(a: str, b: str) -> float:
    """How well two logical types go together."""
    if a == b:
        return 1.0
    if {a, b} == {"numeric", "boolean"}:
        return 0.7
    return 0.5 if {a, b} <= {"categorical", "text", "numeric"} else 0.0


def looks_like_id(name: str) -> bool:
    return bool(ID_NAME.search(name))


def looks_like_date(name: str) -> bool:
    return any(h in name.lower() for h in DATE_HINTS)


def is_artifact(name: str) -> bool:
    return bool(ARTIFACT_NAME.search(name))
