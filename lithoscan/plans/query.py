"""Search strings and what they ask for."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "method": "method", "m": "method", "type": "type", "t": "type", "class": "type", "c": "type",
    "field": "field", "f": "field", "property": "field", "p": "field", "def": "definition", "d": "definition",
}


@dataclass
class ParsedQuery:
    keywords: list[str] = field(default_factory=list)
    type: str | None = None
    method: str | None = None
    field: str | None = None
    definition: str | None = None

    def combined(self) -> str:
        filters = [x for x in (self.type, self.method, self.field, self.definition) if x]
        return " ".join([*filters, *self.keywords])

    def sections(self) -> dict[str, str | list[str]]:
        """Sections to plan, and the term of each."""
        out: dict[str, str | list[str]] = {}
        if self.type is not None or not (self.method or self.field or self.definition):
            out["types"] = self.type or self.combined()
        if self.method is not None or self.field is not None or self.keywords:
            out["members"] = [x for x in (self.method, self.field) if x] + self.keywords
        if self.definition is not None or not (self.type or self.method or self.field):
            out["defs"] = self.definition or self.combined()
            if self.keywords:
                out["content"] = self.keywords
        return out


def tokens(raw: str) -> list[str]:
    """Split at white space outside double quotes; the quotes go."""
    out, word, quoted = [], [], False
    for c in raw:
        if c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            out.append("".join(word))
            word = []
        else:
            word.append(c)
    return [t for t in [*out, "".join(word)] if t]


def parse(raw: str | None) -> ParsedQuery:
    """``prefix:value`` sets a filter, the last of its kind counting; an unknown
    prefix makes the token a keyword."""
    found = ParsedQuery()
    for token in tokens(raw or ""):
        prefix, colon, value = token.partition(":")
        kind = KINDS.get(prefix.lower()) if colon else None
        if kind:
            setattr(found, kind, value)
        else:
            found.keywords.append(token)
    return found


_TEXTS, _LISTS = ("type", "method", "field", "definition", "combined"), ("keywords", "sections")
PARSED = T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS])


@F.pandas_udf(PARSED)
def parsed(raw: pd.Series) -> pd.DataFrame:
    """Search strings of a column: filters, keywords, the combined term and the
    sections they plan, in order; null counts as empty."""
    found = [parse(text) for text in raw]
    rows = [(q.type, q.method, q.field, q.definition, q.combined(), q.keywords, sorted(q.sections())) for q in found]
    return pd.DataFrame(rows, columns=[*_TEXTS, *_LISTS])
