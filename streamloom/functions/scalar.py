"""Small functions of the streams that are not geography."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_diff_ms(t1: Column | str, t2: Column | str) -> Column:
    return F.unix_millis(t2) - F.unix_millis(t1)


def erraticness_desc(e: Column) -> Column:
    level = (e / 2.5).cast("int")
    return F.when(level == 0, "calm").when(level == 1, "busy").otherwise("crazy")


_WORDS = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)|('[^'\\]*')|(\d+(?:\.\d+)?)|(<=|>=|<>|!=|==|[-+*/%<>=(),]))")
_CALLS = frozenset(("abs", "floor", "ceil", "round", "sqrt", "cos", "sin", "least", "greatest", "coalesce", "minute", "hour", "unix_millis", "timestamp"))
_KEYWORDS = frozenset(("and", "or", "not", "between", "in", "is", "null", "true", "false"))


def safe_predicate(text: str, columns: list[str], calls: frozenset[str] = _CALLS) -> Column:
    """A user's predicate as a column, if it uses only these columns, listed functions, literals and operators.

    Anything else, such as a call that reaches outside the engine, raises ValueError. A literal may hold no
    backslash, with which it could end elsewhere than it seems to; what is parsed is what was checked, put
    together again from its parts, so nothing that two parts make together (a comment) is left in it.
    """
    at, end, names, parts = 0, len(text.rstrip()), {c.lower() for c in columns}, []
    while at < end:
        m = _WORDS.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a predicate: {text[at:at + 20]!r}")
        at = m.end()
        if m[1]:
            word, called = m[1].lower(), text[at:].lstrip().startswith("(")
            if called and word not in calls and word not in _KEYWORDS or not called and word not in names | _KEYWORDS:
                raise ValueError(f"not allowed in a predicate: {m[1]}")
            if text[at : at + 1] == "'":
                raise ValueError(f"not allowed in a predicate: {m[1]}'")
        part = m[0].strip()
        parts.append("=" if part == "==" else part)
    return F.expr(" ".join(parts))
