"""Regular expressions with the meaning that Python's ``re.search`` gives them.

A literal pattern is rewritten once for the JVM's engine and stays inside the plan; patterns that come
from a column go through an Arrow UDF that calls ``re`` itself.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unix line ends, Unicode classes, Unicode case folding.
FLAGS = "(?dUu)"


def translate(pattern: str) -> str:
    """The JVM form of a Python pattern; an invalid pattern raises ``re.error`` as Python does."""
    re.compile(pattern)
    out: list[str] = []
    names: dict[str, str] = {}
    i, inside = 0, False
    while i < len(pattern):
        c = pattern[i]
        rest = pattern[i:]
        if c == "\\":
            pair = pattern[i : i + 2]
            out.append({"\\Z": "\\z", "\\s": "[\\s\\x1c-\\x1f]"}.get(pair, pair) if not inside else pair)
            i += 2
        elif inside:
            out.append("\\" + c if c in "[&~" else c)
            inside = c != "]"
            i += 1
        elif c == "[":
            inside = True
            head = re.match(r"\[\^?\]?", rest).group()
            out.append(head.replace("]", "\\]"))
            i += len(head)
        elif m := re.match(r"\(\?P<(\w+)>", rest):
            names[m[1]] = f"g{len(names)}x"
            out.append(f"(?<{names[m[1]]}>")
            i += m.end()
        elif m := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"\\k<{names[m[1]]}>")
            i += m.end()
        else:
            out.append(c)
            i += 1
    return FLAGS + "".join(out)


def search(text: Column, pattern: str) -> Column:
    """Whether a literal pattern is found in a text; NULL for NULL."""
    return text.rlike(translate(pattern))


def _search_each(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or t is None else re.search(p, t) is not None for p, t in zip(patterns, texts, strict=True)], dtype=object)


#: Pattern and text as columns, in this order.
search_column = F.pandas_udf(_search_each, T.BooleanType())
