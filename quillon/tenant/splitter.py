"""Scripts to statements, and statements to their leading word, with SQL's quoting and comments."""

from __future__ import annotations

import re

#: Quoted texts and names, comments, the statement end; anything else a character at a time.
TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|--[^\n]*|/\*.*?(?:\*/|\Z)|;|.""", re.S)


def split(script: str) -> list[str]:
    """The statements of a script, without empty ones."""
    out, now = [], []
    for m in TOKEN.finditer(script):
        if m[0] == ";":
            out.append("".join(now))
            now = []
        else:
            now.append(m[0])
    out.append("".join(now))
    return [s.strip() for s in out if bare(s)]


def bare(statement: str) -> str:
    """Without comments and outer white space."""
    return "".join(" " if m[0].startswith(("--", "/*")) else m[0] for m in TOKEN.finditer(statement)).strip()


def leading_word(statement: str) -> str:
    return (re.match(r"[A-Za-z]+", bare(statement)) or [""])[0].upper()


def parameters(statement: str) -> int:
    """Number of ``?`` markers outside quotes and comments."""
    return sum(m[0] == "?" for m in TOKEN.finditer(statement))
