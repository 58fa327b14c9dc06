"""What captured migration statements are: transaction marks, pure reads, data statements."""

from __future__ import annotations

import re

from quillon.tenant import splitter

#: Fixed value: the bookkeeping table, whose rows are no data of the tenant.
BOOKKEEPING = "django_migrations"
WRITES = {"INSERT", "UPDATE", "DELETE", "REPLACE"}


def mark(statement: str) -> str:
    """begin, commit, rollback or other; savepoints are other, as they end nothing."""
    words = splitter.bare(statement).upper().rstrip(";").split()
    if not words:
        return "other"
    if words[0] == "BEGIN":
        return "begin"
    if words[0] in ("COMMIT", "END"):
        return "commit"
    return "rollback" if words[0] == "ROLLBACK" and "TO" not in words else "other"


def pure_read(statement: str) -> bool:
    """SELECT, or a PRAGMA without assignment; WITH may write, so it never counts."""
    word = splitter.leading_word(statement)
    return word == "SELECT" or (word == "PRAGMA" and "=" not in splitter.bare(statement))


def data_statement(statement: str) -> bool:
    """Rows written literally: no bookkeeping, and no copy of a table's own rows."""
    text = splitter.bare(statement)
    if splitter.leading_word(text) not in WRITES or re.search(rf'\b{BOOKKEEPING}\b', text):
        return False
    return not re.match(r"(?is)(insert|replace)\b.*?\bselect\b", re.sub(r"'(?:[^']|'')*'", "''", text))


def replayable(statements: list[str]) -> list[str]:
    """Without what only read."""
    return [s for s in statements if not pure_read(s)]
