"""Errors that a tenant sees: a code, a status and a text."""

from __future__ import annotations


class TenantError(Exception):
    def __init__(self, code: str, status: int, message: str):
        super().__init__(message)
        self.code, self.status = code, status


#: Codes of the public contract, with statuses.
READONLY = ("FILO_READONLY", 403)
BLOCKED = ("FILO_BLOCKED", 403)
TIMEOUT = ("FILO_QUERY_TIMEOUT", 503)
TOO_LARGE = ("FILO_RESULT_TOO_LARGE", 400)
SUSPENDED = ("FILO_SUSPENDED", 403)
#: First characters of a SQLSTATE and the code that a tenant gets.
BY_STATE = {"42": "SQLITE_ERROR", "22": "SQLITE_CONSTRAINT_CHECK", "23": "SQLITE_CONSTRAINT", "54": "SQLITE_FULL", "40": "SQLITE_BUSY"}


def failure(code: tuple[str, int], message: str) -> TenantError:
    return TenantError(*code, message)


def mapped(error: Exception) -> TenantError:
    """A Spark error as the tenant sees it."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    state = getattr(error, "getSqlState", lambda: None)() or ""
    if "NOT_NULL" in condition or "NULL_COLUMN" in condition:
        return TenantError("SQLITE_CONSTRAINT_NOTNULL", 400, str(error))
    return TenantError(BY_STATE.get(state[:2], "SQLITE_ERROR"), 400, str(error))
