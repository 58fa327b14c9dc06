"""Tenant names: one label under a zone, resolved closed."""

from __future__ import annotations

import re

LABEL = re.compile(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?")


class UnknownTenant(Exception):
    pass


def for_host(host: str | None, zone: str) -> str:
    """The tenant of ``<tenant>.<zone>``, with or without a port; anything else is refused."""
    name = (host or "").strip().lower()
    name = re.sub(r":\d+$", "", name).removesuffix(".")
    label = name.removesuffix("." + zone.lower())
    if label == name or not LABEL.fullmatch(label):
        raise UnknownTenant(host)
    return label
