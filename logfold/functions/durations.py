"""Durations of configuration files, as text like 1h30m or 250ms."""

from __future__ import annotations

import re
from decimal import Decimal

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def parse_duration(text: str, fallback: int = 0) -> int:
    """Nanoseconds; empty text gives the fallback. Malformed or negative text is an error."""
    if not text:
        return fallback
    if text == "0":
        return 0
    at, total = 0, Decimal(0)
    body = text.removeprefix("+")
    while at < len(body):
        m = _PART.match(body, at)
        if not m:
            raise ValueError(f"bad or negative duration {text!r}")
        total += Decimal(m[1]) * UNITS[m[2]]
        at = m.end()
    if not body:
        raise ValueError(f"bad duration {text!r}")
    return int(total)
