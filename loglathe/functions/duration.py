"""Durations such as ``1d12h`` or ``1s500ms``, in milliseconds."""

from __future__ import annotations

import re

from loglathe.errors import ProgramError

UNITS = {"y": 365 * 86_400_000, "w": 7 * 86_400_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}
_PART = re.compile(r"([0-9]+)(ms|[ywdhms])")
_LARGEST = (1 << 32) - 1


def scan_duration(text: str, at: int = 0) -> tuple[int, int]:
    """Milliseconds and where the duration ends. Units fall in size and come once each."""
    total, start, last = 0, at, None
    order = list(UNITS)
    while m := _PART.match(text, at):
        number, unit = int(m[1]), m[2]
        if number > _LARGEST:
            raise ProgramError("duration number is too large", text, at)
        if last is not None and order.index(unit) <= order.index(last):
            break
        total, last, at = total + number * UNITS[unit], unit, m.end()
    if last is None or total == 0:
        raise ProgramError("expected a duration above zero, such as 5m or 1h30m", text, start)
    return total, at


def parse_duration(value: str | int) -> int:
    """A whole text as a duration; integers are milliseconds already."""
    if isinstance(value, int):
        return value
    total, end = scan_duration(value)
    if end != len(value):
        raise ProgramError("unexpected text after the duration", value, end)
    return total
