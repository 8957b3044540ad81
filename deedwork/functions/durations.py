"""Durations as seconds: ``24h``, ``30m`` or ISO 8601."""

from __future__ import annotations

import re

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")


def seconds_of(text: str) -> int:
    """A year counts 365 days and a month 30, which is close enough for a retention window."""
    short = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text.lower())
    if short:
        return int(short[1]) * _UNITS[short[2]]
    iso = _ISO.fullmatch(text.strip().upper())
    if not iso or not any(iso.groups()):
        raise ValueError(f"{text!r} is not a duration")
    years, months, weeks, days, hours, minutes, seconds = (int(g or 0) for g in iso.groups())
    return (years * 365 + months * 30 + weeks * 7 + days) * 86400 + hours * 3600 + minutes * 60 + seconds
