"""What a report is asked for: time bounds, the range to read, and options that exclude each other."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, time

from logscope.plans.thresholds import parse_threshold

# Ms of a unit, and the forms of a date without a zone.
UNITS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
DATES = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d")
TIMES = ("%H:%M:%S", "%H:%M")


def parse_bound(text: str, launched: datetime) -> int:
    """ms since the epoch of ``15m``, a date, or a time of the launch's day.

    Dates without a zone are in the zone of ``launched``.
    """
    text = text.strip()
    if m := re.fullmatch(r"([+-]?[0-9]+)([smhd])", text):
        return int(launched.timestamp() * 1000) - int(m[1]) * UNITS[m[2]]
    if re.fullmatch(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        return int(datetime.fromisoformat(text).timestamp() * 1000)
    for form in (*DATES, *TIMES):
        try:
            at = datetime.strptime(text, form)
        except ValueError:
            continue
        if form in TIMES:
            at = datetime.combine(launched.date(), time(at.hour, at.minute, at.second))
        return int(at.replace(tzinfo=launched.tzinfo).timestamp() * 1000)
    raise ValueError(f"can't tell a time from {text!r}: give an age such as 90s or 6h, a clock time such as 07:45, or a day such as 2025-11-30")


def read_from_start(follow: bool, lines: int | None, everything: bool, since: str | None) -> bool:
    """Whether sources are read from their start.

    ``lines`` asks for the last lines only; a report, or a lower bound, reads everything else.
    """
    if lines is not None:
        return False
    return everything or since is not None or not follow


def conflicts(thresholds: Sequence[str], follow: bool, nplus1: int) -> list[str]:
    """Why the options can't be met together."""
    found = []
    if thresholds and follow:
        found.append("thresholds are checked when the log has ended, and a followed log never does")
    if nplus1 == 0 and any(parse_threshold(t).metric == "nplus1" for t in thresholds):
        found.append("nplus1 is switched off by --nplus1 0, so it can have no threshold")
    return found
