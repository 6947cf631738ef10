"""Times by their meaning, and functions inside texts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
SHIFTS = "Night Morning Afternoon Evening".split()
_NORTH = ["Winter", "Spring", "Summer", "Autumn"]


def season(month: str) -> tuple[str, str]:
    if month not in MONTHS:
        return "hurricane", "typhoon"
    k = (MONTHS.index(month) + 1) % 12 // 3
    return f"N_{_NORTH[k]}", f"S_{_NORTH[(k + 2) % 4]}"


def describe(t: datetime) -> tuple[str, str]:
    """The description and the compact key of a time."""
    quarter, hour, start = f"Qu{t.minute // 15 + 1}", f"Hr{t.hour:02d}", t.minute // 5 * 5
    month, day = MONTHS[t.month - 1], DAYS[t.weekday()]
    when = ", ".join([*season(month), SHIFTS[t.hour // 6], day, f"Day{t.day}", month, f"Yr{t.year}", hour, quarter])
    return when, f"{day[:3]}:{hour}:{quarter}-Min{start:02d}_{(start + 5) % 60:02d}"


def resolve(specs: list[str], now: datetime) -> datetime:
    """Day3, Yr2030, Min05_10, Hr14, a weekday or a month to a time; the first spec is the command and doesn't count.

    A weekday alone is its next day, today included. What isn't given is that of now; hour 0 counts as not given.
    """
    got: dict[str, int] = {}
    weekday = None
    for v in specs[1:]:
        if m := re.fullmatch(r"(Day|Yr|Hr|Min)(\d+)(?:_\d+)?", v):
            got[m[1]] = int(m[2])
        elif v in DAYS and weekday is None:
            weekday = DAYS.index(v)
        elif v in MONTHS and "month" not in got:
            got["month"] = MONTHS.index(v) + 1
    if weekday is not None and not ({"Day", "Yr", "month"} & got.keys()):
        return datetime(now.year, now.month, now.day) + timedelta(days=(weekday - now.weekday()) % 7)
    return datetime(got.get("Yr") or now.year, got.get("month") or now.month, got.get("Day") or now.day, got.get("Hr") or now.hour, got.get("Min", 0))


def duration(seconds: int) -> str:
    """Years of 365 days, days, hours and minutes; division is towards zero."""
    parts = []
    for unit, size in (("Years", 31_536_000), ("Days", 86_400), ("Hours", 3600), ("Minutes", 60)):
        n = int(seconds / size)
        seconds -= n * size
        if n > 0:
            parts.append(f"{n} {unit}")
    return ", ".join(parts) or "0 Minutes"


def built_in(words: list[str], now: datetime) -> str:
    if not words or words[0] not in ("TimeUntil", "TimeSince"):
        return ""
    seconds = round((resolve(words, now) - now).total_seconds())
    return duration(seconds if words[0] == "TimeUntil" else -seconds)


def expand(text: str, now: datetime | None = None) -> str:
    """Replaces {TimeUntil …} and {TimeSince …} and drops Dynamic: marks."""
    now = now or datetime.now()
    if "{" not in text or "}" not in text:
        return text
    return re.sub(r"\{([^}]*)\}?", lambda m: built_in(m[1].split(), now), text.removeprefix("Dynamic:"))
