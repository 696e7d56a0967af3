"""Time policy: price windows by weekday and hour, the next cheap hour, feed dates and UTC days."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Names of weekdays, Monday first.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


_WINDOW = re.compile(r"(\d{1,2})(?::00)?\s*-\s*(\d{1,2})(?::00)?")


def windows(spec: str) -> list[tuple[int, int]]:
    """'01:00-04:00, 13-18' as half-open windows of whole hours; raises on anything else."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        found = _WINDOW.fullmatch(part)
        if not found or not 0 <= int(found[1]) < int(found[2]) <= 24:
            raise ValueError(f"not an hour window: {part!r}")
        out.append((int(found[1]), int(found[2])))
    return out


def weekdays(spec: str) -> set[int]:
    """'mon,tue,4' as numbers from Monday 0; figures count modulo 7."""
    out = set()
    for part in filter(None, (p.strip().lower() for p in spec.split(","))):
        if part.lstrip("-").isdigit():
            out.add(int(part) % 7)
        elif part[:3] in WEEKDAYS:
            out.add(WEEKDAYS.index(part[:3]))
        else:
            raise ValueError(f"not a weekday: {part!r}")
    return out


def is_peak(ts: Column, hours: list[tuple[int, int]], days: set[int], cheap_dates: tuple[str, ...] = ()) -> Column:
    """Whether a UTC timestamp lies in a dear hour of a dear weekday that is not a listed date."""
    hour = F.hour(ts)
    inside = F.lit(False)
    for low, high in hours:
        inside = inside | ((hour >= low) & (hour < high))
    day = F.weekday(ts).isin(*days) if days else F.lit(False)
    listed = F.date_format(ts, "yyyy-MM-dd").isin(*cheap_dates) if cheap_dates else F.lit(False)
    return inside & day & ~listed


def next_offpeak(ts: Column, hours: list[tuple[int, int]], days: set[int], cheap_dates: tuple[str, ...] = ()) -> Column:
    """First whole hour from the timestamp's own on that is not dear, null if there is none.

    Looked up: the week's 168 hours know how far their next cheap hour is, and a listed date may come before that.
    """
    dear = [h // 24 in days and any(low <= h % 24 < high for low, high in hours) for h in range(168)]
    ahead = [next((k for k in range(168) if not dear[(h + k) % 168]), None) for h in range(168)]
    start = F.date_trunc("hour", ts)
    steps = F.element_at(F.array(*(F.lit(k).cast("int") for k in ahead)), (F.weekday(ts) * 24 + F.hour(ts) + 1).cast("int"))
    found = start + F.make_dt_interval(F.lit(0), steps)
    for date in cheap_dates:
        midnight = F.to_timestamp(F.lit(f"{date} 00:00:00"))
        found = F.when(F.to_date(ts) == F.to_date(midnight), start).when(midnight > start, F.least(found, midnight)).otherwise(found)
    return found


def describe(hours: list[tuple[int, int]], days: set[int]) -> str:
    """The policy in words."""
    named = ", ".join(WEEKDAYS[d].capitalize() for d in sorted(days)) or "never"
    return f"peak = {', '.join(f'{low:02d}:00-{high:02d}:00' for low, high in hours)} UTC on {named} (all other hours off-peak)"


def status(ts: Column, hours: list[tuple[int, int]], days: set[int], cheap_dates: tuple[str, ...] = ()) -> Column:
    """One line that says whether a UTC timestamp is dear and, if so, when that ends."""
    opens = next_offpeak(ts, hours, days, cheap_dates)
    wait = ((F.unix_timestamp(opens) - F.unix_timestamp(F.date_trunc("hour", ts))) / 3600).cast("bigint")
    minute = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    dear = F.format_string("PEAK now (%s UTC) — off-peak resumes %s UTC (in %dh)", minute(ts), minute(opens), wait)
    return F.when(is_peak(ts, hours, days, cheap_dates), dear).otherwise(F.format_string("off-peak now (%s UTC)", minute(ts)))


def feed_date(x: Column) -> Column:
    """RFC 822 date as a timestamp, null where it is none; the weekday's name is ignored, named UTC zones are +0000."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)\z", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
