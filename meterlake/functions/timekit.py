"""Instants, civil buckets and windows. Session time zone UTC; ``ts`` columns are ``timestamp``."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_month(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM")


def week_start(date: Column, start_day: int = 0) -> Column:
    """The date on which the week of ``date`` starts; days count from Monday, 0."""
    return F.date_sub(date, F.pmod(F.weekday(date) - start_day, F.lit(7)).cast("int"))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts)


def moment(ts: str, tie: str) -> Column:
    """A time and a non-negative number in one ordered decimal. Unlike a struct it has a fixed width, so ``max_by`` over it is aggregated by
    hash, without a sort of all rows."""
    whole = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(whole).cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(tie).cast("decimal(19,0)")


def floor_minutes(ts: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / (60 * minutes)) * (60 * minutes))


def round_minutes(ts: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / (60.0 * minutes) + 0.5) * (60 * minutes))


def month_window(now: dt.datetime, tz: str) -> tuple[dt.datetime, dt.datetime]:
    """The calendar month of ``now`` in a zone, as UTC instants; right across changes of the clock."""
    z = ZoneInfo(tz)
    local = now.astimezone(z)
    first = dt.datetime(local.year, local.month, 1, tzinfo=z)
    after = dt.datetime(local.year + local.month // 12, local.month % 12 + 1, 1, tzinfo=z)
    return first.astimezone(dt.UTC), after.astimezone(dt.UTC)


def week_window(now: dt.datetime, tz: str, start_day: int = 0) -> tuple[dt.datetime, dt.datetime]:
    z = ZoneInfo(tz)
    local = now.astimezone(z)
    day = local.date() - dt.timedelta(days=(local.weekday() - start_day) % 7)
    at = lambda d: dt.datetime(d.year, d.month, d.day, tzinfo=z).astimezone(dt.UTC)
    return at(day), at(day + dt.timedelta(days=7))


def parse_filter_range(low: str | None, high: str | None, tz: str) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Bounds of a filter as UTC instants, the upper one exclusive: a date begins in the zone, and as the upper bound lasts until the next
    day; a time with an offset of its own keeps it."""
    z = ZoneInfo(tz)

    def at(text: str, upper: bool) -> dt.datetime:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
            day = dt.date.fromisoformat(text) + dt.timedelta(days=int(upper))
            return dt.datetime(day.year, day.month, day.day, tzinfo=z).astimezone(dt.UTC)
        t = dt.datetime.fromisoformat(text)
        return (t if t.tzinfo else t.replace(tzinfo=z)).astimezone(dt.UTC)

    return low and at(low, False), high and at(high, True)


def parse_window(token: str, now: dt.datetime, tz: str = "UTC", week: tuple[dt.datetime, dt.datetime] | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Bounds of this-week, last-week, Nw-ago, this-month, last-month, Nm-ago, last-Nd, prev-Nd or A..B (dates, B included).

    Weeks are those of the subscription: ``week`` is the start of the present one and its next reset. The present one ends now, or at the reset if
    that has passed; earlier ones are seven days each, counted back from its start. Without ``week`` their tokens are an error. Months
    are whole calendar months of the zone, the present one too."""
    if m := re.fullmatch(r"this-week|last-week|(\d+)w-ago", token):
        if week is None:
            raise ValueError(f"no start of a subscription week is known, which {token!r} needs")
        if token == "this-week":
            return week[0], min(now, week[1])
        start = week[0] - dt.timedelta(weeks=1 if token == "last-week" else int(m[1]))
        return start, start + dt.timedelta(weeks=1)
    if m := re.fullmatch(r"this-month|last-month|(\d+)m-ago", token):
        back = {"this-month": 0, "last-month": 1}.get(token, int(m[1] or 0))
        local = now.astimezone(ZoneInfo(tz))
        n = local.year * 12 + local.month - 1 - back
        return month_window(dt.datetime(n // 12, n % 12 + 1, 15, tzinfo=ZoneInfo(tz)), tz)
    if m := re.fullmatch(r"(last|prev)-(\d+)d", token):
        days = dt.timedelta(days=int(m[2]))
        return (now - days, now) if m[1] == "last" else (now - 2 * days, now - days)
    if m := re.fullmatch(r"(\d{4}-\d\d-\d\d)\.\.(\d{4}-\d\d-\d\d)", token):
        z = ZoneInfo(tz)
        a, b = (dt.datetime.fromisoformat(x).replace(tzinfo=z) for x in m.groups())
        if b < a:
            raise ValueError(f"window ends before it starts: {token!r}")
        return a.astimezone(dt.UTC), (b + dt.timedelta(days=1)).astimezone(dt.UTC)
    raise ValueError(f"unknown window {token!r}")
