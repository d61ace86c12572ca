"""Date math and date formats, worked out on the driver with a pinned ``now``."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from ..config import Refused

#: Unit letters of date math and of intervals, in seconds where they have a length.
SECONDS = {"s": 1, "m": 60, "h": 3600, "H": 3600, "d": 86400, "w": 7 * 86400}
CALENDAR = {"minute": "m", "1m": "m", "hour": "h", "1h": "h", "day": "d", "1d": "d", "week": "w", "1w": "w", "month": "M", "1M": "M", "quarter": "q", "1q": "q", "year": "y", "1y": "y"}
TRUNC = {"s": "second", "m": "minute", "h": "hour", "H": "hour", "d": "day", "w": "week", "M": "month", "q": "quarter", "y": "year"}

_STEP = re.compile(r"([+-])(\d*)([yMwdhHmsq])|/([yMwdhHmsq])")
_ISO = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$")


def zone(name: str | None):
    if not name or name in ("Z", "UTC"):
        return UTC
    if m := re.fullmatch(r"([+-])(\d{2}):?(\d{2})", name):
        from datetime import timezone

        return timezone((-1 if m[1] == "-" else 1) * timedelta(hours=int(m[2]), minutes=int(m[3])))
    return ZoneInfo(name)


def shift(at: datetime, unit: str, n: int) -> datetime:
    if unit in SECONDS:
        return at + timedelta(seconds=n * SECONDS[unit])
    months = at.year * 12 + at.month - 1 + n * {"M": 1, "q": 3, "y": 12}[unit]
    y, m = divmod(months, 12)
    return at.replace(year=y, month=m + 1, day=min(at.day, monthrange(y, m + 1)[1]))


def floor(at: datetime, unit: str) -> datetime:
    at = at.replace(microsecond=0)
    if unit == "s":
        return at
    at = at.replace(second=0)
    if unit == "m":
        return at
    at = at.replace(minute=0)
    if unit in "hH":
        return at
    at = at.replace(hour=0)
    if unit == "d":
        return at
    if unit == "w":
        return at - timedelta(days=at.weekday())
    at = at.replace(day=1)
    if unit == "q":
        return at.replace(month=(at.month - 1) // 3 * 3 + 1)
    return at if unit == "M" else at.replace(month=1)


#: Pattern letters of Java date formats and the regular expressions and fields they read.
_LETTERS = {"yyyy": (r"\d{4}", "y"), "uuuu": (r"\d{4}", "y"), "MM": (r"\d{2}", "M"), "M": (r"\d{1,2}", "M"), "dd": (r"\d{2}", "d"), "d": (r"\d{1,2}", "d"), "HH": (r"\d{2}", "h"), "H": (r"\d{1,2}", "h"), "mm": (r"\d{2}", "m"), "ss": (r"\d{2}", "s"), "SSS": (r"\d{3}", "f"), "MMM": (r"[A-Za-z]{3}", "b"), "Z": (r"[+-]\d{2}:?\d{2}|Z", "z"), "XXX": (r"[+-]\d{2}:\d{2}|Z", "z"), "XX": (r"[+-]\d{4}|Z", "z")}
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def by_format(text: str, pattern: str, tz) -> tuple[datetime, str] | None:
    """(moment, finest unit read) of a text in a Java date pattern, or None."""
    if pattern in ("strict_date_optional_time", "date_optional_time", "iso8601", "strict_date_optional_time_nanos"):
        return by_iso(text, tz)
    if pattern in ("epoch_millis", "epoch_second"):
        if not re.fullmatch(r"-?\d+", text):
            return None
        return datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=int(text) * (1000 if pattern == "epoch_second" else 1)), "f"
    names, regex = [], ""
    for m in re.finditer(r"'([^']*)'|([A-Za-z])\2*|(.)", pattern):
        if m[1] is not None:
            regex += re.escape(m[1])
        elif m[2]:
            if m[0] not in _LETTERS:
                raise Refused(f"date format letter {m[0]!r} isn't supported")
            r, name = _LETTERS[m[0]]
            names.append(name)
            regex += f"({r})"
        else:
            regex += re.escape(m[3])
    found = re.fullmatch(regex, text)
    if not found:
        return None
    v = dict(zip(names, found.groups()))
    month = _MONTHS.index(v["b"].title()) + 1 if "b" in v else int(v.get("M", 1))
    at = datetime(int(v.get("y", 1970)), month, int(v.get("d", 1)), int(v.get("h", 0)), int(v.get("m", 0)), int(v.get("s", 0)), int(v.get("f", 0)) * 1000, zone(v["z"]) if "z" in v else tz)
    return at, next((u for u in "fsmhdM" if u in v or u == "M" and "b" in v), "y")


def by_iso(text: str, tz) -> tuple[datetime, str] | None:
    m = _ISO.fullmatch(text.strip())
    if not m:
        return None
    y, mo, d, h, mi, s, f, z = m.groups()
    at = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(6, "0")[:6]), zone(z) if z else tz)
    return at, "f" if f else "s" if s else "m" if mi else "h" if h else "d" if d else "M" if mo else "y"


def moment(value, now: datetime, up: bool = False, tz_name: str | None = None, fmt: str | None = None) -> datetime:
    """A date expression as a moment in UTC; ``up`` takes the last millisecond of what the expression leaves open.

    ``value`` is epoch milliseconds, a date in ISO or ``fmt`` (alternatives joined by ||), or date math
    on ``now`` or on a date followed by ||.
    """
    tz = zone(tz_name)
    if isinstance(value, datetime):
        return value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=value * (1000 if fmt == "epoch_second" else 1))
    text = str(value).strip()
    if text.startswith("now"):
        at, unit, math = now.astimezone(tz), "f", text[3:]
    else:
        base, _, math = text.partition("||")
        found = next((r for f in (fmt.split("||") if fmt else ["iso8601"]) if (r := by_format(base, f, tz))), None)
        if not found and not fmt and re.fullmatch(r"-?\d{5,}", base):
            found = by_format(base, "epoch_millis", tz)
        if not found:
            raise Refused(f"unreadable date {value!r}")
        at, unit = found
    if math and not re.fullmatch(f"(?:{_STEP.pattern})*", math):
        raise Refused(f"unreadable date math {value!r}")
    at = at.astimezone(tz)
    for sign, n, u, to in _STEP.findall(math):
        if to:
            at = floor(at, to)
            if up:
                at = shift(at, to, 1) - timedelta(milliseconds=1)
        else:
            at = shift(at, u, (-1 if sign == "-" else 1) * int(n or 1))
    if up and not math and unit in "dMy" and not text.startswith("now"):
        at = shift(at, unit, 1) - timedelta(milliseconds=1)
    return at.astimezone(UTC)


def fixed_seconds(interval: str) -> float:
    """Seconds of a fixed interval such as 30s or 7h."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", str(interval))
    if not m or int(m[1]) < 1:
        raise Refused(f"unknown fixed interval {interval!r}")
    return int(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def offset_seconds(offset) -> float:
    if not offset:
        return 0
    m = re.fullmatch(r"([+-]?)(\d+)(ms|s|m|h|d)", str(offset))
    if not m:
        raise Refused(f"unknown offset {offset!r}")
    return (-1 if m[1] == "-" else 1) * fixed_seconds(m[2] + m[3]) if int(m[2]) else 0
