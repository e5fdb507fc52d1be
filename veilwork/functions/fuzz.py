"""Shifting dates, times of day and timestamps written as text. What can't be read stays as it is.

The arithmetic is on whole days and seconds of the day, so neither session time zones nor daylight saving touch it.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.stream import let

DATE = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z"
TIME = r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(\.[0-9]{1,9})?)?\z"
DATETIME = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})([ T])([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(\.[0-9]{1,9})?([+-][0-9]{2}:?[0-9]{2})?\z"
DAY = 86_400


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"))


_DATE, _TIME, _DATETIME = map(_python, (DATE, TIME, DATETIME))


def _fraction(digits: str | None) -> str:
    """Three, six or nine digits, or none if they are zero."""
    digits = (digits or ".")[1:].ljust(9, "0")
    if not digits.strip("0"):
        return ""
    return "." + (digits[:3] if not digits[3:].strip("0") else digits[:6] if not digits[6:].strip("0") else digits)


def _day(text: str) -> dt.date | None:
    try:
        y, m, d = map(int, text.split("-"))
        return dt.date(y, m, d)
    except ValueError:
        return None


def date_text(text: str, days: int) -> str:
    found = _DATE.match(text.strip())
    day = found and _day(found[0])
    try:
        return (day + dt.timedelta(days)).isoformat() if day else text
    except OverflowError:
        return text


def _clock(total: int) -> str:
    return f"{total // 3600:02}:{total // 60 % 60:02}"


def time_text(text: str, seconds: int) -> str:
    found = _TIME.match(text.strip())
    if not found:
        return text
    h, m, s = int(found[1]), int(found[2]), int(found[3] or 0)
    if h > 23 or m > 59 or s > 59:
        return text
    total, fraction = (h * 3600 + m * 60 + s + seconds) % DAY, _fraction(found[4])
    return _clock(total) + (f":{total % 60:02}{fraction}" if fraction or s or total % 60 else "")


def datetime_text(text: str, seconds: int) -> str:
    found = _DATETIME.match(text.strip())
    day = found and _day(found[1])
    if not day:
        return text
    h, m, s = (int(found[i]) for i in (3, 4, 5))
    offset = found[7] or ""
    if h > 23 or m > 59 or s > 59 or offset and (int(offset[1:3]) > 23 or int(offset[-2:]) > 59):
        return text
    carry, total = divmod(h * 3600 + m * 60 + s + seconds, DAY)
    try:
        day += dt.timedelta(carry)
    except OverflowError:
        return text
    offset = offset and f"{offset[:3]}:{offset[-2:]}"
    return f"{day.isoformat()}{found[2]}{_clock(total)}:{total % 60:02}{_fraction(found[6])}{offset}"


def _parts(c: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(c, pattern, i + 1) for i in range(n)]


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _clock_column(total: Column) -> Column:
    return F.concat(_two(F.floor(total / 3600)), F.lit(":"), _two(F.floor(total / 60) % 60))


def _fraction_column(c: Column) -> Column:
    digits = F.rpad(F.substring(c, 2, 9), 9, "0")
    short = F.when(digits.endswith("000000"), F.substring(digits, 1, 3)).when(digits.endswith("000"), F.substring(digits, 1, 6)).otherwise(digits)
    return F.when(digits == "000000000", "").otherwise(F.concat(F.lit("."), short))


def date_column(c: Column, days: Column) -> Column:
    def shifted(t: Column) -> Column:
        day = F.when(t.rlike(DATE), t.try_cast("date"))
        moved = F.date_add(day, days.cast("int"))
        return F.coalesce(F.when(F.year(moved).between(1, 9999), moved.cast("string")), c)

    return let(F.trim(c), shifted)


def time_column(c: Column, seconds: Column) -> Column:
    def shifted(t: Column) -> Column:
        h, m, s, fraction = _parts(t, TIME, 4)
        h, m, s = (F.coalesce(x.try_cast("int"), F.lit(0)) for x in (h, m, s))
        valid = t.rlike(TIME) & (h < 24) & (m < 60) & (s < 60)

        def shown(total: Column) -> Column:
            f = _fraction_column(fraction)
            tail = F.concat(F.lit(":"), _two(total % 60), f)
            return F.concat(_clock_column(total), F.when((f != "") | (s > 0) | (total % 60 > 0), tail).otherwise(""))

        return F.when(valid, let(F.pmod(h * 3600 + m * 60 + s + seconds, F.lit(DAY)), shown)).otherwise(c)

    return let(F.trim(c), shifted)


def datetime_column(c: Column, seconds: Column) -> Column:
    mark = "\x01"

    def shifted(t: Column) -> Column:
        # one search for all parts; a text that has none goes through it as it is, and is told by the pattern
        parts = F.split(F.regexp_replace(t, DATETIME, mark.join(f"${i + 1}" for i in range(7))), mark, -1)
        return F.when(t.rlike(DATETIME), let(parts, moved_by)).otherwise(c)

    def moved_by(parts: Column) -> Column:
        day, between, h, m, s, fraction, offset = (F.get(parts, F.lit(i)) for i in range(7))
        h, m, s = (x.cast("int") for x in (h, m, s))
        zone = F.when(offset == "", "").otherwise(F.concat(F.substring(offset, 1, 3), F.lit(":"), F.substring(offset, -2, 2)))
        sane = (offset == "") | ((F.substring(offset, 2, 2).try_cast("int") < 24) & (F.substring(offset, -2, 2).try_cast("int") < 60))

        def dated(date: Column) -> Column:
            def shown(all_seconds: Column) -> Column:
                moved = F.date_add(date, F.floor(all_seconds / DAY).cast("int"))
                total = F.pmod(all_seconds, F.lit(DAY))
                text = F.concat(moved.cast("string"), between, _clock_column(total), F.lit(":"), _two(total % 60), _fraction_column(fraction), zone)
                return F.when(F.year(moved).between(1, 9999), text).otherwise(c)

            return F.when(date.isNotNull() & (h < 24) & (m < 60) & (s < 60) & sane, let(h * 3600 + m * 60 + s + seconds, shown)).otherwise(c)

        return let(day.try_cast("date"), dated)

    return let(F.trim(c), shifted)
