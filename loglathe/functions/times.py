"""Timestamps in texts, as Unix milliseconds; naive times are UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglathe.errors import ProgramError

_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "b": "MMM", "B": "MMMM", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "%": "'%'"}
_FRACTION = "[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"

#: Formats that a cast to timestamps reads too, with what stands between day and clock.
_CAST = {"%Y-%m-%dT%H:%M:%S": "T", "%Y-%m-%d %H:%M:%S": " "}


def to_pattern(fmt: str) -> tuple[str, bool]:
    """A strftime format as Spark's pattern, and whether it carries an offset."""
    out, offset, i, quoted = "", False, 0, ""

    def literal() -> str:
        return "'" + quoted.replace("'", "''") + "'" if quoted else ""

    while i < len(fmt):
        c = fmt[i]
        if c != "%":
            quoted += c
            i += 1
            continue
        out, quoted = out + literal(), ""
        if fmt[i : i + 3] in ("%.f", "%.3", "%.6", "%.9"):
            out += _FRACTION
            i += 3 if fmt[i + 2] == "f" else 4
            continue
        d = fmt[i + 1 : i + 2]
        if d == "z":
            out, offset = out + "[XX][xxx]", True
        elif d in _DIRECTIVES:
            out += _DIRECTIVES[d]
        else:
            raise ProgramError(f"time format directive %{d} is not supported")
        i += 2
    return out + literal(), offset


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def by_format(text: Column, fmt: str) -> Column:
    """Milliseconds of texts in a strftime format, else NULL."""
    pattern, offset = to_pattern(fmt)
    if offset:
        return _millis(F.try_to_timestamp(text, F.lit(pattern)))
    slow = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " xx"))
    between = _CAST.get(fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S"))
    if between is None:
        return _millis(slow)
    # A cast reads this shape alike, several times faster; the year 0 it would take too.
    fits = text.rlike(rf"\A(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{between}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\z")
    return _millis(F.when(fits, F.concat(text, F.lit("Z")).try_cast("timestamp")).otherwise(slow))


def detect(text: Column) -> Column:
    """Milliseconds of the first spelling that fits; an unknown one is NULL."""
    n = r"[0-9]"
    day = rf"{n}{{4}}-{n}{{2}}-{n}{{2}}"
    clock = rf"{n}{{2}}:{n}{{2}}:{n}{{2}}(\.{n}{{1,9}})?"
    zoned = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+([+-])", "$1"), r"([+-]\d\d)(\d\d)$", "$1:$2")
    iso = F.when(text.rlike(rf"\A{day}[Tt ]{clock}(Z|z|\s?[+-]{n}{{2}}:?{n}{{2}})\z"), _millis(F.upper(zoned).try_cast("timestamp")))
    naive = F.when(text.rlike(rf"\A{day}[T ]{clock}\z"), _millis(F.concat(text, F.lit("Z")).try_cast("timestamp")))
    rfc2822 = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UT|UTC|Z)$", " +0000")
    mail = F.when(text.rlike(r"\A([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d(:\d\d)? \S+\z"), F.coalesce(_millis(F.try_to_timestamp(rfc2822, F.lit("d MMM yyyy HH:mm:ss xx"))), _millis(F.try_to_timestamp(rfc2822, F.lit("d MMM yyyy HH:mm xx")))))
    web = _millis(F.try_to_timestamp(F.when(text.rlike(r"\A\d\d/[A-Za-z]{3}/\d{4}:"), text), F.lit("dd/MMM/yyyy:HH:mm:ss xx")))
    seconds = F.when(text.rlike(rf"\A{n}{{10}}\z"), text.try_cast("long") * 1000)
    millis = F.when(text.rlike(rf"\A{n}{{13}}\z"), text.try_cast("long"))
    return F.coalesce(iso, naive, mail, web, seconds, millis)


def parse_time(value: str | int | datetime) -> int:
    """A bound of a query: milliseconds, a datetime, or any text that ``detect`` takes."""
    if isinstance(value, int):
        return value
    if isinstance(value, datetime):
        when = value
    else:
        text = value.strip()
        if re.fullmatch(r"\d{10}|\d{13}", text):
            return int(text) * (1000 if len(text) == 10 else 1)
        when = None
        for read in (datetime.fromisoformat, parsedate_to_datetime, lambda t: datetime.strptime(t, "%d/%b/%Y:%H:%M:%S %z")):
            try:
                when = read(text)
                break
            except (ValueError, TypeError):
                continue
        if when is None:
            raise ProgramError(f"not a timestamp: {value}")
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    gone = when - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (gone.days * 86_400 + gone.seconds) * 1000 + gone.microseconds // 1000


def check_range(since: int | None, until: int | None) -> None:
    if since is not None and until is not None and since > until:
        raise ProgramError("the time range ends before it begins")
